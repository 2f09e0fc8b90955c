"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles is by document frequency, rare ones first. It is cut into fragments: the head of a document's
own sequence in that order, which by its size two linked sets must meet in, gives the candidates (prefix and positional
filters). Of each candidate pair the overlaps are counted fragment by fragment, in fragments of the hash order, and
summed, and the sum decides. Shingles of one document only come first and link nothing, and passages that many
documents share come last, so most documents show nothing at all.

No pairs are formed within a group of copies: equal sets are one class beforehand, and of the documents that show the same
shingle each is first compared with the smallest only. Links found so contract documents to components. Where many
pairs over different components are left, this is repeated with other documents in place of the smallest. The last comparison takes all remaining pairs that the filters leave
and whose components differ. So every link between documents of different components has been tried, which makes the
components exact, while links inside a component are not all listed. Rounds work on the components that new links join, not on all links
again, and end once a round no longer halves the pairs that are left.

Sets are compared by 64-bit hashes of shingles: two different shingles of one pair count as equal with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spherecube.runtime import materialise, remove_stage

from .common import bloom_words, bounded_batches, connected_components, give_back, in_few, in_slices, maybe_in
from .words import ODD, batch_words, mix, texts_of

#: Most bits of the filter that keeps documents without a candidate out of the second reading (4 MiB); from some 20 million
#: ids on it lets most others pass, which costs their reading and changes no result.
FILTER_BITS = 1 << 25
#: About how many shingles are counted together, and how many documents' sequences are made together.
BUCKET, GROUP = 500_000, 5000
#: A shingle is reported by a slice if one in OFTEN of its documents has it, and hot if all reports together are one in HOT
#: of all documents, LEAST_HOT at least.
OFTEN, HOT, LEAST_HOT = 64, 256, 5000
#: Pairs of different components by row, up to which all of them are looked at by size and place; and of those that may
#: still link, up to which all are compared. Beyond, documents are compared by stars once more.
WIDE, FEW = 1024, 1
#: Fragments of the order in which overlaps are counted: 2 to this power.
COUNT_BITS = 3


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = batch_words(texts)
    rolled = words.copy()
    for j in range(1, width):
        rolled[: len(words) - j] = mix(rolled[: len(words) - j] * ODD + np.uint64(j)) + words[j:] if len(words) > j else 0
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(mix(rolled[a : b - width + 1])))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                whole = mix(whole * ODD + w)
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(digest[0]), int(digest[1])


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (digest of the set), per document.

    The first row of a slice of the input also has `often`, the shingles of one in OFTEN of its documents, with `times`.
    """

    def run(batches):
        for batch in in_slices(batches):
            sets = shingle_sets(texts_of(batch), width)
            tokens, times = np.unique(np.concatenate(sets).view(np.int64), return_counts=True)
            often = times >= max(4, len(sets) / OFTEN)
            rest = [np.empty(0, np.int64)] * (len(sets) - 1)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 pa.array([tokens[often], *rest], pa.list_(pa.int64())), pa.array([times[often], *rest], pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "often", "times"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded_batches).mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, often array<long>, times array<long>"
    )


def _kept(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose ids are in `wanted`, of a few others, and of all where there are too many ids.

    A filter of 16 bits an id, FILTER_BITS at most, is tested before any text leaves the JVM.
    """
    key = F.col("doc_id").cast("long")
    rows = docs.where(F.col("doc_id").isNotNull()).select(key.alias("doc_id"), "text")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    return rows.where(maybe_in(bloom_words(wanted, "doc_id", bits), F.col("doc_id"), bits))


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """The shingles of so many documents that one task should not count them; at most 2 * HOT times the mean set size."""
    least = max(LEAST_HOT, sets.count() // HOT)
    pairs = sets.select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    found = pairs.groupBy(F.col("x.often").alias("token")).agg(F.sum("x.times").alias("k")).where(F.col("k") >= least)
    return np.sort(np.array([r["token"] for r in found.select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))


def names_of(bucket: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """Shingles of a bucket (the first `bits` bits) by the 48 bits after those, as even numbers; hot ones have odd numbers."""
    top = np.uint64(bucket) << np.uint64(64 - bits)
    return ((top | ((keys.astype(np.uint64) << np.uint64(16)) >> np.uint64(bits))) & ~np.uint64(1)).view(np.int64)


def shown_shingles(docs: DataFrame, reps: DataFrame, hot: np.ndarray, total: int, width: int, percent: int) -> DataFrame:
    """token, rep, n, pos: the shingles of more than one document in the head of each document's sequence.

    The shingles of `hot` come last in every sequence and are not counted; a document shows them where its others do not
    fill its head, so that no task meets all documents of a passage that very many share. On their way to the groups
    these rows go through the buckets too, each document's through that of its id's hash.

    Shingles are sent to buckets of their hash, there counted, and those of several documents go back to groups of
    documents. A bucket holds about BUCKET shingles and a group about GROUP documents, whatever their total. What
    differs in the last 16 bits of its hash only is one shingle here; it is not in the counts of overlaps.
    """
    bits = max(4, int(total / BUCKET).bit_length())
    rows = _kept(docs, reps.withColumnRenamed("rep", "doc_id"))
    groups = max(1, reps.count() // GROUP)
    late = docs.sparkSession.sparkContext.broadcast(hot)
    shows = lambda n: n - (percent * n + 99) // 100 + 1  # noqa: E731  how many first shingles are a document's head

    def deal(batches):
        for piece in in_slices(batches):
            sets = shingle_sets(texts_of(piece), width)
            sizes = np.array([len(x) for x in sets])
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            after, extra = np.zeros(len(sets), dtype=np.int64), [np.empty(0, dtype=np.int64)] * 4
            if len(late.value):
                place = np.searchsorted(late.value, tokens).clip(max=len(late.value) - 1)
                is_hot = late.value[place] == tokens
                after = np.bincount(owner[is_hot], minlength=len(sets))
                places, whose = place[is_hot], owner[is_hot]  # by document, in the order of `hot`
                rank = np.arange(len(whose)) - np.repeat(np.cumsum(after) - after, after)
                pos = sizes[whose] - after[whose] + rank
                show = pos < shows(sizes[whose])
                extra = [ids[whose[show]], sizes[whose[show]], -1 - pos[show], 2 * places[show] + 1]
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.int32)
            late_bucket = (mix(extra[0].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
            late_order = np.argsort(late_bucket, kind="stable")
            extra, late_bucket = [x[late_order] for x in extra], late_bucket[late_order]
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            keys = ((tokens << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            filled = np.union1d(bucket, late_bucket)
            bounds = [np.searchsorted(x, filled, side).tolist() for x in (bucket, late_bucket) for side in ("left", "right")]
            for to, a, b, c, d in zip(filled.tolist(), *bounds, strict=True):
                runs = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                held = owner[a:b][runs]
                yield row(to, ids[held], sizes[held], after[held], np.diff(np.append(runs, b - a)), keys[a:b].tobytes(), [x[c:d] for x in extra])

    def row(bucket, ids, sizes, after, counts, keys, extra):
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, sizes, after, counts)]
        more = [pa.array([x], pa.list_(pa.int64())) for x in extra]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *lists, pa.array([keys], pa.binary()), *more], names=names_dealt)

    def count(table: pa.Table) -> pa.Table:
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        counts = flat("counts")
        docs_, sizes, after = (np.repeat(flat(n), counts) for n in ("ids", "sizes", "after"))
        packed = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(packed), 8), dtype=np.uint8)
        keys[:, :6] = packed
        order = np.lexsort((docs_, keys.view("<u8").ravel()))
        keys, docs_, sizes, after = keys.view("<u8").ravel()[order], docs_[order], sizes[order], after[order]
        again = np.zeros(len(keys), dtype=bool)
        again[1:] = (keys[1:] == keys[:-1]) & (docs_[1:] == docs_[:-1]) & (sizes[1:] == sizes[:-1])
        keys, docs_, sizes, after = keys[~again], docs_[~again], sizes[~again], after[~again]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        frequency = np.diff(np.append(starts, len(keys)))
        df = np.repeat(frequency, frequency)
        several = df > 1
        names = names_of(table["bucket"][0].as_py(), keys[several], bits)
        # Hot shingles have their place already, which stands for the frequency as a negative number.
        late_docs, late_sizes, late_pos, late_names = (flat(n) for n in names_dealt[-4:])
        columns = [
            np.concatenate(x) for x in ((docs_[several], late_docs), (sizes[several], late_sizes), (after[several], 0 * late_docs), (df[several], late_pos), (names, late_names))
        ]
        group = (mix(columns[0].astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, columns = group[order], [c[order] for c in columns]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        parts = [[c for c in np.split(x, starts[1:])] if len(starts) else [] for x in columns]
        give_back()
        return pa.table({"g": pa.array(group[starts], pa.int64()), **{n: pa.array(x, pa.list_(pa.int64())) for n, x in zip(names_counted, parts, strict=True)}})

    def heads(table: pa.Table) -> pa.Table:
        columns = [table[n].combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names_counted]
        placed = columns[3] < 0
        late_docs, late_sizes, _, late_pos, late_names = (c[placed] for c in columns)
        docs_, sizes, after, df, names = (c[~placed] for c in columns)
        order = np.lexsort((names, df, sizes, docs_))
        docs_, sizes, after, names = docs_[order], sizes[order], after[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], (docs_[1:] != docs_[:-1]) | (sizes[1:] != sizes[:-1])])) if len(docs_) else np.empty(0, int)
        held = np.diff(np.append(starts, len(docs_)))
        pos = np.arange(len(docs_)) - np.repeat(starts, held) + sizes - after - np.repeat(held, held)
        shown = pos < shows(sizes)
        give_back()
        out = (names[shown], late_names), (docs_[shown], late_docs), (sizes[shown], late_sizes), (pos[shown], -1 - late_pos)
        return pa.table({n: np.concatenate(x) for n, x in zip(("token", "rep", "n", "pos"), out, strict=True)})

    names_counted = ["docs", "sizes", "after", "df", "names"]
    names_dealt = ["bucket", "ids", "sizes", "after", "counts", "keys", "late_docs", "late_sizes", "late_pos", "late_names"]
    lists = lambda names: ", ".join(f"{n} array<long>" for n in names)
    dealt = bounded_batches(rows).mapInArrow(deal, f"bucket int, {lists(names_dealt[1:5])}, keys binary, {lists(names_dealt[6:])}")
    counted = dealt.groupBy("bucket").applyInArrow(count, f"g long, {lists(names_counted)}")
    return counted.groupBy("g").applyInArrow(heads, "token long, rep long, n long, pos long")


def token_fragments(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id, s1, n, f, tokens: the fragments for counting of the documents whose ids are in `wanted`, and of few others."""

    def run(batches):
        for piece in in_slices(batches):
            ids, owners, sizes, at, parts = piece.column("doc_id").to_pylist(), [], [], [], []
            rows = []
            for doc, tokens in zip(ids, shingle_sets(texts_of(piece), width), strict=True):
                frag = (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                starts = np.flatnonzero(np.diff(frag, prepend=-1))
                s1 = _digest(tokens)[0]
                for f, part in zip(frag[starts].tolist(), np.split(tokens, starts[1:]) if len(starts) else [], strict=True):
                    rows.append(doc)
                    owners.append(s1)
                    sizes.append(len(tokens))
                    at.append(f)
                    parts.append(part)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()), pa.array(at, pa.int32()), _lists(parts)],
                    names=["doc_id", "s1", "n", "f", "tokens"],
                )

    return bounded_batches(_kept(docs, wanted)).mapInArrow(run, "doc_id long, s1 long, n long, f int, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlaps are counted per fragment and summed per pair.

    A row that is given twice has its fragments once, so that no overlap counts twice.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    parts = materialise(token_fragments(docs, wanted, width).dropDuplicates(["doc_id", "s1", "f"]))
    left, right = (
        parts.select(F.col("doc_id").alias(x), F.col("s1").alias(f"s{x}"), F.col("n").alias(f"n{x}"), "f", F.col("tokens").alias(f"t{x}"))
        for x in "ab"
    )
    fits = (percent * F.col("na") <= 100 * F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na"))
    counted = (
        pairs.join(left, "a").join(right, ["b", "f"]).where(fits)
        .select("a", "b", "sa", "sb", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
        .groupBy("a", "b", "sa", "sb", "na", "nb").agg(F.sum("part").alias("both"))
    )
    linked = materialise(in_few(counted.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct(), pairs.count()))
    remove_stage(parts)
    return linked


def star_of(rows: DataFrame, turn: int, may_link) -> DataFrame:
    """Pairs (a, b), a < b: one document of each token, that a hash of the turn puts first, with those of other components.

    The hash is of the document alone, so the tokens of a group mostly choose the same one.
    """
    first = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "pos", "c")).alias("first"))
    near = rows.join(first, "token").where("c <> first.c").where(may_link("n", "pos", "first.n", "first.pos"))
    return near.select(F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b"))


def size_band(n: str, percent: int) -> Column:
    """Sizes of linked sets are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / (log(100 / percent) + 1e-4))


def across(rows: DataFrame, may_link, percent: int) -> DataFrame:
    """All pairs (a, b), a < b, of documents of one token, of fitting sizes and of different components.

    Rows of a token's largest component `big` are on one side only. So no pair within it is formed, and those within the
    others are no more than the pairs between them and it. Rows meet by token and band of size.
    """
    banded = rows.withColumn("band", size_band("n", percent))
    left, right = (banded.select("token", "big", "band", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "pos", "c")]) for x in "ab")
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band")
    right = right.select("token", near, "rep_b", "n_b", "pos_b", "c_b")
    both = left.where("c_a <> big").join(right, ["token", "band"]).where("c_a <> c_b and (c_b = big or rep_a < rep_b)")
    both = both.where(may_link("n_a", "pos_a", "n_b", "pos_b"))
    return both.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def with_links(near: DataFrame, links: DataFrame) -> DataFrame:
    """The components `near` (v, component) after more links (a, b): only components that the links join are worked on."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    size = near.count() + 2 * links.count()
    known = near.unionByName(ends.join(near, "v", "left_anti").withColumn("component", F.col("v")))
    known = materialise(in_few(known, size))
    left, right = (known.select(F.col("v").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    lifted = links.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    joined = materialise(in_few(connected_components(lifted), size))
    renamed = joined.select(F.col("v").alias("component"), F.col("component").alias("to"))
    out = materialise(in_few(known.join(renamed, "component", "left").select("v", F.coalesce("to", "component").alias("component")), size))
    for stage in (known, joined, near):
        remove_stage(stage)
    return out


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles; a text
    with fewer words has its whole word sequence as one shingle; a text that is null or has no words has the empty set,
    is linked with nothing and is a component of its own. component_id is the smallest doc_id reachable by links.
    Repeated rows come back as often as they were given. Rows with the same doc_id are one document, whose links
    are those of each of its texts. A null doc_id takes part with nothing: its component_id is null. Other columns
    of `docs` are not looked at.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    sets = materialise(shingle_table(docs, width))
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n", "s1", "s2")
    copies = materialise(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"))
    members = materialise(full.join(copies, ["n", "s1", "s2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n"))
    reps = members.where("doc_id = rep").groupBy("rep").agg(F.sum("n").alias("n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    hot = frequent_shingles(sets)
    shown = materialise(shown_shingles(docs, reps.select("rep"), hot, total, width, percent))
    groups = shown.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("head"), F.max("rep").alias("last"), F.count("*").alias("k"))
    shared = materialise(shown.join(groups.where("head.rep < last").select("token", "head", "k"), "token"))

    def may_link(na, pa_, nb, pb):
        """From their places in both sequences on, two sets can still share as much as a link takes."""
        need = percent * (F.col(na) + F.col(nb))
        return ((100 + percent) * (F.col(na) - F.col(pa_)) >= need) & ((100 + percent) * (F.col(nb) - F.col(pb)) >= need)

    star = shared.where(F.col("rep") != F.col("head.rep")).where(may_link("n", "pos", "head.n", "head.pos"))
    tried = materialise(star.select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct())
    links = verified(tried, docs, width, percent)
    changed = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    more = members.join(changed, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    near = materialise(in_few(connected_components(links.union(more)), 2 * links.count()))
    remove_stage(links)

    several = materialise(shared.where("k > 2").select("token", "rep", "n", "pos"))
    for stage in (shown, shared):
        remove_stage(stage)
    left, turn, last = None, 0, False
    while not last:
        # Of each token, the rows of documents in two components or more, with the component that has most of them.
        named = several.join(near.select(F.col("v").alias("rep"), "component"), "rep", "left")
        named = materialise(named.select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("c")))
        counts = materialise(named.groupBy("token", size_band("n", percent).alias("band"), "c").agg(F.count("*").alias("k")))
        big = counts.groupBy("token", "c").agg(F.sum("k").alias("k")).groupBy("token").agg(
            F.max_by("c", F.struct("k", "c")).alias("big"), F.count("*").alias("parts")
        ).where("parts > 1").select("token", "big")
        rest = materialise(named.join(big, "token"))
        square = lambda c: F.sum(F.col(c).cast("double") ** 2)
        by_band = counts.groupBy("token", "band").agg(F.sum("k").alias("k"), square("k").alias("same"))
        open_ = by_band.agg(1.5 * (square("k") - F.sum("same"))).first()[0] or 0
        rows = rest.count()
        for stage in (several, named, counts):
            remove_stage(stage)
        several = rest
        if not rows:
            break
        stuck = left is not None and 2 * open_ > left  # the last round has not halved them
        found = None
        if stuck or open_ <= WIDE * rows:
            found = materialise(in_few(across(several, may_link, percent).distinct().join(tried, ["a", "b"], "left_anti"), rows))
            last = stuck or found.count() <= FEW * rows
        if not last:
            if found is not None:
                remove_stage(found)
            found = star_of(several, turn, may_link).distinct().join(tried, ["a", "b"], "left_anti")
            found = materialise(in_few(found, rows))
        if not found.isEmpty():
            links = verified(found, docs, width, percent)
            near = with_links(near, links)
            remove_stage(links)
        left, turn = open_, turn + 1
        if not last:
            wider = materialise(tried.union(found))
            for stage in (tried, found):
                remove_stage(stage)
            tried, found = wider, None
        several = several.select("token", "rep", "n", "pos")
    for stage in (tried, several):
        remove_stage(stage)
    classes = members.select("doc_id", "rep").distinct().join(near.withColumnRenamed("v", "rep"), "rep", "left")
    classes = classes.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles")).join(classes, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
