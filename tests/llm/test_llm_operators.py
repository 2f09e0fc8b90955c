"""The operators of spherecube.llm against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.llm import bpe, chat, common, langid, licenses, mixing, ngram_join, packing, quality, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice("the of and sky sea red tree stone walk deep far near light rain road".split()) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, near copies, a passage in many, a repeated row."""
    rng = random.Random(7)
    rows = [(None, "no id at all here now", "en", "a", 1), (1, None, "en", None, None), (2, "", None, "a", 0), (3, " \n\t ", "en", "b", 4)]
    rows += [(4, "Short text", "en", "a", 1), (5, "short TEXT", "en", "b", 1), (6, "short text", "fr", "b", 1)]
    base = prose(rng, 120).split()
    passage = prose(rng, 40)
    for k in range(7, 27):
        words = list(base)
        words[rng.randrange(120)] = f"changed{k}"
        rows.append((k, " ".join(words), "en", "hot", 1))
    rows += [(k, f"{prose(rng, 12)} {passage} {prose(rng, rng.randrange(3, 40))}", "en", "hot", 1) for k in range(27, 60)]
    rows += [(60, prose(rng, 30_000), "en", "hot", 1), (61, "x" * 200_000, "en", None, 1), (62, prose(rng, 30), "en", "a", 1), (62, prose(rng, 30), "en", "a", 1)]
    rows += [rows[10], rows[10]]
    clashing = "doc_id long, text string, lang string, source string, n_chars long, score double, n_shingles int, size int, sk int, ids int, words int"
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5) for r in rows], clashing).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def linked(rows, width, percent):
    """doc_id, set size and component of each row, by comparing all pairs."""
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((doc, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return sorted(((d, len(s), None if d is None else top(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(corpus, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = sorted_rows(ngram_join.jaccard_components(corpus, width, percent), "doc_id", "n_shingles", "component_id")
    assert got == linked(rows, width, percent)


def test_hot_shingles_lose_no_link(corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 5)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert sorted_rows(ngram_join.jaccard_components(corpus, 4, 85), "doc_id", "n_shingles", "component_id") == linked(rows, 4, 85)


def test_hot_shingles_are_spread(spark, monkeypatch):
    """Documents of nothing but hot shingles: none to count, and no bucket has all of the shown ones."""
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 5)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{j}" for j in sorted(rng.sample(range(24), 20)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, group_by = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *cols: ("late_docs" in self.columns and dealt.append(self)) or group_by(self, *cols))
    assert sorted_rows(ngram_join.jaccard_components(docs, 1, 85), "doc_id", "n_shingles", "component_id") == linked(rows, 1, 85)
    held = collections.Counter()
    for r in dealt[0].select("bucket", F.size("late_docs").alias("k")).collect():
        held[r["bucket"]] += r["k"]
    assert max(held.values()) < 0.5 * sum(held.values())


def test_repeated_rows_count_once(spark):
    """Two sets of 100 that share 80 are not linked, however often their rows come; 5 of the shared are the rarest."""
    given = []
    for base, repeats in ((0, (1, 1)), (100, (2, 1)), (200, (2, 3))):
        own = [[f"{x}{base}n{k}" for k in range(20)] for x in "ab"]
        shared = [f"s{base}n{k}" for k in range(80)]
        given += [(base + i, " ".join(shared + own[i])) for i in range(2) for _ in range(repeats[i])]
        given += [(base + 3 + k, " ".join([own[0][k], own[1][k], *shared[5:20], f"z{base}n{k}"])) for k in range(20)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted_rows(ngram_join.jaccard_components(docs, 1, 85), "doc_id", "n_shingles", "component_id") == linked(given, 1, 85)


def test_copies_that_miss_the_smallest_are_not_all_compared(spark, monkeypatch):
    """The smallest document shows the shingles of a hundred others that link with each other, and not with it."""
    base, rare = [f"a{k}" for k in range(51)], [f"b{k}" for k in range(9)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base, *rare, f"own{k}"])) for k in range(1, 101)]
    rows += [(200 + k, " ".join([*rare, *(f"x{k}n{j}" for j in range(30))])) for k in range(5)]  # the nine are the most frequent
    compared, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(ngram_join.jaccard_components(docs, 1, 85), "doc_id", "n_shingles", "component_id") == linked(rows, 1, 85)
    assert sum(compared) < 1000


@pytest.mark.parametrize("wide", [0, 1024])
def test_rounds_lose_no_link(corpus, monkeypatch, wide):
    monkeypatch.setattr(ngram_join, "FEW", 0)
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert sorted_rows(ngram_join.jaccard_components(corpus, 5, 80), "doc_id", "n_shingles", "component_id") == linked(rows, 5, 80)


def test_each_text_of_a_document_links(spark):
    texts = [" ".join(f"{x}{k}" for k in range(8)) for x in "abcd"]
    rows = [*enumerate(texts, 1), *((50, t) for t in texts[:3]), (51, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 50: 1, 4: 4, 51: 4}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["v"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_join_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_mixture_keeps_to_targets(corpus):
    rows = mixing.mixture(corpus).collect()
    assert len(rows) == corpus.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"]].append(r)
    for source_size, members in by.items():
        assert members[0]["target"] <= 3 * source_size
        largest = max(r["size"] for r in members)
        assert abs(sum(r["taken"] for r in members) - members[0]["target"]) <= largest
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixture(corpus.repartition(5)).collect()), key=repr)


def test_mixed_documents_are_the_copies_taken(corpus):
    taken = {(r["doc_id"], r["size"]): r["taken"] // r["size"] for r in mixing.mixture(corpus).collect() if r["size"]}
    got = mixing.mixed_documents(corpus)
    assert got.columns == corpus.columns
    copies = collections.Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in got.collect())
    times = collections.Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in corpus.collect())
    assert {k: v for k, v in copies.items() if k[1]} == {k: v * times[k] for k, v in taken.items() if v}


def test_mixture_of_nothing(empty, spark):
    assert mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)
    assert {(r["target"], r["taken"]) for r in mixing.mixture(blank).collect()} == {(0.0, 0)}


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "  a  b ", "a\n b", "\ta \n\n b\r\n", "don't we'll I'VE", "日本語 の 文 です", "naïve café über", "x" * 3000, "a " * 2000, "123 4567 8,9.0",
    "emoji 👩‍👩‍👧   nbsp em", "\x1c x \x85 y", "a​ b", "mixed  double   triple    spaces", "trailing ", " leading", "¿Qué? ñandú…", "<|endoftext|> stays text",
]


def test_encoding_is_the_rank_files(spark, corpus, reference_encoding):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(99, None)], "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    expected = []
    for doc, text in texts:
        ids = reference_encoding.encode_ordinary(text)
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted_rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_offsets_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in bpe.offsets(bpe.encoded(docs)).collect():
        assert len(r["spans"]) == len(r["ids"])
        assert [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])
        assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == set(range(len(r["text"])))


def test_decoding_of_split_characters(spark):
    whole = bpe.encoded(spark.createDataFrame([(1, "日本語 👩‍👧")], "doc_id long, text string")).first()["ids"]
    cuts = spark.createDataFrame([(k, whole[:k]) for k in range(len(whole) + 1)] + [(99, None)], "k int, ids array<int>")
    for r in bpe.decoded(cuts).select("k", "bytes", bpe.readable("bytes").alias("t")).collect():
        assert "日本語 👩‍👧".encode().startswith(bytes(r["bytes"]))
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("row", [16, 256])
def test_packing_loses_no_token(corpus, reference_encoding, row):
    rows = packing.packed(corpus, row).collect()
    found = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert len(ids) == row and r["resets"] == r["cu_seqlens"][:-1] and r["cu_seqlens"][-1] <= row
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["resets"], r["cu_seqlens"][1:], strict=True):
            found[doc].append((start, ids[a:b].tolist()))
    expected = collections.defaultdict(list)
    for r in corpus.collect():
        ids = reference_encoding.encode_ordinary(r["text"] or "")
        expected[r["doc_id"]] += [(k, ids[k : k + row]) for k in range(0, len(ids), row)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert len({r["pack_id"] for r in rows}) == len(rows)


def test_best_fit_takes_the_fullest_row():
    rng = random.Random(1)
    for _ in range(50):
        row = rng.randrange(1, 40)
        sizes = [rng.randrange(1, row + 1) for _ in range(rng.randrange(40))]
        free, expected = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fit = [f for f in free if f >= sizes[k]]
            space = min(fit) if fit else row
            if fit:
                free.remove(space)
            free.append(space - sizes[k])
            expected.append(space)
        rows = packing.best_fit_decreasing(sizes, row)
        assert sorted(itertools.chain(*rows)) == list(range(len(sizes)))
        assert sorted(row - sum(sizes[k] for k in r) for r in rows) == sorted(free)


def cost(roles, target):
    """Of giving the turns these target roles; None if that is not legal."""
    total, state = 0, 0
    for role, to in zip(roles, target, strict=True):
        total += chat.RELABEL * (role != chat.ROLES[to - 1])
        if to == state:
            total += chat.MERGE
        elif (state, to) in chat.INSERTIONS:
            total += chat.INSERT * len(chat.INSERTIONS[state, to])
        else:
            return None
        state = to
    return total + chat.end_cost(state)


def test_repairs_are_cheapest_and_legal(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 1)  # conversations over many blocks
    rng = random.Random(3)
    turns, convs = [], {}
    for conv in range(30):
        roles = [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 7))]
        convs[conv] = roles
        turns += [(conv, k, r, f"t{k}", "clash") for k, r in enumerate(roles)]
    got = collections.defaultdict(list)
    for r in chat.repaired(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, place string")).collect():
        got[r["conv_id"]].append(r)
    for conv, roles in convs.items():
        rows = sorted(got[conv], key=lambda r: r["place"])
        target = [chat.ROLES.index(r["new_role"]) + 1 for r in rows]
        costs = [c for t in itertools.product((1, 2, 3), repeat=len(roles)) if (c := cost(roles, t)) is not None]
        assert cost(roles, target) == min(costs)
        text = "".join(r["rendered"] for r in rows)
        shown = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert re.fullmatch(r"(system )?(user assistant )+", " ".join([*shown, ""]))
        assert text.count(chat.CLOSING) == len(shown) and text.endswith(chat.CLOSING)
        assert all(f"t{k}" in text for k in range(len(roles)))


def test_chat_of_nulls_repeats_and_nothing(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b")]
    got = chat.repaired(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and collections.Counter(r["conv_id"] for r in got) == {None: 1, 1: 3}
    assert chat.repaired(spark.createDataFrame([], schema)).count() == 0


def best(rows, k, is_query):
    vectors = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            vectors[i] = [int(np.floor(x * 256)) for x in e]
    out = []
    for q in filter(is_query, vectors):
        scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "SEEDS", 16)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [(i, rows[10][1]) for i in range(400, 460)]  # a hot vector
    rows += [(500, None), (None, rows[0][1]), (501, [None, 1.0]), (502, [float("nan")]), (503, [float("inf"), 1.0]), (505, []), (510, [1.0, 2.0]), (520, [1e6] * 12), rows[3]]
    table = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, score int, cell int")
    got = sorted_rows(topk.search(table, F.col("vec_id") % 5 == 0, 5), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == best(rows, 5, lambda i: i % 5 == 0)


def test_pools_and_blocks_of_clusters_seldom_meet(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("QUERIES", 32), ("SEEDS", 256), ("LEAF", 8), ("PIVOTS", 8), ("DEALT", 100)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(1600)]
    seen, real = {}, topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df: seen.setdefault(tuple(df.columns), real(df)) if "pool" in df.columns or "block" in df.columns else real(df))
    got = sorted_rows(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 5), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == best(rows, 5, lambda i: i % 5 == 0)
    blocks, pools = (seen[c].select(c[k]).distinct().count() for c, k in ((("block", "v", "ids"), 0), (("v", "q", "floor", "pool"), 3)))
    assert blocks >= 20 and pools >= 10 and seen[("block", "pool")].count() <= 0.3 * blocks * pools


def test_search_in_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    two = topk.search(spark.createDataFrame([(0, [1.0]), (5, [2.0])], schema), F.col("vec_id") % 5 == 0)
    assert sorted_rows(two, "query_id", "rank", "vec_id", "score") == [(0, 1, 5, 256 * 512), (5, 1, 0, 256 * 512)]


def test_names_of_shingles_keep_their_bits():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    for bits in (4, 15, 16, 21, 40):
        buckets = tokens >> np.uint64(64 - bits)
        keys = (tokens << np.uint64(bits)) >> np.uint64(16)
        names = np.concatenate([ngram_join.names_of(int(b), keys[i : i + 1], bits) for i, b in enumerate(buckets)])
        lost = max(1, 16 - bits)
        assert (names.view(np.uint64) == tokens >> np.uint64(lost) << np.uint64(lost)).all()


def test_join_with_many_buckets(spark, corpus, monkeypatch):
    rows = corpus.select("doc_id", "text").where("doc_id < 40")
    expected = linked([tuple(r) for r in rows.collect()], 4, 85)
    monkeypatch.setattr(ngram_join, "BUCKET", 0.05)
    assert sum(n for _, n, _ in expected) / 0.05 > 1 << 15
    assert sorted_rows(ngram_join.jaccard_components(rows), "doc_id", "n_shingles", "component_id") == expected


def test_unlinked_documents_on_one_shingle_are_not_all_verified(spark, monkeypatch):
    """Most of the documents that share a passage differ in size: few of the k * k pairs are tried."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, " ".join([passage] * (1 + k % 40))) for k in range(120)]  # repeats of the passage: shingles across its end only
    rows += [(200 + k, f"{passage} " + " ".join(f"s{j}" for j in range(k))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tried, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    assert sorted_rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == linked(rows, 4, 85)
    assert sum(tried) < 240 * 240 / 8


def test_forward_sums_all_segmentations():
    known = ["a", "b", "ab", "aba", langid.BEGIN, langid.BEGIN + "a", "c"]
    table = np.random.default_rng(0).random((len(known) + 1, 3))

    def ways(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            piece = known.index(text[:n]) if text[:n] in known else len(known) if n == 1 else None
            if piece is not None:
                yield from ([piece, *rest] for rest in ways(text[n:]))

    words = ["abab", "x", "abac", "bbbb", "aaaaaaaaaaaaaaaaaa"[:9]]
    expected = np.array([sum(np.prod(table[w], axis=0) for w in ways(langid.BEGIN + word)) for word in words])
    lattice = langid.Lattice(known)
    assert np.allclose(lattice.forward(words, table), np.log(expected))
    counts = np.zeros_like(table)
    for word, total in zip(words, expected, strict=True):
        for w in ways(langid.BEGIN + word):
            for p in w:
                counts[p] += np.prod(table[w], axis=0) / total
    assert np.allclose(lattice.expected(words, table, np.ones((len(words), 3))), counts)
    long = lattice.forward(["ab" * 400], table / 9)
    assert np.isfinite(long).all()


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(corpus, empty):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(corpus).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[60][0] == "en"
    assert langid.languages(corpus).count() == corpus.count()
    assert langid.languages(empty).count() == 0
    unknown = langid.languages(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_of_odd_texts(spark, corpus, empty):
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (7, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(corpus, labels).collect()
    assert len(rows) == corpus.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(corpus, labels.where("toxic = 0"))
    assert {r["score"] for r in none.collect()} == {0.0}


def test_toxicity_where_all_documents_are_labelled(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", F.lit(1).alias("toxic"))
    every = docs.select("doc_id").distinct().join(toxic, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    found = toxicity.toxicity(docs, every).join(toxic, "doc_id", "left").collect()
    caught, others = ([r["predicted"] for r in found if (r["toxic"] == 1) == t] for t in (True, False))
    assert sum(caught) >= 0.5 * len(caught) > 0 and sum(others) <= 0.1 * len(others)  # toxic ones are among those called clean


def risk(w, x, toxic, prior):
    """The risk that fit_nnpu lowers, written out: and whether the share of the unlabelled is negative."""
    rows = np.repeat(np.arange(len(toxic)), np.diff(x[1]))
    g = np.bincount(rows, w[x[0]], len(toxic)) + w[-1]
    p = 1 / (1 + np.exp(-g))
    as_toxic, as_clean = np.log1p(np.exp(-g)), np.log1p(np.exp(g))
    rest = as_clean[~toxic].mean() - prior * as_clean[toxic].mean()
    return prior * as_toxic[toxic].mean() + max(rest, 0), rest, p


@pytest.mark.parametrize("hard", [False, True])
def test_fit_lowers_the_non_negative_risk(hard):
    rng = np.random.default_rng(2)
    toxic = np.arange(60) < 20
    sets = [np.flatnonzero(rng.random(8) < (0.2 + 0.6 * (t & (np.arange(8) < 3)))) for t in toxic]
    if hard:  # each text has a word of its own: learning by heart would turn the rest of the risk negative
        sets = [np.append(s, 8 + k) for k, s in enumerate(sets)]
    width = 68 if hard else 8
    x = np.concatenate(sets).astype(np.int64), np.cumsum([0, *map(len, sets)])
    w = toxicity.fit_nnpu(x, toxic, width, 0.3)
    at, start = risk(w, x, toxic, 0.3), risk(np.zeros(width + 1), x, toxic, 0.3)
    assert at[0] < 0.8 * start[0] and at[1] > -0.1
    if not hard:  # no direction lowers the risk and the decay together any further
        full = lambda v: risk(v, x, toxic, 0.3)[0] + toxicity.DECAY * (v[:-1] ** 2).sum() / 2
        slopes = [(full(w + d) - full(w - d)) / 2e-4 for d in np.eye(width + 1) * 1e-4]
        assert at[1] < 0 or np.abs(slopes).max() < 0.02


def test_long_runs_of_letters_teach_and_are_scored(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abcdef") for _ in range(3000)), "left") for k in range(40)] + [(100 + k, "".join(rng.choice("ghijkl") for _ in range(3000)), "right") for k in range(40)]
    rows += [(900, "abc" * 200_000, None), (901, "jkl" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs).collect()}
    assert all(found[r[0]] == r[2] for r in rows if r[2]) and (found[900], found[901]) == ("left", "right")
    assert langid.words_of("a" * 600) == ["a" * 256, "a" * 256, "a" * 88]


def scanned(text):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = {
    "MIT License, mit-license! MIT\nlicense": "mit", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "under the GNU General Public License, version 3.": "gpl,gpl-3.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Mozilla Public License 2.0": "mpl-2.0", "the Mozilla Public License": "mpl", "nothing here": "", "die Mit Lizenz": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
}


def test_license_scan(spark, corpus, empty):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*LICENSED, None, "", "mit license " * 3000])], "doc_id long, text string")
    docs = docs.unionByName(corpus.select("doc_id", "text"))
    texts = collections.Counter((r["doc_id"], scanned(r["text"])) for r in docs.collect())
    rows = licenses.license_scan(docs).collect()
    assert collections.Counter((r["doc_id"], tuple(r)[1:6]) for r in rows) == texts
    found = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs.where(F.length("text") < 90)).collect() if r["labels"]}
    assert all(set(re.findall("[^,]+", r["base_labels"])) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    for k, (_, labels) in enumerate(LICENSED.items()):
        assert found.get(k, "") == labels
    assert len(licenses.signature_rules()) > 200
    assert licenses.license_scan(empty).count() == 0


def measured(text):
    text = text or ""
    words, lines, seen, dup, covered = WORD.findall(text), text.split("\n"), set(), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark, corpus, empty):
    rng = random.Random(2)
    loops = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 30, 300)] + ["a b c d e f g h\n" * 5, "# * $ %" * 20, "one\none\n\n \n one"]
    docs = spark.createDataFrame([(100 + k, t) for k, t in enumerate(loops)], "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    rows = quality.quality(docs).collect()
    expected = collections.Counter((r["doc_id"], measured(r["text"])) for r in docs.collect())
    assert collections.Counter((r["doc_id"], tuple(r)[1:7]) for r in rows) == expected
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.quality(empty).count() == 0


def test_quality_keeps_the_good(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad)
