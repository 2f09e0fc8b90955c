"""The trie of conversation prefixes, finished shard by shard below a shared skeleton.

A conversation is the sequence of its turns' digests. Equal sequences are one class, and classes are ordered by sequence.
Splitters, drawn from a sample, cut the order into shards of about equal weight. A node whose members lie in several shards
is a prefix of a splitter: these nodes are the skeleton, which is broadcast. Each shard, sorted, finishes all its other
nodes by itself and adds up what it knows of the skeleton's nodes; these parts are then reduced.

Conversations of more than SEGMENT turns are cut into segments, each a sequence below the digest of all before it. Segments
of one level form a trie of their own, whose roots hang below the ends of the level above; so no row holds more than a
segment, and levels are worked on from the deepest to the first (there is one, unless conversations are that long).

Only digests and word counts of turns are shuffled. What a shard holds follows its weight, not its texts.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spherecube.operators.keys import number_within
from spherecube.runtime import materialise

from .common import WORD, bounded_batches

#: Turns of a segment, turns of a shard, shards, sampled classes of a shard, and turns that a splitter keeps.
SEGMENT, SHARD, MAX_SHARDS, DRAWN, SPLITTER = 32768, 20_000, 4096, 16, 16
#: Members of a class whose decimal ids are joined in one row on the way to its hash.
CHUNK = 65_536
#: Bytes of a turn's digest; the bytes before a sequence name the segments above it (zeros where there is none).
WIDTH = 16
TOP = "0" * (2 * WIDTH)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 0), digest (hexadecimal, of role and text) and words of each turn, ordered by turn, null first.

    Rows of one turn are ordered by role, the first 32 characters of the text, and the digest.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    numbered = number_within(rows, ["conv_id"], ["turn", "role", "head", "digest"], "k")
    return numbered.select("conv_id", (F.col("k") - 1).alias("k"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """All ids, and conv_id, pos, digest, words of the rebuilt conversations.

    The first h turns of conversation c are those of c - c % family (fewer, if it has fewer); its own follow from the h-th
    on. h is the unsigned crc32 of the decimal c, modulo `most`.
    """
    given = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.where("k = 0").select("conv_id", given.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("k") < most - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "digest", "words"))).alias("first"))
    lent = materialise(ids.where("h > 0").join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("first", F.array()), 1, F.col("h").cast("int")).alias("first")))
    shared = lent.select("conv_id", F.explode("first").alias("t")).select("conv_id", F.col("t.k").alias("pos"), "t.digest", "t.words")
    short = lent.where(F.size("first") < F.col("h")).select("conv_id", (F.col("h") - F.size("first")).alias("less"))
    own = turns.where(F.col("k") >= given).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("k") - F.coalesce("less", F.lit(0))).alias("pos"), "digest", "words")
    return ids.select("conv_id"), shared.unionByName(own)


def segments_of(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, level, chain, following, path, words, n: the segments of each conversation, the empty last one too.

    path: digests in a row; chain: names all segments before; following: with this one, where the segment is full.
    """
    per = F.lit(SEGMENT)
    rows = turns.select("conv_id", F.floor(F.col("pos") / per).alias("level"), F.struct("pos", "digest", "words").alias("t"))
    marks = ids.select("conv_id", F.lit(0).cast("long").alias("level")).union(
        turns.where((F.col("pos") + 1) % per == 0).select("conv_id", F.floor((F.col("pos") + 1) / per))
    )
    rows = rows.unionByName(marks, allowMissingColumns=True)
    packed = rows.groupBy("conv_id", "level").agg(F.array_sort(F.collect_list("t")).alias("t"))  # a mark has no turn
    packed = packed.select("conv_id", "level", F.array_join(F.col("t.digest"), "").alias("path"), F.col("t.words").alias("words"), F.size("t").alias("n"))
    full = packed.where(F.col("n") == per).select("conv_id", "level", F.md5(F.col("path").cast("binary")).alias("m"))
    so_far = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    names = full.select("conv_id", "level", F.md5(F.array_join(F.collect_list("m").over(so_far), "").cast("binary")).alias("name"))
    before = names.select("conv_id", (F.col("level") + 1).alias("level"), F.col("name").alias("chain"))
    out = packed.join(before, ["conv_id", "level"], "left").join(names.withColumnRenamed("name", "following"), ["conv_id", "level"], "left")
    return out.withColumn("chain", F.coalesce("chain", F.lit(TOP)))


def id_hashes(members: DataFrame) -> DataFrame:
    """cls, ends: SHA-256 of the decimal conv_ids of each class in ascending order, joined by commas.

    Range partitions join ids in chunks; one task passes a class's chunks through the hash, a row of text at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist()
            bounds = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            spans = [(x, min(x + CHUNK, b)) for a, b in zip(bounds, bounds[1:], strict=False) for x in range(a, b, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a, _ in spans], pa.string()), pa.array([ids[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())], names=["cls", "conv_id", "joined"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for cls, joined in zip(batch.column("cls").to_pylist(), batch.column("joined").to_pylist(), strict=True):
                if cls != name:
                    if state:
                        done.append((name, state.hexdigest()))
                    name, state = cls, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(joined.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["cls", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, state.hexdigest())], names=["cls", "ends"])

    ranged = members.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id")
    joined = bounded_batches(ranged).mapInArrow(chunks, "cls string, conv_id long, joined string")
    return joined.repartition("cls").sortWithinPartitions("cls", "conv_id").mapInArrow(hashes, "cls string, ends string")


def classes_of(segments: DataFrame) -> DataFrame:
    """One row for each different sequence of a level: p (its bytes), words, n_convs, conv_id (smallest), ends, following."""
    segments = segments.withColumn("cls", F.md5(F.concat("chain", "path").cast("binary")))
    equal = segments.groupBy("level", "cls").agg(
        F.any_value(F.unhex(F.concat("chain", "path"))).alias("p"), F.any_value("words").alias("words"), F.any_value("following").alias("following"),
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    equal = materialise(equal)
    ending = segments.where(F.col("n") < SEGMENT).select("cls", "conv_id")
    several = id_hashes(ending.join(equal.where("n_convs > 1").select("cls"), "cls", "left_semi"))
    alone = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    ends = F.when(F.col("following").isNotNull(), F.lit(None)).when(F.col("n_convs") == 1, alone).otherwise(F.col("ends"))
    return materialise(equal.join(several, "cls", "left").withColumn("ends", ends))


def splitters_of(classes: DataFrame) -> list[bytes]:
    """Ascending sequences, of at most SPLITTER turns, that cut the classes into shards of about SHARD turns."""
    weight = F.size("words") + 1
    total = classes.agg(F.sum(weight)).first()[0] or 0
    shards = min(MAX_SHARDS, -(-total // SHARD))
    if shards < 2:
        return []
    chance = F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) / float(1 << 40)
    drawn = classes.where(chance < weight * (DRAWN * shards / total))
    sample = sorted(r[0] for r in drawn.select(F.substring("p", 1, WIDTH * (SPLITTER + 1))).toLocalIterator())
    return sorted({bytes(sample[len(sample) * i // shards]) for i in range(1, shards)} if sample else [])


def skeleton_of(splitters: list[bytes]) -> dict[bytes, int]:
    """A number for each prefix of a splitter; the empty one, above all, is 0."""
    prefixes = {s[:n] for s in splitters for n in range(0, len(s) + 1, WIDTH)} | {b""}
    return {p: i for i, p in enumerate(sorted(prefixes))}


class Shard:
    """The nodes of a shard's classes, which come in ascending order."""

    def __init__(self, skeleton: dict[bytes, int]):
        self.skeleton = skeleton
        self.parent, self.depth, self.words, self.number, self.above, self.root = [], [], [], [], [], []
        self.n, self.low, self.children, self.leaves, self.saved, self.ends = [], [], [], [], [], []
        self.stack, self.last = [], None

    def add(self, p: bytes, words: list[int], n: int, low: int, ends: str | None, more: tuple[int, int, int]) -> None:
        depth, last = len(p) // WIDTH, self.last
        same = 0
        if last is not None:
            while same < min(depth, len(last) // WIDTH) and p[same * WIDTH : (same + 1) * WIDTH] == last[same * WIDTH : (same + 1) * WIDTH]:
                same += 1
        del self.stack[same + 1 :]
        for d in range(len(self.stack), depth + 1):
            number = self.skeleton.get(p[: d * WIDTH]) if d <= SPLITTER + 1 else None
            self.parent.append(self.stack[-1] if self.stack else -1)
            self.above.append([] if not self.stack or number is None else [*self.above[self.stack[-1]], self.number[self.stack[-1]]])
            self.root.append(p[:WIDTH].hex() if d == 1 else None)
            self.words.append(words[d - 2] if d > 1 else 0)
            for values, first in ((self.depth, d), (self.number, number), (self.n, 0), (self.low, low), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None)):
                values.append(first)
            self.stack.append(len(self.parent) - 1)
        at = self.stack[-1]
        self.n[at], self.low[at], self.ends[at] = n, min(low, self.low[at]), ends
        self.children[at], self.leaves[at], self.saved[at] = more
        self.last = p

    def finish(self) -> list[tuple]:
        """Rows of all nodes: those of the skeleton with what the shard knows of them."""
        for at in range(len(self.parent) - 1, -1, -1):
            if self.number[at] is None:
                self.leaves[at] += self.children[at] == 0
                self.saved[at] += (self.n[at] - 1) * self.words[at]
            up = self.parent[at]
            if up >= 0:
                self.n[up] += self.n[at]
                self.low[up] = min(self.low[up], self.low[at])
                self.leaves[up] += self.leaves[at]
                self.saved[up] += self.saved[at]
                self.children[up] += self.number[at] is None
        number = lambda at: self.number[at] if at >= 0 else None
        return [
            (self.number[at], number(up), self.above[at], self.root[at], self.depth[at], self.low[at],
             self.low[up] if up >= 0 and number(up) is None else None,
             self.n[at], self.children[at], self.leaves[at], self.saved[at], self.words[at], self.ends[at])
            for at, up in enumerate(self.parent)
        ]


NODE = "number int, up int, above array<int>, root string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def level_nodes(classes: DataFrame) -> DataFrame:
    """All nodes of the tries of one level: depth (1 for its roots, which have `root`), conv_id, parent_conv_id and the sums."""
    spark = classes.sparkSession
    splitters = splitters_of(classes)
    shared = spark.sparkContext.broadcast((splitters, skeleton_of(splitters)))  # at most MAX_SHARDS * (SPLITTER + 2) prefixes
    fields = [f.split(" ") for f in NODE.split(", ")]

    @arrow_udf("int")
    def shard_of(p: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value[0], x) for x in p.to_pylist()], pa.int32())

    def finish(table: pa.Table) -> pa.Table:
        shard = Shard(shared.value[1])
        columns = [table[c].to_pylist() for c in ("p", "words", "n_convs", "conv_id", "ends", "below_children", "below_leaves", "below_saved")]
        for i in sorted(range(table.num_rows), key=columns[0].__getitem__):
            p, words, n, low, ends, *more = (c[i] for c in columns)
            shard.add(p, words, n, low, ends, tuple(more))
        rows = shard.finish()
        return pa.table({name: pa.array([r[i] for r in rows], TYPES[kind]) for i, (name, kind) in enumerate(fields)})

    nodes = materialise(classes.withColumn("shard", shard_of("p")).groupBy("shard").applyInArrow(finish, NODE))
    parts = nodes.where("number is not null").groupBy("number").agg(
        F.max("up").alias("up"), F.max("above").alias("above"), F.max("root").alias("root"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"), F.max("ends").alias("ends"),
    )
    inner = parts.where("up is not null").groupBy(F.col("up").alias("number")).agg(F.count("*").alias("inner"))
    parts = parts.join(inner, "number", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    parts = materialise(parts)
    own = parts.select(
        F.explode(F.concat("above", F.array("number"))).alias("number"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    ).groupBy("number").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    named = parts.select(F.col("number").alias("up"), F.col("conv_id").alias("from_skeleton"))
    done = parts.join(own, "number").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("own")})
    done = done.join(named, "up", "left").withColumnRenamed("from_skeleton", "parent_conv_id")
    below = nodes.where("number is null and up is not null").drop("parent_conv_id").join(named, "up").withColumnRenamed("from_skeleton", "parent_conv_id")
    columns = ["root", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inside = nodes.where("number is null and up is null").select(columns)
    return inside.unionByName(below.select(columns)).unionByName(done.select(columns)).where("depth > 0")


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: each different sequence of a conversation's first d turns.

    conv_id: the node's smallest member; depth: d; parent_conv_id: its parent's conv_id, null for the root; n_convs:
    members, those whose conversation begins with the sequence; n_children; n_leaves: childless nodes in its subtree, itself
    included; saved_tokens: the sum over its subtree of (members - 1) times the words of the last turn's text;
    ends_sha256: of the decimal ids of members that end here, ascending, joined by commas.

    `conversations` has conv_id, turn, role, text; other columns are not looked at. Rows without a conv_id take no part; a
    null role or text is empty; null turns come first; rows of one turn, repeated rows too, are turns of their own, ordered
    as `turns_of` says. Conversations left without turns end at the root. An empty table has no nodes. Turns are told
    apart by 128-bit digests of role and text. See `rebuilt` for the turns that conversations get from others.
    """
    turns = materialise(turns_of(conversations))
    classes = classes_of(materialise(segments_of(*rebuilt(turns, family, most))))
    deepest = classes.agg(F.max("level")).first()[0]
    names = ["children", "leaves", "saved"]
    roots, levels = None, []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = classes.where(F.col("level") == level)
        if roots is None:
            here = here.withColumns({f"below_{c}": F.lit(0).cast("long") for c in names})
        else:  # a root without children is counted as a leaf above
            below = roots.select(
                F.col("root").alias("following"), F.col("n_children").alias("below_children"),
                (F.col("n_leaves") - (F.col("n_children") == 0).cast("long")).alias("below_leaves"), F.col("saved_tokens").alias("below_saved"), F.col("ends").alias("_ends"),
            )
            here = here.join(below, "following", "left").withColumn("ends", F.coalesce("_ends", "ends"))
            here = here.withColumns({f"below_{c}": F.coalesce(f"below_{c}", F.lit(0).cast("long")) for c in names})
        nodes = level_nodes(here)
        nodes = materialise(nodes.withColumn("depth", F.col("depth") - 1))
        roots = nodes.where("depth = 0")
        levels.append(nodes.where(F.lit(level == 0) | (F.col("depth") > 0)).withColumn("depth", F.col("depth") + level * SEGMENT))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    out = conversations.sparkSession.createDataFrame([], shape) if not levels else None
    for nodes in levels:
        parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
        some = nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", empty).alias("ends_sha256"))
        out = some if out is None else out.unionByName(some)
    return out


#: The same in SQL, for DuckDB, of production parameters.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
               xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                               lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT i.conv_id, 0 AS own, k, role, text FROM ids i JOIN t ON t.conv_id = i.base AND k < h
      UNION ALL SELECT i.conv_id, 1, k, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND k >= h),
p AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, k) FILTER (WHERE k IS NOT NULL), []) AS path
      FROM ids LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS d, path FROM p),
nodes AS (SELECT path[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends
          FROM m GROUP BY path[1:d], d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY node[1:d - 1]),
one AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children,
               CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
        FROM nodes LEFT JOIN kids USING (node)),
up AS (SELECT saved, n_children, node, unnest(range(0, d + 1)) AS a FROM one),
total AS (SELECT node[1:a] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY node[1:a])
SELECT one.conv_id, one.d AS depth, parent.conv_id AS parent_conv_id, one.n_convs, one.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(one.ends, '')) AS ends_sha256
FROM one JOIN total USING (node) LEFT JOIN nodes parent ON one.d > 0 AND parent.node = one.node[1:one.d - 1]
"""
