"""Exact search of the largest inner products with two cover trees.

Equal vectors are one, with their smallest ids. The vectors are dealt into blocks by a tree of pivots that grows with them, and so
are the queries into pools; every block is indexed by a cover tree, and so are the queries that meet it. Pairs of nodes are visited together: a pair is pruned when
no inner product within its covering radii can reach the worst k-th score among its queries. The scores of a bounded
set of vectors give every query a first k-th score, so blocks and nodes are pruned from the start.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherecube.runtime import materialise

#: Vectors of a block and of a leaf, queries that meet a block together, pivots, and vectors for first k-th scores.
BLOCK, LEAF, QUERIES, PIVOTS, SEEDS = 4096, 64, 8192, 64, 1024
#: Splits of a cell at most, and vectors that meet a cell's pivots together.
DEPTH, DEALT = 8, 16_384
#: A child covers this share of its parent's radius.
SHRINK = 0.7


class CoverTree:
    """Nodes with a centre, a covering radius and the rows below them; children cover shrinking radii around centres that
    are further apart than the radius."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.rows, self.centre, self.radius, self.children = [], [], [], []
        if len(points):
            todo = [(np.arange(len(points)), 0, None)]
            while todo:
                rows, centre, parent = todo.pop()
                distance = np.sqrt(((points[rows] - points[centre]) ** 2).sum(axis=1))
                node = len(self.rows)
                self.rows.append(rows)
                self.centre.append(centre)
                self.radius.append(float(distance.max()))
                self.children.append([])
                if parent is not None:
                    self.children[parent].append(node)
                if len(rows) > leaf and self.radius[node] > 0:
                    todo += [(r, c, node) for r, c in self._cover(rows, centre, distance)]

    def _cover(self, rows: np.ndarray, centre: int, distance: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Rows by centre: the node's own one first, then always the row furthest from all centres, while it is too far."""
        reach, nearest, owner, centres = SHRINK * distance.max(), distance.copy(), np.zeros(len(rows), dtype=int), [centre]
        while nearest.max() > reach and len(centres) < max(2, len(rows) // self.leaf * 2):
            centres.append(int(rows[nearest.argmax()]))
            far = np.sqrt(((self.points[rows] - self.points[centres[-1]]) ** 2).sum(axis=1))
            owner[far < nearest] = len(centres) - 1
            nearest = np.minimum(nearest, far)
        return [(rows[owner == k], c) for k, c in enumerate(centres) if (owner == k).any()]


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer rows."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ d.T.astype(object)
    if max(map(abs, exact.ravel()), default=0) >= 2**63:
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k highest (score, smaller id first) of each query so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors = floors  # scores that k vectors are known to reach, or the lowest integer
        self.scores = np.full((len(floors), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(floors), k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> float:
        return float(np.maximum(self.scores[queries, -1], self.floors[queries]).min())

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        limit = np.maximum(self.scores[queries, -1], self.floors[queries])
        hit = np.flatnonzero((scores >= limit[:, None]).any(axis=1))
        if not len(hit):
            return
        k, at = self.scores.shape[1], queries[hit]
        scores = np.concatenate([self.scores[at], scores[hit]], axis=1)
        ids = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(hit), len(ids)))], axis=1)
        order = np.lexsort((ids, np.where(scores == np.iinfo(np.int64).min, np.inf, -scores.astype(np.float64))), axis=1)
        if np.abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) >= 2**53:  # floats would tie different scores
            order = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i: (-int(s[j]), i[j])) for s, i in zip(scores, ids, strict=True)])
        order = order[:, :k]
        self.scores[at] = np.take_along_axis(scores, order, axis=1)
        self.ids[at] = np.take_along_axis(ids, order, axis=1)


def dual_tree(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, owner: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """The k best of `ids` for each query; row owner[j] of `vectors` belongs to ids[j] (owner ascending)."""
    best = Best(floors, k)
    if not len(queries) or not len(vectors):
        return best
    qt, dt = CoverTree(queries.astype(np.float64)), CoverTree(vectors.astype(np.float64))
    q_norm = [float(np.linalg.norm(qt.points[c])) for c in qt.centre]
    d_norm = [float(np.linalg.norm(dt.points[c])) for c in dt.centre]

    def bound(a: int, b: int) -> float:
        centre = float(qt.points[qt.centre[a]] @ dt.points[dt.centre[b]])
        ra, rb = qt.radius[a], dt.radius[b]
        top = centre + ra * d_norm[b] + rb * q_norm[a] + ra * rb
        return top + 1e-9 * (abs(centre) + (q_norm[a] + ra) * (d_norm[b] + rb)) + 1e-6

    todo = [(-bound(0, 0), 0, 0)]
    while todo:
        top, a, b = heapq.heappop(todo)
        if -top < best.worst(qt.rows[a]):
            continue
        below_a, below_b = qt.children[a], dt.children[b]
        if not below_a and not below_b:
            rows = dt.rows[b]
            starts, ends = np.searchsorted(owner, rows), np.searchsorted(owner, rows, side="right")
            at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
            scores = products(queries[qt.rows[a]], vectors[rows])
            best.add(qt.rows[a], np.repeat(scores, ends - starts, axis=1), ids[at])
            continue
        if below_b and (not below_a or dt.radius[b] >= qt.radius[a]):
            pairs = [(a, x) for x in below_b]
        else:
            pairs = [(x, b) for x in below_a]
        for x, y in pairs:
            top = bound(x, y)
            if top >= best.worst(qt.rows[x]):
                heapq.heappush(todo, (-top, x, y))
    return best


def matrix(column, width: int = 0) -> np.ndarray:
    """Integer rows of a list column; shorter ones are filled up with zeros, which add nothing to a product."""
    rows = [np.asarray(r, dtype=np.int64) for r in column.to_pylist()]
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of every component, without vectors that are null or hold a null or non-finite one."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: the k smallest different ids of each different vector; the limit is applied before the shuffle, too."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def dealt(rows: DataFrame, most: int, columns: str, least: int = 2) -> DataFrame:
    """`rows` (v, key, cell, ...: `columns`) with cells of at most `most` vectors, found by a tree of pivots.

    A cell that is too large is split by the nearest of its own pivots, its vectors of smallest key: about twice as many as
    it needs, from `least` to PIVOTS. So cells get narrower as the table grows, and no pivots of the whole tree are ever
    in one place: each group of DEALT vectors of a cell meets that cell's pivots. A cell that stays too large after DEPTH
    splits is left as it is.
    """

    def nearest(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.drop_columns(["salt"])
        points, pivots = _aligned(matrix(left["v"]).astype(np.float64), matrix(pa.array(right["pivots"][0].as_py(), pa.list_(pa.int64()))).astype(np.float64))
        far = (pivots**2).sum(axis=1) - 2 * points @ pivots.T
        cell = pa.array([f"{key[0].as_py()}.{k}" for k in far.argmin(axis=1).tolist()], pa.string())
        out = left.drop_columns(["salt"])
        return out.set_column(out.schema.get_field_index("cell"), "cell", cell)

    names = rows.columns
    for _ in range(DEPTH):
        wide = materialise(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if wide.isEmpty():
            break
        ways = F.least(F.lit(PIVOTS), F.greatest(F.lit(least), 2 * F.ceil(F.col("n") / most)))
        place = F.row_number().over(Window.partitionBy("cell").orderBy("key", "v"))
        first = rows.withColumn("r", place).where(F.col("r") <= PIVOTS).join(wide, "cell").where(F.col("r") <= ways)
        pivots = materialise(first.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("pivots")))
        groups = wide.select("cell", F.ceil(F.col("n") / DEALT).alias("groups"))
        salted = rows.join(groups, "cell").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("groups"))).select(*names, "salt")
        sent = materialise(pivots.join(groups, "cell")).select("cell", F.col("pivots.v").alias("pivots"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
        split = salted.groupBy("cell", "salt").cogroup(sent.groupBy("cell", "salt")).applyInArrow(nearest, columns)
        rows = materialise(split.unionByName(rows.join(wide.select("cell"), "cell", "left_anti").select(*names)))
    return rows


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with the other rows.

    vectors: vec_id, embedding. Ties go to the smaller vec_id; where there are fewer than k other rows, all are
    returned. Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Of
    vectors of different length the shorter one counts as filled up with zeros; an empty one has score 0 with all. Rows
    that repeat a vec_id with the same vector count once; with different vectors they are rows of their own, of which a
    query gets at most the k + 1 best, its own id left out. Scores must fit 64 bits. Other columns are not looked at.
    """
    rows = materialise(usable(vectors))
    distinct = materialise(_smallest(rows, k + 1).withColumn("key", F.xxhash64("v")))
    asked = materialise(rows.where(is_query).distinct())
    questions = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("q")))
    sample = distinct.orderBy("key", F.element_at("ids", 1)).limit(SEEDS).collect()
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    seeds = matrix(pa.array([r["v"] for r in sample], pa.list_(pa.int64())))
    times = np.array([len(r["ids"]) for r in sample])
    pivots = seeds[:PIVOTS].astype(np.float64)

    def place(batches):
        """Nearest pivot of each vector."""
        for batch in batches:
            points, p = _aligned(matrix(batch.column("v")).astype(np.float64), pivots)
            far = (p**2).sum(axis=1) - 2 * points @ p.T
            cell = pa.array(list(map(str, far.argmin(axis=1).tolist())), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    def floors(batches):
        """The (k + 1)-th best score of each query among the seeds: one of them may be the query itself."""
        for batch in batches:
            q, s = _aligned(matrix(batch.column("v")), seeds)
            scores = np.sort(np.repeat(products(q, s), times, axis=1), axis=1)[:, ::-1]
            floor = scores[:, k] if scores.shape[1] > k else np.full(len(q), np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    placed = materialise(distinct.mapInArrow(place, "v array<long>, ids array<long>, key long, cell string"))
    placed = dealt(placed, BLOCK, "v array<long>, ids array<long>, key long, cell string")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    placed = placed.join(sizes, "cell").withColumn("block", F.struct("cell", F.pmod("key", F.ceil(F.col("n") / BLOCK)).alias("part")))
    blocks = materialise(placed.select("block", "v", "ids"))
    asked_with = "v array<long>, q long, floor long, key long, cell string"
    questions = questions.mapInArrow(floors, "v array<long>, q long, floor long").withColumns({"key": F.xxhash64("q"), "cell": F.lit("")})
    questions = dealt(materialise(questions), QUERIES, asked_with)
    # What no pivots could split is dealt by key.
    sizes = questions.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("n"))
    questions = questions.join(sizes, "cell").withColumn("pool", F.concat("cell", F.lit("/"), F.pmod("key", F.col("n")).cast("string")))
    questions = materialise(questions.select("v", "q", "floor", "pool"))

    def ball(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A block's mean and radius, or for queries also the lowest floor: what decides whether they meet at all."""
        points = matrix(table["v"]).astype(np.float64)
        centre = points.mean(axis=0)
        radius = np.sqrt(((points - centre) ** 2).sum(axis=1).max())
        out = {"centre": pa.array([centre.tolist()]), "radius": pa.array([float(radius)])}
        if "floor" in table.column_names:
            return pa.table({"pool": pa.array([key[0].as_py()], pa.string()), **out, "floor": pa.array([min(table["floor"].to_pylist())], pa.int64())})
        return pa.table({"block": pa.array([key[0].as_py()], table.schema.field("block").type), **out})

    at = "struct<cell: string, part: long>"
    data_balls = blocks.select("block", "v").groupBy("block").applyInArrow(ball, f"block {at}, centre array<double>, radius double")
    query_balls = questions.groupBy("pool").applyInArrow(ball, "pool string, centre array<double>, radius double, floor long")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    d, q = data_balls.alias("d"), query_balls.alias("q")
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    reach = dot(F.col("q.centre"), F.col("d.centre")) + (norm("q.centre") + F.col("q.radius")) * F.col("d.radius") + F.col("q.radius") * norm("d.centre")
    meeting = materialise(d.crossJoin(q).where(reach * (1 + F.signum(reach) * 1e-6) + 1 >= F.col("floor")).select("block", "pool"))  # headers only

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        points, asks = _aligned(matrix(left["v"]), matrix(right["v"]))
        ids = left["ids"].to_pylist()
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        best = dual_tree(asks, points, np.array([x for group in ids for x in group], dtype=np.int64), owner, right["floor"].to_numpy(), k + 1)
        got = best.ids != np.iinfo(np.int64).max
        names = np.repeat(right["q"].to_numpy(), got.sum(axis=1))
        return pa.table({"q": pa.array(names, pa.int64()), "vec_id": pa.array(best.ids[got]), "score": pa.array(best.scores[got])})

    left = blocks.join(meeting, "block").groupBy("block", "pool")
    right = questions.join(meeting, "pool").select("block", "pool", "v", "q", "floor").groupBy("block", "pool")
    found = left.cogroup(right).applyInArrow(meet, "q long, vec_id long, score long")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    names = asked.join(questions.select("v", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    others = names.join(top, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL, for DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e::DOUBLE[], d.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
