"""Hard negatives by one-bit codes of rotated vectors.

Rows are dealt into blocks of one label. Within a block, each vector's difference from the block's mean is rotated by a fixed
random rotation, and its signs are the code; stored beside it are the difference's length and its alignment with the code
(the inner product of the unit vectors). For an anchor, popcounts of code and bit planes of the rotated anchor estimate the
inner product with the code. What the code leaves of the vector and what it leaves of the anchor are both orthogonal to the
code, so by Cauchy and Schwarz their product is within the product of their lengths: this gives an interval that holds the
true score with certainty. Rows whose interval cannot matter are passed over; all others are scored in whole numbers.

Anchors meet blocks in two rounds: with those of their own label, for the positives, and, with the bands of scores that
these allow, with those of other labels. Each meeting returns a few rows per anchor, of which the best are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherecube.runtime import materialise

from .common import bounded_batches, held_by_worker
from .topk import matrix, products

#: Rows of a block, anchors of a pool, anchors that are compared with a block at a time, bits of a rotated anchor's numbers.
BLOCK, POOL, AT_ONCE, PLANES = 4096, 512, 32, 6
#: Positives of an anchor and negatives of a positive, and the band of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    make = lambda: np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))[0]
    return held_by_worker(f"rotation {width}", make)


class Codes:
    """One-bit codes of the differences of integer vectors from their mean, with lengths and alignments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, width = vectors, vectors.shape[1]
        points = vectors.astype(np.float64)
        self.centre = points.mean(axis=0) if len(points) else np.zeros(width)
        turned = (points - self.centre) @ rotation(width).T
        self.norms = np.sqrt((turned**2).sum(axis=1))
        signs = turned > 0
        self.bits = np.packbits(signs, axis=1)
        self.aligned = np.divide(np.abs(turned).sum(axis=1), np.sqrt(width) * self.norms, out=np.ones(len(points)), where=self.norms > 0).clip(max=1)

    def record(self) -> dict[str, object]:
        return {
            "width": self.vectors.shape[1], "vectors": self.vectors.astype("<i8").tobytes(), "bits": self.bits.tobytes(),
            "centre": self.centre.tolist(), "norms": self.norms.tolist(), "aligned": self.aligned.tolist(),
        }

    @classmethod
    def of(cls, record: dict) -> Codes:
        out, width = cls.__new__(cls), record["width"]
        out.vectors = np.frombuffer(record["vectors"], "<i8").reshape(-1, width)
        out.bits = np.frombuffer(record["bits"], np.uint8).reshape(len(out.vectors), -1)
        out.centre, out.norms, out.aligned = (np.array(record[c], dtype=np.float64) for c in ("centre", "norms", "aligned"))
        return out

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each row (first axis) can have with each anchor."""
        width = self.vectors.shape[1]
        points = anchors.astype(np.float64)
        turned = points @ rotation(width).T
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.where(high > low, (high - low) / (2**PLANES - 1), 1.0)
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * levels
        count = lambda bits: np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
        total = np.zeros((len(self.bits), len(anchors)))
        for plane in range(PLANES):
            chosen = np.packbits((levels >> plane) & 1, axis=1)
            total += count(_words(self.bits)[:, None, :] & _words(chosen)[None, :, :]) << plane
        dot = (2 * (low * count(self.bits)[:, None] + step * total) - rounded.sum(axis=1)) / np.sqrt(width)
        off = np.abs(turned - rounded).sum(axis=1) / np.sqrt(width)  # how far the rounded anchor's product can be off
        length = np.sqrt((points**2).sum(axis=1))
        left = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(dot) - off, 0) ** 2, 0))
        norms, aligned = self.norms[:, None], self.aligned[:, None]
        middle = points @ self.centre + norms * aligned * dot
        half = norms * (aligned * off + np.sqrt(np.maximum(1 - aligned**2, 0)) * left)
        half += 1e-7 * (length * (np.sqrt((self.centre**2).sum()) + norms)) + 1e-6
        return middle - half, middle + half

    def anchors(self, vectors: np.ndarray) -> np.ndarray:
        """Anchors in the block's width: a shorter vector is filled up with zeros, and what is beyond meets zeros."""
        width = self.vectors.shape[1]
        return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))

    def _leading(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, n: int) -> list[np.ndarray]:
        """Scores of the (at least) n wanted rows of each anchor whose estimates are highest."""
        middle = np.where(wanted, low + high, -np.inf)
        if len(middle) > n:
            wanted = wanted & (middle >= np.partition(middle, len(middle) - n, axis=0)[len(middle) - n])
        return [scores for _, scores in self._scored(anchors, wanted)]

    def best(self, anchors: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the k highest scores of each anchor, ties in row order; allowed[row, anchor].

        The k rows of highest estimates are scored first; whose interval stays below the least of them is passed over.
        """
        out = []
        low, high = self.intervals(anchors)
        floors = [s.min() if len(s) >= k else -np.inf for s in self._leading(anchors, low, high, allowed, k)]
        for rows, scores in self._scored(anchors, allowed & (high >= np.array(floors))):
            if len(rows) > k:
                top = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                rows, scores = rows[top], scores[top]
            order = np.argsort(-scores, kind="stable")[:k]
            out.append((rows[order], scores[order]))
        return out

    def bands(self, anchors: np.ndarray, bands: list[list[tuple[int, int]]], k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Rows and scores of the k highest scores within each band (least, greatest) of each anchor, ties in row order.

        The rows of highest estimates are scored first; where k of them are within each band, the k-th bounds all others.
        """
        out = []
        low, high = self.intervals(anchors)
        least = np.array([min((a for a, _ in b), default=0) for b in bands], dtype=np.float64)
        greatest = np.array([max((b for _, b in x), default=-1) for x in bands], dtype=np.float64)
        wanted = (high >= least) & (low <= greatest) & (least <= greatest)
        floors = np.full(len(anchors), -np.inf)
        for a, (scores, own) in enumerate(zip(self._leading(anchors, low, high, wanted, 4 * k), bands, strict=True)):
            within = [np.sort(scores[(scores >= x) & (scores <= y)]) for x, y in own]
            if own and all(len(w) >= k for w in within):
                floors[a] = min(w[-k] for w in within)
        for (rows, scores), own in zip(self._scored(anchors, wanted & (high >= floors)), bands, strict=True):
            order = np.argsort(-scores, kind="stable")
            rows, scores = rows[order], scores[order]
            found = []
            for x, y in own:
                start, end = np.searchsorted(-scores, [-y, -x + 1])
                found.append((rows[start : min(end, start + k)], scores[start : min(end, start + k)]))
            out.append(found)
        return out

    def _scored(self, anchors: np.ndarray, wanted: np.ndarray):
        """Row numbers and integer scores of the wanted rows of each anchor."""
        rows = np.flatnonzero(wanted.any(axis=1))
        scores = products(anchors, self.vectors[rows])
        for a in range(len(anchors)):
            chosen = wanted[rows, a]
            yield rows[chosen], scores[a, chosen]


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: every different row that takes part, with its label as it counts and floor(256 * x) of each x."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("e", lambda x: F.floor(x * 256)).alias("v")).distinct()


def _dealt(rows: DataFrame, most: int, by: list[str]) -> DataFrame:
    """`rows` with a number `part`, so that about `most` of those that agree in `by` have the same one."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    joined = rows.join(sizes, by) if by else rows.crossJoin(sizes)  # one row of one number
    return joined.withColumn("part", F.pmod("key", F.ceil(F.col("n") / most))).drop("n")


def _stacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; empty vectors count as zeros."""
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    return order, matrix(table["v"], 1)[order]


CODES = "width int, vectors binary, bits binary, centre array<double>, norms array<double>, aligned array<double>"


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row per block: label, part, its ids in ascending order, and its codes."""

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order, vectors = _stacked(table)
        record = {"label": key[0].as_py(), "part": key[1].as_py(), "ids": table["vec_id"].to_numpy()[order].tolist(), **Codes(vectors).record()}
        return pa.table({n: pa.array([x], pa.int32()) if n == "width" else pa.array([x]) for n, x in record.items()})

    return _dealt(rows, BLOCK, ["label"]).select("label", "part", "vec_id", "v").groupBy("label", "part").applyInArrow(
        index, f"label long, part long, ids array<long>, {CODES}"
    )


def _pooled(anchors: DataFrame, by: list[str]) -> DataFrame:
    """A row per pool of anchors: those of `by`, pool, and arrays of the other columns."""
    rest = [c for c in anchors.columns if c not in by]
    return _dealt(anchors, POOL, by).withColumnRenamed("part", "pool").groupBy(*by, "pool").agg(F.collect_list(F.struct(*rest)).alias("anchors"))


def _meetings(joined: DataFrame, meet, schema: str) -> DataFrame:
    """`meet`, a generator of rows, for each meeting of a block (its codes) with a pool of anchors."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for record in batch.to_pylist():
                codes, ids = Codes.of(record), np.array(record["ids"], dtype=np.int64)
                for i in range(0, len(record["anchors"]), AT_ONCE):
                    some = record["anchors"][i : i + AT_ONCE]
                    vectors = codes.anchors(matrix(pa.array([a["v"] for a in some], pa.list_(pa.int64())), 1))
                    parts = list(meet(codes, ids, record, some, vectors))
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=names)

    return bounded_batches(joined).mapInArrow(run, schema)


def positives_of(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """key, place (from 1), positive_id, positive_score: the k highest scores of each anchor with others of its label."""

    def meet(codes, ids, record, some, vectors):
        own = np.array([a["vec_id"] for a in some])
        for a, (rows, scores) in zip(some, codes.best(vectors, ids[:, None] != own, k), strict=True):
            yield np.full(len(rows), a["key"]), ids[rows], scores

    pools = materialise(_pooled(anchors, ["label"]))
    pairs = blocks.select("label", "part").join(pools.select("label", "pool"), "label")
    found = _meetings(pairs.join(pools, ["label", "pool"]).join(blocks, ["label", "part"]), meet, "key long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def negatives_of(asked: DataFrame, blocks: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """For each positive of the anchors `asked`, the k highest scores within its band among rows of other labels."""

    def meet(codes, ids, record, some, vectors):
        # 100 * score within low and high times the positive's, in whole numbers
        bands = [[(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in a["positives"]] if a["label"] != record["label"] else [] for a in some]
        for a, found in zip(some, codes.bands(vectors, bands, k), strict=True):
            for p, (rows, scores) in zip(a["positives"], found, strict=False):
                fixed = [np.full(len(rows), x) for x in (a["key"], a["vec_id"], p["place"], p["positive_id"], p["positive_score"])]
                yield (*fixed, ids[rows], scores)

    pools = materialise(_pooled(asked, []))
    many = pools.count()
    if not many:
        pools = pools.where("false")
    pairs = blocks.select("label", "part").withColumn("pool", F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1))).cast("array<long>")))
    names = "key long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meetings(pairs.join(pools, "pool").join(blocks, ["label", "part"]), meet, names)
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `vectors` (vec_id, embedding, label).

    An anchor's positives are the highest integer inner products with other rows of its label (ties: smaller vec_id); a
    positive's negatives are the highest ones with rows of other labels that lie within `low` and `high` percent of the
    positive's score. Where vec_id is divisible by 7 the label counts as (label + 1) % 10.

    Rows with a null in vec_id, label or vector, or a non-finite component, take no part. Vectors of different lengths are
    filled up with zeros; an empty one has score 0 with all. Rows that repeat another in all three columns count once;
    rows that share a vec_id but not the rest are rows of their own, though none is its namesake's positive. Anchors
    without positives, and positives without negatives, have no rows. An empty table gives an empty result. Scores must fit
    64 bits, else it is an error. Other columns are not looked at.
    """
    rows = materialise(usable(vectors).withColumn("key", F.xxhash64("vec_id", "label", "v")))
    blocks = materialise(blocks_of(rows))
    anchors = rows.where(is_anchor)
    near = positives_of(anchors, blocks, positives).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    found = negatives_of(anchors.join(near, "key"), blocks, negatives, low, high)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same in SQL, for DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)::DOUBLE[] AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, d.vec_id AS b, q.label = d.label AS same, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS positive_id, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
