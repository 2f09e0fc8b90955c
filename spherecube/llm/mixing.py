"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order, up to three times over. A copy's virtual finish time is the tokens
its source has sent by then, divided by the source's target; all copies in the order of that time, cut at the total
budget, are the mix. DataFrame operations only.

The running sum within a source is taken in two steps, within and over hash buckets, and the cut is found in bins of
virtual time, then in finer bins of the one it falls into: no source and no order is handled by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherecube.runtime import materialise

from .common import WORD

#: How often a document may be taken at most, and the weights that sources get in turn.
PASSES = 3
WEIGHTS = 3
#: Bins of one unit of virtual time, and finer bins of each of these.
BINS, FINER = 256, 4096


def _key(source: str = "source") -> Column:
    """A source's name, never null."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def _place(doc_id: str = "doc_id") -> Column:
    """What the shuffled order of documents goes by."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sk, source_size, target per source of `sizes` (sk, source, size).

    Weights are 1, 2, 3 in turn in the order of the names, null last. A target is the share by weight of all sizes, but
    three times the source's size at most: with sources by that bound per weight, ascending, a source is at its bound if
    its share of what the ones before it leave is not smaller.
    """
    big = "decimal(38,0)"
    per = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * PASSES)
    ascending = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("from", F.sum("w").over(ascending.rowsBetween(0, Window.unboundedFollowing)))
    )
    bound = F.col("cap").cast(big) * F.col("from").cast("decimal(18,0)") <= (F.col("total") - F.col("before")).cast(big) * F.col("w").cast("decimal(9,0)")
    ranked = ranked.withColumn("bound", bound)
    ranked = ranked.withColumn("left", F.col("total") - F.sum(F.when(F.col("bound"), F.col("cap")).otherwise(0)).over(everything))
    ranked = ranked.withColumn("open", F.sum(F.when(F.col("bound"), 0).otherwise(F.col("w"))).over(everything))
    share = F.col("w").cast("double") * F.col("left").cast("double") / F.col("open").cast("double")
    return ranked.select("sk", "source_size", F.when(F.col("bound"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _finish(copy: int) -> Column:
    sent = (F.col("sent") + F.lit(copy) * F.col("source_size")).cast("double")
    return F.when(F.col("target") > 0, F.try_divide(sent, F.col("target"))).otherwise(F.lit(0.0))


def _bins(v: Column) -> tuple[Column, Column]:
    """The bin and the finer bin of a virtual time; all times from the thousandth unit on share the last one."""
    far = F.least(v, F.lit(1000.0))
    coarse = F.floor(far * BINS)
    return coarse, F.floor((far * BINS - coarse) * FINER)


def _crossing(sums: DataFrame, column: str, budget: int) -> tuple[int, int] | None:
    """The first bin whose running sum exceeds `budget`, and the sum before it; None if none does."""
    running = sums.withColumn("upto", F.sum("total").over(Window.orderBy(column)))
    row = running.where(F.col("upto") > budget).orderBy(column).select(column, (F.col("upto") - F.col("total")).alias("before")).first()
    return None if row is None else (row[column], int(row["before"]))


class Mix:
    """The mix of `docs` (doc_id, text, source).

    `placed`: sk, place, doc_id, size, sent (tokens the source has sent up to the document), source_size, target, per row.
    `limits`: sk, upto: by pass the last (place, doc_id, size) of the source that the mix takes, or null.
    """

    def __init__(self, docs: DataFrame):
        sizes = materialise(docs.select(_key().alias("sk"), "source", _place().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size")))
        targets = materialise(source_targets(sizes).coalesce(1))
        rows = sizes.drop("source").withColumn("bucket", F.substring("place", 1, 3))
        part = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("total"))
        earlier = part.select("sk", "bucket", F.coalesce(
            F.sum("total").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
        order = Window.partitionBy("sk", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
        within = rows.withColumn("within", F.sum("size").over(order))  # rows alike in all of these get the same sum
        self.placed = materialise(
            within.join(earlier, ["sk", "bucket"]).join(targets, "sk")
            .select("sk", "place", "doc_id", "size", (F.col("within") + F.col("earlier")).alias("sent"), "source_size", "target")
        )
        self.targets = targets
        self.limits = self._limits()

    def _limits(self) -> DataFrame:
        copies = self.placed.withColumn("copy", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), _finish(e).alias("v")) for e in range(PASSES)])))
        copies = copies.select("sk", "place", "doc_id", "size", F.col("copy.v").alias("v"), F.col("copy.e").alias("e"))
        coarse, fine = _bins(F.col("v"))
        copies = copies.select("*", coarse.alias("bin"), fine.alias("finer"))
        budget = self.placed.agg(F.sum("size")).first()[0] or 0
        found = _crossing(copies.groupBy("bin").agg(F.sum("size").alias("total")), "bin", budget)
        if found is None:
            taken = copies
        else:
            bin_, before = found
            inside = copies.where(F.col("bin") == bin_)
            finer, more = _crossing(inside.groupBy("finer").agg(F.sum("size").alias("total")), "finer", budget - before)
            rest = inside.where(F.col("finer") == finer)
            name = F.struct("v", "place", "doc_id", "size", "e")
            cut = rest.withColumn("upto", F.sum("size").over(Window.orderBy("v", "place", F.col("doc_id").asc_nulls_first(), "size", "e")))
            last = cut.where(F.col("upto") <= budget - before - more).agg(F.max(name).alias("last"))
            earlier = (F.col("bin") < bin_) | ((F.col("bin") == bin_) & (F.col("finer") < finer))
            here = (F.col("bin") == bin_) & (F.col("finer") == finer)
            taken = copies.crossJoin(last).where(earlier | (here & (name <= F.col("last"))))  # `last` is one row
        last_of = lambda e: F.max(F.when(F.col("e") == e, F.struct("place", "doc_id", "size"))).alias(f"upto{e}")
        return materialise(taken.groupBy("sk").agg(*[last_of(e) for e in range(PASSES)]).coalesce(1))

    @staticmethod
    def copies(place, doc_id, size) -> Column:
        """How often the mix takes a document, where `limits` is joined on: a pass of a source is a prefix of its order."""
        name = F.struct(place.alias("place"), doc_id.alias("doc_id"), size.alias("size"))
        return sum((F.when(name <= F.col(f"upto{e}"), 1).otherwise(0) for e in range(PASSES)), F.lit(0))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs` (doc_id, text, source).

    size counts words, 0 for a null text; documents of null source are a source of their own. taken is size times the
    number of copies in the mix, at most 3. Rows that repeat a doc_id are documents of their own, ordered by size;
    fully equal rows are taken together. A null doc_id is an id like others. Sources without words have target 0.
    """
    mix = Mix(docs)
    rows = mix.placed.join(mix.limits, "sk", "left")
    taken = F.col("size") * Mix.copies(F.col("place"), F.col("doc_id"), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    mix = Mix(docs)
    keyed = docs.select(F.struct("*").alias("row"), _key().alias("sk"), _place().alias("place"), F.col("doc_id").cast("long").alias("id"), _size().alias("size"))
    times = Mix.copies(F.col("place"), F.col("id"), F.col("size"))
    copies = keyed.join(mix.limits, "sk", "left").select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select("row.*")


#: The same in SQL, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
p AS (SELECT source, sum(size) AS s FROM d GROUP BY source),
r AS (SELECT source, s, 3 * s AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(s) OVER () AS total FROM p),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
f AS (SELECT *, cap * rest <= (total - before) * w AS bound FROM b),
t AS (SELECT source, s, CASE WHEN bound THEN cap::DOUBLE ELSE w::DOUBLE * (total - sum(CASE WHEN bound THEN cap ELSE 0 END) OVER ())::DOUBLE
             / (sum(CASE WHEN bound THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
q AS (SELECT d.*, t.s, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id NULLS FIRST, d.size) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, CASE WHEN target > 0 THEN (sent + e * s)::DOUBLE / target ELSE 0.0 END AS v FROM q, (VALUES (0), (1), (2)) AS k(e)),
o AS (SELECT *, sum(size) OVER (ORDER BY v, place, doc_id NULLS FIRST, size, e) <= sum(size) FILTER (e = 0) OVER () AS is_in FROM c)
SELECT doc_id, size, s::BIGINT AS source_size, target, (size * count(*) FILTER (is_in))::BIGINT AS taken
FROM o GROUP BY doc_id, source, size, s, target
"""
