"""Toxicity by non-negative positive-unlabelled learning.

The classifiers see confirmed toxic texts and all others as unlabelled texts; that one is confirmed clean is not used. Of the risk of calling an
unlabelled text toxic, the share that the toxic texts among them cause is taken off by the class prior; where this
estimate turns negative, which only a classifier that has learnt its texts by heart brings about, the step goes the
other way (the non-negative risk estimator).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spherecube.runtime import materialise

from .common import bounded_batches, in_slices, is_fold, text_slices
from .words import BYTES, LOWER, ODD, mix, texts_of, word_hashes

#: Bounds of the samples the classifiers are fitted on and of the features, and by how many standard errors a feature's
#: rates must differ between the two samples.
MAX_TOXIC, MAX_UNLABELLED, MAX_WORDS, LEAST_Z = 4000, 8000, 2048, 3.0
BAGS, STEPS, RATE, DECAY = 3, 300, 0.1, 2e-4

#: Beginnings of words that are features like the words, and how rare a feature may be to count as dense in a text.
PREFIXES, DENSE = (4, 5, 6, 7, 8), 100

#: Bytes between words: every ASCII character but letters, digits and the apostrophe.
APART = np.array([b < 128 and chr(b) not in "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for b in range(256)])


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their beginnings of PREFIXES bytes, the row of each, and the number of words by row."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, words = word_hashes(joined, APART)
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    rows = np.repeat(np.arange(len(texts)), sizes)
    found, owners = [words], [rows]
    low = LOWER[joined]
    stop = np.append(APART[low], True)
    for n in range(1, PREFIXES[-1] + 1):
        at = starts + n - 1
        inside = ~stop[at]
        starts, rows, words = starts[inside], rows[inside], (BYTES[low[at[inside]]] if n == 1 else mix(words[inside] * ODD + BYTES[low[at[inside]]]))
        if n in PREFIXES:
            found.append(words ^ np.uint64(n))
            owners.append(rows)
    return np.concatenate(found).view(np.int64), np.concatenate(owners), sizes


def counted(features: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different features by row: ~f stands for an f that makes up at least one of DENSE words of its text."""
    order = np.lexsort((features, rows))
    features, rows = features[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], (features[1:] != features[:-1]) | (rows[1:] != rows[:-1])])) if len(rows) else np.empty(0, int)
    counts = np.diff(np.append(starts, len(rows)))
    features, rows = features[starts], rows[starts]
    dense = counts * DENSE >= sizes[rows]
    return np.concatenate([features, ~features[dense]]), np.concatenate([rows, rows[dense]])


def word_sets(docs: DataFrame) -> DataFrame:
    """The different features `words` of a text in place of `text`; the other columns stay."""

    def run(batches):
        for batch in in_slices(batches):
            features, rows = counted(*word_features(texts_of(batch)))
            order = np.argsort(rows, kind="stable")
            sets = np.split(features[order], np.searchsorted(rows[order], np.arange(1, batch.num_rows)))
            columns = [pa.array(sets, pa.list_(pa.int64())) if n == "text" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=["words" if n == "text" else n for n in batch.schema.names])

    schema = ", ".join(f"`{n}` {'array<long>' if n == 'text' else t}" for n, t in docs.dtypes).replace("`text`", "words")
    return bounded_batches(docs).mapInArrow(run, schema)


def fit_nnpu(x: tuple[np.ndarray, np.ndarray], toxic: np.ndarray, width: int, prior: float) -> np.ndarray:
    """Weights and, last, the offset of a linear classifier; x: feature numbers and the row bounds among them."""
    features, bounds = x
    rows = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    positive, unlabelled = toxic / toxic.sum(), ~toxic / max(1, (~toxic).sum())
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        g = np.bincount(rows, w[features], len(toxic)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_clean = np.logaddexp(0, g)
        if as_clean @ unlabelled - prior * (as_clean @ positive) >= 0:
            slope = prior * positive * (p - 1) + p * (unlabelled - prior * positive)
        else:
            slope = -p * (unlabelled - prior * positive)
        grad = np.append(np.bincount(features, slope[rows], width), slope.sum()) + DECAY * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and a row of weights (offset last) per classifier.

    docs: doc_id, text of the training rows; known: doc_id, toxic of those that are labelled (others: null or absent).
    The samples are the rows of smallest hashed id: at most MAX_TOXIC toxic and MAX_UNLABELLED others. The others count as
    unlabelled, also those labelled clean, so a table in which every document has a label teaches, too. Without a
    toxic or another text there is no classifier: no words and no weights.
    """
    known = known.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = F.xxhash64("doc_id")
    toxic_ids = known.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).orderBy(order, "doc_id").limit(MAX_TOXIC)
    other = docs.select("doc_id").where("doc_id is not null").distinct().join(known.where("toxic = 1"), "doc_id", "left_anti")
    other = other.select("doc_id", F.lit(False).alias("toxic")).orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    ids = materialise(toxic_ids.union(other).coalesce(1))
    sample = materialise(word_sets(docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "toxic", "text")))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return np.empty(0, dtype=np.int64), np.empty((0, 1))
    prior = min(max(prior, 1e-3), 0.9)
    rates = sample.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        (F.sum(F.col("toxic").cast("double")) / sizes[True]).alias("t"), (F.sum((~F.col("toxic")).cast("double")) / sizes[False]).alias("u")
    )
    spread = F.sqrt((F.col("t") + 1 / sizes[True]) / sizes[True] + (F.col("u") + 1 / sizes[False]) / sizes[False])
    rates = rates.withColumn("z", F.abs(F.col("t") - F.col("u")) / spread).where(F.col("z") >= LEAST_Z)  # not by chance
    best = rates.orderBy(F.desc("z"), "w").select("w").limit(MAX_WORDS).collect()
    words = np.sort(np.array([r["w"] for r in best], dtype=np.int64))

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["toxic", "doc_id"])
        features, counts = [], []
        for found in rows["words"]:
            found = np.asarray(found, dtype=np.int64)
            at = np.searchsorted(words, found)
            at = at[at < len(words)] if not len(words) else at.clip(max=len(words) - 1)
            features.append(at[words[at] == found[: len(at)]])
            counts.append(len(features[-1]))
        x = np.concatenate(features).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
        return pd.DataFrame({"bag": [key[0]], "w": [fit_nnpu(x, rows["toxic"].to_numpy(bool), len(words), prior)]})

    # A classifier leaves out one part in BAGS of the sample; with few rows each sees all of them.
    few = min(sizes.values()) < 10 * BAGS
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BAGS))
    held = F.array_intersect("words", F.lit(words.tolist()).cast("array<long>"))  # at most MAX_WORDS of a text's features
    bags = sample.withColumn("words", held).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1)))).where(F.lit(few) | (part != F.col("bag")))
    fitted = bags.groupBy("bag").applyInPandas(train, "bag int, w array<double>").collect()
    return words, np.array([r["w"] for r in sorted(fitted, key=lambda r: r["bag"])])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """`docs` with a column `name`, the mean probability of the classifiers; without one 0. A null text counts as empty.

    A column of `docs` of that name is an error. Only texts go to Python, and only the score comes back.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column named {name}")
    words, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((words, weights, np.unique(np.concatenate([words, ~words]))))

    @arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        words, weights, bases = shared.value
        out = [np.empty(0)]
        for piece in text_slices(texts):
            features, rows, sizes = word_features(piece)
            total = np.zeros(len(piece))
            if len(words):
                at = np.searchsorted(bases, features).clip(max=len(bases) - 1)
                hit = bases[at] == features
                features, rows = counted(features[hit], rows[hit], sizes)
                at = np.searchsorted(words, features).clip(max=len(words) - 1)
                hit = words[at] == features
                for w in weights:
                    g = np.bincount(rows[hit], w[at[hit]], len(piece)) + w[-1]
                    total += 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            out.append(total / max(1, len(weights)))
        return pa.array(np.concatenate(out), pa.float64())

    # Not deterministic for Spark, so that a filter on the result does not run it a second time.
    return bounded_batches(docs).withColumn(name, scores.asNondeterministic()("text"))


def fit_held_out(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model of the rows that crc32 of the id does not hold out (remainder 0 of 5)."""
    train = ~is_fold(F.col("doc_id"), 5, 0)
    return fit(docs.select("doc_id", "text").where(train), labels.select("doc_id", "toxic").where(train))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text), with labels (doc_id, toxic).

    Null and empty texts get the score of a text without known words. Rows with a null id are scored and never learnt
    from; several labels of a document count as toxic if one is. Other columns are not looked at.
    """
    scored = score(docs.select("doc_id", "text"), fit_held_out(docs, labels))
    return scored.select(
        "doc_id", is_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
