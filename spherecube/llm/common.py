"""What several operators share: Arrow passes over texts, words, a fixed-size filter of ids, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherecube.runtime import bound_arrow, materialise, remove_stage

#: Fixed value: white space that separates words, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Characters of text that an Arrow pass works on at a time, so that its memory does not follow the batch.
SLICE_CHARS = 2_000_000

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """`docs`, in whose session Arrow batches are bounded, as `tune` has them."""
    bound_arrow(docs.sparkSession)
    return docs


def lower_ascii(text):
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_fold(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves `remainder`; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of at most `SLICE_CHARS` bytes of text, or one row.

    After each batch, memory that is free by then goes back to the system.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start, total = [], 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > SLICE_CHARS:
                ends.append((start, i))
                start, total = i, 0
            total += size
        for a, b in [*ends, (start, batch.num_rows)]:
            yield batch.slice(a, b - a)
        give_back()


def text_slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The bytes of the texts of an Arrow array (null: empty) in lists of about `SLICE_CHARS` bytes at most, or one text."""
    for piece in in_slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        yield [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it where `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Returns memory that numpy and Arrow have freed to the system: a worker outlives its tasks and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL(None)
except OSError:  # a system without a common library of C
    _LIBC = None


_HELD: dict[str, object] = {}


def held_by_worker(name: str, make: Callable[[], object]) -> object:
    """What `make` returns, kept for a Python worker's later tasks until it is asked for something of another name.

    Workers outlive stages, so what one operator remembers must not add to the memory of the next one.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def bloom_positions(key, bits: int) -> list:
    """Three positions of a key in a filter of `bits` bits, as columns."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in range(3)]


def bloom_words(keys: DataFrame, key: str, bits: int) -> Column:
    """A Bloom filter of all keys as an array of 64-bit words, made by one aggregation: `bits` / 8 bytes in all.

    A scalar subquery, which every task of a plan that uses it gets once.
    """
    positions = keys.select(F.explode(F.array(*bloom_positions(F.col(key), bits))).alias("p"))
    words = positions.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row["w"]] = row["b"]
    return keys.sparkSession.createDataFrame(pa.table({"words": pa.array([out], pa.list_(pa.int64()))})).scalar()


def maybe_in(words: Column, key: Column, bits: int) -> Column:
    """Whether a key may be among those of a Bloom filter; never false for one that is."""
    found = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in bloom_positions(key, bits)]
    return found[0] & found[1] & found[2]


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """`df` of about `rows` short rows in as many partitions as such rows need: small tables are not written as many files."""
    return df.coalesce(8 + rows // 100_000)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (v, component) for every vertex of the undirected `edges` (a, b); component is the smallest vertex reached.

    Each round every vertex joins the neighbour (or itself) that a hash of the round puts first, and the graph is
    contracted; the hash breaks chains, so the number of rounds grows as the logarithm of the longest path. Rounds
    start from written tables: a lost executor costs a part of one round.
    """
    edges = materialise(edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b"))
    names, level = None, 0
    first = edges
    while size := edges.count():
        level += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        chosen = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        chosen = chosen.select(F.col("a").alias("v"), F.least(rank(F.col("a")), F.col("m"))["v"].alias("r"))
        joined = materialise(in_few(chosen, size))
        left, right = (joined.select(F.col("v").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
        lifted = edges.join(left, "a").join(right, "b").where("ra <> rb")
        shorter = materialise(in_few(lifted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), size))
        step = joined.select(F.col("v").alias("r"), F.col("r").alias("s"))
        if names is None:
            moved, known = joined, 2 * size
        else:
            moved = materialise(in_few(names.join(step, "r", "left").select("v", F.coalesce("s", "r").alias("r")), known))
        for stale in (None if edges is first else edges, names, joined if names is not None else None):
            if stale is not None:
                remove_stage(stale)
        edges, names = shorter, moved
    if names is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    lowest = names.groupBy("r").agg(F.min("v").alias("component"))
    return names.join(lowest, "r").select("v", "component")
