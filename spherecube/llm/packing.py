"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents longer than a row are cut into full rows and a rest, losing no token. Rests, the longest first, each go into
the row whose free space they fill best; a segment tree over the possible free spaces finds it. Every task packs what it
reads, in portions of bounded size, so nothing is shuffled and a lost task packs the same rows again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, slices, worker_encoder
from .common import bounded_batches

#: Length of a row, and tokens that are packed together.
ROW, PORTION = 2048, 4_000_000


class FreeSpaces:
    """A segment tree over free spaces 0..most: how many open rows have each; finds the smallest one that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, space: int, by: int) -> None:
        node = self.leaves + space
        while node:
            self.counts[node] += by
            node >>= 1

    def smallest_from(self, space: int) -> int | None:
        """The smallest free space of an open row that is at least `space`."""
        node = self.leaves + space
        if self.counts[node]:
            return space
        while node > 1:
            if node % 2 == 0 and self.counts[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Which items go into each row. Equal items in the order given; of equally full rows the one filled last."""
    spaces, rows, by_space = FreeSpaces(row), [], {}
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        space = spaces.smallest_from(sizes[item])
        if space is None:
            space = row
            rows.append([])
            at = len(rows) - 1
        else:
            at = by_space[space].pop()
            spaces.add(space, -1)
        rows[at].append(item)
        left = space - sizes[item]
        by_space.setdefault(left, []).append(at)
        spaces.add(left, 1)
    return rows


def pack(documents: list[tuple[int | None, np.ndarray]], row: int, pad: int, dtype: str) -> list[dict]:
    """Packed rows of the documents (id, token ids)."""
    segments = [(doc, start, ids[start : start + row]) for doc, ids in documents for start in range(0, len(ids), row)]
    out = []
    for members in best_fit_decreasing([len(s[2]) for s in segments], row):
        parts = [segments[m] for m in members]
        bounds = np.cumsum([0, *(len(p[2]) for p in parts)])
        ids = np.full(row, pad, dtype=dtype)
        ids[: bounds[-1]] = np.concatenate([p[2] for p in parts])
        out.append({
            "ids": ids.tobytes(), "cu_seqlens": bounds.tolist(), "resets": bounds[:-1].tolist(),
            "doc_ids": [p[0] for p in parts], "doc_starts": [p[1] for p in parts],
        })
    return out


SCHEMA = pa.schema([
    ("pack_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
])


def packed(docs: DataFrame, row: int = ROW, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows of `row` token ids that hold the tokens of all `docs` (doc_id, text) once each.

    ids: little-endian, two bytes each (four for vocabularies over 65,535), filled up with the id after the last one.
    cu_seqlens: 0 and the end of each segment; resets: where positions start again from 0; doc_ids, doc_starts:
    the document of each segment and its first token's place there. pack_id is unique. Null and empty texts have no
    tokens and are in no row; repeated rows and null ids are packed like any other.
    """
    vocabulary = vocabulary or Vocabulary()
    pad = len(vocabulary.table)
    dtype = "<u2" if pad < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder, number, held, tokens = worker_encoder(shared), TaskContext.get().partitionId() << 33, [], 0

        def flush():
            nonlocal number, held, tokens
            rows = pack(held, row, pad, dtype)
            for i, r in enumerate(rows):
                r["pack_id"] = number + i
            number, held, tokens = number + len(rows), [], 0
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], schema=SCHEMA)

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                for doc, found in zip(ids[a:b], encoder.encode(texts.slice(a, b - a).cast(pa.binary()).to_pylist()), strict=True):
                    held.append((doc, found))
                    tokens += len(found)
                if tokens >= PORTION:
                    yield from flush()
        yield from flush()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded_batches(columns).mapInArrow(run, "pack_id long, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_starts array<long>")


def write_packed(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet: a matrix of ids by row, with the bounds of its segments."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
