"""Packing documents into windows online by the sum of squares of level counts.

A level array counts the open windows of each fill. A document goes, whole, into the window (or a new one) after which the
sum of squared counts of partially filled windows is least; a window filled to the row, or to a power of two, needs no
padding and counts nothing. So the fills in use stay many and even, and most documents find a window they complete.

A document longer than a row first gives full rows. Windows that stay partially filled are at most OPEN: beyond, a document
is cut to complete the fullest one. At a task's end what is left is cut together, so that no token is padding: full rows,
and powers of two of the last rest. Every task packs what it reads, in one pass, and holds no more than OPEN windows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_by_worker, in_slices
from .units import DIGIT, GAP, LETTER, ODD, PieceIds, byte_classes, expand, joined_calls, per_text, spread
from .words import LOWER

#: The vocabulary of the registered query, and the id that ends a document.
VOCABULARY, END = "word_bpe_49k.json", 1
#: Length of a row, and partially filled windows that a task keeps open at most.
ROW, OPEN = 2048, 512
#: Words of one call of the library.
CALL = 200


class WordEncoder:
    """Ids of a vocabulary that drops white space, splits letters, single digits and the rest, and takes lower case.

    A cut between white space is encoded alone; one of plain ASCII without apostrophes falls into its runs, letters in lower
    case. What else a cut holds (other alphabets, control characters, names of special tokens) is the library's.
    """

    def __init__(self, description: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(description)
        model = json.loads(description)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The same merges for words that need no normalising, without a memory of their own.
        self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix="</w>", cache_capacity=0))
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.last[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        self.classes = byte_classes(gaps=b" \t\n\r", odd=b"'<|>")
        self.pieces = PieceIds(self._learn)

    def _learn(self, spelt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of letters go in a row, in which each one's last id is the next that ends a word; others go one by one."""
        starts = np.cumsum(lengths) - lengths
        plain = np.add.reduceat(self.classes[spelt] == LETTER, starts, dtype=np.int64) == lengths
        counts = np.zeros(len(lengths), dtype=np.int64)
        calls = joined_calls(spelt[expand(starts[plain], lengths[plain])], lengths[plain], CALL)
        found = [np.array(e.ids, dtype="<i4") for e in self.bare.encode_batch_fast(calls, add_special_tokens=False)]
        words = np.concatenate(found) if found else np.empty(0, "<i4")
        counts[plain] = np.diff(np.flatnonzero(self.last[words]), prepend=-1)
        other = np.flatnonzero(~plain)
        texts = [spelt[starts[k] : starts[k] + lengths[k]].tobytes().decode() for k in other.tolist()]
        found = [np.array(e.ids, dtype="<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts[other] = [len(f) for f in found]
        order = np.concatenate([np.flatnonzero(plain), other])
        at = np.empty(len(lengths), dtype=np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([words, *found]), at, counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each end."""
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        kind = self.classes[data]
        inside = kind != GAP
        edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return np.empty(0, "<i4"), np.zeros(len(texts), dtype=np.int64)
        odd = np.add.reduceat(kind == ODD, starts, dtype=np.int64) > 0
        whole = spread(odd, starts, ends, len(data))
        first = (edges[:-1] == 1) | (inside & ~whole & ((kind == DIGIT) | np.concatenate([[True], kind[1:] != kind[:-1]])))
        last = np.concatenate([first[1:] | (edges[1:-1] == -1), [True]]) & inside
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        ids, counts = self.pieces.encode(np.where(whole, data, LOWER[data]), starts, ends)
        return ids, per_text(ids, counts, starts, begins)


def free_levels(row: int) -> np.ndarray:
    """Which fills 0..row need no padding: none, a whole row and the powers of two."""
    level = np.arange(row + 1)
    return (level & (level - 1) == 0) | (level == row)


class Windows:
    """Open windows by level, with what each holds: documents' pieces (key, start, ids)."""

    def __init__(self, row: int = ROW, most: int = OPEN):
        self.row, self.most, self.free = row, most, free_levels(row)
        self.counts = np.zeros(row + 1, dtype=np.int64)  # the level array
        self.open: dict[int, list[list]] = {}
        self.partial = 0  # open windows that need padding

    def _move(self, size: int) -> int:
        """The level whose window takes `size` tokens with the least sum of squares after it; of equal ones the fullest."""
        below, above = np.arange(self.row - size + 1), np.arange(size, self.row + 1)
        gained = np.where(self.free[above], 0, 2 * self.counts[above] + 1)
        lost = np.where(self.free[below], 0, 2 * self.counts[below] - 1)
        change = np.where((self.counts[below] > 0) | (below == 0), gained - lost, np.iinfo(np.int64).max)
        return int(len(change) - 1 - change[::-1].argmin())

    def _put(self, level: int, piece: tuple) -> list[list]:
        """A piece into a window of `level`; returns the window, if it is full."""
        window = self.open[level].pop() if level else []
        window.append(piece)
        to = level + len(piece[2])
        if level:
            self.counts[level] -= 1
            self.partial -= not self.free[level]
        if to == self.row:
            return [window]
        self.counts[to] += 1
        self.partial += not self.free[to]
        self.open.setdefault(to, []).append(window)
        return []

    def add(self, key, ids: np.ndarray) -> list[list]:
        """Places a document; returns the windows that are full now."""
        done, start = [], 0
        while len(ids) - start >= self.row:
            done.append([(key, start, ids[start : start + self.row])])
            start += self.row
        while start < len(ids):
            size = len(ids) - start
            level = self._move(size)
            if level == 0 and self.partial >= self.most and not self.free[size]:  # too many open: cut to complete the fullest
                level = int(np.flatnonzero((self.counts > 0) & ~self.free)[-1])
                size = min(size, self.row - level)
            done += self._put(level, (key, start, ids[start : start + size]))
            start += size
        return done

    def close(self) -> list[list]:
        """All windows that are left; those that need padding are cut together, the fullest completed first."""
        out, rest = [], []
        for level in sorted(self.open, reverse=True):
            (out if self.free[level] else rest).extend(self.open[level])
        while rest:
            window = rest.pop(0)
            gap = self.row - sum(len(p[2]) for p in window)
            while gap and rest:
                key, start, ids = rest[-1].pop()
                window.append((key, start, ids[:gap]))
                if len(ids) > gap:
                    rest[-1].append((key, start + gap, ids[gap:]))
                if not rest[-1]:
                    rest.pop()
                gap -= len(window[-1][2])
            out += [window] if not gap else self._powers(window, self.row - gap)
        self.__init__(self.row, self.most)
        return out

    def _powers(self, window: list[tuple], size: int) -> list[list]:
        """The window's pieces, cut into windows of powers of two that add up to `size`."""
        out = []
        for bit in reversed(range(size.bit_length())):
            need = (size >> bit & 1) << bit
            if need:
                out.append([])
            while need:
                key, start, ids = window.pop(0)
                out[-1].append((key, start, ids[:need]))
                if len(ids) > need:
                    window.insert(0, (key, start + need, ids[need:]))
                need -= len(out[-1][-1][2])
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_online(docs: DataFrame, row: int = ROW, path: str | None = None, end: int = END, most: int = OPEN, with_ids: bool = False) -> DataFrame:
    """A row for each piece of the documents' tokens in their sequences of at most `row` tokens.

    doc_id; start: tokens of its document before the piece; length; ids_crc32: of the ids as little-endian unsigned 32-bit
    numbers; doc_tokens: of the whole document, with the id `end` after its last one; sequence_id: unique; offset: of the
    piece in its sequence, whose pieces follow each other from 0; with `with_ids` also the ids, as array<int>. Null and
    empty texts have the ending id alone; repeated rows and null ids are packed like any other; other columns are not
    looked at. No document is dropped; a sequence is as long as `row` or a power of two, so nothing needs padding.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key = f"words {path or VOCABULARY}"

    def rows(windows: list[list], first: int) -> pa.RecordBatch:
        flat = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + k, ids) for k, window in enumerate(windows) for (doc, n), start, ids in window]
        lengths = np.array([f[2] for f in flat])
        before = np.cumsum(lengths) - lengths
        opens = np.cumsum([0, *map(len, windows[:-1])])
        offset = before - np.repeat(before[opens], [len(w) for w in windows])
        columns = [pa.array([f[i] for f in flat], pa.int64()) for i in range(6)] + [pa.array(offset, pa.int64())]
        if with_ids:
            columns.append(pa.array([f[6] for f in flat], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = [c.split(" ")[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        encoder = held_by_worker(key, lambda: WordEncoder(shared.value))
        number, windows = TaskContext.get().partitionId() << 33, Windows(row, most)
        for piece in in_slices(batches):
            texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
            ids, ends = encoder.encode(texts)
            done, start = [], 0
            for doc, to in zip(piece.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                tokens = np.append(ids[start:to], np.int32(end))
                done += windows.add((doc, len(tokens)), tokens)
                start = to
            if done:
                yield rows(done, number)
                number += len(done)
        left = windows.close()
        if left:
            yield rows(left, number)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded_batches(columns).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
