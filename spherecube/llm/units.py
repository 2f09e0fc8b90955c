"""Token ids of the pieces of many texts at once: each piece is looked up by hash, compared byte by byte, and learnt once.

A tokenizer that splits text before its merges gives a piece the same ids wherever it stands. So a batch of texts is cut
into pieces with numpy, pieces seen before are found in a table of bounded size, and only new ones go to the library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import hash_spans

#: Slots of the table of pieces, of which at most half are filled before it starts anew.
SLOTS = 1 << 20
#: Classes of bytes.
GAP, LETTER, DIGIT, OTHER, ODD = range(5)


def byte_classes(gaps: bytes, odd: bytes = b"'") -> np.ndarray:
    """The class of each byte; odd are those named, control characters and all parts of characters beyond ASCII."""
    out = np.full(256, ODD, dtype=np.uint8)
    out[0x21:0x7F] = OTHER
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[list(odd)] = ODD
    out[list(gaps)] = GAP
    return out


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Pool:
    """Arrays one after the other in one growing array."""

    def __init__(self, dtype: str):
        self.values, self.used = np.empty(1 << 16, dtype=dtype), 0

    def add(self, values: np.ndarray) -> int:
        need = self.used + len(values)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.empty(need, dtype=self.values.dtype)])
        self.values[self.used : need] = values
        start, self.used = self.used, need
        return start


class PieceIds:
    """Ids of pieces, each learnt the first time.

    `learn` takes the bytes of new pieces, one after the other, and their lengths; it returns ids and, for each piece, where
    its ids start there and how many they are.
    """

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], slots: int = SLOTS):
        self.learn, self.slots = learn, slots
        self.clear()

    def clear(self) -> None:
        self.hashes, self.piece = np.zeros(self.slots, dtype=np.uint64), np.full(self.slots, -1, dtype=np.int32)
        self.bytes, self.ids, self.known = Pool("u1"), Pool("<i4"), 0
        self.at, self.size = np.empty(1 << 12, dtype=np.int64), np.empty(1 << 12, dtype=np.int64)
        self.ids_at, self.count = np.empty(1 << 12, dtype=np.int64), np.empty(1 << 12, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            piece, same = self.piece[slot], self.hashes[slot] == hashes[left]
            hit = same & (piece >= 0)
            out[left[hit]] = piece[hit]
            on = (piece >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, hashes: np.ndarray, pieces: np.ndarray) -> None:
        """Different hashes that are not in the table."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.piece[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.hashes[slot[won]], self.piece[slot[won]] = hashes[won], pieces[won]
            lost = np.ones(len(hashes), dtype=bool)
            lost[won] = False
            hashes, pieces, slot = hashes[lost], pieces[lost], (slot[lost] + 1) & (self.slots - 1)

    def _remember(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, whose bytes and ids are kept."""
        spelt = data[expand(starts, lengths)]
        ids, ids_at, counts = self.learn(spelt, lengths)
        first, self.known = self.known, self.known + len(starts)
        while self.known > len(self.at):
            self.at, self.size, self.ids_at, self.count = (np.concatenate([x, np.empty(len(x), x.dtype)]) for x in (self.at, self.size, self.ids_at, self.count))
        new = slice(first, self.known)
        self.size[new], self.count[new] = lengths, counts
        self.at[new] = self.bytes.add(spelt) + np.cumsum(lengths) - lengths
        self.ids_at[new] = self.ids.add(ids) + ids_at
        return np.arange(first, self.known, dtype=np.int32)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces data[starts:ends], one after the other, and how many each piece has."""
        if not len(starts):
            return np.empty(0, dtype="<i4"), np.empty(0, dtype=np.int64)
        lengths = ends - starts
        hashes = hash_spans(data, starts, lengths)
        found = self.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.known + len(fresh) > self.slots // 2 and self.known:
                self.clear()
                return self.encode(data, starts, ends)
            if len(fresh) > self.slots // 2:  # one batch with more pieces than the table holds
                half = len(starts) // 2
                parts = [self.encode(data, starts[s], ends[s]) for s in (slice(half), slice(half, None))]
                return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            some = missing[first]
            new = self._remember(data, starts[some], lengths[some])
            self._insert(fresh, new)
            found[missing] = new[which]
        same = self.size[found] == lengths
        at, to, held = (self.at[found], starts, lengths) if same.all() else (self.at[found[same]], starts[same], lengths[same])
        differ = self.bytes.values[expand(at, held)] != data[expand(to, held)]
        if differ.any():
            same[np.flatnonzero(same)] = ~np.logical_or.reduceat(differ, np.cumsum(held) - held)
        for i in np.flatnonzero(~same).tolist():  # another piece of the same hash; hardly ever
            found[i] = self._remember(data, starts[i : i + 1], lengths[i : i + 1])[0]
        counts = self.count[found]
        return self.ids.values[expand(self.ids_at[found], counts)], counts


def joined_calls(spelt: np.ndarray, lengths: np.ndarray, call: int) -> list[str]:
    """The ASCII pieces with spaces between, `call` pieces a string."""
    if not len(lengths):
        return []
    ends = np.cumsum(lengths + 1)
    spaced = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    spaced[expand(ends - lengths - 1, lengths)] = spelt
    text, cuts = spaced.tobytes().decode("ascii"), [0, *ends[call - 1 :: call].tolist(), int(ends[-1])]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def per_text(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the ids of each text end; pieces start at `starts`, texts at `text_starts` (ascending) of one array of bytes."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[np.concatenate([np.searchsorted(starts, text_starts[1:]), [len(starts)]])]


def spread(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A mask of `size` places that holds in the spans whose value holds; spans do not overlap."""
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[starts[values]] += 1
    edge[ends[values]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)

