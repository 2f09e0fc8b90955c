"""64-bit hashes of the words of many texts at once, on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import SLICE_CHARS

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words hashed at a time: their numbers stay in the processor's cache and take little memory.
CHUNK = 1 << 17
#: A number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, of which there is one at least; spans are in ascending order."""
    powers = np.full(int(lengths.max()), ODD, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    totals = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(totals, np.arange(0, int(totals[-1]) + CHUNK, CHUNK)))
    hashes = np.empty(len(starts), dtype=np.uint64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
        if a == b:
            continue
        held = lengths[a:b]
        before = np.cumsum(held) - held
        places = np.arange(int(held.sum())) - np.repeat(before, held)
        values = BYTES[data[places + np.repeat(starts[a:b], held)]] * powers[places]
        hashes[a:b] = mix(np.add.reduceat(values, before) + held.astype(np.uint64))
    return hashes


def word_hashes(data: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of `data` (bytes), A to Z taken in lower case; `apart` marks the bytes between words."""
    low = LOWER[data]
    inside = ~apart[low]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    return starts, hash_spans(low, starts, ends - starts)


def text_words(text: bytes, apart: np.ndarray = SPACE) -> np.ndarray:
    """Word hashes of one text, which is cut at white space where it is long."""
    parts, start = [], 0
    while start < len(text):
        end = min(len(text), start + SLICE_CHARS)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(word_hashes(np.frombuffer(text, np.uint8, end - start, start), apart)[1])
        start = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def batch_words(texts: list[bytes], apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the bounds of each text's words."""
    if len(texts) == 1:
        words = text_words(texts[0], apart)
        return words, np.array([0, len(words)])
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, words = word_hashes(joined, apart)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The bytes of a column of texts; a null is the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]
