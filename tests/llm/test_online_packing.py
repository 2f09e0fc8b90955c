"""Word pieces against the tokenizers library; online packing against its rules and a plain sum of squares."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spherecube.llm import online_packing, units, words

PATH = public_tokenizers.path(online_packing.VOCABULARY)
ALPHABET = [
    "a", "B", "the", "don't", "'s", "İ", "é", "é", "J̌", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "　", "12", "3", "٣", ",", "--",
    "<|endoftext|>", "<|", "\U0001f600", "中文", "Σ", "ς", "\x00", "​", "'re", "''", "|", "Straße", "quick",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return online_packing.WordEncoder(file.read())


def ids_of(encoder, texts):
    ids, ends = encoder.encode([t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))) for _ in range(40)]
        assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, [""]) == [[]] and ids_of(encoder, ["", " ", "x" * 5000]) == [[], [], library.encode("x" * 5000).ids]


def test_a_small_table_starts_anew_and_hashes_may_meet(encoder, library, monkeypatch):
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "again worda, wordb"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(encoder, "pieces", units.PieceIds(encoder._learn, slots=64))
    for _ in range(3):
        assert ids_of(encoder, texts) == want
    real = words.hash_spans
    monkeypatch.setattr(units, "hash_spans", lambda *a: real(*a) % np.uint64(7))
    monkeypatch.setattr(encoder, "pieces", units.PieceIds(encoder._learn))
    assert ids_of(encoder, texts) == want


def least_sum(counts, size, row):
    """The level after which the sum of squares is least, the fullest of equal ones, by trying all."""
    free = {row, 0} | {1 << k for k in range(row.bit_length())}
    total = lambda c: sum(n * n for level, n in c.items() if level not in free)
    tried = []
    for level in [0] + [x for x in counts if counts[x] and x + size <= row]:
        after = collections.Counter(counts)
        after[level] -= 1
        after[level + size] += 1
        tried.append((total(after), -level))
    return -min(tried)[1]


def test_each_document_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(5)
    windows = online_packing.Windows(row=48, most=10**6)
    for k in range(400):
        size = rng.choice([rng.randrange(1, 48), 16, 7])
        counts = collections.Counter({i: int(n) for i, n in enumerate(windows.counts) if n})
        level = least_sum(counts, size, 48)
        before = dict(counts)
        windows.add(k, np.arange(size))
        after = {i: int(n) for i, n in enumerate(windows.counts) if n}
        expected = collections.Counter(before)
        if level:
            expected[level] -= 1
        if level + size < 48:
            expected[level + size] += 1
        assert after == {i: n for i, n in expected.items() if n}


@pytest.mark.parametrize("sizes", [[], [1], [5] * 40, [33] * 200, [2048] * 3, [2049, 4100, 1], None])
def test_every_token_is_in_one_piece_and_nothing_is_padded(sizes):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 300) for _ in range(900)] if sizes is None else sizes
    windows, out = online_packing.Windows(row=64, most=8), []
    for k, n in enumerate(sizes):
        out += windows.add(k, np.arange(n))
        assert windows.partial <= 8 + 1 and sum(map(len, windows.open.values())) == windows.counts.sum()
    out += windows.close()
    seen = collections.defaultdict(list)
    for window in out:
        fill = sum(len(ids) for _, _, ids in window)
        assert fill == 64 or (fill < 64 and fill & (fill - 1) == 0)
        for key, start, ids in window:
            assert ids.tolist() == list(range(start, start + len(ids)))
            seen[key] += ids.tolist()
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}


def test_packed_documents(spark, library):
    rng = random.Random(1)
    texts = [None, "", " \n", "One two, three!", "x" * 30_000, " ".join(rng.choice(ALPHABET) for _ in range(9000))]
    texts += [" ".join(rng.choice(["sea", "sky", "Tree.", "l'eau", "2024"]) for _ in range(rng.randrange(1, 900))) for _ in range(120)]
    rows = [(None if k == 3 else k, t, 7, 8) for k, t in enumerate(texts)] + [(200, texts[8], 1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, length int").repartition(4)
    found = online_packing.packed_online(docs, with_ids=True).collect()
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc, copies in ids.items():
        assert {n for _, _, n in pieces[doc]} == {len(copies[0])}
        assert collections.Counter(t for _, part, _ in pieces[doc] for t in part) == collections.Counter(t for c in copies for t in c)
        for start, part, _ in pieces[doc]:
            assert part == copies[0][start : start + len(part)]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    assert online_packing.packed_online(docs.where("doc_id < 0")).count() == 0
    assert online_packing.packed_online(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).where("length <> 1 or ids_crc32 <> " + str(zlib.crc32(b"\1\0\0\0"))).count() == 0
