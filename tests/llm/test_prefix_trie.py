"""The prefix trie against a trie built in memory."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from spherecube.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string, k int, path int, depth int, pos int, words int, level int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, x in own.items():
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + x[h:]
    return out


def trie(rows):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in conversations(rows).items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += own
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -10**9, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def found(df):
    rows = [tuple(r) for r in pt.prefix_trie(df).collect()]
    return sorted((a, b, -10**9 if c is None else c, *rest) for a, b, c, *rest in rows)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for c in range(-25, 150):
        common = rng.random() < 0.4
        for turn in range(rng.randrange(1, 9)):
            text = "hello there " * (turn + 1) if common else rng.choice(["one", "two words", "a b c", None, "", "x\ty\nz"])
            out.append((c, turn, rng.choice(["user", "assistant"]) if not common else "user", text))
    out += [(200 + k, t, "user", f"same {t}") for k in range(60) for t in range(5)]  # copies
    out += [(301, None, "user", "late"), (301, None, "system", "early"), (301, 3, None, None), (None, 1, "user", "nobody")]
    out += [(305, 0, "user", "again"), (305, 0, "user", "again"), (305, 1, "user", "b"), (1007, 0, "user", "alone")]
    out += [(400, t, "user", f"turn {t % 3}") for t in range(90)] + [(401, t, "user", f"turn {t % 3}") for t in range(85)]  # long ones
    return out


def test_whole_trie(spark, rows):
    assert found(made(spark, rows)) == trie(rows)


def test_many_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(pt, "SHARD", 40)
    monkeypatch.setattr(pt, "CHUNK", 7)
    df = made(spark, rows)
    assert len(pt.splitters_of(pt.classes_of(pt.segments_of(*pt.rebuilt(pt.turns_of(df)))))) > 5
    monkeypatch.setattr(pt, "SPLITTER", 2)
    assert found(df) == trie(rows)


def test_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(pt, "SHARD", 60)
    monkeypatch.setattr(pt, "SEGMENT", 5)
    rows = [r for r in rows if r[0] is None or r[0] < 350] + [(400, t, "user", f"turn {t % 3}") for t in range(14)] + [(401, t, "user", f"turn {t % 3}") for t in range(10)]
    assert found(made(spark, rows)) == trie(rows)


def test_small_tables(spark):
    assert found(made(spark, [])) == []
    assert found(made(spark, [(None, 1, "user", "nobody")])) == []
    one = [(7, 0, "user", "a b"), (27, 0, "user", "a b")]
    assert found(made(spark, one)) == trie(one)
