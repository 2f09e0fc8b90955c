"""Intervals of one-bit codes hold the true scores; mining equals brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key int, part int, v int, n int"


@pytest.mark.parametrize("width", [1, 3, 8, 64, 70])
def test_intervals_hold_every_score(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(-300, 300, (500, width))
    rows[:50] = rows[0] + rng.integers(-3, 4, (50, width))
    rows[60:80] = 0
    anchors = np.concatenate([rows[:10], rng.integers(-300, 300, (10, width)), np.zeros((1, width), dtype=np.int64)])
    low, high = hn.Codes(rows).intervals(anchors)
    scores = rows @ anchors.T
    assert (low <= scores).all() and (scores <= high).all()
    again = hn.Codes.of(hn.Codes(rows).record())
    assert np.allclose(again.intervals(anchors)[0], low)


def test_tight_groups_pass_over_most_rows(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (20, 64))
    rows = np.concatenate([c + rng.integers(-4, 5, (100, 64)) for c in centres])
    codes, scored = hn.Codes(rows), []
    real = codes._scored
    monkeypatch.setattr(codes, "_scored", lambda anchors, wanted: scored.append(wanted.sum()) or real(anchors, wanted))
    best, scores = codes.best(rows[:1], np.ones((len(rows), 1), dtype=bool), 5)[0]
    expected = np.argsort(-(rows @ rows[0]), kind="stable")[:5]
    assert best.tolist() == expected.tolist() and scores.tolist() == (rows @ rows[0])[expected].tolist()
    assert sum(scored) <= 0.2 * len(rows)


def mined(rows, modulus, positives=5, negatives=10, low=30, high=90):
    used = {}
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        used[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in e))] = None
    out = []
    for i, label, v in used:
        if i % modulus:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in used]
        near = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for p, j in near:
            fits = sorted((s, k) for s, k, other in scored if other != label and low * -p <= 100 * -s <= high * -p)
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df, modulus, **more):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % modulus == 0, **more).collect())


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(3)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([0, 0, 0, 1, 2, 9])) for k in range(-30, 270)]
    rows += [(k, rows[5][1], rng.choice([0, 1])) for k in range(300, 340)]  # copies of one vector: ties
    rows += [rows[7], rows[7], (rows[8][0], rows[9][1], 0), (400, None, 1), (405, [1.0, None], 1), (410, [float("nan")] * 8, 1), (415, [float("inf")] * 8, 1)]
    rows += [(420, [0.1] * 8, None), (None, [0.1] * 8, 1), (425, [], 0), (430, [0.5], 0), (435, [0.3] * 11, 1), (440, [0.0] * 8, 2)]
    rows = [(*r, 1, 2, 3, 4) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "POOL", 16)
    expected = mined(rows, 5)
    assert len(expected) > 300 and found(df, 5) == expected
    assert found(df, 5, positives=2, negatives=3, low=50, high=100) == mined(rows, 5, 2, 3, 50, 100)


def test_small_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA), 5) == []
    one = [(0, [1.0, 0.0], 1, 0, 0, 0, 0)]
    assert found(spark.createDataFrame(one, SCHEMA), 5) == []
    three = [*one, (5, [1.0, 0.0], 2, 0, 0, 0, 0), (6, [0.5, 0.5], 3, 0, 0, 0, 0)]
    assert found(spark.createDataFrame(three, SCHEMA), 5) == mined(three, 5) == [(0, 5, 1, 6, 65536, 32768), (5, 0, 1, 6, 65536, 32768)]
