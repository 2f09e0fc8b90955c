"""Cores of operators against plain computations: estimation of votes, license rules with priority and containment, packed files."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.llm import bpe, licenses, packing, quality


def expectation_maximisation(counts, n_rules):
    """Share of good ones and vote rates, by numpy, from vote patterns (-1, 0, 1 a rule) with their numbers."""
    patterns = np.array(list(counts), dtype=int)
    n = np.array([counts[tuple(p)] for p in patterns], dtype=float)
    cast = np.stack([patterns == -1, patterns == 1], axis=2).reshape(len(patterns), -1).astype(float)
    good, on_good, on_bad = quality.GOOD, np.tile(quality.ON_GOOD, n_rules), np.tile(quality.ON_BAD, n_rules)

    def posterior():
        return 1 / (1 + np.exp(-(np.log(good / (1 - good)) + cast @ np.log(on_good / on_bad))))

    for _ in range(quality.STEPS):
        p = posterior()
        rates = []
        for weight in (n * p, n * (1 - p)):
            times = (weight @ cast).reshape(-1, 2)
            rates.append(((times + 1) / (times.sum(axis=1, keepdims=True) + 2)).ravel())
        good = min(max(((n * p).sum() + 1) / (n.sum() + 2), 0.05), 0.95)
        on_good, on_bad = rates
    return good, on_good, on_bad, dict(zip(map(tuple, patterns.tolist()), posterior(), strict=True))


@pytest.mark.parametrize("seed", [0, 1])
def test_votes_are_weighed_as_by_numpy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        is_good = rng.random() < 0.7
        rows.append(tuple(rng.choices((-1, 0, 1), (5, 10, 85) if is_good else w)[0] for w in ((60, 20, 20), (30, 40, 30), (80, 0, 20), (5, 90, 5))))
    rules = ["v_a", "v_b", "v_c", "v_d"]
    voted = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in rules))
    given = quality.estimate(voted, rules)
    good, on_good, on_bad, expected = expectation_maximisation(collections.Counter(rows), 4)
    found = given.first()["given"]
    assert found["good"] == pytest.approx(good) and np.allclose(found["on_good"], on_good) and np.allclose(found["on_bad"], on_bad)
    judged = voted.crossJoin(given).withColumn("p", quality._posterior(F.col("given"), quality._cast(rules))).collect()
    assert all(r["p"] == pytest.approx(expected[tuple(r)[:4]]) for r in judged)


def scan(text, rules):
    """Labels and highest confidence of all hits of all rules that no other hit contains; of equal ones the first rule."""
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words, hits = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), []
    for at, word in enumerate(words):
        before = "".join(w + " " for w in words[max(0, at - licenses.REACH) : at])
        after = "".join(" " + w for w in words[at + 1 : at + 1 + licenses.REACH])
        for rule in rules:
            if rule["kw"] == word:
                left, right = re.search(rule["before"], before), re.search(rule["after"], after)
                if left and right:
                    hits.append((at - len(left.group().split()), at + 1 + len(right.group().split()), rule["prio"], rule["label"], rule["conf"]))
    kept = [h for h in hits if not any((g[0] <= h[0] and g[1] >= h[1] and (g[:2] != h[:2] or g[2] < h[2])) for g in hits)]
    return sorted({h[3] for h in kept}), max((h[4] for h in kept), default=0.0)


def test_license_rules_are_those_of_a_plain_scan(spark):
    rules = licenses.signature_rules()
    rng = random.Random(8)
    plain = lambda p: re.sub(r"\(\?:([^|()]*)[^()]*\)", r"\1", p).replace("[sc]", "s").replace("?", "")
    spelt = [" ".join(f"{plain(r['before'])} {r['kw']} {plain(r['after'])}".replace("^", "").replace("$", "").split()) for r in rules]
    fill = "the software is provided under terms of this license version 2 0 or later gnu public general apache mit bsd mozilla all rights".split()
    texts = [*spelt, *(f"{a}, {b}" for a, b in (rng.sample(spelt, 2) for _ in range(150)))]
    texts += [" ".join(rng.choice(fill) for _ in range(rng.randrange(3, 60))) for _ in range(150)]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hit = 0
    for r in rows:
        labels, conf = scan(texts[r["doc_id"]], rules)
        base = [x for x in r["base_labels"].split(",") if x]
        assert r["labels"].split(",") == (sorted({*labels, *base}) or [""]), texts[r["doc_id"]]
        assert r["score"] == pytest.approx(max(conf, 0.5) if base else conf)
        hit += bool(labels)
    assert hit > 0.6 * len(texts) and {x for r in rows for x in r["labels"].split(",")} >= {r["label"] for r in rules[: len(licenses.SENTENCES)]}


def test_packed_files_read_back_as_a_matrix(spark, tmp_path):
    vocabulary, row = bpe.Vocabulary(), 64
    docs = spark.createDataFrame([(k, f"word{k} and some more text, " * (k % 9)) for k in range(60)] + [(None, "no id"), (70, None)], "doc_id long, text string")
    path = f"{tmp_path}/packed"
    packing.write_packed(packing.packed(docs, row, vocabulary), path)
    encoder, found = bpe.Encoder(vocabulary), collections.defaultdict(dict)
    rows = spark.read.parquet(path).collect()
    matrix = np.stack([np.frombuffer(r["ids"], "<u2") for r in rows])
    assert matrix.shape == (len(rows), row) and len({r["pack_id"] for r in rows}) == len(rows)
    for ids, r in zip(matrix, rows, strict=True):
        bounds = r["cu_seqlens"]
        assert bounds[0] == 0 and r["resets"] == bounds[:-1] and (ids[bounds[-1] :] == len(vocabulary.table)).all()
        for a, b, doc, start in zip(bounds, bounds[1:], r["doc_ids"], r["doc_starts"], strict=False):
            found[doc][start] = ids[a:b].tolist()
    for r in docs.collect():
        expected = encoder.encode([r["text"]])[0].tolist()
        assert [t for _, part in sorted(found[r["doc_id"]].items()) for t in part] == expected


def test_encoding_works_on_short_slices_and_gives_memory_back(monkeypatch):
    """A worker shares its executor with the heap: arrays of places follow a slice, and freed memory must not stay."""
    assert bpe.slices([300_000] * 4) == [(0, 1), (1, 2), (2, 3), (3, 4)] and bpe.slices([2_000_000]) == [(0, 1)]
    given = []
    monkeypatch.setattr(bpe, "give_back", lambda: given.append(1))
    encoder = bpe.Encoder(bpe.Vocabulary())
    texts = ["some words " * 30_000, "more of them", None]
    assert bpe.encode_texts(encoder, bpe.pa.array(texts)).to_pylist() == [e.tolist() for e in encoder.encode(texts)] and given
