"""Resampling and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import negatives, resampling


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_features(text):
    ws = plain_words(text)
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for _, text in rows for f in plain_features(text)) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, text in docs:
        fs = plain_features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, docs, target):
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (docs, target)]
    return sorted((tuple(r) for r in resampling.resample(*frames).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


VOCABULARY = ["the", "The", "rivER", "é", "straße", "x-y", "42", "a.b", "#", "日本", "word joined", "\x00z"]


def texts(rng, n, words):
    return [" ".join(rng.choices(VOCABULARY, k=rng.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize("bounds", [(300_000, 600_000, 1 << 20), (3, 4, 16)])
def test_resampling_equals_brute_force(spark, monkeypatch, bounds):
    """Also with tries that are counted off all the time, and texts in pieces of a few words."""
    rng = random.Random(1)
    docs = [(i, t) for i, t in enumerate(texts(rng, 150, 60))]
    docs += [(500, None), (501, ""), (502, "..."), (None, "the river " * 15), (None, "the river " * 15), (7, docs[7][1]), (7, "the " * 30), (503, "é" * 5000 + " the" * 3000)]
    target = [(i, t) for i, t in enumerate(texts(rng, 10, 30))] + [(99, None)]
    for name, value in zip(("WORD_NODES", "PAIR_NODES", "PIECE"), bounds):
        monkeypatch.setattr(resampling, name, value)
    assert resampled(spark, docs, target) == plain_resample(docs, target)
    counts = resampling.Counts()
    for _, t in docs:
        counts.add((t or "").encode())
    counts.count(last=True)
    assert counts.totals.tolist() == [Counter(zlib.crc32(f.encode()) % 10_000 for _, t in docs for f in plain_features(t))[b] for b in range(10_000)]
    weigh = resampling.Gains(np.arange(10_000))
    for _, t in docs:
        fs = plain_features(t)
        assert weigh.of((t or "").encode()) == (len(plain_words(t)), sum(zlib.crc32(f.encode()) % 10_000 for f in fs))


def test_a_node_continues_its_parents_crc():
    trie = resampling.Trie()
    trie.walk([b"deux", b"mots"], None)
    assert list(trie.pair_crc) == [zlib.crc32(b"deux mots")]
    nodes, pairs = trie.walk([b"mots"], b"deux")
    assert nodes.tolist() == [1] and pairs.tolist() == [0]


def test_resampling_of_nothing(spark):
    assert resampled(spark, [], [(1, "a b")]) == []
    docs = [(i, "w " * 20) for i in range(9)]
    assert resampled(spark, docs, []) == plain_resample(docs, [])
    frame = spark.createDataFrame([(1, "a", 5, 6)], "doc_id int, text string, score long, level long")
    assert resampling.resample(frame, frame.limit(0)).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def plain_negatives(rows):
    kept = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i and len(w) == len(v)]
        order = lambda s: (-s[0], s[1])
        for score, j, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scores if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(i, j, rank, k, score, n) for rank, (n, k, _) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(parts)
    return sorted(tuple(r) for r in negatives.hard_negatives(frame).collect())


@pytest.mark.parametrize("wave", [1 << 23, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, wave):
    """Also with waves of a few anchors, and blocks smaller than the table."""
    monkeypatch.setattr(negatives, "WAVE_NUMBERS", wave)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 32)
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 4)), rng.normal(0.3, 0.4, 6).round(1).tolist()) for i in range(-20, 620)]
    rows += [(700, None, [1.0] * 6), (701, 1, None), (702, 1, [None] + [1.0] * 5), (703, 1, [float("nan")] * 6), (704, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (800, 1, []), (900, 2, [1.0, 2.0]), (901, 2, [1.0, 2.5]), (902, 3, [0.5, 1.0])]
    rows += rows[30:60] * 8 + [(1000 + i, i % 3, [0.5] * 6) for i in range(80)]
    found = mined(spark, rows)
    assert found == plain_negatives(rows) and any(r[0] == 900 for r in found)
    assert mined(spark, rows, 1) == found


def test_scores_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(1e5, 3e6) for _ in range(8)]) for i in range(0, 400, 5)]
    rows += [(1, 0, [1e300] * 8)]
    assert mined(spark, rows) == plain_negatives(rows[:-1])
    a = np.array([[2.0**40, 1.0]])
    assert negatives.products(a, a).tolist() == [[negatives.NONE]]
    assert negatives.products(a, np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]


def test_no_anchors_and_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(100, 1, [-1.0]), (101, 1, [1.0]), (102, 2, [1.0])]) == []


def test_first_takes_ties_by_column():
    scores = np.array([[5, 7, 7, 1, 7]])
    assert [(r, c.tolist()) for r, c in negatives.first(scores, np.ones((1, 5), bool), 2)] == [(0, [1, 2])]
    assert [(r, c.tolist()) for r, c in negatives.first(scores, scores < 7, 3)] == [(0, [0, 3])]
    assert list(negatives.first(scores, scores > 9, 2)) == []


def test_vectors_of_each_length():
    vectors = pa.array([[9.0], [1.0, 2.0], [0.5], []], pa.list_(pa.float64())).slice(1)
    assert [(at.tolist(), m.tolist()) for at, m in negatives.by_length(vectors)] == [([2], [[]]), ([1], [[128.0]]), ([0], [[256.0, 512.0]])]
