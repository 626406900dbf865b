"""MinHash groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import minhash
from tests.llm.test_duplicates import groups


def plain_set(text, words=3):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    return {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())


def plain(rows, least=85, all_=100, words=3):
    """(doc_id, n, component, kept) of each row, every pair compared."""
    sets = [plain_set(t, words) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] & sets[j] and all_ * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    root = groups(pairs, range(len(rows)))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root[i]] = min(d, best.get(root[i], d))
    return sorted(((d, len(sets[i]), best.get(root[i]), d == best.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)


def ran(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.groups(docs, **options)
    return sorted(((r.doc_id, r.n, r.component_id, r.doc_id == r.component_id) for r in found.collect()), key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def corpus(rng, families, size):
    rows, i = [], 0
    for _ in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, size)):
            rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.05, 0.2])))))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(random.Random(seed), 30, 9)
    assert ran(spark, rows) == plain(rows)


def test_another_threshold_and_size(spark):
    rows = corpus(random.Random(3), 15, 9)
    assert ran(spark, rows, shingle_words=5, least=80) == plain(rows, 80, 100, 5)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(50_000))
    rows = [(5, None), (6, ""), (7, " \n"), (None, "a b c d"), (9, "A  b\tC d"), (9, "A b c d"), (9, "other words here now"), (8, "a b"), (3, "A\nB"), (None, "x"), (None, "x"), (11, long), (10, long + " end"), (4, "é É"), (2, "é é")]
    found = ran(spark, rows)
    assert found == plain(rows)
    empty = [r for r in ran(spark, rows, link_empty=True) if r[1] == 0]
    assert empty == [(5, 0, 5, True), (6, 0, 5, False), (7, 0, 5, False)]


def test_empty_table_and_other_columns(spark):
    assert ran(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e", 3, "x"), (2, "a b c d e", 4, "y")], "doc_id long, text string, cid long, band string")
    assert [r.component_id for r in minhash.groups(docs).collect()] == [1, 1]


def test_a_crowd_of_one_template(spark, monkeypatch):
    """Texts that share much of a template but are no near copies, with some that are: bands are crowded, and are split by further orders."""
    monkeypatch.setattr(minhash, "CROWD", 5)
    monkeypatch.setattr(minhash, "LEVELS", ((40, 2), (220, 16)))
    rng, template = random.Random(4), [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"o{i}-{k}" for k in range(40)]
        rows.append((i, " ".join(template + own)))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(template + own[:-1] + ["end"])))
    rng.shuffle(rows)
    seen = []
    again = minhash.Search.banded_again
    monkeypatch.setattr(minhash.Search, "banded_again", lambda self, cids, level: seen.append(cids.count()) or again(self, cids, level))
    assert ran(spark, rows) == plain(rows)
    assert seen and seen[0] > 5


@pytest.mark.parametrize("level, off", [(0, 0.15), (1, 0.06)])
def test_estimate_is_near_the_truth(spark, level, off):
    rng, n = np.random.default_rng(5), minhash.SIGNATURES[level][1]
    both = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    rows = []
    for share in (0.0, 0.3, 0.5, 0.85, 1.0):
        common = both[: int(2 * share / (1 + share) * 1000)]
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 1000 - len(common)).astype(np.uint64)])) for _ in "ab")
        rows.append((share, *(minhash.packed(minhash.minima(x, n), level).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
    for r in df.select("share", minhash.estimate(F.col("a"), F.col("b"), level).alias("e"), minhash.matches(F.col("a"), F.col("b"), level).alias("m")).collect():
        assert abs(r.e - r.share) < off
        assert r.share < 1 or r.m == n
    assert minhash.lowest_estimate(0.85, level) < (0.71, 0.80)[level]


def test_errors_of_estimates_are_as_small_as_the_margin_supposes():
    """Over many pairs at 0.85 the errors of both signatures have the deviation that independent orders would give, so the margin holds for them."""
    rng = np.random.default_rng(6)
    for level, (bits, n) in enumerate(minhash.SIGNATURES):
        sigma = (0.85 - minhash.lowest_estimate(0.85, level)) / minhash.MARGIN
        errors = []
        for _ in range(150):
            common, *own = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (170, 15, 15))
            x, y = (minhash.packed(minhash.minima(np.concatenate([common, o]), n), level).view(np.uint64) for o in own)
            differing = x ^ y
            if bits > 1:
                groups_of_bits = (differing[:, None] >> (np.arange(0, 64, bits, dtype=np.uint64))) & np.uint64((1 << bits) - 1)
                equal = (groups_of_bits == 0).sum()
            else:
                equal = n - np.bitwise_count(differing).sum()
            errors.append((equal / n - 2.0**-bits) / (1 - 2.0**-bits) - 0.85)
        assert np.std(errors) < 1.2 * sigma and abs(np.mean(errors)) < 0.3 * sigma


def test_what_is_joined_already_is_not_compared_with_its_hub(spark, monkeypatch):
    known = spark.createDataFrame([(i, 10, [1, 2, 3 + i // 29], [0] * 16) for i in range(30)], "cid long, n long, bands array<long>, signature array<long>")
    search = minhash.Search(spark.createDataFrame([], "doc_id long, text string"), known, 3, 85, 100)
    search.roots = spark.createDataFrame([(i, 0) for i in range(1, 29)], "node long, root long")
    compared = []
    monkeypatch.setattr(minhash.Search, "sifted", lambda self, pairs, known, level: compared.extend(map(tuple, pairs.collect())) or pairs.limit(0))
    monkeypatch.setattr(minhash.Search, "confirm", lambda self, pairs: None)
    search.settle(known)
    assert compared and all(29 in pair for pair in compared)


def test_pairs_are_sifted_with_one_row_of_what_is_known_of_a(spark):
    known = spark.createDataFrame([(i, 10, [0] * 16) for i in range(4)] + [(9, 99, [0] * 16)], "cid long, n long, signature array<long>")
    pairs = spark.createDataFrame([(3, 0), (3, 1), (2, 1), (9, 1), (9, 3)], "a long, b long")
    search = minhash.Search(known, known, 3, 85, 100)
    assert sorted(map(tuple, search.sifted(pairs, known, 0).collect())) == [(2, 1), (3, 0), (3, 1)]


@pytest.mark.parametrize("level", [0, 1])
def test_bitmaps_rule_out_pairs_just_below_the_threshold(spark, level):
    rng, rows = np.random.default_rng(9), []
    for n in (20, 150, 400):
        for shared in [n - k for k in range(n // 4)]:
            x, y, z = (np.sort(rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2)) for k in (shared, n - shared, n - shared))
            a, b = np.union1d(x, y), np.union1d(x, z)
            rows.append((shared / (2 * n - shared), len(a), minhash.signature(a, minhash.minima(a, minhash.orders_of(level)), level).tolist(), len(b), minhash.signature(b, minhash.minima(b, minhash.orders_of(level)), level).tolist()))
    df = spark.createDataFrame(rows, "share double, a_n long, a_signature array<long>, b_n long, b_signature array<long>")
    found = df.select("share", minhash.may_be_linked(85, 100, level).alias("may")).collect()
    assert all(r.may for r in found if r.share >= 0.85)
    assert not any(r.may for r in found if r.share < 0.81)
