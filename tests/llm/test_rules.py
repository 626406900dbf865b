"""Licences, toxicity, mixing and quality."""

import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import licenses as li
from parley.llm import mixing, quality, toxicity

# Licences


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_places(words):
    return [(i, label) for phrase, label in li.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "2.0", "cc", "BY", "nc", "é", ",", "\n", "mit", "x", "CC BY-NC", "under the MIT License"]), max_size=20).map(" ".join))
def test_base_places(text):
    words = plain_words(text)
    places = plain_places(words)
    got = li.scan(text.encode())
    assert (got["n_words"], got["n_base"]) == (len(words), len(places))
    assert (got["first_word"], got["last_word"]) == ((min(p for p, _ in places), max(p for p, _ in places)) if places else (None, None))
    assert got["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert {x for _, x in places} <= set(got["labels"].split(",")) or not places


@pytest.mark.parametrize(
    ("text", "postfix", "labels", "ok"),
    [
        ("MIT", ["mit"], {"mit"}, True),
        ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only", "or"], {"mit", "gpl-3"}, True),
        ("MIT AND GPL-2.0+", ["mit", "gpl-2.0+", "and"], {"mit", "gpl-2"}, False),
        ("(MIT OR GPL-3.0) AND Apache-2.0", ["mit", "gpl-3.0", "or", "apache-2.0", "and"], {"mit", "gpl-3", "apache-2"}, True),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"], {"gpl-2", "mit"}, True),
        ("(GPL-2.0 WITH Linux-syscall-note) OR MIT", ["gpl-2.0", "linux-syscall-note", "with", "mit", "or"], {"gpl-2", "mit"}, True),
        ("Apache-2.0 WITH LLVM-exception", ["apache-2.0", "llvm-exception", "with"], {"apache-2"}, True),
        ("mit and isc or epl-2.0 and wtfpl", ["mit", "isc", "and", "epl-2.0", "wtfpl", "and", "or"], {"mit", "isc", "epl-2.0", "wtfpl"}, True),
        ("MIT This file is free", ["mit"], {"mit"}, True),
        ("LicenseRef-Mine OR DocumentRef-a.b:LicenseRef-c", ["licenseref-mine", "documentref-a.b:licenseref-c", "or"], {"licenseref-mine", "documentref-a.b:licenseref-c"}, False),
    ],
)
def test_expressions(text, postfix, labels, ok):
    assert li.to_postfix(text) == postfix
    assert li.evaluate(postfix) == (labels, ok)


@pytest.mark.parametrize("text", ["", "OR MIT", "MIT OR", "(MIT", "()", ") MIT"])
def test_broken_expressions(text):
    with pytest.raises(li.ExpressionError):
        li.to_postfix(text)


@pytest.mark.parametrize("text", ["MIT and so on", "this file is free", "zz", "MIT WITH ISC", "Classpath-exception-2.0", "MIT OR (GPL-2.0 WITH nothing)"])
def test_unknown_names_make_no_expression(text):
    with pytest.raises(li.ExpressionError):
        li.evaluate(li.to_postfix(text))
    got = li.scan(f"SPDX-License-Identifier: {text}".encode())
    assert (got["labels"], got["score"], got["expressions"]) == ("", 0.0, [])


@pytest.mark.parametrize("text", ["xspdx license identifier: MIT", "spdx license identifierzz: MIT", "spdx license identifier MIT", "spdx license: MIT", "éspdx license identifier: MIT"])
def test_tags_are_whole_words_and_end_in_a_mark(text):
    assert li.scan(text.encode())["labels"] == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["SPDX-License-Identifier", "spdx", "license", "identifier", ": MIT", ": ISC OR Zlib", ":", "\n", "é", ",", "= wtfpl", "spdx license identifier:", " "]), max_size=12).map(" ".join))
def test_tags_by_brute_force(text):
    data, expected = text.encode(), set()
    for m in re.finditer(rb"(?<![0-9A-Za-z\x80-\xff])spdx[^0-9A-Za-z\x80-\xff]+license[^0-9A-Za-z\x80-\xff]+identifier(?![0-9A-Za-z\x80-\xff])[ \t]*[:=](?=[ \t]*([A-Za-z0-9.+():\- \t]+))", data, re.IGNORECASE):
        try:
            expected |= li.evaluate(li.to_postfix(m[1].decode()))[0]
        except li.ExpressionError:
            pass
    assert set(filter(None, li.scan(data)["labels"].split(","))) == expected


def test_tags_and_notices():
    got = li.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;\n# spdx-license-identifier: OR\n")
    assert got["labels"] == "apache-2,mit" and got["permissive"] and got["score"] == 1.0 and len(got["expressions"]) == 1
    got = li.scan("This work is licensed under the GNU General Public License, version 3.".encode())
    assert (got["labels"], got["base_labels"], got["permissive"]) == ("gpl-3", "", False)
    assert li.scan(b"")["labels"] == "" and li.scan(b"")["score"] == 0.0


def test_op8(spark, tmp_path):
    rows = [(1, "under the MIT license", "x"), (1, "under the MIT license", "x"), (None, None, "x"), (2, "", "x"), (3, "word " * 50_000 + "cc by-nc", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in li.op8_licenses(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted([(1, 4, 1, 0, 0, "mit"), (1, 4, 1, 0, 0, "mit"), (None, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 50_003, 1, 50_000, 50_000, "cc-by-nc")], key=str)
    assert li.scan_licenses(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0


# Toxicity


def toxic_corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zzdumb", "zzvile", "zzfool"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "ly", "ness", "."]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def write_toxic(spark, tmp_path, rows, labels):
    spark.createDataFrame([(i, t, "en", 0.5) for i, t, *_ in rows], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_op3_on_held_out_documents(spark, tmp_path):
    rows = toxic_corpus()
    d = write_toxic(spark, tmp_path, rows + [(None, None, 0), (5000, "", 0), (5000, "word " * 30_000, 0)], [(i, 1, x) for i, _, x in rows] + [(0, None, None), (None, 1, 1), (1, 1, rows[1][2])])
    found = toxicity.op3_toxicity(spark, d).collect()
    assert len(found) == len(rows) + 3
    truth = {i: x for i, _, x in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    wrong = [r for r in held if r.predicted != truth[r.doc_id]]
    assert len(held) > 100 and len(wrong) <= 0.03 * len(held)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = toxicity.reject_toxic(spark, docs, d)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if not r.predicted)


def test_labels_of_held_out_documents_change_nothing(spark, tmp_path):
    rows = toxic_corpus(400)
    flip = lambda i, x: 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x
    one = write_toxic(spark, tmp_path / "1", rows, [(i, 1, x) for i, _, x in rows])
    two = write_toxic(spark, tmp_path / "2", rows, [(i, 1, flip(i, x)) for i, _, x in rows])
    assert sorted(map(tuple, toxicity.op3_toxicity(spark, one).collect())) == sorted(map(tuple, toxicity.op3_toxicity(spark, two).collect()))


def test_op3_without_labels_or_documents(spark, tmp_path):
    d = write_toxic(spark, tmp_path, [(1, "a b")], [])
    assert toxicity.op3_toxicity(spark, d).first().predicted == 0
    d = write_toxic(spark, tmp_path / "e", [], [(1, 1, 1)])
    assert toxicity.op3_toxicity(spark, d).count() == 0


ALL_LEVELS = toxicity.Rule(0.0, 2.0, (0, 1, 2, 3))


def test_risk_stays_above_zero():
    """With positives among the unlabelled, the uncorrected risk would push them all to the negative side."""
    rng = np.random.default_rng(0)
    common = lambda: rng.integers(1000, 2000, 20).astype(np.int32)
    positives = [np.unique(np.append(common(), np.int32(7))) for _ in range(60)]
    unlabelled = [np.unique(np.append(common(), np.int32(7))) for _ in range(30)] + [np.unique(common()) for _ in range(270)]
    every = np.unique(np.concatenate(positives + unlabelled))
    model = toxicity.fit(every, positives, unlabelled, 0.1, (ALL_LEVELS,))
    assert model.weights[7] + model.bias > 0 > model.bias
    assert toxicity.fit(every, [], unlabelled, 0.0).score("x") < 0.5


def plain_fit(x_p, x_u, prior, steps):
    """The same risk, gradient by gradient, over dense matrices."""
    w, b = np.zeros(x_p.shape[1]), np.log(prior / (1 - prior))
    moments = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    for t in range(1, steps + 1):
        z_p, z_u = x_p @ w + b, x_u @ w + b
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        plus = [(-(1 - s_p)[:, None] * x_p).mean(0), -(1 - s_p).mean()]
        minus_p, minus_u = [(s_p[:, None] * x_p).mean(0), s_p.mean()], [(s_u[:, None] * x_u).mean(0), s_u.mean()]
        rest = np.log1p(np.exp(z_u)).mean() - prior * np.log1p(np.exp(z_p)).mean()
        g = [prior * a + c - prior * m if rest >= 0 else prior * m - c for a, m, c in zip(plus, minus_p, minus_u)]
        g = np.append(g[0] + toxicity.DECAY * w, g[1])
        moments = [0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g**2]
        step = toxicity.RATE * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_fit_equals_plain_numpy(prior):
    rng = np.random.default_rng(3)
    x_p, x_u = ((rng.random((n, 12)) < q).astype(float) for n, q in ((40, np.linspace(0.9, 0.3, 12)), (150, np.linspace(0.1, 0.2, 12))))
    features = np.arange(12, dtype=np.int32) * 4
    as_rows = lambda x: [features[r > 0] for r in x]
    model = toxicity.fit(features, as_rows(x_p), as_rows(x_u), prior, (toxicity.Rule(0.0, -1e9, (0,)),))
    kept = [i for i, f in enumerate(features.tolist()) if f in model.weights]
    assert len(kept) > 5
    w, b = plain_fit(x_p[:, kept], x_u[:, kept], prior, toxicity.STEPS)
    assert np.allclose([model.weights[int(features[i])] for i in kept], w, atol=1e-6) and math.isclose(model.bias, b, abs_tol=1e-6)


def test_score_equals_plain_sum():
    rng = random.Random(2)
    words = ["fool", "Foolish,", "fools!", "plain", "words", "(vile)", "vilest", "a", "*", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(50)]
    every = sorted({int(f) for t in texts for f in toxicity.features(t)})
    model = toxicity.Classifier({f: rng.uniform(-1, 1) for f in every if rng.random() < 0.6}, -0.3)
    for t in texts:
        tokens = [w.strip(toxicity.STRIP) for w in t.lower().split()]
        counts = {}
        for w in tokens:
            for name in {w, *(w[:k] + "~" * k for k in toxicity.PREFIXES if len(w) > k)} - {""}:
                counts[name] = counts.get(name, 0) + 1
        stem = lambda n: toxicity.stems(n.rstrip("~") + ("x" if "~" in n else ""))[0 if "~" not in n else -1]
        found = {stem(n) << 2 | k for n, c in counts.items() for k in toxicity.levels(c, len(tokens))}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in found)
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-z)), abs_tol=1e-9)


def test_rule_is_chosen_by_what_other_folds_teach():
    """Levels beyond the first are noise here: the rule with them fits the sample and not the fold left out."""
    rng = np.random.default_rng(5)
    noise = lambda: (rng.integers(100, 4000, 60) << 2 | 1).astype(np.int32)
    positives = [np.unique(np.append(noise(), np.int32(28))) for _ in range(60)]
    unlabelled = [np.unique(np.append(noise(), np.int32(28))) for _ in range(20)] + [np.unique(noise()) for _ in range(180)]
    every = np.unique(np.concatenate(positives + unlabelled))
    model = toxicity.fit(every, positives, unlabelled, 0.1, (toxicity.Rule(0.0, 1.0, (1,)), toxicity.Rule(0.0, 1.0, (0,))))
    assert set(model.weights) == {28}


def test_unlabelled_text_is_of_all_documents(spark, tmp_path, monkeypatch):
    """Documents that nobody labelled are drawn too, those that are held out aren't."""
    rows = toxic_corpus(300)
    d = write_toxic(spark, tmp_path, rows, [(i, 1, x) for i, _, x in rows[:60]])
    drawn = []
    whole = toxicity.sample_features
    monkeypatch.setattr(toxicity, "sample_features", lambda docs, chosen: drawn.extend(chosen.collect()) or whole(docs, chosen))
    toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    training = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5}
    assert {r.chosen_id for r in drawn if not r.toxic} == training
    assert {r.chosen_id for r in drawn if r.toxic} == {i for i, _, x in rows[:60] if x and i in training}


def test_a_repeated_row_is_one_of_the_sample(spark, monkeypatch):
    """Rows of one id, repeated beyond both bounds, leave the sample its size; of texts that share an id the least counts."""
    rows = [(1, "b toxic", "x"), (1, "a toxic", "x")] * 700 + [(i, f"text {i}", "x") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(1, 400)], "doc_id long, quality int, toxic int")
    sizes, texts = [], []
    whole = toxicity.sample_features

    def watched(docs, chosen):
        found = whole(docs, chosen)
        sizes.append((chosen.where("toxic = 0").count(), chosen.where("toxic = 1").count(), found.count()))
        texts.extend(len(r.features) for r in found.collect())
        return found

    monkeypatch.setattr(toxicity, "sample_features", watched)
    toxicity.train(docs, labels, positives=20, unlabelled=100)
    assert sizes == [(100, 20, 120)]
    everyone = spark.createDataFrame([(1, 0)], "chosen_id long, toxic int")
    assert whole(docs, everyone).first().features == toxicity.features("a toxic").tolist()


def test_rules_tried_in_tasks_give_the_same(spark):
    rng = np.random.default_rng(4)
    positives, unlabelled = ([np.unique(rng.integers(0, 60, 12)) * 4 for _ in range(n)] for n in (30, 80))
    every = np.unique(np.concatenate(positives + unlabelled))
    one, other = (toxicity.fit(every, positives, unlabelled, 0.1, spark=s) for s in (None, spark))
    assert one.weights == other.weights and one.bias == other.bias


def test_long_training_texts_keep_all_their_words(spark, tmp_path):
    """Toxic words have the highest hashes of texts of more than 40,000 features."""
    filler = [f"{i:x}" for i in range(60_000)]
    words = sorted((f"zz{i}" for i in range(4000)), key=lambda w: toxicity.stems(w)[0])[-3:]
    filler = [w for w in filler if max(toxicity.stems(w)) < min(toxicity.stems(w)[0] for w in words)]
    rows = [(i, " ".join([*filler, *(words if i % 4 == 0 else ["plain"] * 3)]), int(i % 4 == 0)) for i in range(40)]
    d = write_toxic(spark, tmp_path, rows, [(i, 1, x) for i, _, x in rows])
    assert min(len(toxicity.features(t)) for _, t, _ in rows) > 40_000
    assert {r.doc_id for r in toxicity.op3_toxicity(spark, d).where("predicted = 1").collect()} == {i for i, _, x in rows if x}


# Mixing


def duck(tmp_path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return con


def mixed(spark, tmp_path, n=2000, more=[]):
    rng = random.Random(9)
    rows = [(i, " ".join(["word"] * rng.randint(1, 40)) + rng.choice(["", "", " | x", " @"]), rng.choice(["en", "de", None]), rng.choice(["big"] * 3 + ["a", "b", None]), 1.5) for i in range(n)]
    rows += [(None, None, "en", "a", 0.0), (None, "no id", "en", "a", 0.0), (3, "", None, None, 0.0), (3, "", None, None, 0.0)]
    rows = [] if more is None else rows + more
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, prob double").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("more", [[], [(9999, "long " * 30_000, "fr", None, 0.0)], None], ids=["plain", "very long", "empty"])
def test_op6_equals_sql(spark, tmp_path, more):
    d = mixed(spark, tmp_path, more=more)
    found = sorted(map(tuple, mixing.op6_mixing(spark, d).select("doc_id", "source", "lang", "topic", "n_tokens", "prob", "kept").collect()), key=str)
    expected = sorted(duck(tmp_path, "documents").sql(mixing.oracle()).fetchall(), key=str)
    assert [(*r[:5], round(r[5], 4), r[6]) for r in found] == [(*r[:5], round(r[5], 4), r[6]) for r in expected]


def test_sample_meets_its_marginals(spark, tmp_path):
    rows = mixing.with_cells(spark.read.parquet(f"{mixed(spark, tmp_path)}/documents.parquet"))
    cells = rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("base")).where("base > 0").cache()
    targets = {d: mixing.target_shares(cells, d) for d in mixing.DIMENSIONS}
    one = mixing.rake(cells, targets, keep=0.4, rounds=20).collect()
    many = mixing.rake(cells, targets, keep=0.4, rounds=20, one_task_rows=0).collect()
    key = lambda r: (r.source, r.lang, r.topic)
    assert {key(r) for r in one} == {key(r) for r in many}
    w = {key(r): r.w for r in many}
    assert all(math.isclose(r.w, w[key(r)], rel_tol=1e-9) and 0 <= r.w <= r.base * (1 + 1e-12) for r in one)
    total = sum(r.w for r in one)
    for i, d in enumerate(mixing.DIMENSIONS):
        for t in targets[d].collect():
            assert math.isclose(sum(r.w for r in one if key(r)[i] == t[0]) / total, t.share, abs_tol=0.01)
    sampled = mixing.sample(rows, keep=0.4).where("kept").agg(F.sum("n_tokens")).first()[0]
    assert math.isclose(sampled / rows.agg(F.sum("n_tokens")).first()[0], 0.4, abs_tol=0.04)


def test_op6_meets_its_targets(spark, tmp_path):
    rows = mixing.with_cells(spark.read.parquet(f"{mixed(spark, tmp_path)}/documents.parquet"))
    raked = mixing.probabilities(rows).where("base > 0").cache()
    targets = {d: mixing.feasible_shares(raked, d, mixing.target_shares(raked, d)) for d in mixing.DIMENSIONS}
    assert mixing.residual(raked, targets) <= mixing.TOLERANCE
    assert math.isclose(raked.agg(F.sum("w") / F.sum("base")).first()[0], mixing.KEEP, abs_tol=1e-3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["license", " | ", "@", "!!!!", "password", "x", "\t", "secret "]), max_size=8).map("".join), min_size=1, max_size=10))
def test_topics(spark, texts):
    found = [r.topic for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.topic_of(F.col("t")).alias("topic")).collect()]
    for t, topic in zip(texts, found):
        counts = [sum(t.count(m) for m in marks) for _, marks in mixing.TOPICS]
        assert topic == ("prose" if not max(counts) else mixing.TOPICS[counts.index(max(counts))][0])


def test_rows_without_id_are_drawn_by_text(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"{i % 200} " + "word " * 20, "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    kept = [r.text for r in mixing.mix(spark, docs, str(tmp_path)).collect()]
    assert 0.4 * 400 < len(kept) < 0.8 * 400 and all(kept.count(t) == 2 for t in kept)


def test_mix_stage(spark, tmp_path):
    d = mixed(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = mixing.mix(spark, docs, d)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in mixing.op6_mixing(spark, d).where("kept").collect())
    assert mixing.mix(spark, docs.limit(0), d).count() == 0


def test_mix_stage_hands_on_what_topics_lack(spark, tmp_path):
    """Tempered shares ask the small topics for more than they have."""
    rng = random.Random(10)
    ends = rng.choices(["", " | x", " @", " !!", " license"], [90, 4, 2, 1.5, 2.5], k=20_000)
    docs = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(1, 40)) + e, rng.choices(["en", "de"], [3, 1])[0], rng.choice("abc")) for i, e in enumerate(ends)], "doc_id long, text string, lang string, source string")
    rows = mixing.with_cells(docs)
    kept = mixing.with_cells(mixing.mix(spark, docs, str(tmp_path)))
    whole = rows.agg(F.sum("n_tokens")).first()[0]
    assert math.isclose(kept.agg(F.sum("n_tokens")).first()[0] / whole, mixing.KEEP, abs_tol=0.01)
    cells = rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("base")).where("base > 0").cache()
    targets = {d: mixing.feasible_shares(cells, d, mixing.target_shares(cells, d)) for d in mixing.DIMENSIONS}
    raked = mixing.rake_to_targets(cells, targets)
    found = mixing.marginals(raked, targets).collect()
    has = {(d, r[0]): r[1] / whole for d in mixing.DIMENSIONS for r in cells.groupBy(d).agg(F.sum("base")).collect()}
    assert all(abs(r.wanted - r.got) <= mixing.TOLERANCE and r.wanted <= has[r.dimension, r.category] * (1 + 1e-9) for r in found)
    assert {r.category for r in found if math.isclose(r.wanted, has[r.dimension, r.category])} == {"table", "contact", "shout", "legal"}
    assert all(math.isclose(sum(r.wanted for r in found if r.dimension == d), mixing.KEEP) for d in mixing.DIMENSIONS)


# Quality


def test_op10_equals_sql(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(3000):
        good = rng.random() < 0.7
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(15, 80))]
        if not good:
            words = [w + rng.choice(["###", "!!", ""]) for w in words]
        text = "\n".join([" ".join(words)] * (1 if good else rng.choice([1, 1, 2])))
        rows.append((i, text, rng.choice(["en", "en", "de"])))
        labels.append((i, int(good), 0))
    edge = [(None, None, None), (4000, "", "en"), (4001, " \n\t ", "en"), (4002, "x y\n\nx y\n x y", "fr"), (4003, "one two three four five six seven eight " * 2000, "en"), (4004, "é# ﬁ|<> " * 30, "en"), (5, "again", "en"), (4005, "a b c d e f g h\n" * 3, "en")]
    rows += edge
    labels += [(1, 1, 0), (2, None, 0), (None, 1, 0), (99999, 1, 0)]
    rows += [r for r in rows[:40] for _ in range(60)]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duck(tmp_path, "documents", "labels")
    found = sorted(map(tuple, quality.op10_quality(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted(con.sql(quality.oracle()).fetchall(), key=str)
    by = {r[0]: r for r in found}
    assert by[4000][1:] == (0, 0, 0, 0, 0, True, False) and by[4003][5] == 16_000 and by[4002][4] == 1
    truth = {i: q for i, q, _ in labels if q is not None}
    good = [r for r in found if truth.get(r[0]) == 1 and not r[6]]
    bad = [r for r in found if truth.get(r[0]) == 0 and not r[6]]
    assert sum(not r[7] for r in good) <= quality.FALSE_REJECTION * len(good) and sum(not r[7] for r in bad) > 0.5 * len(bad)


def plain_repeat(words, size=8):
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({j for p in seen.values() if len(p) > 1 for i in p for j in range(i, i + size)})


def test_a_repeated_document_counts_once(spark):
    """Good documents repeated 2,000 times are no more evidence than once."""
    few = [(i, "en", 0.0, 0.0, 0.0, 0.0) for i in range(3)]
    columns = ", ".join(f"{r} double" for r in quality.RULES)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    for rows in (few, few * 2000):
        assert quality.cutoffs(spark.createDataFrame(rows, f"doc_id long, stratum string, {columns}"), labels).count() == 0
    many = [(i, "en", *[0.0] * 4) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    assert quality.cutoffs(spark.createDataFrame(many, f"doc_id long, stratum string, {columns}"), labels).count() == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=20))
def test_repeat_words(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.n for r in df.select("i", quality.let(quality.words_of(F.col("t")), quality.repeat_words).alias("n")).collect()}
    assert found == {i: plain_repeat(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "k", "p"), [(100, 0, 0.01), (1000, 3, 0.01), (50, 10, 0.3), (20_000, 150, 0.01)])
def test_binomial_tail(spark, n, k, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert math.isclose(spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("v")).first().v, exact, rel_tol=1e-9)


def test_op10_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.op10_quality(spark, str(tmp_path)).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in c.STAGES] == ["toxicity", "simhash", "substrings", "mixing", "bpe"]
    for name, stage in c.STAGES:
        out = stage(spark, docs, d).cache()
        assert out.count() <= before
        if name != "bpe":
            assert out.columns == columns
        if name == "substrings":
            assert out.count() == before
        docs, before = out, out.count()
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, c.run(spark, d).collect()))


def test_registry():
    from parley.llm.queries import QUERIES, SQL

    assert sorted(QUERIES, key=lambda q: (len(q), q))[:3] and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(SQL) <= set(QUERIES)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_mixing", "op7_substrings", "op9_warc", "op10_quality"])
def test_queries_equal_their_sql(spark, name):
    from parley.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SMALL}/{f}'")
    found, expected = QUERIES[name](spark, SMALL).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    text = lambda df: sorted(df[columns].astype(object).where(df[columns].notna(), None).astype(str).itertuples(index=False, name=None))
    assert text(found) == text(expected)
