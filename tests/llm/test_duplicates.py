"""SimHash groups and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import simhash, substrings
from parley.llm.common import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "x\x85y", " ", "\n", "\x0b", "word ", "É "]), max_size=40).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h % (1 << 64) == simhash.fingerprint(b"A b c")


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 1 << 30))
def test_links_join_what_is_near(spark, seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    ours = {}
    for f, u in signed.items():
        ours.setdefault(found.get(f, f), set()).add(u)
    theirs = {}
    for n, r in groups(near, fps).items():
        theirs.setdefault(r, set()).add(n)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = groups(edges, {n for e in edges for n in e})
    assert found == {n: r for n, r in expected.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    rows, base = [], sentence(rng, 300)
    for i in range(40):
        text = base if i % 4 == 0 else sentence(rng, rng.choice([0, 1, 2, 12, 13, 14, 60]))
        if i % 4 == 0 and i % 8:
            text = text.replace("alpha beta", "alpha  BETA", 2)
        if i % 5 == 0:
            text += " " + base[: rng.randint(50, 400)]
        rows.append((i * 3 % 40, text))
    return rows + [(7, None), (7, base), (None, base), (None, "only here"), (3, rows[0][1]), (50, ""), (51, " \n"), (52, "word " * 20_000)]


def write(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return df


def test_op2(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows)
    fps = [plain_fingerprint(t or "") for _, t in rows]
    root = groups([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2], range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    expected = sorted(((d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, simhash.op2_simhash(spark, str(tmp_path)).collect()), key=str) == expected


def test_op2_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert simhash.op2_simhash(spark, str(tmp_path)).count() == 0


def test_one_of_each_group_stays(spark, tmp_path):
    docs = write(spark, tmp_path, [(1, "a b c d"), (2, "a b c d"), (3, "A  b c d"), (4, "x y z w"), (None, "a b c d"), (None, "q r s t"), (5, "a b c d e f g"), (5, "x y z w")])
    kept = simhash.keep_one(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d"), (4, "x y z w"), (None, "q r s t"), (5, "a b c d e f g")], key=str)
    unique = docs.where("doc_id < 5")
    assert sorted(r.doc_id for r in simhash.keep_one(spark, unique, str(tmp_path)).collect()) == [1, 4]
    assert simhash.keep_one(spark, docs.limit(0), str(tmp_path)).count() == 0


def near_copies(seed):
    """Texts of 1 to 400 words and copies in which some words are others, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for n in (1, 3, 5, 8, 9, 12, 20, 40, 55, 58, 62, 66, 75, 120, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(100_000)}" for _ in range(n)]
            for _ in range(4):
                rows.append(" ".join(words))
                for _ in range(rng.choice([0, 1, 1, 1 + n // 60])):
                    words[rng.choice([0, -1, rng.randrange(n)])] = f"w{rng.randrange(100_000)}"
                words = words + ["end"] * rng.choice([0, 0, 1])
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_balls_over_blocks_find_all_similar_texts(spark, tmp_path):
    rows = near_copies(5)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in (t.split() for _, t in rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert sum(sets[i] != sets[j] for i, j in near) > 20
    found = simhash.similar_groups(write(spark, tmp_path, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == groups(near, range(len(rows)))


def test_balls_meet_where_all_differing_bits_are_loose():
    x, y = (np.array([[v, *(1 << b for b in loose)]], np.uint32) for v, loose in ((0b1011, (0, 5, 6, 7)), (0b0010, (3, 9, 10, 11))))
    both = set(simhash.balls(x)[0].tolist()) & set(simhash.balls(y)[0].tolist())
    assert len(set(simhash.balls(x)[0].tolist())) == 1 << simhash.LOOSE and both == {0b1010}
    y[0, 0] ^= 1 << 20
    assert not set(simhash.balls(x)[0].tolist()) & set(simhash.balls(y)[0].tolist())


def test_kinds_of_sets_that_may_be_similar_overlap():
    assert all(set(simhash.kinds(n)) & set(simhash.kinds(m)) for n in range(4, 200) for m in range(n, n * 5 // 4 + 1))
    assert sum(simhash.WAVES) == simhash.BLOCKS


def plain_repeats(rows, window=13):
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, words):
        for i in range(len(ws) - window + 1):
            if d is not None:
                key = tuple(ws[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if d is not None and least[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_op7(spark, tmp_path):
    for seed in (1, 2):
        rows = corpus(seed)
        write(spark, f"{tmp_path}/{seed}", rows)
        assert sorted(map(tuple, substrings.op7_substrings(spark, f"{tmp_path}/{seed}").collect()), key=str) == sorted(plain_repeats(rows), key=str)


def test_op7_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert substrings.op7_substrings(spark, str(tmp_path)).count() == 0


def test_anchors_cover_every_window():
    rng = random.Random(3)
    a, b = sentence(rng, 200).encode().split(), sentence(rng, 200).encode().split()
    shared = b[50:63]
    a[100:113] = shared
    x, y = substrings.Runs(a), substrings.Runs(b)
    assert x.picks(13, 5)[100] - 100 == y.picks(13, 5)[50] - 50 and x.of(13)[100] == y.of(13)[50]
    for runs, words in ((x, a), (y, b)):
        hashes = runs.of(5).tolist()
        assert runs.picks(13, 5).tolist() == [min(range(i, i + 9), key=lambda j: (hashes[j], j)) for i in range(len(words) - 12)]
        _, places, firsts, counts = runs.seeds(13, 5)
        assert [p for p, n in zip(places.tolist(), counts.tolist()) for _ in range(n)] == runs.picks(13, 5).tolist() and firsts[0] == 0
    assert len(substrings.Runs([]).picks(13, 5)) == 0 == len(substrings.Runs(a[:12]).seeds(13, 5)[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=12), st.lists(st.sampled_from([b"a", b"b"]), max_size=12), st.integers(0, 11), st.integers(0, 11))
def test_extension(words, hub, i, j):
    i, j = min(i, len(words)), min(j, len(hub))
    first, end = substrings.extended(words, i, hub, j)
    assert words[first:end] == hub[first - i + j : end - i + j]
    assert first == 0 or first - i + j == 0 or words[first - 1] != hub[first - i + j - 1]
    assert end == len(words) or end - i + j == len(hub) or words[end] != hub[end - i + j]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 1 << 30))
def test_repeats_that_the_least_document_lacks(spark, seed):
    """Passages shared by some documents and cut off differently in each, around phrases that all have; ids repeat, some are null."""
    rng = random.Random(seed)
    phrase, passages = sentence(rng, 6), [sentence(rng, rng.randint(5, 30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 4)
            parts += [*p[a : len(p) - rng.randint(0, 4)], phrase, f"u{rng.random()}" if rng.random() < 0.4 else ""]
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(parts)))
    rows += rows[:5]
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("repeats").collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain_repeats(rows), key=str)


def test_maximal_repeats(spark):
    rng = random.Random(4)
    a, b = sentence(rng, 60), sentence(rng, 60)
    passage = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{a} {passage} {a[::-1]}"), (2, f"{b} {passage} tail")], "doc_id long, text string")
    found = {r.doc_id: [(x.first, x.end) for x in r.repeats] for r in substrings.repeats(df).collect()}
    assert found == {1: [], 2: [(60, 80)]}


def test_cut_keeps_spacing(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = write(spark, tmp_path, [(1, f"one\ntwo  {passage}\nthree"), (2, f"first\n\tline {passage}\nlast  line "), (3, None), (4, " keep \n me "), (5, passage)])
    cut = substrings.cut_repeats(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns
    found = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert found == {1: (f"one\ntwo  {passage}\nthree", 1), 2: ("first\n\tline last  line", 22), 3: (None, 1), 4: (" keep \n me ", 1), 5: ("", 0)}


def plain_similar(rows):
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)})
    root = groups([(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return [(d, least.get(root[i])) for i, (d, _) in enumerate(rows)]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.random()}"
    return " ".join(out)


def test_stage_links_similar_texts(spark, tmp_path):
    """Few of these copies are within two bits of three-word SimHash, and a group of them has more pairs that aren't similar."""
    rng = random.Random(6)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(len(rows) + k, edited(rng, words, n)) for k, n in enumerate([0, 1, 2, 3, 4, 6, 8, 12, 20, 3, 3, 3])]
    rows += [(1000, ""), (1001, " "), (1002, None), (1003, "one two"), (1004, "One  two"), (1005, "one")]
    docs = write(spark, tmp_path, rows)
    expected = plain_similar(rows)
    assert sum(c != d for d, c in expected) > 30
    assert sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()) == sorted(expected)
    assert sorted(r.doc_id for r in simhash.keep_one(spark, docs, str(tmp_path)).collect()) == sorted(d for d, c in expected if c == d)


def test_rows_without_id_stay_one_by_one(spark, tmp_path):
    """No id repeats, so ids alone would tell identified rows apart, but not those without one."""
    docs = write(spark, tmp_path, [(1, "a b c d"), (2, "x y z w"), (None, "a b c d"), (None, "q r s t"), (None, "u v")])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (2, "x y z w"), (None, "q r s t"), (None, "u v")], key=str)
    one = docs.where("doc_id is not null or text = 'a b c d'")
    assert sorted(r.doc_id for r in simhash.keep_one(spark, one, str(tmp_path)).collect()) == [1, 2]


def test_cluster_without_shared_folder(spark, monkeypatch):
    """A cluster whose executors share no folder is an error; a session's own options come back."""
    import pytest

    from parley.llm import common

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    common.drop_tables(common.cut(spark.range(3), "three"))
    assert spark.conf.get(key) == before

    class Elsewhere:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Elsewhere)


def test_variants_of_one_hub_are_one_group(spark):
    """A crowd whose variants have twenty hubs is one group, and what shared a hub still shares a group."""
    members = [(h, x) for h in range(1, 21) for x in range(h + 1, 31)] + [(100, 101), (100, 102)]
    found = sorted(map(tuple, simhash.merged(spark.createDataFrame(members, "hub long, fp long")).collect()))
    assert len(found) < len(members) / 6
    for h in {h for h, _ in members}:
        own = {x for g, x in members if g == h}
        assert any(own <= {x for k, x in found if k == g} for g, _ in found)


def test_a_linked_group_is_not_paired_with_itself(spark):
    rows = [(0, x) for x in range(1, 41)]
    roots = spark.createDataFrame([(x, 1) for x in range(2, 39)], "node long, root long")
    known = spark.createDataFrame([(x, 20, [0] * (simhash.SKETCH_BITS // 64)) for _, x in rows], "fp long, n long, bits array<long>")
    found = sorted(map(tuple, simhash.untried(spark.createDataFrame(rows, "hub long, fp long"), roots, known).collect()))
    assert found == sorted([(a, b) for a in (39, 40) for b in range(1, 39)] + [(40, 39)])


def test_a_crowd_around_an_edited_document_is_settled_by_runs(spark, monkeypatch):
    """The least document is the edited one, so that what all others share is beyond their extents."""
    rng, seen, shared = random.Random(11), [], substrings.shared
    passage = [f"w{rng.randint(0, 9999)}" for _ in range(40)]
    rows = [(i, " ".join([*passage[:20], "edited" if i == 0 else passage[20], *passage[21:], f"u{i}"])) for i in range(40)]
    monkeypatch.setattr(substrings, "shared", lambda pairs, *keys: seen.append(pairs.count() if keys == ("high", "low") else 0) or shared(pairs, *keys))
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("repeats").collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain_repeats(rows), key=str)
    assert 0 < max(seen) <= 6 * len(rows)  # of 13 windows each
