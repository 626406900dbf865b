"""BPE, token files, and the tokenizers that they must equal."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parley.llm import bpe, separators
from parley.llm.common import new_folder

OURS = bpe.tokenizer(bpe.default_path(), bpe.default_pattern())
THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


def digest(text):
    ids = theirs(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))


def test_every_token_is_its_own_encoding():
    for i, spelled in enumerate(OURS.bytes_of):
        if i != 50256:
            assert OURS.encode_word(spelled) == [i]


PIECES = ["a", "b", "aa", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "你", "<|endoftext|>", "<|endof", "-", "==", "​", "\x1c", "\x85", "\xa0", " ", "　", "ing", "A", "\x00", "😀", ".", ","]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_equals_the_library(text):
    assert OURS.encode(text) == theirs(text)
    assert OURS.digest(text) == digest(text)
    assert OURS.decode(theirs(text)) == THEIRS.decode(theirs(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text("aabeinrst", max_size=60))
def test_equals_the_library_on_mergeable_letters(text):
    assert OURS.encode(text) == theirs(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 3000, "ab" * 3000, "=" * 999, "a b" * 5000])
def test_long_runs(text):
    assert OURS.encode(text) == theirs(text) and OURS.digest(text) == digest(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5).map(str.encode), min_size=1, max_size=8), st.text("abcd", max_size=20))
def test_automaton_finds_all_words_that_end(words, text):
    found = bpe.SuffixAutomaton({w: i for i, w in enumerate(words)})
    last, string = {w: i for i, w in enumerate(words)}, 0
    for end, byte in enumerate(text.encode(), 1):
        string = found.after[string].get(byte) or found.step(string, byte)
        expected = sorted(((len(w), i) for w, i in last.items() if text.encode()[:end].endswith(w)), reverse=True)
        assert [(n, i) for i, n in found.words[string]] == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "the ", " ", "x-y ", "z", ". ", "\n", "ing "]), max_size=15).map("".join))
def test_other_patterns_take_no_shortcut(text):
    own = bpe.tokenizer(bpe.default_path(), r"\p{L}+ ?|[^\p{L}]+")
    ids = own.encode(text)
    assert own.digest(text)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert own.decode(ids) == text


def test_small_caches_change_nothing(monkeypatch):
    small = bpe.Tokenizer(bpe.default_path(), bpe.default_pattern())
    small._parts = bpe.Recent(3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 2)
    text = "the quick, brown fox. jumps over; the lazy dog the quick brown fox " * 3
    assert small.digest(text) == digest(text)


def test_op5(spark, tmp_path):
    rows = [(1, "Hello  world\n", 1), (2, None, 1), (3, "", 1), (1, "Hello  world\n", 1), (None, "x" * 100_000 + " é", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, bpe.op5_bpe(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted(((i, *digest(t or "")) for i, t, _ in rows), key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = bpe.encode_ids(docs)
    assert sorted(len(r.ids) for r in ids.collect()) == sorted(len(theirs(t or "")) for _, t, _ in rows)
    assert sorted(r.text for r in bpe.decode_ids(ids).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.digests(docs.limit(0)).count() == 0


def by_hand(tokens, eod):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == eod:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(tokens) - start, False)] if start < len(tokens) else [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 1, 2, 7]), max_size=60), min_size=1, max_size=4))
def test_scan_stitches_blocks(spark, files):
    import os

    folder = new_folder(spark, "flat").removeprefix("file://")
    os.makedirs(folder)
    for i, tokens in enumerate(files):
        np.array(tokens, "<u2").tofile(f"{folder}/{i}.bin")
    uris = spark.createDataFrame([(f"file://{folder}/{i}.bin",) for i in range(len(files))], "uri string")
    found = {}
    for r in separators.scan_token_files(uris, eod=7, block_tokens=4, group_blocks=3).collect():
        found.setdefault(int(r.uri.rsplit("/", 1)[1][:-4]), []).append((r.ordinal, r.start, r.n_tokens, r.ended))
    assert {k: sorted(v) for k, v in found.items()} == {i: e for i, t in enumerate(files) if (e := by_hand(t, 7))}


def test_op4(spark, tmp_path):
    rows = [(1, "Hello  world\n", 1), (2, None, 1), (3, "", 1), (1, "Hello  world\n", 1), (None, "ab " * 50_000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, ordinal int").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id, r.n_tokens) for r in separators.op4_separators(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted(((i, len(theirs(t or ""))) for i, t, _ in rows), key=str)


def test_op4_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert separators.op4_separators(spark, str(tmp_path)).count() == 0


def test_files_roll(spark):
    import os

    docs = spark.createDataFrame([(i, "word " * 30) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "flat")
    os.makedirs(folder.removeprefix("file://"))
    placed = separators.write_token_files(docs, folder, file_tokens=100)
    assert placed.select("uri").distinct().count() > 5
    joined = separators.scan_token_files(placed.select("uri"), block_tokens=16, group_blocks=2).join(placed, ["uri", "ordinal"])
    assert sorted((r.doc_id, r.n_tokens) for r in joined.collect()) == [(i, len(theirs("word " * 30))) for i in range(40)]
