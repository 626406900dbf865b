"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

A prefix of a word has exactly one last token in its encoding, and the encoding of the prefix is that of what stands before the token, followed by it. A
token that ends at a prefix is its last one exactly if it can stand beside the last token of what is before it: no merge across their border would come
before the merges that made them. So one pass over all tokens that end at each position, longest first, finds the encoding; nothing is merged or undone.
A suffix automaton of the vocabulary gives these tokens: its state after a prefix is the longest end of the prefix that occurs in any token."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_to_python, whole_text

#: Words kept with their ids in a Python worker, twice: those of late and those from before. It bounds memory, not results.
KEPT_WORDS = 250_000
KEPT_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent(dict):
    """A table that forgets what was not asked for while the last ``most`` new keys came."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class SuffixAutomaton:
    """All substrings of some words, by state; strings that end at the same places of the words share one.

    A state's strings are the ends of its longest one that are longer than the longest of the state it links to. A word is the longest string of its state,
    as it stands at its own start too, where nothing precedes it; so a state stands for one word at most."""

    def __init__(self, words: dict[bytes, int]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, tuple[int, int]] = {}
        for word, token in words.items():
            state = 0
            for byte in word:
                state = self._extended(state, byte)
            own[state] = (token, len(word))
        self._ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)  # by state: the words that end where its longest string ends, longest first
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            above = self._ends[self.link[state]]
            self._ends[state] = (own[state], *above) if state in own else above
        #: Strings that were reached, by number: what each is, the string after each byte that followed it, and the words at its end. No more than the words have substrings.
        self._strings: list[tuple[int, int]] = []
        self._numbers: dict[tuple[int, int], int] = {}
        self.after: list[dict[int, int]] = []
        self.words: list[tuple[tuple[int, int], ...]] = []
        self._number(0, 0)

    def _number(self, state: int, held: int) -> int:
        """The number of the string of ``held`` bytes in ``state``."""
        found = self._numbers.get((state, held))
        if found is None:
            found = self._numbers[state, held] = len(self._strings)
            self._strings.append((state, held))
            self.after.append({})
            self.words.append(() if not state else self._ends[state] if held == self.length[state] else self._ends[self.link[state]])
        return found

    def step(self, string: int, byte: int) -> int:
        """The longest end of the string and ``byte`` that is in a word; kept in ``after``."""
        state, held = self._strings[string]
        while state and byte not in self.go[state]:
            state = self.link[state]
            held = self.length[state]
        to = self.go[state].get(byte)
        found = self.after[string][byte] = 0 if to is None else self._number(to, held + 1)
        return found

    def _added(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, state: int, byte: int) -> int:
        """The state of the longest string of ``state`` with ``byte`` after it: cut off from the state that it is in, where that has longer ones."""
        after, size = self.go[state][byte], self.length[state] + 1
        if self.length[after] == size:
            return after
        part = self._added(size, dict(self.go[after]), self.link[after])
        self.link[after] = part
        while state >= 0 and self.go[state].get(byte) == after:
            self.go[state][byte] = part
            state = self.link[state]
        return part

    def _extended(self, state: int, byte: int) -> int:
        if byte in self.go[state]:
            return self._split(state, byte)
        new = self._added(self.length[state] + 1, {}, 0)
        while state >= 0 and byte not in self.go[state]:
            self.go[state][byte] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, byte)
        return new


class Tokenizer:
    """Encodes as a byte-level BPE file of the tokenizers library does; added tokens are found in the text first."""

    def __init__(self, path: str, pattern: str, kept_words: int = KEPT_WORDS):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        spell = lambda s: bytes(letters[c] for c in s)
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if all(c in letters for c in s):
                self.bytes_of[i] = spell(s)
        self.rank: dict[int, int] = {}  # of the pair left * size + right
        self.made: dict[int, int] = {}  # the token that the pair merges to
        self.parts: dict[int, tuple[int, int]] = {}
        self.size = size
        first_rank: dict[int, int] = {}
        for r, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left * size + right] = r
            self.made[left * size + right] = whole
            if whole not in self.parts:
                self.parts[whole], first_rank[whole] = (left, right), r
        self.rank_of = [first_rank.get(i, -1) for i in range(size)]
        self.matches = SuffixAutomaton({b: i for i, b in enumerate(self.bytes_of) if b and (len(b) == 1 or i in self.parts)})
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spaces_split = pattern == default_pattern()
        # The library's \s is Unicode's White_Space; that of regex has four more control characters.
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.length_of = list(map(len, self.bytes_of))
        self._beside: dict[int, bool] = {}
        self._parts = Recent(kept_words)
        self._decimal_of, self._bytes_of = list(map(str, range(size))).__getitem__, self.bytes_of.__getitem__
        self.signs = {c: self._packed(self.encode_word(c.encode())) for c in map(chr, range(33, 127)) if not c.isalnum()}

    def can_stand(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side.

        Looks at the pair of parts at the border, from the two tokens down: each pair that merges, and would do so before the later of the merges that
        swallow its parts, breaks them. Of the two, the part made last is opened first, as it was the other's neighbour for the shorter time."""
        key = left * self.size + right
        found = self._beside.get(key)
        if found is not None:
            return found
        rank, parts, size = self.rank, self.parts, self.size
        a, b, before_a, before_b = left, right, 1 << 60, 1 << 60
        # before_x: rank of the merge that swallows x. A border pair (x, y) exists from when both are made up to the first of these.
        while True:
            r = rank.get(a * size + b)
            # At equal rank the left merge goes first: what swallows x lies left of the border, what swallows y right of it.
            if r is not None and r < before_a and r <= before_b:
                found = False
                break
            made_a, made_b = self.rank_of[a], self.rank_of[b]
            if made_a < 0 and made_b < 0:
                found = True
                break
            if made_a > made_b:
                before_a, a = made_a, parts[a][1]
                # b stays: it is still swallowed by what swallowed it before
            else:
                before_b, b = made_b, parts[b][0]
        if len(self._beside) > KEPT_PAIRS:
            self._beside.clear()
        self._beside[key] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the last token of every prefix, then back from the end."""
        last, beside, size = [-1] * (len(word) + 1), self._beside, self.size
        after, words, string = self.matches.after, self.matches.words, 0
        for end, byte in enumerate(word, 1):
            to = after[string].get(byte)
            string = self.matches.step(string, byte) if to is None else to
            for token, n in words[string]:
                if n == end:  # nothing stands before it
                    last[end] = token
                    break
                left = last[end - n]
                if left >= 0:
                    fits = beside.get(left * size + token)
                    if fits is None:
                        fits = self.can_stand(left, token)
                    if fits:
                        last[end] = token
                        break
        ids, at, lengths = [], len(word), self.length_of
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"the vocabulary cannot spell byte {word[at - 1]}")
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The pre-tokens with id -1, and the added tokens with theirs."""
        for part in self.split_added.split(text) if self.split_added else (text,):
            if part in self.added:
                yield part, self.added[part]
            else:
                for w in self.words(part):
                    yield w, -1

    def encode(self, text: str) -> list[int]:
        return [i for w, known in self.pieces(text) for i in ([known] if known >= 0 else self.encode_word(w.encode()))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes_of, ids)).decode("utf-8", "replace")

    def _packed(self, ids: list[int]) -> tuple[str, int, bytes]:
        """The ids as decimals, their number, and the bytes that they decode to."""
        return ",".join(map(self._decimal_of, ids)), len(ids), b"".join(map(self._bytes_of, ids))

    def _digest_of(self, text: str) -> tuple[str, int, bytes]:
        """The same of text without added tokens."""
        return self._packed([i for w in self.words(text) for i in self.encode_word(w.encode())])

    def _chunk(self, c: str) -> tuple[str, int, bytes]:
        """The same of a space and ``c``, which neither begins nor ends with white space; kept, as is the word before a last sign."""
        if c.isalpha():
            found = self._packed(self.encode_word(b" " + c.encode()))
        elif c[-1] in self.signs and c[:-1].isalpha():
            word, sign = self._parts[c[:-1]] or self._chunk(c[:-1]), self.signs[c[-1]]
            found = word[0] + "," + sign[0], word[1] + sign[1], word[2] + sign[2]
        else:
            found = self._digest_of(" " + c)
        if len(c) <= 64:
            self._parts.keep(c, found)
        return found

    def _chunks(self, text: str) -> list[tuple[str, int, bytes]]:
        """The same in parts. By the default pattern a single space between two other characters always starts a pre-token, so what lies between such spaces is encoded once and kept."""
        first, *rest = text.split(" ")
        if not self.spaces_split or not first or first[-1].isspace():
            return [self._digest_of(text)]
        out = list(map(self._parts.__getitem__, rest))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    c = rest[i]
                    if not c or c[0].isspace() or c[-1].isspace():
                        return [self._digest_of(text)]
                    out[i] = self._chunk(c)
        return [self._digest_of(first), *out]

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the SHA-256 of the ids in decimal joined by commas, and that of the text which they decode to."""
        out = []
        for part in self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else (text,):
            if part in self.added:
                i = self.added[part]
                out.append((str(i), 1, self.bytes_of[i]))
            elif part:
                out += self._chunks(part)
        ids, n, back = zip(*out) if out else ((), (), ())
        text = b"".join(back).decode("utf-8", "replace")
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str, kept_words: int = KEPT_WORDS) -> Tokenizer:
    return Tokenizer(path, pattern, kept_words)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids; a null or empty text has none."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((t.encode(x.as_py()) for x in part.column(1)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts_to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((t.decode(x.as_py() or []) for x in batch.column(1)), pa.string())], names=["doc_id", "text"])

    return texts_to_python(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded again. A null text is an empty one; repeated rows repeat. kept_words: a smaller table saves memory and takes longer."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern, kept_words)
        for batch in batches:
            rows = [t.digest(x.as_py().decode("utf-8", "replace")) for x in batch.column(1)]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, DIGEST)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """A null text is an empty one, which has no tokens; a null doc_id stays null; repeated rows repeat; an empty table gives no rows; other columns aren't read."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
