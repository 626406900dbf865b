"""Licence scans: Aho-Corasick over tags and notice phrases; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_to_python, whole_text

# The phrases and labels of the contract, then those of the method.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("permission is hereby granted free of charge", "mit"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("cc0", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
TAG = "spdx license identifier"
# Licence identifiers of the public SPDX list, in lower case, whose label is another; then those that are their own label; then exceptions.
IDENTIFIERS = {
    "apache-2.0": "apache-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2",
    "gpl-1.0": "gpl", "gpl-1.0-only": "gpl", "gpl-1.0-or-later": "gpl", "lgpl-2.0": "lgpl", "lgpl-2.0-only": "lgpl", "lgpl-2.0-or-later": "lgpl", "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl",
    "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl",
    "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc0-1.0": "cc0", "mpl-1.1": "mpl", "mpl-2.0": "mpl", "mpl-2.0-no-copyleft-exception": "mpl",
}
OWN_LABELS = frozenset((
    "0bsd", "afl-3.0", "apache-1.0", "apache-1.1", "artistic-1.0", "artistic-2.0", "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent", "bsd-3-clause", "bsd-3-clause-clear",
    "bsd-4-clause", "bsl-1.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cddl-1.0", "cddl-1.1", "cecill-2.1", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "gfdl-1.3-only", "gfdl-1.3-or-later",
    "ijg", "isc", "lppl-1.3c", "mit", "mit-0", "ms-pl", "ms-rl", "mulanpsl-2.0", "ncsa", "odbl-1.0", "ofl-1.1", "openssl", "osl-3.0", "php-3.01", "postgresql", "psf-2.0", "python-2.0", "unicode-dfs-2016",
    "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1",
))
EXCEPTION = re.compile(r"[a-z0-9.+\-]*exception[a-z0-9.+\-]*|linux-syscall-note|gpl-cc-1\.0|shl-2\.[01]")
#: Names that a document defines itself.
OWN_NAME = re.compile(r"(?:documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+")
PERMISSIVE = frozenset(("mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "cc-by", "zlib", "unlicense", "public-domain"))
#: Bytes of words stand for themselves, A-Z for a-z, all others for a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: The words of a text, in bytes, as ``FOLD`` separates them.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What follows a tag: the expression ends at its line's end at the latest.
EXPRESSION = re.compile(rb"[ \t]*[:=][ \t]*([A-Za-z0-9.+():\- \t]+)")
TOKEN = re.compile(r"[()]|(?:DocumentRef-[A-Za-z0-9.\-]+:)?[A-Za-z0-9.+\-]+", re.IGNORECASE)


class ExpressionError(ValueError):
    """Not a licence expression."""


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: operators and, or, with (any case), parentheses, licence names. Two names in a row end the expression, as prose follows it."""
    out: list[str] = []
    held: list[str] = []
    want_name = True
    for token in TOKEN.findall(text):
        low = token.lower()
        if want_name:
            if low in PRECEDENCE or token == ")":
                raise ExpressionError(f"{token} where a licence is due")
            if token == "(":
                held.append(token)
                continue
            out.append(low)
            want_name = False
        elif low in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            want_name = True
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        else:
            break
    if want_name:
        raise ExpressionError("it ends where a licence is due")
    while held:
        if held[-1] == "(":
            raise ExpressionError("a parenthesis is not closed")
        out.append(held.pop())
    return out


def label_of(name: str) -> str:
    """The label of a licence identifier in lower case; a name that nobody knows makes no expression."""
    for known in (name, name.rstrip("+."), name.rstrip(".")):
        if known in IDENTIFIERS:
            return IDENTIFIERS[known]
        if known in OWN_LABELS or OWN_NAME.fullmatch(known):
            return known
    raise ExpressionError(f"{name} is no licence identifier")


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """The labels that the expression names, and whether a choice of its ``or`` needs allowed ones only. An exception after ``with`` lends its licence no new label."""
    held: list[str | tuple[set[str], bool]] = []

    def take() -> tuple[set[str], bool]:
        top = held.pop()
        if isinstance(top, str):
            label = label_of(top)
            return {label}, label in allowed
        return top

    for token in postfix:
        if token == "with":
            exception = held.pop()
            if not isinstance(exception, str) or not EXCEPTION.fullmatch(exception.rstrip(".")):
                raise ExpressionError("no exception after with")
            held.append(take())
        elif token in PRECEDENCE:
            (right, right_ok), (left, left_ok) = take(), take()
            held.append((left | right, left_ok or right_ok if token == "or" else left_ok and right_ok))
        else:
            held.append(token)
    return take()


@lru_cache(maxsize=4)
def _automaton(base: tuple, notices: tuple, tag: str) -> ahocorasick.Automaton:
    """Phrases between spaces, read as Latin-1 so that offsets count bytes."""
    rows: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", ((tag, ""),))):
        for phrase, label in phrases:
            rows.setdefault(f" {phrase} ".encode().decode("latin-1"), []).append((kind, label, len(phrase.split(" "))))
    found = ahocorasick.Automaton()
    for phrase, uses in rows.items():
        found.add_word(phrase, (len(phrase), uses))
    found.make_automaton()
    return found


def scan(data: bytes, base: tuple = BASE, notices: tuple = NOTICES, tag: str = TAG) -> dict:
    """What one text has: places of phrases by word, labels, expressions. Tags are where the automaton finds them; what follows one counts if all of it is an expression of known identifiers, up to a second name in a row."""
    words = data.translate(FOLD).split(b" ")
    words = [w for w in words if w]
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n_base, first, last, labels, base_labels, expressions, tags = 0, None, None, set(), set(), [], []
    at_char, at_word = 0, 0
    for end, (length, uses) in _automaton(base, notices, tag).iter(line):
        start = end - length + 1
        if start >= at_char:
            at_word += line.count(" ", at_char, start)
        else:
            at_word -= line.count(" ", start, at_char)
        at_char = start
        for kind, label, n in uses:
            if kind == "base":
                n_base += 1
                first = at_word if first is None else min(first, at_word)
                last = at_word if last is None else max(last, at_word)
                base_labels.add(label)
            elif kind == "notice":
                labels.add(label)
            else:
                tags.append(at_word + n - 1)
    permissive = None
    if tags:
        ends = [m.end() for m in WORD.finditer(data)]
        for last_of_tag in sorted(tags):
            after = EXPRESSION.match(data, ends[last_of_tag])
            if after:
                try:
                    named, ok = evaluate(to_postfix(after[1].decode("latin-1")))
                except ExpressionError:
                    continue
                labels |= named
                permissive = ok if permissive is None else permissive and ok
                expressions.append(after[1].decode("latin-1").strip())
    labels |= base_labels
    if "gpl-3" in labels or "gpl-2" in labels:
        labels.discard("gpl")
    score = 1.0 if expressions else 0.9 if base_labels else 0.6 if labels else 0.0
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score, "permissive": permissive, "expressions": expressions}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """A row for each row of ``docs``. Null texts are empty; a text without labels has empty strings, score 0 and permissive null."""
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())]
    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py(), base, notices) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], k) for n, k in zip(names[1:], kinds))], names=names)

    return texts_to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, SCAN)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` by ``scan_licenses``; repeated rows repeat, a null doc_id stays null, an empty table gives no rows, other columns aren't read."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
