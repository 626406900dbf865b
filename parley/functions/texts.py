"""Text functions: names, chunks, labels, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LIST_SOURCE, SENDERS, TREE_SOURCE

CHUNK, NAME_LENGTH, EXCERPT, QUESTION = 4000, 150, 300, 100


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_else(value, default) -> Column:
    """``value`` unless it is null or empty."""
    return F.coalesce(F.nullif(_column(value), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def safe_filename(name, default: str = "untitled") -> Column:
    """``name`` without characters that file systems reserve, at most 150 characters long."""
    return or_else(F.substring(F.regexp_replace(_column(name), r'[\\/:*?"<>|]', "_"), 1, NAME_LENGTH), default)


def export_filename(source: str, name, extension: str) -> Column:
    return F.concat(F.lit(f"{source}-"), safe_filename(name), F.lit(f".{extension}"))


def id_from_filename(file_name, source) -> Column:
    """The stem of a file name, without the source's prefix."""
    stem, prefix = F.regexp_replace(_column(file_name), r"(?<=.)\.[^.]*$", ""), F.concat(_column(source), F.lit("-"))
    return F.when(F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1)).otherwise(stem)


def source_from_filename(file_name) -> Column:
    out = F.lit(None).cast("string")
    for s in (LIST_SOURCE, TREE_SOURCE):
        out = F.when(F.startswith(_column(file_name), F.lit(f"{s}-")), s).otherwise(out)
    return out


def chunks(text, size: int = CHUNK) -> Column:
    """The text in pieces of ``size`` characters; none of an empty or null text."""
    t = _column(text)
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(t, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def excerpt(text, length: int = EXCERPT) -> Column:
    t = _column(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.substring(t, 1, length), F.lit("...")))


def strip(text) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(_column(text), r"(?U)^\s+|\s+$", "")


def from_label(text, label: str) -> Column:
    """The text from the first ``label`` on, all of it where there is none; stars after the label go."""
    t = _column(text)
    at = F.instr(t, label)
    rest = F.when(at > 0, F.substr(t, at)).otherwise(t)
    return strip(F.regexp_replace(rest, f"^({label}:?)\\*+", "$1"))


def final_call(text) -> Column:
    return from_label(text, "THE CALL")


def one_line(text, prefix: str = "", length: int = QUESTION) -> Column:
    """White space as single spaces, behind a prefix, cut to a length."""
    return F.substring(F.concat(F.lit(prefix), strip(F.regexp_replace(_column(text), r"(?U)\s+", " "))), 1, length)


def html_escape(text) -> Column:
    t = _column(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def sender_label(source, role) -> Column:
    """Who is named above a message: of the list shape, everyone but the human is the assistant; of the tree shape, other roles name themselves."""
    r, names = F.coalesce(_column(role), F.lit("unknown")), SENDERS
    of_list = F.when(r == "human", names[LIST_SOURCE]["human"]).otherwise(names[LIST_SOURCE]["assistant"])
    of_tree = F.when(r == "user", names[TREE_SOURCE]["user"]).when(r == "assistant", names[TREE_SOURCE]["assistant"]).otherwise(r)
    return F.when(_column(source) == LIST_SOURCE, of_list).otherwise(of_tree)


def role_of_label(source, label) -> Column:
    out = F.lit(None).cast("string")
    for s, names in SENDERS.items():
        for role, name in names.items():
            out = F.when((_column(source) == s) & (_column(label) == name), role).otherwise(out)
    return out


def backoff(attempt, base: float = 10.0) -> Column:
    """Seconds to wait after a failed attempt, the first being 1."""
    return _column(attempt) * F.lit(base)
