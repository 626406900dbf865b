"""Hashes of JSON documents that ignore the order of scalar lists and of keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the order of scalars, by type name and text, which hashes must agree on.
def canonical(value):
    """The value with every list of scalars alone sorted by type and text; other lists keep their order."""
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    items = [canonical(v) for v in value]
    return items if any(isinstance(v, (dict, list)) for v in items) else sorted(items, key=lambda v: (str(type(v)), str(v)))


def canonical_text(document: str | None) -> str | None:
    """JSON with sorted keys and canonical lists; null for null and for what isn't JSON. Of repeated keys the last counts."""
    if document is None:
        return None
    try:
        return json.dumps(canonical(json.loads(document)), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def canonical_json(document) -> Column:
    """Canonical form of any depth; no built-in function sorts lists inside JSON."""

    def run(documents: pd.Series) -> pd.Series:
        return documents.map(canonical_text, na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")(document)


def indented_json(document) -> Column:
    """The document with an indent of two, its keys in their order, in ASCII; null for null, other text as it is."""

    def one(text: str) -> str:
        try:
            return json.dumps(json.loads(text), indent=2)
        except ValueError:
            return text

    def run(documents: pd.Series) -> pd.Series:
        return documents.map(one, na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")(document)


def content_hash(document) -> Column:
    return F.sha2(canonical_json(document), 256)


def text_hash(text) -> Column:
    """The hash of a rebuilt document: of its text as it is."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)
