"""Nested JSON documents in one canonical form, and keys made of their content.

Documents come as JSON texts of any shape. The canonical form has sorted keys at every level, no white space, and none of the
members that look like credentials, at whatever depth they stand. Equal content gives equal text, and so equal keys.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the names of members that hold credentials.
SECRET_WORDS = ("api_key", "apikey", "secret", "password", "authorization", "token_value", "bearer")


def _walk(x, name: str, path: str, scrub: bool, paths: frozenset, floats: frozenset, without: bool):
    if isinstance(x, dict):
        out = {}
        for k, v in x.items():
            at = f"{path}.{k}" if path else k
            if at in paths or scrub and any(w in k.lower() for w in SECRET_WORDS) or without and v is None:
                continue
            out[k] = _walk(v, k, at, scrub, paths, floats, without)
        return out
    if isinstance(x, list):
        return [_walk(v, "", f"{path}[]", scrub, paths, floats, without) for v in x]
    if name in floats and isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x


def canonical_text(text: str | None, scrub: bool = True, paths: Sequence[str] = (), floats: Sequence[str] = (), without_nulls: bool = False) -> str | None:
    """The canonical form of one document; None where the text is null or no JSON.

    ``paths`` (``mask.path``, items of lists as ``[]``) are left out, whole numbers in members named in ``floats`` become
    decimal, and ``without_nulls`` leaves out members that are null.
    """
    if text is None:
        return None
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    doc = _walk(doc, "", "", scrub, frozenset(paths), frozenset(floats), without_nulls)
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical(doc: Column, scrub: bool = True, paths: Sequence[str] = (), floats: Sequence[str] = (), without_nulls: bool = False) -> Column:
    """``canonical_text`` of a column of JSON texts, in Arrow batches."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_text(t, scrub, paths, floats, without_nulls), na_action="ignore")

    return of(doc)


def content_key(doc: Column, **form) -> Column:
    """sha256 of the canonical form."""
    return F.sha2(canonical(doc, **form), 256)


def value_text(value: Column) -> Column:
    """A value as JSON, null included."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def document(_parts: dict[str, Column] | None = None, **members: Column) -> Column:
    """A JSON text with the given members; those of ``_parts`` are JSON texts already."""
    texts = {k: value_text(v) for k, v in members.items()} | (_parts or {})
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(v, F.lit("null"))) for k, v in texts.items()]), F.lit("}"))
