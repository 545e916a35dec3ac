"""Canonical JSON and the identities built on it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """Sorted keys, compact, ASCII-escaped; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def sha256_hex(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_json(c: Column) -> Column:
    """The canonical form of JSON text; NULL where it isn't JSON."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else canonical(json.loads(t)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(c)


def forbidden_paths(value: object, forbidden: set[str], at: str = "") -> list[str]:
    """Dotted and indexed paths of forbidden keys, compared without case."""
    if isinstance(value, dict):
        here = [f"{at}.{k}" if at else k for k in value]
        return [p for p, k in zip(here, value, strict=True) if k.lower() in forbidden] + [x for p, v in zip(here, value.values(), strict=True) for x in forbidden_paths(v, forbidden, p)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in forbidden_paths(v, forbidden, f"{at}[{i}]")]
    return []


def forbidden_key_paths(c: Column, forbidden: set[str]) -> Column:
    """array<string> of the paths of forbidden keys in JSON text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else forbidden_paths(json.loads(t), forbidden) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")(c)


def flatten_addresses(value: object, at: str = "") -> dict[str, str]:
    """Key paths to 20-byte hex strings anywhere in a JSON value."""
    if isinstance(value, dict):
        return {k: v for key, item in value.items() for k, v in flatten_addresses(item, f"{at}.{key}" if at else key).items()}
    text = value if isinstance(value, str) else ""
    ok = len(text) == 42 and text.startswith("0x") and all(c in "0123456789abcdefABCDEF" for c in text[2:])
    return {at: text} if ok else {}
