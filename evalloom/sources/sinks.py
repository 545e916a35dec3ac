"""Sinks: tables as CSV, reports as canonical JSON, keyed appends, plans, blinded exports and figures."""

from __future__ import annotations

import hashlib
import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.canonical import canonical, forbidden_key_paths, sha256_hex

# Keys that name a method's identity.
METHOD_KEYS = {"method", "method_id", "track", "backbone", "model", "model_tag", "provider", "checkpoint", "served_weight_digest"}


def write_csv(df: DataFrame, path: str) -> None:
    """Header, NULL as an empty cell, one file for each partition."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def csv_text(df: DataFrame, order: list[str]) -> str:
    """A small report table as CSV text in a fixed order, with LF endings."""
    cell = lambda v: "" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"' if any(c in str(v) for c in ',"\n') else str(v)
    return "".join(",".join(map(cell, r)) + "\n" for r in [df.columns, *(tuple(x) for x in df.orderBy(*order).collect())])


def write_bundle(tables: dict[str, tuple[DataFrame, list[str]]], report: dict, directory: str) -> str:
    """A report, its tables and a manifest with the SHA-256 of each file; returns the bundle's hash."""
    os.makedirs(directory, exist_ok=True)
    content = {"analysis.json": canonical(report) + "\n"} | {f"{name}.csv": csv_text(df, order) for name, (df, order) in tables.items()}
    hashes = {}
    for name, text in sorted(content.items()):
        with open(os.path.join(directory, name), "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        hashes[name] = hashlib.sha256(text.encode()).hexdigest()
    bundle = sha256_hex(hashes)
    with open(os.path.join(directory, "manifest.json"), "w", encoding="utf-8", newline="\n") as f:
        f.write(canonical({"files": hashes, "bundle_hash": bundle}) + "\n")
    return bundle


def put(df: DataFrame, path: str, key: str, value: str) -> None:
    """Append rows of new keys; a stored key with another value fails, with the same value it is left alone."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = df
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        have = spark.read.parquet(path).select(key, F.sha2(F.col(value).cast("string"), 256).alias("_h"))
        clash = df.join(have, key).where(F.sha2(F.col(value).cast("string"), 256) != F.col("_h"))
        if not clash.isEmpty():
            raise ValueError("a key is stored with another value")
        new = df.join(have, key, "left_anti")
    new.write.mode("append").parquet(path)


def write_plan(plan: DataFrame, path: str) -> str:
    """A JSON line for each campaign in order; returns the hash of the ordered ids."""
    plan.orderBy("order_index").write.mode("overwrite").json(path)
    folded = plan.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "campaign_id"))), lambda x: x["campaign_id"]), "\n"), 256).alias("h"))
    return folded.first()["h"]


def _field_names(kind: T.DataType) -> set[str]:
    """The names of all nested fields of a type."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind} | {n for f in kind for n in _field_names(f.dataType)}
    if isinstance(kind, T.ArrayType):
        return _field_names(kind.elementType)
    return _field_names(kind.keyType) | _field_names(kind.valueType) if isinstance(kind, T.MapType) else set()


def blinded(findings: DataFrame, keep: list[str], json: tuple[str, ...] = ()) -> DataFrame:
    """The allowed columns only. Columns, nested fields, map keys, and keys of the JSON columns that name a method are refused: the query fails.

    Maps are looked at on their first level; deeper ones belong into JSON columns.
    """
    out = findings.select(*keep)
    if bad := {n for n in _field_names(out.schema) if n.lower() in METHOD_KEYS}:
        raise ValueError(f"fields that name a method: {sorted(bad)}")
    named = F.array().cast("array<string>")
    for c in json:
        named = F.concat(named, F.coalesce(forbidden_key_paths(F.col(c), METHOD_KEYS), F.array().cast("array<string>")))
    for f in out.schema:
        if isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType):
            named = F.concat(named, F.coalesce(F.filter(F.map_keys(f.name), lambda k: F.lower(k).isin(sorted(METHOD_KEYS))), F.array().cast("array<string>")))
    digest = F.sha2(F.to_json(F.struct(*keep)), 256)
    return out.withColumn("export_id", F.when(F.size(named) > 0, F.raise_error(F.concat(F.lit("keys that name a method: "), F.array_join(named, ", "))).cast("string")).otherwise(digest))


def bar_svg(values: dict[str, float], title: str, width: int = 480, row: int = 22) -> str:
    """Horizontal bars of values in [0, 1]; no values give an empty string."""
    if not values:
        return ""
    if any(not 0 <= v <= 1 for v in values.values()):
        raise ValueError("a share lies outside [0, 1]")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{row * (len(values) + 1)}"><text x="4" y="15">{html.escape(title)}</text>']
    for i, (k, v) in enumerate(sorted(values.items()), 1):
        out.append(f'<rect x="120" y="{row * i + 4}" width="{v * (width - 180):.3f}" height="{row - 8}"/><text x="4" y="{row * i + 15}">{html.escape(k)}</text><text x="{130 + v * (width - 180):.3f}" y="{row * i + 15}">{v:.4f}</text>')
    return "".join(out) + "</svg>"
