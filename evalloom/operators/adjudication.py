"""Adjudication: pending records, independent labels and their reconciliation, requirement mappings, blinded ledgers with self-hashes.

A ledger is written by people, so folding one into a hash happens in one row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.canonical import canonical_json, forbidden_paths, sha256_hex
from evalloom.sources.sinks import METHOD_KEYS

# The roles of a pending record, and its public fields.
REVIEWERS = ["independent_rater_1", "independent_rater_2", "third_adjudicator"]
PUBLIC = ["instance_id", "lineage_id", "property_family", "cohort"]

FINDING = "finding_id string, instance_id string, claim string, evidence_hash string, raw_claim_hash string, root_cause_id string"
LABEL = "finding_id string, rater_id string, role string, status string, first_failure string, reason string, created_at string"
PARTS = {
    "findings": FINDING, "labels": LABEL, "reconciliations": "finding_id string, adjudicator_id string, status string, first_failure string, reason string, uncertainty_reason string, role_overlap boolean",
    "relabel_history": "finding_id string, previous_status string, new_status string, actor_id string, reason string, created_at string",
    "requirement_mappings": "finding_id string, requirement_id string, status string, reviewer_id string, reason string, created_at string",
}


def row_hash(columns: list[str]) -> Column:
    """The hash of a row's canonical JSON, nulls included."""
    return F.sha2(canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def templates(manifest: DataFrame, public: list[str] | None = None) -> DataFrame:
    """A pending record for each manifest row: public fields, the hash of the whole row, no labels."""
    return manifest.select(
        F.lit(1).alias("schema_version"), F.lit("template_pending_independent_review").alias("record_status"), F.lit("synthetic_template_not_evidence").alias("provenance_status"),
        *(public or PUBLIC), row_hash(manifest.columns).alias("source_manifest_row_hash"), F.array().cast("array<string>").alias("labels"), F.array(*map(F.lit, REVIEWERS)).alias("reviewer_roles"),
    )


def reconcile(findings: DataFrame, labels: DataFrame, adjudicator: Column) -> DataFrame:
    """(finding_id, status, first_failure, role_overlap, error) of each finding that has labels: equal labels stand, others stay unresolved.

    Errors come first: exactly two labels, of distinct raters, neither of them the adjudicator, of a known finding.
    """
    known = findings.select("finding_id").distinct().withColumn("_known", F.lit(True))
    t = labels.withColumn("_by", adjudicator).groupBy("finding_id").agg(
        F.count("*").alias("n"), F.count_distinct("rater_id").alias("raters"), F.count_distinct("role").alias("roles"), F.bool_or(F.col("rater_id") == F.col("_by")).alias("own"),
        F.min("status").alias("status"), F.max("status").alias("other"), F.min("first_failure").alias("failure"), F.max("first_failure").alias("other_failure"),
    )
    t = t.join(known, "finding_id", "left")
    error = F.when(F.col("_known").isNull(), "unknown_finding").when(F.col("n") != 2, "exactly_two_labels").when(F.col("raters") != 2, "same_rater").when(F.col("own"), "adjudicator_is_rater")
    agree = (F.col("status") == F.col("other")) & F.col("failure").eqNullSafe(F.col("other_failure"))
    fine = error.isNull()
    return t.select(
        "finding_id", F.when(fine & agree, F.col("status")).when(fine, "unresolved").alias("status"), F.when(fine & agree, F.col("failure")).when(fine, "timeout_or_unsupported").alias("first_failure"),
        F.when(fine, F.col("roles") < 2).alias("role_overlap"), error.alias("error"),
    )


def mapping_errors(mappings: DataFrame, findings: DataFrame) -> DataFrame:
    """(finding_id, error): mappings of unknown findings, and findings with several."""
    t = mappings.groupBy("finding_id").agg(F.count("*").alias("n")).join(findings.select("finding_id").distinct().withColumn("_known", F.lit(True)), "finding_id", "left")
    error = F.when(F.col("_known").isNull(), "unknown_finding").when(F.col("n") > 1, "several_mappings")
    return t.select("finding_id", error.alias("error")).where("error IS NOT NULL")


def distinct_findings(findings: DataFrame, order: str) -> DataFrame:
    """The first finding of each instance and root cause; a finding without a cause stands for itself."""
    return findings.groupBy("instance_id", F.coalesce("root_cause_id", "finding_id").alias("cause")).agg(F.min_by("finding_id", order).alias("finding_id"))


def export_id(findings: DataFrame, columns: list[str]) -> str:
    """The hash of the canonical list of findings in order of finding_id."""
    one = canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    rows = findings.select(F.struct("finding_id", one.alias("json")).alias("r")).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]).alias("rows"))
    return rows.select(F.sha2(F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")), 256)).first()[0]


def write_ledger(parts: dict[str, list[dict]]) -> str:
    """A ledger as JSON text with its own hash."""
    body = {"schema_version": 1, **{k: parts.get(k, []) for k in PARTS}}
    return json.dumps({**body, "ledger_hash": sha256_hex(body)}, sort_keys=True)


def read_ledger(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The five tables of a ledger; another hash than its own, an unknown schema or a key that names a method is refused."""
    body = json.loads(text)
    declared = body.pop("ledger_hash", None)
    if body.get("schema_version") != 1:
        raise ValueError("unsupported ledger schema")
    if declared != sha256_hex(body):
        raise ValueError("ledger hash mismatch")
    if bad := forbidden_paths(body.get("findings", []), METHOD_KEYS):
        raise ValueError(f"fields that name a method: {bad}")
    out = {}
    for name, schema in PARTS.items():
        rows = [{k: json.dumps(v, sort_keys=True) if isinstance(v, dict | list) else v for k, v in r.items()} for r in body.get(name, [])]
        out[name] = spark.createDataFrame(rows, schema)
    errors = mapping_errors(out["requirement_mappings"], out["findings"]).collect()
    if errors:
        raise ValueError(f"requirement mappings: {[tuple(e) for e in errors]}")
    return out
