"""Report drivers: the analysis report and the paired report over outcome tables, as canonical JSON with its own hash and tables beside it."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.canonical import sha256_hex
from evalloom.operators import endpoints, inference, pairing
from evalloom.operators.methods import one_model
from evalloom.sources.sinks import write_bundle

# The endpoints of the analysis: name, ground truth and measured field.
ENDPOINTS = [("recall", "positive", "detected"), ("useful_recall", "positive", "useful_proposal"), ("false_alert", "negative", "claim_emitted"), ("witness_yield", "positive", "native_witness"), ("replay_rate", "positive", "independent_replay")]
UNIT = ["lineage_id", "instance_id", "replicate"]


def input_hash(outcomes: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order: equal rows count as often as they occur."""
    rows = outcomes.select(F.sha2(F.to_json(F.struct(*sorted(outcomes.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return sha256_hex([str(x) for x in rows.agg(F.count("*"), *(part(i) for i in range(4))).first()])


def tables(outcomes: DataFrame, comparisons: list[tuple[str, str]], draws: int, seed: int) -> dict[str, tuple[DataFrame, list[str]]]:
    """The analysis tables with the columns that order them."""
    long = outcomes.where("ground_truth <> 'unresolved'").select("method", "lineage_id", "instance_id", "ground_truth", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).alias("truth"), F.col(f).alias("v")) for m, t, f in ENDPOINTS))))
    out = {
        "endpoints": (endpoints.hierarchical_mean(long.where("ground_truth = truth"), "v", ["metric", "method"]), ["metric", "method"]),
        "false_discovery": (endpoints.false_discovery(outcomes, ["method"]), ["method"]),
        "restricted_time": (endpoints.restricted_time(outcomes, "claim_time_seconds", ["method"]), ["method"]),
        "denominators": (endpoints.denominators(outcomes, [f for _, _, f in ENDPOINTS], ["method"]), ["method", "field"]),
    }
    if comparisons:
        effects = pairing.paired_effects(outcomes.where("ground_truth = 'positive'"), comparisons, UNIT, "detected", "method", [UNIT[:2], UNIT[:1]])
        tests = inference.sign_test(effects, ["contrast"])
        family = tests.join(inference.holm(tests.select("contrast", "p"), "contrast").select("contrast", "adjusted"), "contrast").join(inference.bootstrap(effects, ["contrast"], seed, draws, 0.95), "contrast", "left")
        out |= {"effects": (effects, ["contrast", "lineage_id"]), "contrasts": (family, ["contrast"])}
    return out


def analysis(outcomes: DataFrame, directory: str, comparisons: list[tuple[str, str]] | None = None, draws: int = 10_000, seed: int = 0, expected_input_hash: str | None = None, more: dict | None = None) -> dict:
    """Write the bundle of one analysis; the report has the input's hash, the tables' rows and its own hash."""
    comparisons = comparisons or []
    methods = sorted(r[0] for r in outcomes.select("method").distinct().collect())
    if unknown := {m for c in comparisons for m in c} - set(methods):
        raise ValueError(f"compared methods without outcomes: {sorted(unknown)}")
    if any(a == b for a, b in comparisons):
        raise ValueError("a method can't be compared with itself")
    seen = input_hash(outcomes)
    if expected_input_hash not in (None, seen):
        raise ValueError(f"input hash mismatch: expected {expected_input_hash}, got {seen}")
    made = tables(outcomes, comparisons, draws, seed)
    body = {"schema_version": 1, "record_type": "analysis", "input_hash": seen, "methods": methods, "draws": draws, "seed": seed, "comparisons": [list(c) for c in comparisons], **(more or {})}
    body |= {"tables": {name: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()] for name, (df, order) in made.items()}}  # report tables: rows by method, metric, contrast or lineage
    report = {**body, "report_hash": sha256_hex(body)}
    return {"report": report, "bundle_hash": write_bundle(made, report, directory)}


def paired(campaigns: DataFrame, directory: str, prefixes: tuple[int, ...] = (1, 2, 4, 8), comparisons: list[tuple[str, str]] | None = None, draws: int = 10_000, seed: int = 0, model_tag: str | None = None, hits: str = "first_verified") -> dict:
    """An analysis for each prefix, of campaigns of one model tag: detected within the prefix where the campaign is available, else unknown.

    hits: the column with the first verified slot, NULL for none.
    """
    rows = one_model(campaigns, model_tag) if "model_tag" in campaigns.columns else campaigns
    wanted = list(dict.fromkeys(prefixes))
    if not wanted or any(not isinstance(p, int) or p <= 0 for p in wanted):
        raise ValueError("prefixes must be positive")
    out = {}
    for p in wanted:
        seen = F.when(F.col("availability") == "available", F.coalesce(F.col(hits) < p, F.lit(False)))
        at = rows.withColumn("detected", seen).withColumn("claim_emitted", seen)
        out[str(p)] = analysis(at.drop(hits), os.path.join(directory, f"prefix-{p}"), comparisons, draws, seed, more={"prefix": p})
    body = {"schema_version": 1, "record_type": "paired_analysis", "model_tag": model_tag, "prefixes": wanted, "bundles": {p: x["bundle_hash"] for p, x in out.items()}, "reports": {p: x["report"]["report_hash"] for p, x in out.items()}}
    return {**body, "report_hash": sha256_hex(body)}


def valid(report: dict) -> bool:
    """Whether a report's own hash is that of the rest of it."""
    return report.get("report_hash") == sha256_hex({k: v for k, v in report.items() if k != "report_hash"})


def main(arguments: list[str] | None = None) -> int:
    """python -m evalloom.plans.report OUTCOMES.jsonl DIRECTORY [LEFT:RIGHT ...]: the analysis of an outcome file."""
    import sys

    from pyspark.sql import SparkSession

    from evalloom.sources.readers import outcomes

    given = sys.argv[1:] if arguments is None else arguments
    if len(given) < 2:
        print(main.__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("report").getOrCreate()
    result = analysis(outcomes(spark, given[0]), given[1], [tuple(c.split(":", 1)) for c in given[2:]])
    print(json.dumps({"bundle_hash": result["bundle_hash"], "report_hash": result["report"]["report_hash"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
