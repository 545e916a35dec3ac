"""Strict, schema-bound readers. Types are never inferred; a damaged line refuses the whole input with its place."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME = (
    "campaign_id string, instance_id string, lineage_id string, method string, replicate bigint, ground_truth string, detected boolean, useful_proposal boolean, claim_emitted boolean, correct_claim boolean, "
    "native_witness boolean, independent_replay boolean, claim_time_seconds double, witness_time_seconds double, horizon_seconds double, availability string, first_failure string"
)
REQUIRED = ["campaign_id", "instance_id", "lineage_id", "method", "replicate", "ground_truth"]
EVENT_LOG = "schema_version int, event_id string, event_type string, campaign_id string, attempt_id string, timestamp string, payload variant, terminal boolean, monotonic_seconds double, duration_seconds double, missing_field_reasons map<string,string>"
SLOT = "struct<slot_id:string,index:int,status:string,raw_response_hash:string,candidate:variant,reason:string,canonical_ast_hash:string>"
ARCHIVE = (
    "campaign struct<campaign_id:string,lineage_id:string,instance_id:string,replicate:bigint,method:string,backbone:string,model_tag:string,config_hash:string,request_settings_hash:string>, "
    f"method_run struct<attempt_id:string,track:string,settings:variant,slots:array<{SLOT}>,provider_responses:array<variant>,budget_checks:array<variant>>, public_artifact_pack variant, public_artifact_pack_hash string"
)
VERIFICATION = (
    "campaign_id string, arm string, model_tag string, property_family string, lineage_id string, instance_id string, replicate bigint, slot_count bigint, ground_truth string, availability string, missing_reason string, "
    "outcomes array<struct<candidate:struct<campaign_id:string,attempt_id:string,lineage_id:string,instance_id:string,replicate:bigint,arm:string,slot_index:int,slot_id:string,proposal_status:string,canonical_ast_hash:string>,"
    "outcome:struct<stages:array<struct<stage:string,status:string,reason:string,elapsed_seconds:double>>,candidate_violation:boolean,property_holds:boolean,security_relevance:boolean,verified_finding:boolean,first_failure:string>>>"
)


def _refuse(condition: Column, message: Column, value: Column) -> Column:
    return F.when(condition, F.raise_error(message).cast("string")).otherwise(value)


def json_lines(spark: SparkSession, path: str, schema: str, allow_empty: bool = True) -> DataFrame:
    """JSON objects a line, by schema; blank lines and a byte order mark are skipped, any other damaged line fails the read."""
    fields = T.StructType.fromDDL(schema)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    parsed = F.from_json("value", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = raw.withColumn("_r", parsed)
    damaged = F.col("_r._bad").isNotNull() | ~F.trim("value").startswith("{")
    checked = rows.withColumn("_ok", _refuse(damaged, F.concat(F.lit("damaged line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80)), F.lit("ok")))
    out = checked.where("_ok = 'ok'").select("_r.*").drop("_bad")
    if not allow_empty and out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return out


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Campaign outcomes: six required fields, defaults for availability and horizon."""
    rows = json_lines(spark, path, OUTCOME)
    absent = F.lit(False)
    for c in REQUIRED:
        absent = absent | F.col(c).isNull()
    rows = rows.withColumn("campaign_id", _refuse(absent, F.lit("a required field is missing or has a wrong type"), F.col("campaign_id")))
    rows = rows.withColumn("replicate", F.when(F.col("replicate") <= 0, F.raise_error(F.lit("replicate must be positive")).cast("bigint")).otherwise(F.col("replicate")))
    return rows.withColumn("availability", F.coalesce("availability", F.lit("available"))).withColumn("horizon_seconds", F.coalesce("horizon_seconds", F.lit(1.0)))


def archives(spark: SparkSession, roots: dict[str, str], expected_slots: int = 8, planned: DataFrame | None = None) -> DataFrame:
    """<root>/*/campaigns.jsonl by arm: one row a file, slots complete and in place, campaigns and (pair, arm) unique."""
    out = None
    for arm, root in roots.items():
        rows = spark.read.schema(ARCHIVE).option("mode", "FAILFAST").json(f"{root}/*/campaigns.jsonl").select("*", F.col("_metadata.file_path").alias("file"), F.lit(arm).alias("arm"))
        out = rows if out is None else out.unionByName(rows)
    c = F.col("campaign")
    out = out.withColumn("pair_key", F.concat_ws("|", c["lineage_id"], c["instance_id"], c["replicate"].cast("string")))
    slots = F.col("method_run.slots")
    wrong = (F.size(slots) != expected_slots) | F.exists(F.transform(slots, lambda s, i: s["index"] != i), lambda x: x)
    bare = F.lower(c["method"]) == "t0"
    wrong = wrong | ~bare & ((F.size("method_run.provider_responses") != expected_slots) | (F.size("method_run.budget_checks") != expected_slots))
    again = (F.count("*").over(Window.partitionBy("file")) > 1) | (F.count("*").over(Window.partitionBy(c["campaign_id"])) > 1) | (F.count("*").over(Window.partitionBy("pair_key", "arm")) > 1)
    out = out.withColumn("arm", _refuse(F.coalesce(wrong, F.lit(True)) | again, F.concat(F.lit("bad archive: "), F.col("file")), F.col("arm")))
    if planned is not None:
        out = out.join(planned.select(F.col("campaign_id").alias("_p")), F.col("campaign.campaign_id") == F.col("_p"), "left_semi")
    return out


def verification_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """Nested campaigns: candidates inherit their campaign's identity, tags default to unknown."""
    rows = json_lines(spark, path, VERIFICATION)
    inherit = lambda o: F.struct(F.coalesce(o["candidate"]["campaign_id"], F.col("campaign_id")).alias("campaign_id"), o["candidate"]["slot_index"].alias("slot_index"), o["candidate"]["slot_id"].alias("slot_id"), o["candidate"]["proposal_status"].alias("proposal_status"), o["candidate"]["canonical_ast_hash"].alias("canonical_ast_hash"), o["outcome"].alias("outcome"))
    rows = rows.withColumn("model_tag", F.coalesce("model_tag", F.lit("unknown"))).withColumn("property_family", F.coalesce("property_family", F.lit("unknown")))
    return rows.withColumn("outcomes", F.transform("outcomes", inherit))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup keyed by instance_id; the last line of a key wins."""
    rows = json_lines(spark, path, schema).withColumn("_n", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in ("instance_id", "_n")]
    return rows.groupBy("instance_id").agg(F.max_by(F.struct(*rest), "_n").alias("_r")).select("instance_id", "_r.*")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EVENT_LOG)


def response_archive(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of request hash to response, a row each; bodies are decoded and must have their recorded hash."""
    response = "struct<response_hash:string,http_status:int,response_text:string,response_model:string,error:string,partial:boolean,response_body_b64:string,usage:map<string,bigint>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{response}>")).alias("request_hash", "r")).select("request_hash", "r.*")
    body = F.unbase64("response_body_b64")
    wrong = F.col("response_body_b64").isNotNull() & (F.sha2(body, 256) != F.col("response_hash"))
    return rows.withColumn("response_hash", _refuse(wrong, F.concat(F.lit("body and hash differ: "), F.col("request_hash")), F.col("response_hash"))).withColumn("body", body)


def replay_lookup(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """Each request's archived response; a miss is a row with error archive_miss."""
    hit = archive.withColumn("_hit", F.lit(True))
    return requests.join(hit, "request_hash", "left").withColumn("error", F.when(F.col("_hit").isNull(), "archive_miss").otherwise(F.col("error"))).withColumn("attempts", F.lit(1)).drop("_hit")


def files(spark: SparkSession, root: str, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(path, sha256, size) of all files under a folder, by relative path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # what follows the last mention of the folder's own name and parents
    path = F.regexp_replace(F.element_at(F.split("path", f"\\Q{root.rstrip('/').removeprefix('file://')}\\E/"), -1), "%20", " ")
    out = rows.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    for name in forbidden:
        out = out.where(~F.contains(F.lower("path"), F.lit(name)))
    return out


def checksum_report(spark: SparkSession, checksums: str, present: DataFrame) -> DataFrame:
    """Lines `sha256  path` against files: ok, malformed, missing or mismatch."""
    raw = spark.read.text(checksums).where(F.trim("value") != "")
    line = raw.select("value", F.regexp_extract("value", r"^([0-9a-f]{64})\s+(.+)$", 1).alias("want"), F.regexp_extract("value", r"^([0-9a-f]{64})\s+(.+)$", 2).alias("path"))
    j = line.join(present.select("path", F.col("sha256").alias("have")), "path", "left")
    return j.select("path", "value", F.when(F.col("want") == "", "malformed").when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "mismatch").otherwise("ok").alias("status"))


# The storage types that are kept.
STORAGE_TYPES = {"t_bool": "bool", "t_uint256": "uint256", "t_int256": "int256", "t_address": "address", "t_bytes32": "bytes32"}


def storage_layout(spark: SparkSession, path: str) -> DataFrame:
    """Storage entries with their scalar type, or the reason why one is skipped."""
    rows = spark.read.option("multiLine", True).schema("storage array<struct<label:string,type:string,slot:string,offset:int,contract:string>>").json(path).select(F.inline("storage"))
    kinds = F.create_map(*(F.lit(x) for kv in STORAGE_TYPES.items() for x in kv))
    return rows.withColumn("kind", F.try_element_at(kinds, F.col("type"))).withColumn("skipped", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported type "), F.coalesce("type", F.lit("?")))))


FINDING = "struct<id:string,category:string,check:string,type:string,location:string,message:string,description:string>"


def tool_findings(rows: DataFrame, tool: str, payload: str, dialect: str = "json_array") -> DataFrame:
    """Findings of saved tool output: an array, or the dialect that nests them in results.detectors or in findings."""
    at = {"json_array": F.from_json(payload, f"array<{FINDING}>"), "detectors": F.from_json(payload, f"struct<results:struct<detectors:array<{FINDING}>>>")["results"]["detectors"], "findings": F.from_json(payload, f"struct<findings:array<{FINDING}>>")["findings"]}[dialect]
    long = rows.select(F.posexplode(at).alias("position", "f"))
    out = long.select(F.lit(tool).alias("tool"), F.coalesce("f.id", F.concat(F.lit(f"{tool}:"), F.col("position"))).alias("finding_id"), F.coalesce("f.category", "f.check", "f.type").alias("category"), F.col("f.location").alias("location"), F.coalesce("f.message", "f.description").alias("message"))
    bad = F.col("category").isNull() | F.col("message").isNull()
    return out.withColumn("category", _refuse(bad, F.concat(F.lit("a finding lacks category or message: "), F.col("finding_id")), F.col("category")))


def test_summary(rows: DataFrame, payload: str) -> DataFrame:
    """(total, passed, failed) of every test_results map anywhere in JSON text; results without a status don't count, and no results give NULLs."""
    def walk(v: object):
        if isinstance(v, dict):
            found = v.get("test_results")
            if isinstance(found, dict):
                yield from (t["status"].lower() for t in found.values() if isinstance(t, dict) and isinstance(t.get("status"), str))
            for x in v.values():
                yield from walk(x)
        elif isinstance(v, list):
            for x in v:
                yield from walk(x)

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = list(walk(json.loads(t)))
            ok = sum(s in ("success", "passed", "pass") for s in found)
            out.append((len(found), ok, len(found) - ok) if found else (None, None, None))
        return pd.DataFrame(out, columns=["total", "passed", "failed"]).astype("Int64")

    return rows.select("*", F.pandas_udf(run, "total long, passed long, failed long")(payload).alias("summary"))
