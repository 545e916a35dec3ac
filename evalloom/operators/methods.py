"""Method runs replayed from archived responses: slots, candidate identities, budgets, version blocks, isolation, support and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions.canonical import canonical_json

# Status words of slots, and of the four independent status columns.
SLOT_STATUSES = ["pending", "candidate", "duplicate", "abstain", "invalid", "truncated", "refusal", "provider_failure"]
MODEL_CACHES = ["/.ollama", "/models", "/model-weights", "/weights", "/huggingface", "/hf-cache", "/transformers-cache", "/vllm-cache"]


def identity(candidate: Column) -> Column:
    """struct<hash, semantic> of a candidate as JSON text: its canonical_hash counts only if it is the hash of its body, else the whole candidate's hash counts."""
    body = F.sha2(canonical_json(F.get_json_object(candidate, "$.body")), 256)
    declared = F.get_json_object(candidate, "$.canonical_hash")
    semantic = F.when(declared.rlike("^[0-9a-f]{64}$") & F.get_json_object(candidate, "$.body").startswith("{") & (body == declared), declared)
    return F.struct(F.coalesce(semantic, F.sha2(canonical_json(candidate), 256)).alias("hash"), semantic.alias("semantic"))


def render(template: str, pack: Column) -> Column:
    """struct<prompt, sha256>: the template with the artifact pack in its one place."""
    if template.count("{artifact_pack}") != 1:
        raise ValueError("a template has exactly one {artifact_pack}")
    prompt = F.replace(F.lit(template), F.lit("{artifact_pack}"), pack)
    return F.struct(prompt.alias("prompt"), F.sha2(prompt, 256).alias("sha256"))


def run(responses: DataFrame, by: str, slot: str, identity_of: Column, most_in: int, most_out: int, model: str | None = None) -> DataFrame:
    """Slots of each attempt from its archived responses: status, reason, candidate identity.

    responses: error, partial, text, response_model, tokens_in, tokens_out. A duplicate repeats a candidate that an earlier slot got accepted; a slot
    beyond its budget is invalid and blocks none. identity_of gives a candidate's identity, NULL where the text holds none.
    """
    text, parsed = F.col("text"), F.try_parse_json("text")
    abstain = F.coalesce(F.try_variant_get(parsed, "$.abstain", "boolean"), F.lit(False))
    said = F.try_variant_get(parsed, "$.reason", "string")
    other = (F.col("error").isNull() & ~F.col("response_model").eqNullSafe(F.lit(model))) if model else F.lit(False)
    failed = F.when(F.col("tokens_in") > most_in, "input_cap_exceeded").when(F.col("tokens_out") > most_out, "output_cap_exceeded")
    rows = responses.withColumn("_id", identity_of)
    first = (
        F.when(other, F.struct(F.lit("provider_failure").alias("s"), F.lit("response_model_mismatch").alias("r")))
        .when(F.col("error").isNotNull(), F.struct(F.lit("provider_failure").alias("s"), F.col("error").alias("r")))
        .when(F.coalesce("partial", F.lit(False)), F.struct(F.lit("truncated").alias("s"), F.lit("provider_response_partial").alias("r")))
        .when(F.coalesce(F.trim(text), F.lit("")) == "", F.struct(F.lit("refusal").alias("s"), F.lit("empty_response").alias("r")))
        .when(parsed.isNull(), F.struct(F.lit("invalid").alias("s"), F.lit("response_not_json").alias("r")))
        .when(abstain, F.struct(F.lit("abstain").alias("s"), F.coalesce(said, F.lit("explicit_abstain")).alias("r")))
        .when(F.col("_id").isNotNull(), F.struct(F.lit("candidate").alias("s"), F.lit(None).cast("string").alias("r")))
        .otherwise(F.struct(F.lit("invalid").alias("s"), F.lit("candidate_not_compiled").alias("r")))
    )
    rows = rows.withColumn("_f", first).withColumn("_over", failed)
    rows = rows.withColumn("_id", F.when(F.col("_f.s") == "candidate", F.col("_id")))
    accepted = F.min(F.when(F.col("_id").isNotNull() & F.col("_over").isNull(), F.col(slot))).over(Window.partitionBy(by, "_id"))
    rows = rows.withColumn("_again", F.col("_id").isNotNull() & F.coalesce(F.col(slot) > accepted, F.lit(False)))
    spent = F.col("_over").isNotNull() & (F.col("_f.s") != "provider_failure")
    status = F.when(F.col("_again"), "duplicate").when(spent, "invalid").otherwise(F.col("_f.s"))
    reason = F.when(F.col("_again"), "duplicate_candidate").when(spent, F.col("_over")).otherwise(F.col("_f.r"))
    return rows.select(by, slot, status.alias("status"), reason.alias("reason"), F.when(status.isin("candidate", "duplicate"), F.col("_id")).alias("identity"))


def slot_errors(slots: DataFrame, by: str, slot: str, n: int) -> DataFrame:
    """(attempt, slot, error) of a ledger of n ordered slots with one terminal record each; columns status, candidate, canonical_ast_hash."""
    t = slots.withColumn("_n", F.count("*").over(Window.partitionBy(by, slot)))
    rules = {
        "out_of_bounds": (F.col(slot) < 0) | (F.col(slot) >= n), "unknown_status": ~F.col("status").isin(SLOT_STATUSES), "not_terminal": F.col("status") == "pending", "several_records": F.col("_n") > 1,
        "candidate_without_payload": (F.col("status") == "candidate") & F.col("candidate").isNull(), "payload_without_candidate": (F.col("status") != "candidate") & F.col("candidate").isNotNull(),
        "hash_without_candidate": F.col("canonical_ast_hash").isNotNull() & ~F.col("status").isin("candidate", "duplicate"), "malformed_hash": ~F.col("canonical_ast_hash").rlike("^[0-9a-f]{64}$"),
    }
    return t.select(by, slot, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("error")).distinct()


def missing_slots(slots: DataFrame, attempts: DataFrame, by: str, slot: str, n: int) -> DataFrame:
    """(attempt, slot) of slots that no record fills."""
    want = attempts.select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(slot))
    return want.join(slots.select(by, slot), [by, slot], "left_anti")


def unique_candidates(slots: DataFrame, by: str) -> DataFrame:
    """Exact distinct identities and conditional counts of each attempt."""
    return slots.groupBy(by).agg(F.count_distinct("identity").alias("unique_candidates"), F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count("*").alias("slots"))


def envelope(campaigns: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """Campaigns with their outcomes as one array in order of slots; without elapsed times the timing is marked unavailable."""
    rest = [c for c in outcomes.columns if c != key]
    timing = F.when(F.count("elapsed") == F.count("*"), F.struct(F.lit("available").alias("status"), F.sum("elapsed").alias("seconds"))).otherwise(F.struct(F.lit("unavailable").alias("status"), F.lit(None).cast("double").alias("seconds")))
    nested = outcomes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("outcomes"), timing.alias("timing"))
    return campaigns.join(nested, key, "left")


def one_model(campaigns: DataFrame, tag: str | None = None) -> DataFrame:
    """Campaigns of one model tag. Several tags and none chosen, or a tag that no campaign has, is an error."""
    if tag is not None:
        out = campaigns.where(F.col("model_tag") == tag)
        if not tag.strip() or out.isEmpty():
            raise ValueError(f"no campaign has the model tag {tag!r}")
        return out
    tags = [r[0] for r in campaigns.select("model_tag").distinct().limit(2).collect()]
    if len(tags) > 1:
        raise ValueError("several model tags; choose one")
    return campaigns


def version_block(observations: DataFrame, identity_hash: str) -> DataFrame:
    """status and reason of each observed version: drift blocks, then a failed canary; columns identity_hash, canary_passed, deviation (its reason, or NULL)."""
    drift = ~F.col("identity_hash").eqNullSafe(F.lit(identity_hash))
    bad = ~F.coalesce("canary_passed", F.lit(False))
    status = F.when(F.col("deviation").isNotNull(), "deviation").when(drift | bad, "blocked").otherwise("passed")
    reason = F.when(F.col("deviation").isNotNull(), F.col("deviation")).when(drift, "version identity drift; explicit deviation required").when(bad, "canary panel failed")
    return observations.withColumn("status", status).withColumn("reason", reason)


def status_errors(rows: DataFrame, key: str, allowed: dict[str, list[str]], required: str = "campaign_status", version: int = 1) -> DataFrame:
    """(key, error) of records of independent status columns: another mapping version, or a word that its column doesn't know; only one column must be set."""
    errors = [F.when(~F.col("status_mapping_version").eqNullSafe(F.lit(version)), "unsupported status_mapping_version")]
    for name, words in allowed.items():
        wrong = ~F.col(name).isin(words)
        errors.append(F.when(F.coalesce(wrong, F.lit(name == required)), F.concat(F.lit(f"invalid {name}: "), F.coalesce(name, F.lit("none")))))
    return rows.select(key, F.explode(F.array_compact(F.array(*errors))).alias("error"))


def parity(reference: DataFrame, adapted: DataFrame, by: str, order: str) -> DataFrame:
    """(fixture, equal, differences) of two runs: their status, and their findings id:category in order; columns status, finding_id, category."""

    def side(df: DataFrame, name: str) -> DataFrame:
        one = F.struct(F.col(order).alias("o"), F.concat_ws(":", "finding_id", "category").alias("f"))
        found = F.transform(F.array_sort(F.collect_list(F.when(F.col("finding_id").isNotNull(), one))), lambda x: x["f"])
        return df.groupBy(by).agg(F.max("status").alias(f"{name}_status"), found.alias(f"{name}_found"))

    t = side(reference, "r").join(side(adapted, "a"), by, "full")
    status = F.when(~F.col("r_status").eqNullSafe(F.col("a_status")), F.concat(F.lit("status:"), F.coalesce("r_status", F.lit("none")), F.lit("!="), F.coalesce("a_status", F.lit("none"))))
    found = F.when(~F.col("r_found").eqNullSafe(F.col("a_found")), "finding_ids_or_categories_differ")
    differences = F.array_compact(F.array(status, found))
    return t.select(by, (F.size(differences) == 0).alias("equal"), F.array_join(differences, ",").alias("differences"))


def isolation(workers: DataFrame, key: str, hosts: list[str]) -> DataFrame:
    """(key, operation, status, reason) of each worker's mounts (array of source, target, sensitivity, read_only), broadcast flag and endpoint, by the first rule that blocks."""
    place = lambda m: F.lower(F.regexp_replace(F.concat_ws("/", m["source"], m["target"]), r"[\\]+", "/"))
    cached = lambda m: F.exists(F.array(*map(F.lit, MODEL_CACHES)), lambda x: F.contains(place(m), x))
    some = lambda rule: F.coalesce(F.exists("mounts", rule), F.lit(False))
    mount = F.when(some(lambda m: m["sensitivity"] == "private_gold"), "private gold mount is forbidden").when(some(lambda m: ~m["read_only"]), "writable bind mount is forbidden").when(some(cached), "model-weight/cache mount is forbidden")
    host = F.lower(F.regexp_extract("endpoint", r"^https?://(?:[^/?#]*@)?([^/?#:]+)", 1))
    network = F.when(host == "", "endpoint must be an HTTP(S) URL").when(~host.isin(hosts), "endpoint is outside provider allowlist")
    rules = [("mount", mount, F.lit(True)), ("evm_broadcast", F.when(F.coalesce("broadcast", F.lit(False)), "execution must not broadcast"), F.lit(True)), ("network", network, F.col("endpoint").isNotNull())]
    checks = F.array_compact(F.array(*(F.when(asked, F.struct(F.lit(name).alias("operation"), F.when(why.isNull(), "allowed").otherwise("blocked").alias("status"), why.alias("reason"))) for name, why, asked in rules)))
    return workers.select(key, F.inline(checks))


def admits(required: DataFrame, support: DataFrame, by: str) -> DataFrame:
    """(by, admitted, unknown): whether all required (category, feature) pairs are supported or conditional; pairs that the matrix lacks are unknown."""
    j = required.join(support, ["category", "feature"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    return j.groupBy(by).agg(F.bool_and(F.col("status").isin("supported", "conditional")).alias("admitted"), F.count_if(F.col("status") == "unknown").alias("unknown"))


def missing_capabilities(required: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(required, allowed))


def distinct_strings(values: Column) -> Column:
    """Non-empty strings, once each, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def prefixes(values: Column) -> Column:
    """Whole numbers above 0, once each, in the order given; others fail the query."""
    wrong = F.exists(values, lambda x: x.isNull() | (x <= 0))
    return F.when(wrong, F.raise_error(F.lit("prefixes must be positive")).cast("array<int>")).otherwise(F.array_distinct(values))


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def artifact_status(contracts: DataFrame, bytecode: DataFrame, by: str) -> DataFrame:
    """Sums of functions, events and slots by lineage, and the class of its bytecode files: Missing, Incomplete or Non-empty."""
    sums = contracts.groupBy(by).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("functions", "events", "slots")))
    code = bytecode.groupBy(by).agg(F.bool_or(F.length(F.trim("hex")) <= 2).alias("_short"))
    status = F.when(F.col("_short").isNull(), "Missing").when(F.col("_short"), "Incomplete (empty/placeholder)").otherwise("Non-empty (unverified)")
    return sums.join(code, by, "left").select(by, "functions", "events", "slots", status.alias("bytecode"))


def batch_report(runs: DataFrame, events: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One long table of a worker batch: counts of runs by status, events by type and telemetry by phase."""
    part = lambda df, name, field: df.groupBy(F.lit(name).alias("part"), F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return part(runs, "runs", "status").unionByName(part(events, "events", "event_type")).unionByName(part(telemetry, "telemetry", "phase"))


# The prespecified studies: what varies, the two arms, and whether it is a diagnostic after the primary results.
STUDIES = [
    ("learned-vs-t0", "proposer", "learned", "t0", False),
    ("primitive-vs-generic-typed-core", "property_representation", "primitive", "generic", False),
    ("grounding-early-vs-deferred", "grounding_timing", "early", "deferred", False),
    ("replay-on-vs-off", "replay_filter", "replay-on", "replay-off", False),
    ("adversarial-channel-vs-fifo", "channel_mode", "adversarial", "fifo", False),
    ("gold-diagnostic-after-primary-freeze", "property_source", "automatic", "gold", True),
]


def ablation_plan(spark: SparkSession) -> DataFrame:
    """A row for each arm of each study."""
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(STUDIES)], "study int, study_id string, factor string, treatment string, control string, diagnostic boolean")
    return rows.select("study", "study_id", "factor", "diagnostic", F.posexplode(F.array("treatment", "control")).alias("side", "arm"))
