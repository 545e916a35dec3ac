"""Reusable column expressions: missing-aware sums, ladders, identity and truth maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of the two decided truths.
TRUTHS = {"positive": ["positive", "vulnerable", "mutant", "sealed_positive"], "negative": ["negative", "patched", "control", "benign_negative"], "unresolved": ["unresolved"]}
# The order of verification stages.
STAGE_ORDER = ["grounding", "symbolic_search", "witness_check", "independent_replay"]


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def poisoned_sum(value: Column, empty_is_zero: bool = True) -> Column:
    """A sum that is NULL when any input is missing; of no input 0, or NULL."""
    total = F.when(F.count(value) == F.count("*"), F.sum(value))
    return F.when(F.count("*") == 0, F.lit(0.0)).otherwise(total) if empty_is_zero else total


def measured(value: Column) -> Column:
    """The value as double, NULL where it isn't a finite number of 0 or more."""
    v = value.cast("double")
    return F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)


def truth(value: Column) -> Column:
    """positive, negative or unresolved; an unknown alias fails the query."""
    out = F.raise_error(F.concat(F.lit("unknown truth: "), value)).cast("string")
    for name, aliases in TRUTHS.items():
        out = F.when(value.isin(aliases), name).otherwise(out)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)


def response_class(error: Column, partial: Column, text: Column) -> Column:
    """provider_failure, truncated, refusal, invalid, abstain or candidate."""
    parsed = F.try_parse_json(text)
    obj = F.schema_of_variant(parsed).startswith("OBJECT")
    abstain = F.try_variant_get(parsed, "$.abstain", "boolean")
    kind = F.try_variant_get(parsed, "$.kind", "string")
    return (
        F.when(error.isNotNull(), "provider_failure")
        .when(F.coalesce(partial, F.lit(False)), "truncated")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "refusal")
        .when(parsed.isNull() | ~obj, "invalid")
        .when(abstain, "abstain")
        .when(kind == "invariant", "candidate")
        .otherwise("invalid")
    )


def budget_check(given: Column, generated: Column, most_in: int, most_out: int) -> Column:
    """unknown without usage, then the cap of the input, then that of the output."""
    return F.when(given.isNull() | generated.isNull(), "unknown").when(given > most_in, "input_cap_exceeded").when(generated > most_out, "output_cap_exceeded").otherwise("pass")


def analysis_availability(status: Column, reason: Column, stages: Column | None = None) -> Column:
    """available, or why a campaign wasn't: a provider's failure in its reason, a timeout of one of its stages or in the reason, no support, else unknown."""
    why = F.coalesce(reason, F.lit(""))
    late = why.contains("timeout")
    if stages is not None:
        late = late | F.coalesce(F.array_contains(stages, "timeout"), F.lit(False))
    return F.when(status == "available", "available").when(why.contains("provider_failure"), "provider_failure").when(late, "timeout").when(status == "unsupported", "unsupported").otherwise("unknown")


def outcome_availability(verified: Column, statuses: Column) -> Column:
    """available when verified, else timeout before unsupported before unknown."""
    has = lambda s: F.exists(statuses, lambda x: x == s)
    return F.when(verified, "available").when(has("timeout"), "timeout").when(has("unsupported"), "unsupported").otherwise("unknown")


def witness_assessment(flags: dict[str, Column], hard: set[str]) -> Column:
    """rejected for a hard failure, pending for any other reason, else confirmed; with the reasons."""
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    status = F.when(F.exists(reasons, lambda r: r.isin(list(hard))), "rejected").when(F.size(reasons) > 0, "pending").otherwise("confirmed")
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def gate(present: list[Column]) -> Column:
    """pending when a flag is absent, fail when one is false, else pass; an explicit false wins."""
    failed = F.lit(False)
    absent = F.lit(False)
    for c in present:
        failed = failed | F.coalesce(~c, F.lit(False))
        absent = absent | c.isNull()
    return F.when(failed, "fail").when(absent, "pending").otherwise("pass")


def remaining_budget(query: float, deadline: Column, elapsed: Column) -> Column:
    return F.least(F.lit(query), F.greatest(F.lit(0.0), deadline - elapsed))


def foundry_class(message: Column) -> Column:
    """struct<status, reason> of a failed test run: faults of the compiler's installation aren't failures of the test."""
    m = F.lower(F.coalesce(message, F.lit("")))
    result = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(m.contains("missing solc") & m.contains("offline"), result("unsupported", "compiler_missing"))
        .when(m.contains("permission denied") & (m.contains(".svm") | m.contains("solc")), result("unknown", "compiler_execution_denied"))
        .when(m.contains("binaries.soliditylang.org") | m.contains("failed to lookup address"), result("unknown", "compiler_install_unavailable"))
        .otherwise(result("fail", "foundry_nonzero_exit"))
    )


def is_hex(c: Column, digits: int, prefix: bool = False) -> Column:
    return c.rlike(f"^{'0x' if prefix else ''}[0-9a-fA-F]{{{digits}}}$")


def safe_path(path: Column, forbidden: list[str]) -> Column:
    """Relative, without .. steps or forbidden names; backslashes count as slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    ok = ~p.rlike(r"^(/|[A-Za-z]:)") & ~F.exists(F.split(p, "/"), lambda x: x == "..")
    for name in forbidden:
        ok = ok & ~F.lower(p).contains(name)
    return ok


def suffix_match(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other."""
    return (a == b) | a.endswith(b) | b.endswith(a)


def draw_index(seed: int, draw: Column, i: Column, n: Column) -> Column:
    """A portable pseudo-random index below n: the first eight hex digits of md5(seed|draw|i), modulo n."""
    key = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), i.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def draw_uniform(*parts: Column) -> Column:
    """A portable pseudo-random number in [0, 1), from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
