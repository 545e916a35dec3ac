"""Hand-computed cases of the evaluation operators, and their semantic traps."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom.functions import canonical, predicate, uint256
from evalloom.functions import columns as C
from evalloom.operators import endpoints, events, inference, pairing, planning, quality, readiness, search, selection
from evalloom.plans.queries import QUERIES
from evalloom.sources import readers, sinks

OUT = "campaign_id string, instance_id string, lineage_id string, method string, replicate int, ground_truth string, detected boolean, claim_emitted boolean, correct_claim boolean, claim_time_seconds double, horizon_seconds double, availability string"


def rows(spark, data):
    return spark.createDataFrame(data, OUT)


def outcome(i, method, lineage="l1", instance="i1", rep=1, truth="positive", detected=True, correct=None, time=None, horizon=5.0, availability="available"):
    return (f"c{i}", instance, lineage, method, rep, truth, detected, detected, correct, time, horizon, availability)


def test_hierarchical_mean_averages_averages_and_drops_unknown_instances(spark):
    df = rows(spark, [outcome(1, "X", instance="a"), outcome(2, "X", instance="a", rep=2, detected=False), outcome(3, "X", instance="b", detected=None), outcome(4, "X", "l2", "c"), outcome(5, "P", detected=None)])
    got = {r["method"]: r for r in endpoints.hierarchical_mean(df, "detected", ["method"]).collect()}
    assert (got["X"]["value"], got["X"]["known"], got["X"]["total"], got["X"]["missing"]) == (0.75, 3, 4, 1)
    assert got["P"]["value"] is None and got["P"]["note"] == "no_known_measurements"


def test_false_discovery_counts_negatives_only(spark):
    df = rows(spark, [outcome(1, "X", truth="negative", correct=False), outcome(2, "X", correct=True), outcome(3, "P", truth="negative", detected=False)])
    got = {r["method"]: (r["value"], r["note"]) for r in endpoints.false_discovery(df, ["method"]).collect()}
    assert got == {"X": (1.0, None), "P": (None, "precision_NA_no_claims")}


def test_times_and_survival(spark):
    df = rows(spark, [outcome(1, "X", time=None), outcome(2, "X", instance="b", time=7.0, availability="timeout")])
    r = endpoints.restricted_time(df, "claim_time_seconds", ["method"]).first()
    assert (r["restricted"], r["conditioned"], r["intention_to_run"], r["missing"]) == (5.0, 5.0, 0.5, 1)
    assert [x["survival"] for x in endpoints.kaplan_meier(df, "claim_time_seconds", ["method"]).collect()] == [1.0]
    df = rows(spark, [outcome(i, "X", instance=f"i{i}", time=float(t)) for i, t in enumerate([1, 2, 2, 9])])
    got = sorted((x["time"], x["at_risk"], x["events"], x["survival"]) for x in endpoints.kaplan_meier(df, "claim_time_seconds", ["method"]).collect())
    assert got == [(1.0, 4, 1, 0.75), (2.0, 3, 2, 0.25), (5.0, 1, 0, 0.25)]


def test_paired_effects_drop_unmatched_units(spark):
    df = rows(spark, [outcome(1, "X"), outcome(2, "P", detected=False), outcome(3, "X", "l2", "z"), outcome(4, "P", "l3", "y")])
    got = pairing.paired_effects(df, [("X", "P")], ["lineage_id", "instance_id", "replicate"], "detected", "method", [["lineage_id", "instance_id"], ["lineage_id"]]).collect()
    assert [(r["lineage_id"], r["effect"]) for r in got] == [("l1", 1.0)]


def test_agreement(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", "y", None), ("d", None, "y")], "id string, left string, right string")
    r = pairing.agreement(df).first()
    assert (r["matched"], r["missing_left"], r["missing_right"], r["agreement"], r["kappa"]) == (2, 1, 1, 0.5, 0.0)
    same = pairing.agreement(df.where("id = 'a'")).first()
    assert (same["agreement"], same["kappa"]) == (1.0, 1.0)
    none = pairing.agreement(df.where("id = 'c'")).first()
    assert none["agreement"] is None and none["kappa"] is None


def test_sign_test_and_holm(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", -1.0), ("b", 0.0), ("b", 0.0)], "contrast string, effect double")
    got = {r["contrast"]: (r["wins"], r["losses"], r["ties"], r["n"], r["p"]) for r in inference.sign_test(e, ["contrast"]).collect()}
    assert got == {"a": (1, 1, 1, 2, 1.0), "b": (0, 0, 2, 0, None)}
    t = spark.createDataFrame([("b", 0.03), ("a", 0.01), ("c", 0.2), ("d", None)], "k string, p double")
    assert {r["k"]: r["adjusted"] for r in inference.holm(t, "k").collect()} == {"a": 0.04 * 3 / 4, "b": 0.06, "c": 0.2, "d": None}
    five = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 1.0)] * 2 + [("b", -1.0)] * 8, "contrast string, effect double")
    assert {r["contrast"]: r["p"] for r in inference.sign_test(five, ["contrast"]).collect()} == {"a": 0.0625, "b": 0.109375}
    with pytest.raises(Exception, match="outside"):
        inference.holm(spark.createDataFrame([("a", 1.5)], "k string, p double"), "k").collect()


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(C.poisoned_sum(F.col("v")).alias("s")).collect()} == {"a": 3.0, "b": None}
    empty = df.where("k = 'z'")
    assert empty.agg(C.poisoned_sum(F.col("v")).alias("s")).first()["s"] == 0.0
    assert empty.agg(C.poisoned_sum(F.col("v"), empty_is_zero=False).alias("s")).first()["s"] is None


def test_truth_and_ladders(spark):
    df = spark.createDataFrame([("mutant",), ("patched",), (None,)], "t string")
    assert [r[0] for r in df.select(C.truth(F.col("t"))).collect()] == ["positive", "negative", None]
    with pytest.raises(Exception, match="unknown truth"):
        spark.createDataFrame([("odd",)], "t string").select(C.truth(F.col("t"))).collect()
    cases = [("http", False, "x"), (None, True, "x"), (None, False, " "), (None, False, "x"), (None, False, '{"abstain": true}'), (None, False, '{"kind": "invariant"}'), (None, False, "[1]")]
    df = spark.createDataFrame(cases, "e string, p boolean, t string")
    assert [r[0] for r in df.select(C.response_class(F.col("e"), F.col("p"), F.col("t"))).collect()] == ["provider_failure", "truncated", "refusal", "invalid", "abstain", "candidate", "invalid"]
    df = spark.createDataFrame([(None, 1), (40000, 1), (1, 9000), (1, 1)], "i int, o int")
    assert [r[0] for r in df.select(C.budget_check(F.col("i"), F.col("o"), 32768, 8192)).collect()] == ["unknown", "input_cap_exceeded", "output_cap_exceeded", "pass"]


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(5)], "id int, s string")
    got = selection.stratified_sample(df, "id", "s", {"a": 1, "b": 2}, 1).collect()
    assert sorted((r["s"], r["weight"]) for r in got) == [("a", 2.0), ("b", 1.5), ("b", 1.5)]
    with pytest.raises(Exception, match="smaller than its sample"):
        selection.stratified_sample(df, "id", "s", {"a": 3}, 1).collect()


def test_stratified_sample_refuses_null_and_repeated_keys(spark):
    for keys in ([1] * 1000, [None] * 30, [1, 1, *range(2, 30)]):
        df = spark.createDataFrame([(k, "a") for k in keys], "id int, s string")
        with pytest.raises(Exception, match="null or repeat"):
            selection.stratified_sample(df, "id", "s", {"a": 20}, 1).collect()
    df = spark.createDataFrame([(i, "a") for i in range(5000)], "id int, s string").repartition(7)
    assert len({r["id"] for r in selection.stratified_sample(df, "id", "s", {"a": 20}, 1).collect()}) == 20


def test_fixed_policies(spark):
    """Macros, resume policy, availability ladder, failure classes, blinding and test summaries, case by case."""
    call = lambda name, *a: {"kind": "primitive", "primitive_id": name, "arguments": list(a)}
    a, b = symbol("f"), symbol("g")
    deny = lambda x: {"kind": "unary", "operator": "not", "operand": x}
    assert predicate.expand(call("challenge_window", a, b)) == binary("implies", a, deny(b)) and predicate.expand(call("justified_destination_effect", a, b)) == predicate.expand(call("proof_binding", a, b)) == binary("implies", a, b)
    assert predicate.expand(call("quorum_authorization", a)) == predicate.expand(call("intent_consumption", a)) == a and predicate.expand(call("replay_exclusion", a)) == predicate.expand(call("callback_noninterference", a)) == deny(a)
    for wrong in (call("quorum_authorization", a, b), call("challenge_window", a), call("odd", a), {"kind": "primitive", "primitive_id": "replay_exclusion", "arguments": [1]}):
        with pytest.raises(predicate.Refused):
            predicate.expand(wrong)

    kinds = spark.createDataFrame([("worker_restart", "v1"), ("lost_response", "v1"), ("provider_outage", "v1"), ("version_drift", "v1"), ("worker_restart", "v2"), ("lost_response", None)], "kind string, version string")
    policy = lambda df: readiness.resume_policy(df, F.col("kind"), F.col("version"), "v1")
    assert [r["action"] for r in policy(kinds).collect()] == ["resume_same_attempt"] * 3 + ["block"] * 3
    with pytest.raises(Exception, match="unknown interruption"):
        policy(spark.createDataFrame([("odd", "v1")], "kind string, version string")).collect()

    cases = [("available", "provider_failure", [], "available"), ("unknown", "x provider_failure timeout", ["timeout"], "provider_failure"), ("unsupported", None, ["passed", "timeout"], "timeout"), ("unsupported", "a timeout", [], "timeout"), ("unsupported", None, [], "unsupported"), ("unknown", "Timeout", None, "unknown"), ("unknown", None, None, "unknown")]
    df = spark.createDataFrame(cases, "s string, r string, t array<string>, want string")
    assert all(r[0] == r[1] for r in df.select(C.analysis_availability(F.col("s"), F.col("r"), F.col("t")), "want").collect())
    texts = [("Missing solc, OFFLINE", "compiler_missing"), ("permission denied: /root/.svm/x", "compiler_execution_denied"), ("see binaries.soliditylang.org", "compiler_install_unavailable"), ("failed to lookup address", "compiler_install_unavailable"), ("missing solc", "foundry_nonzero_exit"), (None, "foundry_nonzero_exit")]
    got = spark.createDataFrame(texts, "m string, want string").select(C.foundry_class(F.col("m")).alias("c"), "want").collect()
    assert all(r["c"]["reason"] == r["want"] for r in got) and [r["c"]["status"] for r in got] == ["unsupported", "unknown", "unknown", "unknown", "fail", "fail"]

    plain = spark.createDataFrame([("f1", '{"claim": {"x": [1]}}', {"k": "v"})], "finding_id string, claim string, more map<string,string>")
    assert sinks.blinded(plain, ["finding_id", "claim", "more"], json=("claim",)).first()["export_id"]
    for bad in (plain.withColumn("claim", F.lit('{"a": [{"Model_Tag": 1}]}')), plain.withColumn("more", F.create_map(F.lit("Checkpoint"), F.lit("v")))):
        with pytest.raises(Exception, match="name a method"):
            sinks.blinded(bad, ["finding_id", "claim", "more"], json=("claim",)).collect()
    with pytest.raises(ValueError, match="served_weight_digest"):
        sinks.blinded(plain.withColumn("n", F.struct(F.array(F.struct(F.lit(1).alias("served_weight_digest"))).alias("deep"))), ["finding_id", "n"])

    doc = json.dumps({"a": {"test_results": {"t1": {"status": "pass"}, "t2": {"status": "Failure"}, "t3": {}, "t4": {"status": "Success", "test_results": {"t5": {"status": "passed"}}}}}})
    assert tuple(readers.test_summary(spark.createDataFrame([(doc,)], "d string"), "d").first()["summary"]) == (4, 3, 1)


def test_wide_predicates(spark):
    """Values beyond 10^38, bit operations and shifts, against Python's integers."""
    top = 1 << 256
    values = [0, 1, 5, 10**37, 10**38 - 1]
    columns = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, t string").select("i", F.col("t").cast("decimal(38,0)").alias("x"))
    compiler = lambda kind, **more: predicate.Compiler({"x": (kind, "source")}, {("x", "post"): F.col("x")}, **more)
    x = {"kind": "symbol", "symbol_id": "x", "state": "post"}
    lit = lambda n, kind="uint256": {"kind": "literal", "type": kind, "value": n}
    big = (1 << 255) + 12345
    cases = [
        ("add", big, lambda v: v + big), ("mul", 10**38, lambda v: v * 10**38), ("bxor", big, lambda v: v ^ big), ("band", big, lambda v: v & big), ("bor", 6, lambda v: v | 6),
        ("shl", 200, lambda v: (v << 200) % top), ("shr", 3, lambda v: v >> 3), ("shl", 256, lambda v: 0), ("div", 10**40, lambda v: v // 10**40), ("mod", 7, lambda v: v % 7),
    ]
    for op, n, want in cases:
        for other in (0, 12345, big):
            body = binary("ge", binary(op, x, lit(n)), lit(other))
            got = predicate.evaluate(columns, {"kind": "invariant", "body": body}, compiler("uint256"), ["i"]).orderBy("i").collect()
            for v, r in zip(values, got, strict=True):
                exact = want(v)
                assert (r["verdict"], r["error"]) == (("UNKNOWN", "overflow") if exact >= top else ("PASS" if exact >= other else "FAIL", None)), (op, n, v)
    low = -(1 << 255)
    body = binary("eq", {"kind": "unary", "operator": "neg", "operand": lit(low, "int256")}, lit(0, "int256"))
    assert predicate.evaluate(columns, {"kind": "invariant", "body": body}, compiler("int256"), ["i"]).first()["error"] == "overflow"
    body = binary("lt", {"kind": "unary", "operator": "bitnot", "operand": x}, lit(0, "int256"))
    assert {r["verdict"] for r in predicate.evaluate(columns, {"kind": "invariant", "body": body}, compiler("int256"), ["i"]).collect()} == {"PASS"}
    words = spark.createDataFrame([(0, uint256.encode(big)), (1, uint256.encode(3))], "i int, x string")
    body = binary("gt", binary("sub", x, lit(4)), lit(10**70))
    got = predicate.evaluate(words, {"kind": "invariant", "body": body}, compiler("uint256", wide=frozenset({"x"})), ["i"]).orderBy("i").collect()
    assert [(r["verdict"], r["error"]) for r in got] == [("PASS", None), ("UNKNOWN", "underflow")]
    with pytest.raises(predicate.Refused, match="type_mismatch"):
        compiler("uint256").predicate({"kind": "invariant", "body": binary("eq", binary("sar", x, lit(1)), lit(1))})
    declared = predicate.identity({"body": body})
    assert {r["verdict"] for r in predicate.independent(words, {"kind": "invariant", "body": body}, compiler("uint256", wide=frozenset({"x"})), ["i"], "0" * 64).collect()} == {"UNKNOWN"} and len(declared) == 64
    text, names = predicate.lower(binary("gt", binary("add", x, lit(1)), lit(2)), {"x": ("int256", "source")})
    assert text.startswith("(bvsgt (bvadd |x@post| #x") and names == {"x@post": "$.body.left.left"}
    with pytest.raises(predicate.Refused):
        predicate.lower(binary("div", x, lit(1)), {"x": ("uint256", "source")})
    assert predicate.structure({"body": body}, {"x": ("uint256", "source")})["reason"] == "missing_required_domain"
    assert predicate.structure({"body": body}, {"x": ("uint256", "source")}, domains=("source",), states=("post",))["status"] == "eligible"


def test_balanced_subset_covers_and_balances(spark):
    df = spark.createDataFrame([(i, "f%d" % (i % 3), i % 2) for i in range(60)], "id int, family string, truth int")
    got = selection.balanced_subset(df, "id", ["family", "truth"], ["family"], 12, 1).collect()
    assert len(got) == 12
    by = [sum(r["family"] == f for r in got) for f in ("f0", "f1", "f2")]
    assert by == [4, 4, 4] and sum(r["truth"] for r in got) == 6


def test_duplicates_ignore_failed_budgets(spark):
    df = spark.createDataFrame([("c", 0, "h", False), ("c", 1, "h", True), ("c", 2, "h", True)], "c string, s int, h string, ok boolean")
    got = selection.duplicate_slots(df, "c", "h", "s", F.col("ok")).orderBy("s").collect()
    assert [r["duplicate"] for r in got] == [False, False, True]


def test_plan(spark):
    inst = spark.createDataFrame([("i2", "l"), ("i1", "l")], "instance_id string, lineage_id string")
    got = planning.campaign_plan(inst, ["X", "P"], ["a", "b"], 2, 3).orderBy("order_index").collect()
    assert [r["order_index"] for r in got] == list(range(16)) and {r["instance_id"] for r in got[:8]} == {"i1"}
    import uuid

    r = got[0]
    assert r["campaign_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r['instance_id']}|{r['method']}|{r['backbone']}|{r['replicate']}"))
    syms = spark.createDataFrame([("b",), ("a",)], "symbol_id string")
    assert [(r["symbol_id"], r["status"]) for r in planning.template_slots(syms, 3).orderBy("slot").collect()] == [("a", "candidate"), ("b", "candidate"), (None, "abstain")]


def test_event_rules(spark):
    log = spark.createDataFrame([(1, 1, 5.0, 1.0, False), (1, 2, 3.0, 1.0, False), (1, 3, 4.0, -1.0, True), (1, 4, 6.0, None, True), (1, 5, 7.0, 1.0, False)], "attempt_id int, seq int, monotonic_seconds double, value double, terminal boolean")
    got = events.validate_log(log).orderBy("seq").collect()
    assert [r["time_regression"] for r in got] == [False, True, False, False, False]  # one late event, one error
    assert [r["negative_duration"] for r in got] == [False, False, True, False, False]
    assert [r["duplicate_terminal"] for r in got] == [False, False, False, True, False] and got[4]["event_after_terminal"]


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, 1, "start"), (1, 2, "uncertain"), (1, 3, "start"), (1, 4, "terminal"), (1, 5, "start"), (2, 1, "start")], "attempt_id int, seq int, event string")
    got = {r["attempt_id"]: (r["state"], r["moves"], r["illegal"], r["recovery"]) for r in events.fold_attempts(log).collect()}
    assert got == {1: ("terminal", 4, 1, "none"), 2: ("running", 1, 0, "recover_uncertain")}


def test_streaming_lifecycle_equals_batch(spark, tmp_path):
    from evalloom.streaming import attempts

    log = [(a, s, e) for a in range(5) for s, e in enumerate(["start", "uncertain", "start", "terminal"][: a + 1])]
    df = spark.createDataFrame(log, "attempt_id long, seq long, event string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("attempt_id long, seq long, event string").parquet(str(tmp_path / "in"))
    q = attempts.live_lifecycle(stream).writeStream.outputMode("update").format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    live = {r["attempt_id"]: (r["state"], r["moves"], r["illegal"]) for r in spark.table("life").collect()}
    assert live == {r["attempt_id"]: (r["state"], r["moves"], r["illegal"]) for r in events.fold_attempts(df).collect()}


def test_streaming_windows_and_keyed_sink(spark, sf, tmp_path):
    from evalloom.streaming import attempts

    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = attempts.read_events(spark, str(tmp_path / "in"))
    q = attempts.windowed_telemetry(stream).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    write = attempts.keyed_writer(str(tmp_path / "out"), "k")
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


SYMBOLS = {"a": ("uint256", "source"), "b": ("uint256", "destination"), "f": ("bool", "source")}


def symbol(s):
    return {"kind": "symbol", "symbol_id": s, "state": "post"}


def binary(o, x, y):
    return {"kind": "binary", "operator": o, "left": x, "right": y}


def literal(n, kind="uint256"):
    return {"kind": "literal", "type": kind, "value": n}


def verdicts(spark, body, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, a long, b long, f boolean").select("id", F.col("a").cast("decimal(38,0)").alias("a"), F.col("b").cast("decimal(38,0)").alias("b"), "f")
    c = predicate.Compiler(SYMBOLS, {(s, "post"): F.col(s) for s in SYMBOLS}, trace="trace", index="id")
    return [(r["verdict"], r["error"]) for r in predicate.evaluate(df.withColumn("trace", F.lit(1)), {"kind": "invariant", "body": body}, c, ["id"]).orderBy("id").collect()]


def test_predicate_errors_are_not_false(spark):
    got = verdicts(spark, binary("ge", binary("sub", symbol("a"), symbol("b")), literal(1)), [(3, 1, True), (1, 3, True), (None, 1, True), (1, 1, True)])
    assert got == [("PASS", None), ("UNKNOWN", "underflow"), ("UNKNOWN", "missing binding a"), ("FAIL", None)]
    lazy = binary("or", symbol("f"), binary("eq", binary("div", symbol("a"), symbol("b")), literal(1)))
    assert verdicts(spark, lazy, [(1, 0, True), (1, 0, False), (2, 2, False)]) == [("PASS", None), ("UNKNOWN", "division by zero"), ("PASS", None)]
    every = {"kind": "quantifier", "operator": "forall", "variable": "x", "variable_type": "uint256", "domain": [1, 2], "body": binary("gt", symbol("a"), {"kind": "bound", "variable": "x", "type": "uint256"})}
    assert [v for v, _ in verdicts(spark, every, [(3, 0, True), (2, 0, True)])] == ["PASS", "FAIL"]
    assert [v for v, _ in verdicts(spark, {**every, "domain": []}, [(0, 0, True)])] == ["PASS"]
    once = {"kind": "temporal", "operator": "once", "horizon": 1, "operand": binary("gt", symbol("a"), literal(5))}
    assert [v for v, _ in verdicts(spark, once, [(9, 0, True), (1, 0, True), (1, 0, True)])] == ["PASS", "PASS", "FAIL"]


def test_predicate_diagnostics():
    c = predicate.Compiler(SYMBOLS, {})
    for body, code in [(literal(1), "non_boolean_root"), ({"kind": "literal", "type": "bool", "value": 1}, "invalid_literal"), ({**literal(1), "more": 1}, "unsupported_fields"), (symbol("z"), "unresolved_symbol"), ({"kind": "odd"}, "invalid_expression_kind"), (literal(True), "invalid_literal")]:
        with pytest.raises(predicate.Refused) as e:
            c.predicate({"kind": "invariant", "body": body})
        assert e.value.code == code
    with pytest.raises(predicate.Refused, match="abstained"):
        c.predicate({"abstain": True, "reason": "none"})
    generic = {"kind": "invariant", "body": binary("implies", symbol("f"), symbol("f"))}
    short = {"kind": "invariant", "body": {"kind": "primitive", "primitive_id": "proof_binding", "arguments": [symbol("f"), symbol("f")]}}
    assert predicate.identity(generic) == predicate.identity(short) and predicate.references(generic["body"]) == [("f", "post")]


def test_uint256(spark):
    top, low = (1 << 255) - 1, -(1 << 255)
    assert uint256.compute("add", (1 << 256) - 1, 1, False) == (None, "overflow")
    assert uint256.compute("div", -7, 2, True) == (-3, None) and uint256.compute("mod", -7, 3, True) == (-1, None)
    assert uint256.compute("div", low, -1, True) == (None, "overflow") and uint256.compute("sar", -4, 300, True) == (-1, None)
    assert uint256.compute("shr", -1, 0, True) == ((1 << 256) - 1, None)  # not folded back
    df = spark.createDataFrame([(uint256.encode(top), uint256.encode(1)), (None, uint256.encode(1))], "a string, b string")
    got = df.select(uint256.arith("sub", F.col("a"), F.col("b"), signed=True).alias("r")).collect()
    assert uint256.decode(got[0]["r"]["value"], True) == top - 1 and got[1]["r"]["error"] == "missing binding"
    df = spark.createDataFrame([(v, uint256.encode(v)) for v in (-5, 3, -1, 0)], "v long, e string")
    assert [r["v"] for r in df.orderBy(uint256.signed_key(F.col("e"))).collect()] == [-5, -1, 0, 3]
    assert df.where(uint256.from_long(F.col("v")) != F.col("e")).count() == 0


def test_search(spark):
    bounds, profile = search.Bounds(4, 4, 2), search.Profile()
    hit = F.array_contains("delivered", F.lit(2).cast("bigint"))
    got = search.search(spark, [1, 2], bounds, profile, hit & F.array_contains("committed", F.lit(1).cast("bigint")))
    assert got["status"] == "SAT" and got["witness"] == ["enqueue 1", "enqueue 2", "deliver 2"]
    assert search.replay(got["witness"], [1, 2], bounds, profile, spark) and not search.replay(["deliver 1"], [1, 2], bounds, profile, spark)
    assert search.search(spark, [1], bounds, profile, F.lit(False))["status"] == "BOUNDED_UNSAT"
    assert search.search(spark, [1, 2], bounds, profile, F.lit(False), max_states=1)["reason"] == "state_limit_exhausted"
    reorg = search.search(spark, [1], search.Bounds(2, 4, 2), search.Profile(reorg=True, finality_depth=1), (F.size("committed") == 0) & (F.col("transactions") == 2))
    assert reorg["witness"] == ["enqueue 1", "reorg 1"]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "src string, dst string")
    assert {(r["src"], r["dst"]): r["hops"] for r in search.closure(e).collect()} == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2, ("a", "a"): 3, ("b", "b"): 3, ("c", "c"): 3}


def test_closure_has_no_bound_of_hops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(67)], "src long, dst long")
    assert {(r["src"], r["dst"], r["hops"]) for r in search.closure(e).collect()} == {(i, j, j - i) for i in range(68) for j in range(i + 1, 68)}
    with pytest.raises(ValueError, match="3 hops"):
        search.closure(e.where("src < 4"), max_rounds=3)
    assert search.closure(e.where("src < 3"), max_rounds=3).count() == 6


def test_registry_differences_takes_all_keys(spark):
    sf = "/root/testdata/sf0.01"
    left = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey").collect()}
    right = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select("c_custkey", "c_nationkey").collect()}
    want = {(k, "only_in_left" if k not in right else "only_in_right" if k not in left else "differs:nation") for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
    assert max(right) > 150 and {(r["k"], r["problem"]) for r in QUERIES["registry_differences"](spark, sf).collect()} == want


def test_import_closure_takes_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    got = {(r["src"], r["dst"], r["hops"]) for r in QUERIES["import_closure"](spark, sf).collect()}
    assert len(keys) > 400 and got == {(k, k >> n, n) for k in keys for n in range(1, k.bit_length())}



def test_quality(spark):
    r = spark.createDataFrame([("a", "l", "b"), ("b", "l", "a"), ("c", "l", "a"), ("d", "m", "zz"), ("e", "m", None)], "k string, l string, o string")
    assert {x["k"]: x["error"] for x in quality.reciprocal_pairs(r, "k", "o", "l").collect()} == {"c": "pair_not_reciprocal", "d": "pair_absent"}
    flags = spark.createDataFrame([(True, True), (None, False), (None, True)], "a boolean, b boolean")
    assert [x[0] for x in flags.select(C.gate([F.col("a"), F.col("b")])).collect()] == ["pass", "fail", "pending"]


def test_sources_and_sinks(spark, tmp_path):
    from evalloom.sources import readers, sinks

    good = {"campaign_id": "c", "instance_id": "i", "lineage_id": "l", "method": "X", "replicate": 1, "ground_truth": "positive", "unknown": 3}
    p = tmp_path / "o.jsonl"
    p.write_text("﻿" + json.dumps(good) + "\n\n" + json.dumps({**good, "campaign_id": "d", "horizon_seconds": 2.5}) + "\n", encoding="utf-8")
    got = readers.outcomes(spark, str(p)).orderBy("campaign_id").collect()
    assert [(r["horizon_seconds"], r["availability"], r["detected"]) for r in got] == [(1.0, "available", None), (2.5, "available", None)]
    p.write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception, match="damaged line"):
        readers.outcomes(spark, str(p)).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("abc")
    files = readers.files(spark, str(tmp_path / "f"))
    assert [(r["path"], r["size"]) for r in files.collect()] == [("x.txt", 3)]
    h = files.first()["sha256"]
    (tmp_path / "sums").write_text(f"{h}  x.txt\n{h}  y.txt\nodd\n{'0' * 64}  x.txt\n")
    assert sorted(r["status"] for r in readers.checksum_report(spark, str(tmp_path / "sums"), files).collect()) == ["malformed", "mismatch", "missing", "ok"]
    df = spark.createDataFrame([("k", "v")], "k string, v string")
    sinks.put(df, str(tmp_path / "kv"), "k", "v")
    sinks.put(df, str(tmp_path / "kv"), "k", "v")
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 1
    with pytest.raises(ValueError):
        sinks.put(spark.createDataFrame([("k", "w")], "k string, v string"), str(tmp_path / "kv"), "k", "v")
    assert sinks.csv_text(spark.createDataFrame([(2, None), (1, "a,b")], "n int, t string"), ["n"]) == 'n,t\n1,"a,b"\n2,\n'
    one = sinks.write_bundle({"t": (df, ["k"])}, {"n": 1}, str(tmp_path / "b"))
    assert one == sinks.write_bundle({"t": (df, ["k"])}, {"n": 1}, str(tmp_path / "b2"))
    assert canonical.forbidden_paths({"a": [{"Secret": 1}]}, {"secret"}) == ["a[0].Secret"]
    with pytest.raises(ValueError):
        sinks.blinded(df.withColumn("track", F.lit("x")), ["k", "track"])
    payload = spark.createDataFrame([('[{"check": "c", "description": "m"}, {"id": "z", "category": "d", "message": "n"}]', '{"x": {"test_results": {"a": {"status": "Success"}, "b": {"status": "Failure"}}}}')], "p string, t string")
    assert [(r["finding_id"], r["category"]) for r in readers.tool_findings(payload, "s", "p").collect()] == [("s:0", "c"), ("z", "d")]
    assert tuple(readers.test_summary(payload, "t").first()["summary"]) == (2, 1, 1)


def test_scheduler_and_opcodes(spark):
    from evalloom.operators import scheduler

    log = [(1, s, r, e) for s, (r, e) in enumerate([(1, "request"), (2, "request"), (3, "request"), (4, "request"), (1, "release"), (9, "release"), (2, "release")])]
    got = scheduler.replay(spark.createDataFrame(log, "worker long, seq long, request long, event string"), slots=1, most_waiting=2).orderBy("seq").collect()
    assert [r["decision"] for r in got] == ["admitted", "queued", "queued", "rejected", "released", "unknown_release", "released"] and [r["running"] for r in got] == [1, 1, 1, 1, 1, 1, 1]
    assert scheduler.opcodes("0x6001600161ffff0100") == ["00", "01", "60", "61"]


def test_bindings_and_matches(spark):
    from evalloom.operators import bindings, campaigns

    actions = spark.createDataFrame([("a", "f", "Bridge"), ("b", "g", None), ("c", "h", "X")], "action string, name string, target string")
    functions = spark.createDataFrame([("f", "src.Bridge"), ("f", "Other"), ("h", "P"), ("h", "Q")], "name string, contract string")
    assert {r["action"]: (r["status"], r["contract"]) for r in bindings.bind_actions(actions, functions).collect()} == {"a": ("bound", "src.Bridge"), "b": ("missing", None), "c": ("ambiguous", None)}
    rows = spark.createDataFrame([("p", "X"), ("p", "P"), ("q", "X"), ("r", "X"), ("r", "X"), ("r", "P")], "pair string, arm string")
    assert {r["pair"]: r["matched"] for r in campaigns.strict_match(rows, ["pair"], "arm", "X", "P").collect()} == {"p": True, "q": False, "r": False}


def most_rows(plan):
    """The most rows that any node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, below)])


def test_actions_meet_counted_functions_not_each_function_of_a_name(spark):
    from evalloom.operators import bindings

    actions = spark.createDataFrame([(i, "f", f"c{i % 3}") for i in range(200)], "action int, name string, target string")
    functions = spark.createDataFrame([("f", f"x.c{i % 4 + 1}") for i in range(300)] + [("f", "y.c0")], "name string, contract string")
    got = bindings.bind_actions(actions, functions)
    assert {(r["action"] % 3, r["status"], r["contract"]) for r in got.collect()} == {(0, "bound", "y.c0"), (1, "ambiguous", None), (2, "ambiguous", None)}
    assert most_rows(got._jdf.queryExecution().executedPlan()) <= 301  # 60,200 if actions meet each function


def test_actions_match_suffixes_both_ways(spark):
    from evalloom.operators import bindings

    cases = [("equal", "e", "p.C"), ("longer", "e", "q.p.C"), ("shorter", "e", "C"), ("other", "e", "D"), ("bytes", "u", "é"), ("null", "n", "C"), ("none", "n", None), ("empty", "u", ""), ("twice", "e", "p.C"), ("twice", "e", "Z"), ("both", "e", "p.C"), ("both", "e", "C"), (None, None, "C")]
    actions = spark.createDataFrame(cases, "action string, name string, target string")
    functions = spark.createDataFrame([("e", "p.C"), ("e", "p.D.E"), ("u", "sé"), ("u", "sè"), ("n", None), (None, "C")], "name string, contract string")
    got = {r["action"]: (r["status"], r["contract"]) for r in bindings.bind_actions(actions, functions).collect()}
    bound, ambiguous = ("bound", "p.C"), ("ambiguous", None)
    assert got == {"equal": bound, "longer": bound, "shorter": bound, "other": ambiguous, "bytes": ("bound", "sé"), "null": ("bound", None), "none": ("bound", None), "empty": ambiguous, "twice": bound, "both": ambiguous, None: ("missing", None)}


def test_prefix_sums_and_ranks(spark):
    from evalloom.runtime import global_index, sums_before

    df = spark.createDataFrame([(k, i, i + 1) for k in ("a", None) for i in range(50)], "k string, i int, v long")
    got = {(r["k"], r["i"]): r["s"] for r in sums_before(df, ["k"], "i", "v", "s", group=7).collect()}
    assert got == {(k, i): i * (i + 1) // 2 for k in ("a", None) for i in range(50)}
    ranks = global_index(df.where("k = 'a'").repartition(7), ["i"], "n").collect()
    assert all(r["n"] == r["i"] for r in ranks) and len(ranks) == 50


def test_reports_are_reproducible(spark, tmp_path):
    """The analysis of an outcome file and the paired report by prefix: equal inputs give equal bundles, wrong ones are refused."""
    from evalloom.plans import report

    one = [{"campaign_id": f"c{i}", "instance_id": f"i{i // 2}", "lineage_id": f"l{i % 3}", "method": "XP"[i % 2], "replicate": 1, "ground_truth": "positive", "detected": i % 4 < 2, "claim_emitted": True, "correct_claim": i % 3 > 0} for i in range(24)]
    (tmp_path / "o.jsonl").write_text("\n".join(json.dumps(r) for r in one))
    rows = readers.outcomes(spark, str(tmp_path / "o.jsonl"))
    a = report.analysis(rows, str(tmp_path / "a"), [("X", "P")], draws=50)
    b = report.analysis(rows.orderBy(F.desc("campaign_id")), str(tmp_path / "b"), [("X", "P")], draws=50, expected_input_hash=a["report"]["input_hash"])
    assert a == b and report.valid(a["report"]) and not report.valid({**a["report"], "seed": 1}) and set(a["report"]["tables"]) == {"endpoints", "false_discovery", "restricted_time", "denominators", "effects", "contrasts"}
    assert (tmp_path / "a" / "manifest.json").read_bytes() == (tmp_path / "b" / "manifest.json").read_bytes()
    for wrong in ({"expected_input_hash": "0"}, {"comparisons": [("X", "Z")]}, {"comparisons": [("X", "X")]}):
        with pytest.raises(ValueError):
            report.analysis(rows, str(tmp_path / "c"), **wrong)
    tagged = rows.withColumn("model_tag", F.when(F.col("method") == "X", "m1").otherwise("m2")).withColumn("first_verified", F.lit(1))
    with pytest.raises(ValueError, match="several model tags"):
        report.paired(tagged, str(tmp_path / "p"), prefixes=(1,))
    with pytest.raises(ValueError, match="no campaign"):
        report.paired(tagged, str(tmp_path / "p"), prefixes=(1,), model_tag="m9")
    with pytest.raises(ValueError, match="positive"):
        report.paired(tagged, str(tmp_path / "p"), prefixes=(0,), model_tag="m1")
    out = report.paired(tagged.withColumn("model_tag", F.lit("m1")), str(tmp_path / "p"), prefixes=(1, 2, 1), draws=20, model_tag="m1")
    assert out["prefixes"] == [1, 2] and report.valid(out) and (tmp_path / "p" / "prefix-2" / "analysis.json").exists()


def test_ledgers_and_small_functions(spark):
    from evalloom.operators import adjudication, methods

    finding = {"finding_id": "f1", "instance_id": "i", "claim": {"x": 1}, "evidence_hash": None, "raw_claim_hash": None, "root_cause_id": None}
    text = adjudication.write_ledger({"findings": [finding], "requirement_mappings": [{"finding_id": "f1", "requirement_id": "r", "status": "mapped", "reviewer_id": "a", "reason": None, "created_at": None}]})
    read = adjudication.read_ledger(spark, text)
    assert read["findings"].first()["claim"] == '{"x": 1}' and read["labels"].count() == 0 and len(adjudication.export_id(read["findings"], ["finding_id", "claim"])) == 64
    body = json.loads(text)
    named = {**finding, "claim": {"a": [{"Track": 1}]}}
    mapping = {"finding_id": "f2", "requirement_id": "r", "status": "mapped", "reviewer_id": "a", "reason": None, "created_at": None}
    for bad, why in [({**body, "ledger_hash": "0"}, "hash"), (json.loads(adjudication.write_ledger({"findings": [named]})), "name a method"), (json.loads(adjudication.write_ledger({"findings": [finding], "requirement_mappings": [mapping]})), "unknown_finding")]:
        with pytest.raises(ValueError, match=why):
            adjudication.read_ledger(spark, json.dumps(bad))
    own = {"body": {"b": 1, "a": "x"}}
    good = json.dumps({**own, "canonical_hash": canonical.sha256_hex(own["body"])})
    forged = json.dumps({**own, "canonical_hash": "0" * 64})
    got = [r["i"] for r in spark.createDataFrame([(good,), (forged,), ('{"a": 1}',)], "t string").select(methods.identity(F.col("t")).alias("i")).collect()]
    assert got[0]["hash"] == got[0]["semantic"] == canonical.sha256_hex(own["body"]) and got[1]["semantic"] is None and got[1]["hash"] == canonical.sha256_hex(json.loads(forged)) and got[2]["hash"] == canonical.sha256_hex({"a": 1})
    df = spark.createDataFrame([(["b", "", "a", "b"], [4, 1, 4], "pack", "6BA7B810-9dad-11d1-80b4-00c04fd430c8")], "s array<string>, p array<int>, k string, u string")
    r = df.select(methods.distinct_strings(F.col("s")).alias("s"), methods.prefixes(F.col("p")).alias("p"), methods.missing_capabilities(F.col("s"), F.array(F.lit("a"))).alias("m"), methods.render("x {artifact_pack} y", F.col("k")).alias("r"), methods.is_uuid(F.col("u")).alias("u"), methods.is_uuid(F.col("k")).alias("n")).first()
    assert (r["s"], r["p"], r["m"], r["r"]["prompt"], r["u"], r["n"]) == (["a", "b"], [4, 1], ["", "b"], "x pack y", True, False)
    with pytest.raises(Exception, match="positive"):
        df.select(methods.prefixes(F.array(F.lit(0)))).collect()
    with pytest.raises(ValueError):
        methods.render("none", F.col("k"))
