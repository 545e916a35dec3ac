"""The registered queries of the evaluation operators, over the views of one data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import columns as C
from evalloom.functions import predicate, uint256
from evalloom.operators import adjudication, bindings, campaigns, endpoints, events, inference, methods, pairing, planning, quality, readiness, scheduler, search, selection
from evalloom.plans.views import Views

CONTRASTS = [("X", "P"), ("X", "T0")]
PREFIXES = (1, 2, 4, 8)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def _hier(v: Views, truth: str, field: str) -> DataFrame:
    return endpoints.hierarchical_mean(v.outcomes().where(F.col("ground_truth") == truth), field, ["method"])


@query
def hier_recall(v: Views) -> DataFrame:
    return _hier(v, "positive", "detected")


@query
def hier_false_alert(v: Views) -> DataFrame:
    return _hier(v, "negative", "claim_emitted")


@query
def witness_yield(v: Views) -> DataFrame:
    return _hier(v, "positive", "native_witness")


@query
def fdp_analysis(v: Views) -> DataFrame:
    return endpoints.false_discovery(v.outcomes(), ["method"])


@query
def restricted_time(v: Views) -> DataFrame:
    return endpoints.restricted_time(v.outcomes(), "claim_time_seconds", ["method"])


@query
def kaplan_meier(v: Views) -> DataFrame:
    return endpoints.kaplan_meier(v.outcomes(), "claim_time_seconds", ["method"])


@query
def stage_denominators(v: Views) -> DataFrame:
    return endpoints.denominators(v.outcomes(), ["detected", "useful_proposal", "claim_emitted", "native_witness", "independent_replay"], ["method"])


@query
def endpoint_table_long(v: Views) -> DataFrame:
    """All hierarchical endpoints in one pass: a row for each metric that a campaign counts for."""
    metrics = [("recall", "positive", "detected"), ("useful_recall", "positive", "useful_proposal"), ("false_alert", "negative", "claim_emitted"), ("witness_yield", "positive", "native_witness"), ("replay_rate", "positive", "independent_replay")]
    long = v.outcomes().where("ground_truth <> 'unresolved'").select("method", "lineage_id", "instance_id", "ground_truth", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).alias("truth"), F.col(f).alias("v")) for m, t, f in metrics))))
    return endpoints.hierarchical_mean(long.where("ground_truth = truth"), "v", ["metric", "method"])


def _effects(v: Views) -> DataFrame:
    rows = v.outcomes().where("ground_truth = 'positive'")
    return pairing.paired_effects(rows, CONTRASTS, ["lineage_id", "instance_id", "replicate"], "detected", "method", [["lineage_id", "instance_id"], ["lineage_id"]])


@query
def paired_lineage_effects(v: Views) -> DataFrame:
    return _effects(v)


@query
def paired_verification_effects(v: Views) -> DataFrame:
    rows = v.hits(PREFIXES).where("availability = 'available'")
    return pairing.paired_effects(rows.withColumn("hit", F.col("hit").cast("int")), CONTRASTS, ["lineage_id", "instance_id", "replicate", "ground_truth"], "hit", "arm", [["lineage_id"]], ["prefix"])


@query
def prefix_recall(v: Views) -> DataFrame:
    return endpoints.prefix_recall(v.hits(PREFIXES), ["arm"])


@query
def false_alert_prefix(v: Views) -> DataFrame:
    return endpoints.prefix_recall(v.hits(PREFIXES[-1:]), ["arm"], truth="negative")


@query
def verification_fdp(v: Views) -> DataFrame:
    return endpoints.verification_fdp(v.hits(PREFIXES), ["arm"], PREFIXES[-1])


@query
def stage_status_counts(v: Views) -> DataFrame:
    facts = v.facts()
    return endpoints.stage_counts(v.stages().join(facts, F.col("key") == F.col("l_orderkey")), facts, ["arm"])


@query
def scoped_denominators(v: Views) -> DataFrame:
    stages = v.stages().join(v.facts().withColumnRenamed("arm", "method"), F.col("key") == F.col("l_orderkey"))
    return endpoints.scoped_counts(stages, ["method", "lineage_id", "ground_truth"], PREFIXES)


@query
def outcome_bridge(v: Views) -> DataFrame:
    return endpoints.bridge(v.facts(), v.slots(), v.stages(), 8, 3600.0)


@query
def proposal_prefix_recall(v: Views) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot_index", "identity"))), lambda s: s["identity"])
    batches = v.slots().groupBy("l_orderkey").agg(ordered.alias("ordered"), F.collect_list(F.when(F.col("verified_finding"), F.col("identity"))).alias("gold"))
    return endpoints.proposal_recall(batches.withColumn("availability", F.when(F.col("l_orderkey") % 10 == 0, "missing").otherwise("available")), PREFIXES)


@query
def budget_recall(v: Views) -> DataFrame:
    rows = v.outcomes().where("ground_truth = 'positive'").withColumn("budget_n", F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("key") % 4 + 1).cast("int")))
    return endpoints.budget_recall(rows, (*PREFIXES, 16))


@query
def poisoned_resource_sums(v: Views) -> DataFrame:
    long = v.slots().select((F.col("l_orderkey") % 3).alias("arm"), F.inline(F.array(F.struct(F.lit("elapsed").alias("field"), F.col("elapsed").alias("v")), F.struct(F.lit("tax").alias("field"), F.col("l_tax").alias("v")))))
    t = long.groupBy("arm", "field").agg(F.round(C.poisoned_sum(F.col("v")), 6).alias("value"), F.count("v").alias("known"), F.count("*").alias("total"))
    return t.select("*", (F.col("total") - F.col("known")).alias("missing"), F.when(F.col("known") < F.col("total"), "missing_observation").alias("note"))


@query
def paired_resource(v: Views) -> DataFrame:
    # hundred-thousandths are whole numbers here, so that sums don't depend on their order
    sums = v.slots().groupBy("l_orderkey").agg(C.poisoned_sum(F.round(F.col("elapsed") * 100000).cast("long"), empty_is_zero=False).alias("v"))
    rows = v.facts().join(sums, F.col("key") == F.col("l_orderkey"))
    out = pairing.paired_effects(rows, CONTRASTS[:1], ["lineage_id", "instance_id", "replicate"], "v", "arm", [["lineage_id", "instance_id"], ["lineage_id"]])
    return out.withColumn("effect", F.round(F.col("effect") / 100000, 9))


@query
def telemetry_by_phase(v: Views) -> DataFrame:
    e = v.table("events")
    tokens = F.when((F.col("event_type") != "error") | (F.col("event_id") % 2 == 0), (F.col("event_id") % 97).cast("double"))
    out = events.telemetry(e.select(F.col("event_type").alias("phase"), F.col("value").alias("cpu"), F.col("value").alias("memory"), tokens.alias("tokens")), "phase")
    return out.withColumn("cpu", F.round("cpu", 6))


def _labels(v: Views) -> DataFrame:
    return v.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("left"), F.col("toxic").alias("right"))


@query
def agreement_kappa(v: Views) -> DataFrame:
    return pairing.agreement(_labels(v))


@query
def confusion_matrix(v: Views) -> DataFrame:
    return pairing.confusion(_labels(v))


@query
def sign_test(v: Views) -> DataFrame:
    return inference.sign_test(_effects(v), ["contrast"])


@query
def holm(v: Views) -> DataFrame:
    return inference.holm(inference.sign_test(_effects(v), ["contrast"]).select("contrast", "p"), "contrast").select("contrast", "p", "adjusted")


@query
def bootstrap_ci(v: Views) -> DataFrame:
    out = inference.bootstrap(_effects(v), ["contrast"], seed=11, draws=200, confidence=0.95)
    return out.select("contrast", *(F.round(c, 6).alias(c) for c in ("point", "low", "high")))


@query
def cluster_bootstrap(v: Views) -> DataFrame:
    items = v.table("labels").join(v.table("documents").select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == F.col("toxic")).cast("int").alias("same"))
    return inference.cluster_bootstrap(items, "source", "same", seed=5, draws=200, confidence=0.95)


@query
def leave_one_out(v: Views) -> DataFrame:
    return inference.leave_one_out(_effects(v), ["contrast"], "lineage_id")


@query
def zero_event_bound(v: Views) -> DataFrame:
    return inference.zero_event_bound(v.outcomes().where("ground_truth = 'negative'"), ["method"], 0.95)


@query
def stratified_sample(v: Views) -> DataFrame:
    return selection.stratified_sample(v.table("documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 20, "de": 10, "fr": 5}, seed=3)


@query
def balanced_subset(v: Views) -> DataFrame:
    rows = v.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_custkey") % 3).alias("truth"))
    return selection.balanced_subset(rows, "c_custkey", ["c_mktsegment", "c_nationkey", "truth"], ["c_nationkey", "c_mktsegment"], size=40, seed=13)


@query
def cheapest_eligible(v: Views) -> DataFrame:
    return selection.cheapest_eligible(v.table("part"), F.col("p_size") >= 25, [F.col("p_retailprice"), F.desc("p_size"), F.col("p_partkey")]).select("p_partkey", "p_retailprice")


@query
def precision_simulation(v: Views) -> DataFrame:
    n = v.table("nation")
    lineages = n.select(F.col("n_name").alias("lineage_id"), (F.lit(0.2) + (F.col("n_nationkey") % 5) * 0.05).alias("p_left"), (F.lit(0.1) + (F.col("n_nationkey") % 3) * 0.05).alias("p_right"))
    return inference.precision_simulation(lineages, seed=9, draws=40, per_lineage=4, per_instance=3)


@query
def budget_estimate(v: Views) -> DataFrame:
    k = F.col("r_regionkey")
    rate = F.when(k != 3, 2.5)
    out = planning.budget(v.table("region").select("r_regionkey"), k + 1, methods=3, replicates=4, calls=8, tokens_in=100 + 0.5 * k, tokens_out=20, hours=0.25, price_in=rate, price_out=F.lit(10.0))
    return out.select("r_regionkey", "campaigns", "calls", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), "hours", "cost")


@query
def campaign_plan(v: Views) -> DataFrame:
    who = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return planning.campaign_plan(who.select(F.concat(F.lit("i"), F.col("c_custkey")).alias("instance_id"), F.col("n_name").alias("lineage_id")), ["X", "P", "T0"], ["b1", "b2"], 2, seed=17)


@query
def sensitivity_matrix(v: Views) -> DataFrame:
    axes = {"track": ["X", "P"], "solver": [10, 30, 120], "horizon": [15, 60], "prefix": [1, 2, 4, 8], "noise": ["low", "mid", "high"]}
    return planning.sensitivity_matrix(v.spark, axes, ~((F.col("track") == "P") & (F.col("solver") == 120)))


@query
def dedup_slots(v: Views) -> DataFrame:
    return selection.duplicate_slots(v.slots(), "l_orderkey", "identity", "slot_index", F.col("l_quantity") >= 5).select("l_orderkey", "slot_index", "identity", "duplicate")


@query
def dedup_findings(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.sha2("text", 256).alias("identity"), "doc_id", "source")
    return selection.first_wins(rows, ["identity"], "doc_id")


@query
def event_validation(v: Views) -> DataFrame:
    return events.validate_log(v.log())


@query
def foreign_keys(v: Views) -> DataFrame:
    children = {"lineitem_part": (v.table("lineitem"), "l_partkey"), "orders_customer": (v.table("orders"), "o_custkey")}
    parents = {"part": (v.table("part").where("p_size < 40"), "p_partkey"), "customer": (v.table("customer").where("c_acctbal > 0"), "c_custkey")}
    return events.foreign_keys(children, parents, {"lineitem_part": "part", "orders_customer": "customer"})


@query
def attempt_lifecycle(v: Views) -> DataFrame:
    names = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "uncertain").when(F.col("event_type") == "purchase", "terminal")
    return events.fold_attempts(v.log().withColumn("event", names).where("event IS NOT NULL"))


@query
def method_events(v: Views) -> DataFrame:
    return events.method_events(v.slots())


@query
def trace_once(v: Views) -> DataFrame:
    return events.within(v.log(), F.col("value") > 50, 3).select("attempt_id", "seq", "once")


@query
def trace_globally(v: Views) -> DataFrame:
    return v.log().groupBy("attempt_id").agg(F.bool_and((F.col("value") >= 1) | (F.col("event_type") != "view")).alias("globally"))


@query
def predicate_eval(v: Views) -> DataFrame:
    """(q > 40) or ((q - d) div t >= 3), with d unbound where there is no discount."""
    symbol = lambda s: {"kind": "symbol", "symbol_id": s, "state": "post"}
    literal = lambda n: {"kind": "literal", "type": "uint256", "value": n}
    binary = lambda o, a, b: {"kind": "binary", "operator": o, "left": a, "right": b}
    body = binary("or", binary("gt", symbol("q"), literal(40)), binary("ge", binary("div", binary("sub", symbol("q"), symbol("d")), symbol("t")), literal(3)))
    rows = v.slots().select("l_orderkey", "slot_index", F.col("l_quantity").cast("decimal(38,0)").alias("q"), F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("decimal(38,0)")).alias("d"), F.round(F.col("l_tax") * 100).cast("decimal(38,0)").alias("t"))
    compiler = predicate.Compiler({s: ("uint256", "source") for s in "qdt"}, {(s, "post"): F.col(s) for s in "qdt"})
    return predicate.evaluate(rows, {"kind": "invariant", "body": body}, compiler, ["l_orderkey", "slot_index"])


@query
def predicate_wide(v: Views) -> DataFrame:
    """q * 2^130 * (q bxor 5) >= 2^141 and (d shl 250) > 2^252: beyond any native integer."""
    symbol = lambda s: {"kind": "symbol", "symbol_id": s, "state": "post"}
    literal = lambda n: {"kind": "literal", "type": "uint256", "value": n}
    binary = lambda o, a, b: {"kind": "binary", "operator": o, "left": a, "right": b}
    product = binary("mul", binary("mul", symbol("q"), literal(1 << 130)), binary("bxor", symbol("q"), literal(5)))
    body = binary("and", binary("ge", product, literal(1 << 141)), binary("gt", binary("shl", symbol("d"), literal(250)), literal(1 << 252)))
    rows = v.slots().select("l_orderkey", "slot_index", F.col("l_quantity").cast("decimal(38,0)").alias("q"), F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("decimal(38,0)")).alias("d"))
    compiler = predicate.Compiler({s: ("uint256", "source") for s in "qd"}, {(s, "post"): F.col(s) for s in "qd"})
    return predicate.evaluate(rows, {"kind": "invariant", "body": body}, compiler, ["l_orderkey", "slot_index"])


@query
def uint256_arith(v: Views) -> DataFrame:
    key = uint256.from_long(F.col("o_orderkey"))
    big = uint256.arith("shl", key, F.lit(uint256.encode(240)))
    rows = v.table("orders").select("o_orderkey", key.alias("k"), big["value"].alias("big"))
    out = rows.withColumn("sum", uint256.arith("add", F.col("big"), F.col("k"))).withColumn("product", uint256.arith("mul", F.col("big"), F.col("k")))
    return out.select("o_orderkey", "big", F.col("sum.value").alias("sum"), F.col("product.value").alias("product"), F.col("product.error").alias("error"))


@query
def antecedent_reachability(v: Views) -> DataFrame:
    error = F.when(F.col("l_discount") == 0, "missing binding")
    return predicate.reachability(v.slots(), F.col("l_quantity") > 45, error, "slot_index", ["l_orderkey"], exhaustive=True)


@query
def bfs_search(v: Views) -> DataFrame:
    return search.levels(v.spark, [1, 2], search.Bounds(4, 4, 2), search.Profile(), F.array_contains("delivered", F.lit(2).cast("bigint")))


@query
def import_closure(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    half = F.floor(k / 2).cast("long")
    return search.closure(v.table("part").where(half > 0).select(k.alias("src"), half.alias("dst")))


@query
def manifest_rules(v: Views) -> DataFrame:
    rules = {"negative_total": F.col("o_totalprice") < 1000, "open_and_urgent": (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "old": F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp")}
    return quality.rule_errors(v.table("orders"), "o_orderkey", rules)


@query
def pair_rules(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    other = F.when(k % 2 == 0, k + 1).when(k % 6 == 1, k - 1)
    rows = v.table("orders").select(k.alias("k"), (F.col("o_custkey") % 7).alias("l"), other.alias("o"))
    return quality.reciprocal_pairs(rows, "k", "o", "l")


@query
def inventory(v: Views) -> DataFrame:
    return quality.inventory(v.table("orders"), ["o_orderstatus", "o_orderpriority"])


@query
def support_coverage(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_partkey", F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("m"))
    return quality.coverage(rows, "l_partkey", "m", ["s0", "s1", "s2"])


@query
def trace_rewrite(v: Views) -> DataFrame:
    mapping = v.spark.createDataFrame([("type", "even", "click", "TAP"), ("type", "shared", "click", "CLICK"), ("type", "shared", "view", "VIEW")], "kind string, scope string, original string, public string")
    rows = v.table("events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("scope"))
    return quality.rewrite(rows, mapping, "scope", "type", "event_type", "public").select("event_id", "event_type", "public")


@query
def content_hash(v: Views) -> DataFrame:
    return quality.duplicate_content(v.table("documents").where("text IS NOT NULL"), "doc_id", F.col("text"))


@query
def json_extract(v: Views) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return v.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query
def response_classes(v: Views) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "  ").when(i % 5 == 0, "no json").when(i % 3 == 0, '{"abstain": true, "reason": "none"}').otherwise(F.col("props"))
    c = C.response_class(F.when(F.col("event_type") == "error", "http"), i % 11 == 0, text)
    return v.table("events").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query
def label_reconcile(v: Views) -> DataFrame:
    return quality.reconcile(_labels(v))


@query
def gate_status(v: Views) -> DataFrame:
    return v.outcomes().groupBy("method", C.gate([F.col("detected"), F.col("native_witness")]).alias("gate")).agg(F.count("*").alias("n"))


@query
def status_history(v: Views) -> DataFrame:
    return selection.latest_status(v.log(), "attempt_id", "seq", "event_type")


@query
def pending_batch(v: Views) -> DataFrame:
    """A resumable batch: the limit is the operator."""
    done = v.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.pending(v.table("orders").select("o_orderkey", "o_totalprice"), done, "o_orderkey", "o_orderkey", 50)


@query
def set_differences(v: Views) -> DataFrame:
    left = v.table("orders").select(F.col("o_custkey").alias("k")).distinct()
    right = v.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return quality.set_difference(left, right)


@query
def candidate_projection(v: Views) -> DataFrame:
    slot = F.struct("slot_index", F.when(F.col("slot_index") % 2 == 0, F.concat(F.lit("s"), F.col("identity"))).alias("slot_id"), F.when(F.col("verified_finding"), "candidate").otherwise("abstain").alias("status"), F.col("identity").cast("string").alias("payload"))
    ordered = v.slots().groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return campaigns.candidate_inputs(ordered)


@query
def failure_reasons(v: Views) -> DataFrame:
    ladder = {f"{s}_{c}": F.col(s) == c for s in ("grounding", "symbolic_search", "witness_check", "independent_replay") for c in ("failed", "timeout", "unsupported", "unknown")}
    return v.slots().groupBy(campaigns.first_reason(ladder).alias("reason")).agg(F.count("*").alias("n"))


@query
def unknown_outcomes(v: Views) -> DataFrame:
    queue = v.table("lineitem").select(F.col("l_orderkey").alias("campaign_id"), "l_linenumber", "l_partkey").withColumn("seq", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    return campaigns.unknown_outcomes(queue.select("campaign_id", "seq"), "campaign_id", "seq").select("campaign_id", "seq", "detected", "availability")


@query
def strict_match(v: Views) -> DataFrame:
    return campaigns.strict_match(v.outcomes(), ["instance_id", "replicate"], "method", "X", "P")


@query
def run_terminal_report(v: Views) -> DataFrame:
    runs = v.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    ends = v.table("lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"))
    return campaigns.run_report(runs, ends, "o_orderkey").groupBy("status", "check").agg(F.count("*").alias("n"))


@query
def design_balance(v: Views) -> DataFrame:
    return campaigns.design_balance(v.table("customer"), "c_mktsegment", {"BUILDING": 10, "MACHINERY": 0, "absent": 3})


@query
def registry_differences(v: Views) -> DataFrame:
    left = v.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    right = v.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return campaigns.registry_differences(left, right, "k", ["nation"])


@query
def symbol_bindings(v: Views) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["bool", "uint256", "address", "string"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    symbols = v.table("part").select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("n"), F.col("p_partkey") % 97).alias("name"), kind.alias("type"))
    layout = v.table("supplier").select(F.concat(F.lit("n"), F.col("s_suppkey")).alias("label"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).alias("slot"), (F.col("s_suppkey") % 20 - 1).cast("int").alias("offset"))
    return bindings.bind_symbols(symbols, layout)


@query
def action_bindings(v: Views) -> DataFrame:
    actions = v.table("customer").select(F.col("c_custkey").alias("action"), F.concat(F.lit("f"), F.col("c_custkey") % 30).alias("name"), F.concat(F.lit("c"), F.col("c_custkey") % 3).alias("target"))
    functions = v.table("supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 20).alias("name"), F.concat(F.lit("x.c"), F.col("s_suppkey") % 4).alias("contract"))
    return bindings.bind_actions(actions, functions)


@query
def legitimacy(v: Views) -> DataFrame:
    reasons = {"single_domain": F.col("p_size") < 10, "no_post_state": F.col("p_partkey") % 7 == 0, "constant_body": F.col("p_retailprice") < 950}
    out = bindings.legitimacy(v.table("part").select("p_partkey", "p_size", "p_retailprice"), reasons, {"constant_body"})
    return out.select("p_partkey", "legitimacy", F.array_join("reasons", ",").alias("reasons"))


@query
def verified_findings(v: Views) -> DataFrame:
    q = F.col("l_quantity")
    s = v.slots().select("l_orderkey", "slot_index", campaigns.verified(q > 20, F.col("l_discount") > 0.05, F.col("l_tax") < 0.04, F.col("independent_replay") == "passed").alias("finding"))
    return s.groupBy("l_orderkey").agg(F.count_if("finding").alias("verified"), F.count("finding").alias("known"), F.count("*").alias("total"))


@query
def scheduler_replay(v: Views) -> DataFrame:
    """Purchases release what the view before them asked for; rows only, as the state is sequential."""
    e = v.table("events").where("event_type IN ('view', 'purchase')")
    log = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2).cast("long").alias("request"), F.when(F.col("event_type") == "view", "request").otherwise("release").alias("event"))
    return scheduler.replay(log, 2, 3)


@query
def eligible_by_all(v: Views) -> DataFrame:
    """Parts that every one of three supplier groups supports."""
    rows = v.table("lineitem").select("l_partkey", (F.col("l_suppkey") % 3).alias("m"))
    return rows.groupBy("l_partkey").agg(F.count_distinct("m").alias("methods")).where("methods = 3").select("l_partkey")


@query
def split_leakage(v: Views) -> DataFrame:
    """Lineages that occur in both splits."""
    rows = v.outcomes().select("lineage_id", F.when(F.col("key") % 5 == 0, "held").otherwise("open").alias("split"))
    return rows.groupBy("lineage_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query
def telemetry_windows(v: Views) -> DataFrame:
    """The batch form of the streaming windows: five-minute sums by event type."""
    e = v.table("events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return e.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n", "value")


@query
def preflight_panel(v: Views) -> DataFrame:
    rows = v.table("part").select((F.col("p_partkey") % 6).cast("string").alias("family"), (F.col("p_size") > 0).alias("a"), (F.col("p_partkey") % 35 != 4).alias("b"))
    return readiness.preflight(rows, [str(i) for i in range(8)], "family", ["a", "b"])


@query
def admission_blockers(v: Views) -> DataFrame:
    rich = v.table("customer").where("c_acctbal > 5000")
    evidence = {"lock": (v.table("orders"), "o_custkey"), "review": (rich, "c_custkey")}
    return readiness.blockers(v.table("customer").select("c_custkey"), "c_custkey", evidence)


@query
def launch_guard(v: Views) -> DataFrame:
    asked = v.table("orders").select(F.col("o_custkey").alias("k")).distinct()
    return readiness.launch_guard(asked, v.table("customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("k")), "k", {"protocol": True, "review": None, "budget": False})


@query
def resume_actions(v: Views) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["worker_restart", "lost_response", "provider_outage", "version_drift"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = v.table("orders").select("o_orderkey", kinds.alias("kind"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("v"), F.col("o_custkey") % 2)).alias("version"))
    return readiness.resume_policy(rows, F.col("kind"), F.col("version"), "v1").groupBy("kind", "action").agg(F.count("*").alias("n"))


@query
def timing_summary(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("wall"), (F.col("l_quantity") - F.when(F.col("l_returnflag") == "A", 10).otherwise(0)).alias("solver"), F.col("l_tax").alias("queue"))
    return readiness.timing_summary(rows, ["l_returnflag"], ["wall", "solver", "queue"])


@query
def benchmark_rows(v: Views) -> DataFrame:
    return readiness.benchmark_rows(v.spark, ["l1", "l2", "l3"], [f"m{i}" for i in range(10)])


@query
def power_table(v: Views) -> DataFrame:
    return readiness.power_table(v.spark, [5, 10, 20, 40], [0.3, 0.5, 0.7], 0.5)


def _responses(v: Views) -> DataFrame:
    """Events as archived responses: a user's events in order are the slots of an attempt."""
    e, i = v.table("events"), F.col("event_id")
    text = F.when(i % 13 == 0, "  ").when(i % 17 == 0, "no json").when(i % 19 == 0, '{"abstain": true, "reason": "none"}').otherwise(F.concat(F.lit('{"kind": "invariant", "n": '), (i % 7).cast("string"), F.lit("}")))
    return e.select(
        F.col("user_id").alias("attempt_id"), F.col("event_id").alias("slot"), F.when(F.col("event_type") == "error", "http_500").alias("error"), (i % 23 == 0).alias("partial"), text.alias("text"),
        F.when(i % 29 == 0, "other").otherwise("m1").alias("response_model"), (i % 50).alias("tokens_in"), (i % 31).alias("tokens_out"),
    )


def _method_slots(v: Views) -> DataFrame:
    n = F.get_json_object("text", "$.n")
    return methods.run(_responses(v), "attempt_id", "slot", F.when(n.isNotNull(), F.concat(F.lit("n"), n)), 45, 28, model="m1")


@query
def method_run(v: Views) -> DataFrame:
    return _method_slots(v)


@query
def unique_candidates(v: Views) -> DataFrame:
    return methods.unique_candidates(_method_slots(v), "attempt_id")


@query
def slot_ledger(v: Views) -> DataFrame:
    """Lines as slot records, with repeated, unfinished and contradictory ones."""
    k = F.col("l_partkey")
    status = F.when(k % 11 == 0, "pending").when(F.col("l_returnflag") == "A", "candidate").when(k % 5 == 0, "odd").otherwise("abstain")
    rows = v.table("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("slot"), status.alias("status"), F.when(k % 3 != 0, k).alias("candidate"), F.when(k % 4 == 0, F.sha2(k.cast("string"), 256)).when(k % 9 == 0, "zz").alias("canonical_ast_hash"))
    return methods.slot_errors(rows, "l_orderkey", "slot", 5)


@query
def missing_slots(v: Views) -> DataFrame:
    slots = v.table("lineitem").where("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_linenumber") - 1).alias("slot"))
    return methods.missing_slots(slots, v.table("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "slot", 4)


@query
def version_block(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    rows = v.table("orders").select("o_orderkey", F.when(k % 5 != 0, F.concat(F.lit("h"), (k % 3).cast("string"))).alias("identity_hash"), F.when(k % 4 != 0, k % 2 == 0).alias("canary_passed"), F.when(k % 11 == 0, "approved").alias("deviation"))
    return methods.version_block(rows, "h1").groupBy("status", "reason").agg(F.count("*").alias("n"))


@query
def status_errors(v: Views) -> DataFrame:
    rows = v.table("orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.lit(1)).otherwise(2).alias("status_mapping_version"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderstatus")).alias("campaign_status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("search_status"))
    return methods.status_errors(rows, "o_orderkey", {"campaign_status": ["F", "O"], "search_status": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})


@query
def parity(v: Views) -> DataFrame:
    """The lines of two return flags as the findings of a reference and an adapted run, by part."""
    rows = v.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", F.concat(F.lit("s"), F.col("l_suppkey") % 2).alias("finding_id"), F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("category"), F.when(F.col("l_partkey") % 6 == 0, "partial").otherwise("done").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return methods.parity(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'").withColumn("status", F.lit("done")), "l_partkey", "o")


@query
def worker_isolation(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    mount = lambda source, kind, ro: F.struct(source.alias("source"), F.lit("/mnt/x").alias("target"), kind.alias("sensitivity"), ro.alias("read_only"))
    mounts = F.array(mount(F.lit("/data/pack"), F.lit("public_artifact"), F.lit(True)), mount(F.when(k % 5 == 0, "C:\\Users\\Models").otherwise("/data/raw"), F.when(k % 7 == 0, "private_gold").otherwise("controlled_raw"), k % 3 != 0))
    endpoint = F.when(k % 4 == 0, "https://Provider.example/v1").when(k % 4 == 1, "ftp://provider.example").when(k % 4 == 2, "http://user@other.example:80/x")
    return methods.isolation(v.table("customer").select("c_custkey", mounts.alias("mounts"), (k % 10 == 0).alias("broadcast"), endpoint.alias("endpoint")), "c_custkey", ["provider.example"])


@query
def support_admits(v: Views) -> DataFrame:
    """Suppliers of an order as required features, nations as categories of a support matrix."""
    required = v.table("lineitem").select("l_orderkey", (F.col("l_suppkey") % 30).alias("category"), F.col("l_returnflag").alias("feature")).distinct()
    support = v.table("nation").select(F.col("n_nationkey").alias("category"), F.explode(F.array(*map(F.lit, "ANR"))).alias("feature")).withColumn("status", F.when(F.col("category") % 9 == 0, "unsupported").when(F.col("category") % 2 == 0, "conditional").otherwise("supported"))
    return methods.admits(required, support, "l_orderkey")


@query
def artifact_status(v: Views) -> DataFrame:
    contracts = v.table("part").select((F.col("p_partkey") % 40).alias("lineage"), F.col("p_size").alias("functions"), F.when(F.col("p_size") > 10, 1).alias("events"), F.lit(2).alias("slots"))
    code = v.table("supplier").select((F.col("s_suppkey") % 53).alias("lineage"), F.when(F.col("s_suppkey") % 8 == 0, "0x").otherwise("0x6000").alias("hex"))
    return methods.artifact_status(contracts, code, "lineage")


@query
def batch_report(v: Views) -> DataFrame:
    runs = v.table("orders").select(F.col("o_orderstatus").alias("status"))
    return methods.batch_report(runs, v.table("events"), v.table("lineitem").select(F.col("l_linestatus").alias("phase")))


@query
def ablation_plan(v: Views) -> DataFrame:
    return methods.ablation_plan(v.spark)


@query
def campaign_envelope(v: Views) -> DataFrame:
    """Campaigns with nested outcomes, read back as counts, the order of slots and the timing."""
    nested = methods.envelope(v.outcomes().select(F.col("key").alias("l_orderkey"), "method"), v.slots().select("l_orderkey", "slot_index", "identity", "elapsed"), "l_orderkey", "slot_index")
    return nested.select("l_orderkey", "method", F.coalesce(F.size("outcomes"), F.lit(0)).alias("n"), F.array_join(F.transform("outcomes", lambda o: o["identity"]), ",").alias("identities"), F.col("timing.status").alias("timing"), F.round("timing.seconds", 6).alias("seconds"))


@query
def adjudication_reconcile(v: Views) -> DataFrame:
    """Labels of documents as those of two raters; some findings have one label, one rater, or a rater who adjudicates."""
    base = v.table("labels").select(F.concat(F.lit("f"), F.col("doc_id")).alias("finding_id"), "doc_id", "quality", "toxic")
    label = lambda rater, status, failure: F.struct(rater.alias("rater_id"), F.lit("rater").alias("role"), status.cast("string").alias("status"), failure.alias("first_failure"))
    k = F.col("doc_id")
    one, two = label(F.lit("r1"), F.col("quality"), F.lit(None).cast("string")), label(F.when(k % 11 == 0, "r1").otherwise("r2"), F.col("toxic"), F.when(k % 4 == 0, "late"))
    labels = base.select("finding_id", F.inline(F.when(k % 7 == 0, F.array(one)).otherwise(F.array(one, two))))
    return adjudication.reconcile(base.where(k % 13 != 0), labels, F.when(F.col("finding_id").endswith("5"), "r2").otherwise("r3"))


@query
def requirement_mappings(v: Views) -> DataFrame:
    mappings = v.table("lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") * 3).alias("finding_id")).where("l_returnflag = 'A'")
    return adjudication.mapping_errors(mappings, v.table("part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("finding_id")))


@query
def adjudication_templates(v: Views) -> DataFrame:
    rows = v.table("nation").select(F.col("n_name").alias("instance_id"), F.col("n_regionkey").alias("lineage_id"), F.lit(None).cast("string").alias("property_family"), F.lit("dev").alias("cohort"))
    return adjudication.templates(rows).select("instance_id", "lineage_id", "record_status", "source_manifest_row_hash", F.size("labels").alias("labels"), F.array_join("reviewer_roles", ",").alias("reviewer_roles"))


@query
def distinct_findings(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("finding_id"), F.col("l_partkey").alias("instance_id"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("c"), F.col("l_suppkey") % 4)).alias("root_cause_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return adjudication.distinct_findings(rows, "o")
