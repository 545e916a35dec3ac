"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

OUTCOMES = """
o AS (
  SELECT 'c' || o_orderkey AS campaign_id, 'i' || o_custkey AS instance_id, n_name AS lineage_id, CASE o_orderkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'P' ELSE 'T0' END AS method,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS replicate,
    CASE WHEN o_custkey % 5 <= 2 THEN 'positive' WHEN o_custkey % 5 = 3 THEN 'negative' ELSE 'unresolved' END AS ground_truth,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 200000 END AS detected,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'available' WHEN o_orderpriority = '3-MEDIUM' THEN 'timeout' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'provider_failure'
      WHEN o_orderstatus = 'F' THEN 'unsupported' ELSE 'unknown' END AS availability, o_orderkey AS key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), outcomes AS (
  SELECT *, detected AS useful_proposal, detected AND key % 4 <> 0 AS native_witness, detected AND key % 4 <> 0 AND key % 7 <> 0 AS independent_replay, detected AS claim_emitted,
    CASE WHEN detected THEN ground_truth = 'positive' END AS correct_claim, CASE WHEN detected THEN (key * 37 % 5000)::DOUBLE END AS claim_time_seconds,
    CASE WHEN detected THEN (key * 53 % 4800)::DOUBLE END AS witness_time_seconds, 3600.0::DOUBLE AS horizon_seconds
  FROM o
)"""

SLOTS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS slot_index FROM lineitem
), raw AS (
  SELECT l_orderkey, slot_index, l_partkey AS identity, CASE WHEN l_discount <> 0 THEN l_extendedprice / 1000 END AS elapsed, l_quantity, l_discount, l_tax,
    CASE WHEN l_quantity >= 10 THEN 'passed' ELSE 'failed' END AS s1, CASE l_returnflag WHEN 'N' THEN 'passed' WHEN 'A' THEN 'timeout' ELSE 'unknown' END AS s2,
    CASE WHEN l_linestatus = 'F' THEN 'passed' ELSE 'failed' END AS s3, CASE WHEN l_tax < 0.05 THEN 'passed' ELSE 'unsupported' END AS s4
  FROM ranked WHERE slot_index < 8
), slots AS (
  SELECT l_orderkey, slot_index, identity, elapsed, l_quantity, l_discount, l_tax, s1 AS grounding, CASE WHEN s1 = 'passed' THEN s2 ELSE 'not_applicable' END AS symbolic_search,
    CASE WHEN s1 = 'passed' AND s2 = 'passed' THEN s3 ELSE 'not_applicable' END AS witness_check, CASE WHEN s1 = 'passed' AND s2 = 'passed' AND s3 = 'passed' THEN s4 ELSE 'not_applicable' END AS independent_replay,
    s1 = 'passed' AND s2 = 'passed' AND s3 = 'passed' AND s4 = 'passed' AS verified_finding
  FROM raw
), stages AS (
  SELECT l_orderkey, slot_index, 0 AS stage_index, 'grounding' AS stage, grounding AS status FROM slots UNION ALL SELECT l_orderkey, slot_index, 1, 'symbolic_search', symbolic_search FROM slots
  UNION ALL SELECT l_orderkey, slot_index, 2, 'witness_check', witness_check FROM slots UNION ALL SELECT l_orderkey, slot_index, 3, 'independent_replay', independent_replay FROM slots
)"""

HITS = OUTCOMES + "," + SLOTS + """, hits AS (
  SELECT key, instance_id, lineage_id, replicate, method AS arm, ground_truth, availability, prefix, coalesce(first < prefix, false) AS hit
  FROM outcomes JOIN (SELECT DISTINCT l_orderkey FROM slots) s ON key = s.l_orderkey
    LEFT JOIN (SELECT l_orderkey, min(slot_index) AS first FROM slots WHERE verified_finding GROUP BY 1) f ON key = f.l_orderkey, (VALUES (1), (2), (4), (8)) p(prefix)
)"""

LOG = "log AS (SELECT user_id AS attempt_id, event_id AS seq, event_type, value, props, epoch_us(ts) / 1e6 AS monotonic_seconds, event_type = 'purchase' AS terminal FROM events)"


def _hier(truth: str, field: str) -> str:
    return f"""WITH {OUTCOMES}, r AS (SELECT *, {field}::INT::DOUBLE AS v FROM outcomes WHERE ground_truth = '{truth}'),
i AS (SELECT method, lineage_id, instance_id, avg(v) AS v FROM r WHERE v IS NOT NULL GROUP BY ALL), l AS (SELECT method, lineage_id, avg(v) AS v FROM i GROUP BY ALL), t AS (SELECT method, avg(v) AS v FROM l GROUP BY ALL)
SELECT r.method, round(max(t.v), 9) AS value, count(r.v) AS known, count(*) AS total, count(*) - count(r.v) AS missing, CASE WHEN max(t.v) IS NULL THEN 'no_known_measurements' END AS note
FROM r LEFT JOIN t ON r.method = t.method GROUP BY 1"""


EFFECTS = OUTCOMES + """, c(contrast, l, r) AS (VALUES ('X-P', 'X', 'P'), ('X-T0', 'X', 'T0')),
u AS (
  SELECT contrast, a.lineage_id, a.instance_id, avg(a.detected::INT - b.detected::INT) AS v FROM c JOIN outcomes a ON a.method = l
  JOIN outcomes b ON b.method = r AND a.lineage_id = b.lineage_id AND a.instance_id = b.instance_id AND a.replicate = b.replicate
  WHERE a.ground_truth = 'positive' AND a.detected IS NOT NULL AND b.detected IS NOT NULL GROUP BY 1, 2, 3
), e AS (SELECT contrast, lineage_id, round(avg(v), 9) AS effect, count(*) AS n FROM u GROUP BY 1, 2)"""

RECALL = """SELECT arm, prefix, round(hits / nullif(known, 0), 9) AS value, hits, known, total, total - known AS missing, CASE WHEN known = 0 THEN 'no_known_measurements' END AS note
FROM (SELECT arm, prefix, count(*) FILTER (availability = 'available' AND hit) AS hits, count(*) FILTER (availability = 'available') AS known, count(*) AS total FROM hits WHERE ground_truth = '{truth}' {more} GROUP BY 1, 2)"""

DRAW = "('0x' || substr(md5('{seed}|' || {draw} || '|' || {i}), 1, 8))::BIGINT % {n}"

SIGNS = """, t AS (SELECT contrast, count(*) FILTER (effect > 0) AS wins, count(*) FILTER (effect < 0) AS losses, count(*) FILTER (effect = 0) AS ties FROM e GROUP BY 1),
tail AS (SELECT contrast, k, sum(ln((wins + losses - j + 1)::DOUBLE / j)) AS lg FROM t, range(0, wins + losses + 1) q(k), range(1, k + 1) w(j) GROUP BY 1, 2),
p AS (
  SELECT t.contrast, wins, losses, ties, wins + losses AS n,
    CASE WHEN wins + losses > 0 THEN least(1.0, (SELECT sum(exp(coalesce(tail.lg, 0) - (wins + losses) * ln(2))) FROM range(0, wins + losses + 1) z(k) LEFT JOIN tail ON tail.contrast = t.contrast AND tail.k = z.k WHERE least(z.k, wins + losses - z.k) <= least(wins, losses))) END AS p
  FROM t
)"""

NATIONS = "lin AS (SELECT n_name AS lineage_id, 0.2 + (n_nationkey % 5) * 0.05 AS p_left, 0.1 + (n_nationkey % 3) * 0.05 AS p_right FROM nation)"

ORACLES: dict[str, str] = {
    "hier_recall": _hier("positive", "detected"),
    "hier_false_alert": _hier("negative", "claim_emitted"),
    "witness_yield": _hier("positive", "native_witness"),
    "fdp_analysis": f"""WITH {OUTCOMES}, t AS (
  SELECT method, count(*) FILTER (claim_emitted) AS total, count(*) FILTER (claim_emitted AND correct_claim IS NOT NULL) AS known, count(*) FILTER (claim_emitted AND NOT correct_claim) AS wrong FROM outcomes WHERE ground_truth = 'negative' GROUP BY 1)
SELECT method, round(wrong / nullif(known, 0), 9) AS value, known, total, total - known AS missing, CASE WHEN total = 0 THEN 'precision_NA_no_claims' END AS note FROM t""",
    "restricted_time": f"""WITH {OUTCOMES}, p AS (SELECT *, least(coalesce(claim_time_seconds, horizon_seconds), horizon_seconds) AS s FROM outcomes WHERE ground_truth = 'positive'),
a AS (SELECT method, round(avg(v), 9) AS v FROM (SELECT method, lineage_id, avg(v) AS v FROM (SELECT method, lineage_id, instance_id, avg(s) AS v FROM p GROUP BY ALL) GROUP BY ALL) GROUP BY 1),
b AS (SELECT method, round(avg(v), 9) AS v FROM (SELECT method, lineage_id, avg(v) AS v FROM (SELECT method, lineage_id, instance_id, avg(s) AS v FROM p WHERE availability = 'available' GROUP BY ALL) GROUP BY ALL) GROUP BY 1)
SELECT p.method, max(a.v) AS restricted, max(b.v) AS conditioned, round(count(*) FILTER (availability = 'available') / count(*), 9) AS intention_to_run, count(*) AS total, count(*) FILTER (claim_time_seconds IS NULL) AS missing
FROM p LEFT JOIN a ON p.method = a.method LEFT JOIN b ON p.method = b.method GROUP BY 1""",
    "kaplan_meier": f"""WITH {OUTCOMES}, t AS (
  SELECT method, least(coalesce(claim_time_seconds, horizon_seconds), horizon_seconds) AS time, count(*) AS n, count(*) FILTER (claim_time_seconds IS NOT NULL AND availability = 'available' AND claim_time_seconds <= horizon_seconds) AS events
  FROM outcomes WHERE ground_truth = 'positive' GROUP BY 1, 2
), r AS (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY time DESC)::BIGINT AS at_risk FROM t)
SELECT method, time, at_risk, events, round(product(1 - events / at_risk) OVER (PARTITION BY method ORDER BY time), 9) AS survival FROM r""",
    "stage_denominators": f"""WITH {OUTCOMES}, f AS (
  SELECT method, 'detected' AS field, detected AS v FROM outcomes UNION ALL SELECT method, 'useful_proposal', useful_proposal FROM outcomes UNION ALL SELECT method, 'claim_emitted', claim_emitted FROM outcomes
  UNION ALL SELECT method, 'native_witness', native_witness FROM outcomes UNION ALL SELECT method, 'independent_replay', independent_replay FROM outcomes)
SELECT method, field, count(*) AS total, count(v) AS known, count(*) - count(v) AS missing, count(*) FILTER (v) AS positive FROM f GROUP BY 1, 2
UNION ALL SELECT method, 'availability:' || availability, count(*), count(*), 0, count(*) FROM outcomes GROUP BY 1, 2""",
    "endpoint_table_long": " UNION ALL ".join(f"SELECT '{name}' AS metric, * FROM ({_hier(truth, field)})" for name, truth, field in [("recall", "positive", "detected"), ("useful_recall", "positive", "useful_proposal"), ("false_alert", "negative", "claim_emitted"), ("witness_yield", "positive", "native_witness"), ("replay_rate", "positive", "independent_replay")]),
    "paired_lineage_effects": f"WITH {EFFECTS} SELECT * FROM e",
    "paired_verification_effects": f"""WITH {HITS}, c(contrast, l, r) AS (VALUES ('X-P', 'X', 'P'), ('X-T0', 'X', 'T0')), v AS (SELECT * FROM hits WHERE availability = 'available')
SELECT contrast, a.lineage_id, a.prefix, round(avg(a.hit::INT - b.hit::INT), 9) AS effect, count(*) AS n FROM c JOIN v a ON a.arm = l
JOIN v b ON b.arm = r AND a.lineage_id = b.lineage_id AND a.instance_id = b.instance_id AND a.replicate = b.replicate AND a.prefix = b.prefix AND a.ground_truth = b.ground_truth GROUP BY 1, 2, 3""",
    "prefix_recall": f"WITH {HITS} {RECALL.format(truth='positive', more='')}",
    "false_alert_prefix": f"WITH {HITS} {RECALL.format(truth='negative', more='AND prefix = 8')}",
    "verification_fdp": f"""WITH {HITS}, t AS (
  SELECT arm, count(*) FILTER (availability = 'available' AND hit AND ground_truth = 'negative') AS wrong, count(*) FILTER (availability = 'available' AND hit AND ground_truth <> 'unresolved') AS known, count(*) AS total,
    count(*) FILTER (availability <> 'available' OR ground_truth = 'unresolved') AS missing FROM hits WHERE prefix = 8 GROUP BY 1)
SELECT arm, round(wrong / nullif(known, 0), 9) AS value, known, total, missing, CASE WHEN known = 0 THEN 'precision_NA_no_claims' END AS note FROM t""",
    "stage_status_counts": f"""WITH {OUTCOMES}, {SLOTS} SELECT method AS arm, stage, status, count(*) AS n FROM stages JOIN outcomes ON key = l_orderkey GROUP BY 1, 2, 3
UNION ALL SELECT method, 'campaign', availability, count(*) FROM outcomes GROUP BY 1, 3""",
    "scoped_denominators": f"""WITH {OUTCOMES}, {SLOTS}, j AS (SELECT method, lineage_id, ground_truth, prefix, stage, status FROM stages JOIN outcomes ON key = l_orderkey, (VALUES (1), (2), (4), (8)) p(prefix) WHERE slot_index < prefix)
SELECT 'method' AS dimension, method AS scope, prefix, stage, status, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'lineage_id', lineage_id, prefix, stage, status, count(*) FROM j GROUP BY ALL
UNION ALL SELECT 'ground_truth', ground_truth, prefix, stage, status, count(*) FROM j GROUP BY ALL""",
    "outcome_bridge": f"""WITH {OUTCOMES}, {SLOTS}, s AS (
  SELECT l_orderkey, bool_or(verified_finding) AS hit, bool_or(grounding = 'passed') AS useful, bool_or(witness_check = 'passed') AS witness, bool_or(independent_replay = 'passed') AS replay,
    (array_agg(elapsed ORDER BY slot_index) FILTER (verified_finding))[1] AS t FROM slots GROUP BY 1
), w AS (SELECT l_orderkey, first(stage || ':' || status ORDER BY slot_index, stage_index) AS first_failure FROM stages WHERE status NOT IN ('passed', 'not_applicable') GROUP BY 1)
SELECT campaign_id, method AS arm, ground_truth, availability, CASE WHEN a THEN coalesce(hit, false) END AS detected, CASE WHEN a THEN coalesce(useful, false) END AS useful_proposal, CASE WHEN a THEN coalesce(witness, false) END AS native_witness,
  CASE WHEN a THEN coalesce(replay, false) END AS independent_replay, CASE WHEN a AND hit THEN ground_truth = 'positive' END AS correct_claim, round(CASE WHEN a AND hit THEN t END, 9) AS claim_time_seconds, 3600.0::DOUBLE AS horizon_seconds, first_failure
FROM (SELECT campaign_id, method, ground_truth, availability, key, CASE WHEN availability = 'available' THEN true END AS a FROM outcomes) o LEFT JOIN s ON key = s.l_orderkey LEFT JOIN w ON key = w.l_orderkey""",
    "proposal_prefix_recall": f"""WITH {SLOTS}, b AS (
  SELECT l_orderkey, list(identity ORDER BY slot_index) AS ordered, coalesce(list(identity) FILTER (verified_finding), []) AS gold, CASE WHEN l_orderkey % 10 = 0 THEN 'missing' ELSE 'available' END AS availability FROM slots GROUP BY 1
), t AS (SELECT prefix, count(*) FILTER (availability = 'available' AND list_has_any(ordered[1:prefix], gold)) AS hits, count(*) FILTER (availability = 'available') AS known, count(*) AS total FROM b, (VALUES (1), (2), (4), (8)) p(prefix) GROUP BY 1)
SELECT prefix, round(hits / nullif(known, 0), 9) AS value, hits, known, total, total - known AS missing FROM t""",
    "budget_recall": f"""WITH {OUTCOMES}, r AS (SELECT *, [1, 2, 4, 8][key % 4 + 1] AS b FROM outcomes WHERE ground_truth = 'positive'), t AS (
  SELECT b, count(*) AS total, count(*) FILTER (availability = 'available' AND detected IS NOT NULL) AS known, count(*) FILTER (availability = 'available' AND detected) AS hits FROM r GROUP BY 1)
SELECT budget_n, round(coalesce(hits, 0) / nullif(coalesce(known, 0), 0), 9) AS value, coalesce(hits, 0) AS hits, coalesce(known, 0) AS known, coalesce(total, 0) AS total, coalesce(total, 0) - coalesce(known, 0) AS missing,
  CASE WHEN coalesce(total, 0) = 0 THEN 'no_scheduled_observations' WHEN coalesce(known, 0) = 0 THEN 'no_known_measurements' END AS note FROM (VALUES (1), (2), (4), (8), (16)) w(budget_n) LEFT JOIN t ON b = budget_n""",
    "poisoned_resource_sums": f"""WITH {SLOTS}, f AS (SELECT l_orderkey % 3 AS arm, 'elapsed' AS field, elapsed AS v FROM slots UNION ALL SELECT l_orderkey % 3, 'tax', l_tax FROM slots)
SELECT arm, field, round(CASE WHEN count(v) = count(*) THEN sum(v) END, 6) AS value, count(v) AS known, count(*) AS total, count(*) - count(v) AS missing, CASE WHEN count(v) < count(*) THEN 'missing_observation' END AS note FROM f GROUP BY 1, 2""",
    "paired_resource": f"""WITH {OUTCOMES}, {SLOTS}, s AS (SELECT l_orderkey, CASE WHEN count(elapsed) = count(*) THEN sum(round(elapsed * 100000)::BIGINT)::BIGINT END AS v FROM slots GROUP BY 1), x AS (SELECT o.*, v FROM outcomes o JOIN s ON key = l_orderkey WHERE v IS NOT NULL),
i AS (SELECT a.lineage_id, a.instance_id, avg(a.v - b.v) AS v FROM x a JOIN x b ON a.method = 'X' AND b.method = 'P' AND a.lineage_id = b.lineage_id AND a.instance_id = b.instance_id AND a.replicate = b.replicate GROUP BY 1, 2)
SELECT 'X-P' AS contrast, lineage_id, round(round(avg(v), 9) / 100000, 9) AS effect, count(*) AS n FROM i GROUP BY 2""",
    "telemetry_by_phase": """SELECT event_type AS phase, count(*) AS n, round(sum(value), 6) AS cpu, round(max(value), 9) AS memory_peak, CASE WHEN count(tokens) = count(*) THEN sum(tokens) END AS tokens
FROM (SELECT *, CASE WHEN event_type <> 'error' OR event_id % 2 = 0 THEN (event_id % 97)::DOUBLE END AS tokens FROM events) GROUP BY 1""",
    "agreement_kappa": """WITH m AS (SELECT quality AS l, toxic AS r FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (l = r) AS same FROM m),
pe AS (SELECT sum(a * b) AS ab FROM (SELECT l AS k, count(*)::DOUBLE AS a FROM m GROUP BY 1) JOIN (SELECT r AS k, count(*)::DOUBLE AS b FROM m GROUP BY 1) USING (k))
SELECT n::BIGINT AS matched, (SELECT count(*) FROM labels WHERE quality IS NULL) AS missing_left, (SELECT count(*) FROM labels WHERE toxic IS NULL) AS missing_right, round(same / n, 9) AS agreement,
  round(CASE WHEN ab / (n * n) = 1 AND same = n THEN 1.0 WHEN ab / (n * n) = 1 THEN 0.0 ELSE (same / n - ab / (n * n)) / (1 - ab / (n * n)) END, 9) AS kappa FROM t, pe""",
    "confusion_matrix": """WITH m AS (SELECT quality AS l, toxic AS r FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT l AS v FROM m UNION SELECT r FROM m)
SELECT a.v AS "left", b.v AS "right", count(m.l) AS n FROM k a CROSS JOIN k b LEFT JOIN m ON l = a.v AND r = b.v GROUP BY 1, 2""",
    "sign_test": f"WITH {EFFECTS}{SIGNS} SELECT contrast, wins, losses, ties, n, round(p, 9) AS p FROM p",
    "holm": f"""WITH {EFFECTS}{SIGNS}, q AS (SELECT contrast, round(p, 9) AS p FROM p), s AS (SELECT *, row_number() OVER (ORDER BY p, contrast) AS rn, count(*) OVER () AS m FROM q WHERE p IS NOT NULL)
SELECT q.contrast, q.p, round(a.adjusted, 9) AS adjusted FROM q LEFT JOIN (SELECT contrast, max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, contrast ROWS UNBOUNDED PRECEDING) AS adjusted FROM s) a USING (contrast)""",
    "bootstrap_ci": f"""WITH {EFFECTS}, x AS (SELECT contrast, round(effect * 1e9)::BIGINT AS effect, row_number() OVER (PARTITION BY contrast ORDER BY lineage_id) - 1 AS i, count(*) OVER (PARTITION BY contrast) AS c FROM e),
d AS (SELECT s.contrast, d, sum(x.effect)::DOUBLE / count(*) / 1e9 AS m FROM (SELECT contrast, d, {DRAW.format(seed=11, draw='d', i='k', n='c')} AS i FROM (SELECT DISTINCT contrast, c FROM x), range(200) q(d), range(c) w(k)) s JOIN x ON x.contrast = s.contrast AND x.i = s.i GROUP BY 1, 2)
SELECT d.contrast, round(max(p.point), 6) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM d JOIN (SELECT contrast, sum(effect)::DOUBLE / count(*) / 1e9 AS point FROM x GROUP BY 1) p USING (contrast) GROUP BY 1""",
    "cluster_bootstrap": f"""WITH s AS (SELECT source, sum((quality = toxic)::INT)::DOUBLE AS s, count(*) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM s),
d AS (SELECT d, sum(x.s) / sum(x.c) AS m FROM (SELECT d, {DRAW.format(seed=5, draw='d', i='k', n='n')} AS i FROM (SELECT max(n) AS n FROM x), range(200) q(d), range(n) w(k)) z JOIN x ON x.i = z.i GROUP BY 1)
SELECT count(*) AS draws, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM d""",
    "leave_one_out": f"WITH {EFFECTS} SELECT contrast, lineage_id, (sum(u) OVER w - u)::DOUBLE / nullif(count(*) OVER w - 1, 0)::DOUBLE / 1e9 AS mean_of_others FROM (SELECT *, round(effect * 1e9)::BIGINT AS u FROM e) WINDOW w AS (PARTITION BY contrast)",
    "zero_event_bound": f"WITH {OUTCOMES} SELECT method, count(*) AS n, round(1 - pow(0.05, 1.0 / count(*)), 9) AS bound FROM outcomes WHERE ground_truth = 'negative' GROUP BY 1",
    "stratified_sample": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 WHEN 'fr' THEN 5 END AS k FROM documents WHERE lang IN ('en', 'de', 'fr'))
SELECT doc_id, lang, round(n / k, 9) AS weight FROM r WHERE r <= k""",
    "cheapest_eligible": "SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 25 ORDER BY p_retailprice, p_size DESC, p_partkey LIMIT 1",
    "precision_simulation": f"""WITH {NATIONS}, u AS (SELECT lineage_id, p_left, p_right, d, ('0x' || substr(md5('9|' || d || '|' || lineage_id || '|' || i || '|' || c), 1, 8))::BIGINT / 4294967296.0 AS u FROM lin, range(40) a(d), range(4) b(i), range(3) q(c)),
e AS (SELECT d, avg(e) AS e FROM (SELECT d, lineage_id, avg(CASE WHEN u < p_left THEN 1.0 WHEN u < p_left + p_right THEN -1.0 ELSE 0.0 END) AS e FROM u GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT round(sqrt(sum((p_left + p_right - pow(p_left - p_right, 2)) / 12)) / count(*), 9) AS analytic_sd, round(stddev_pop(p_left - p_right), 9) AS between_sd FROM lin)
SELECT count(*) AS draws, round(avg(e), 9) AS mean, round(stddev_samp(e), 9) AS sd, round(stddev_samp(e) / sqrt(count(*)), 9) AS mcse, max(analytic_sd) AS analytic_sd, max(between_sd) AS between_sd FROM e, a""",
    "budget_estimate": """SELECT r_regionkey, ((r_regionkey + 1) * 12)::BIGINT AS campaigns, ((r_regionkey + 1) * 96)::BIGINT AS calls, ceil((r_regionkey + 1) * 96 * (100 + 0.5 * r_regionkey))::BIGINT AS input_tokens, ceil((r_regionkey + 1) * 96 * 20)::BIGINT AS output_tokens,
  round((r_regionkey + 1) * 12 * 0.25, 9) AS hours, round(CASE WHEN r_regionkey <> 3 THEN (ceil((r_regionkey + 1) * 96 * (100 + 0.5 * r_regionkey)) * 2.5 + ceil((r_regionkey + 1) * 96 * 20) * 10.0) / 1e6 END, 9) AS cost FROM region""",
    "campaign_plan": """WITH i AS (SELECT 'i' || c_custkey AS instance_id, n_name AS lineage_id FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT *, instance_id || '|' || method || '|' || backbone || '|' || replicate AS k FROM i, (VALUES ('X'), ('P'), ('T0')) m(method), (VALUES ('b1'), ('b2')) b(backbone), range(1, 3) r(replicate)),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(k)) AS h FROM p)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS campaign_id, instance_id, lineage_id, method, backbone, replicate::INT AS replicate,
  row_number() OVER (ORDER BY instance_id, md5('17|' || k)) - 1 AS order_index FROM h""",
    "sensitivity_matrix": """SELECT substr(sha256(track || '|' || solver || '|' || horizon || '|' || prefix || '|' || noise), 1, 16) AS cell_id, track, solver, horizon, prefix, noise, CASE WHEN NOT (track = 'P' AND solver = 120) THEN 'eligible' ELSE 'excluded' END AS status
FROM (VALUES ('X'), ('P')) a(track), (VALUES (10), (30), (120)) b(solver), (VALUES (15), (60)) c(horizon), (VALUES (1), (2), (4), (8)) d(prefix), (VALUES ('low'), ('mid'), ('high')) e(noise)""",
    "dedup_slots": f"WITH {SLOTS} SELECT l_orderkey, slot_index, identity, coalesce(slot_index > min(slot_index) FILTER (l_quantity >= 5) OVER (PARTITION BY l_orderkey, identity), false) AS duplicate FROM slots",
    "dedup_findings": "SELECT sha256(text) AS identity, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "event_validation": f"""WITH {LOG}, w AS (SELECT *, last(monotonic_seconds IGNORE NULLS) OVER (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, coalesce(bool_or(terminal) OVER (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM log)
SELECT attempt_id, seq, count(*) OVER (PARTITION BY seq) > 1 AS duplicate_id, coalesce(monotonic_seconds < l, false) AS time_regression, coalesce(value, 0) < 0 AS negative_duration, ended AND NOT terminal AS event_after_terminal, ended AND terminal AS duplicate_terminal FROM w""",
    "foreign_keys": """SELECT 'lineitem_part' AS child, l_partkey::VARCHAR AS id, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 2
UNION ALL SELECT 'orders_customer', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 2""",
    "attempt_lifecycle": f"""WITH RECURSIVE {LOG}, e AS (SELECT attempt_id, row_number() OVER (PARTITION BY attempt_id ORDER BY seq) AS i, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'uncertain' WHEN 'purchase' THEN 'terminal' ELSE event_type END AS ev, count(*) OVER (PARTITION BY attempt_id) AS n FROM log WHERE event_type IN ('signup', 'error', 'purchase')),
m(s, ev, t) AS (VALUES ('planned', 'start', 'running'), ('running', 'uncertain', 'uncertain'), ('uncertain', 'start', 'running'), ('running', 'terminal', 'terminal'), ('uncertain', 'terminal', 'terminal')),
f AS (SELECT DISTINCT attempt_id, 0::BIGINT AS i, 'planned' AS state, 0 AS moves, 0 AS illegal, n FROM e
  UNION ALL SELECT f.attempt_id, e.i, coalesce(m.t, f.state), f.moves + (m.t IS NOT NULL)::INT, f.illegal + (m.t IS NULL)::INT, f.n FROM f JOIN e ON e.attempt_id = f.attempt_id AND e.i = f.i + 1 LEFT JOIN m ON m.s = f.state AND m.ev = e.ev)
SELECT attempt_id, n AS events, state, moves, illegal, CASE state WHEN 'running' THEN 'recover_uncertain' WHEN 'terminal' THEN 'none' ELSE 'resume' END AS recovery FROM f WHERE i = n""",
    "method_events": f"""WITH {SLOTS}, r AS (SELECT l_orderkey, count(*) AS n FROM slots GROUP BY 1)
SELECT l_orderkey, 0 AS seq, 'start' AS event FROM r UNION ALL SELECT l_orderkey, (2 * n + 1)::INT, 'completed' FROM r UNION ALL SELECT l_orderkey, (2 * slot_index + 1)::INT, 'response' FROM slots UNION ALL SELECT l_orderkey, (2 * slot_index + 2)::INT, 'slot' FROM slots""",
    "trace_once": f"WITH {LOG} SELECT attempt_id, seq, max((value > 50)::INT) OVER (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) > 0 AS once FROM log",
    "trace_globally": f"WITH {LOG} SELECT DISTINCT attempt_id, bool_and(value >= 1 OR event_type <> 'view') OVER (PARTITION BY attempt_id) AS globally FROM log",
    "predicate_eval": f"""WITH {SLOTS}, b AS (SELECT l_orderkey, slot_index, l_quantity::BIGINT AS q, CASE WHEN l_discount > 0 THEN round(l_discount * 100)::BIGINT END AS d, round(l_tax * 100)::BIGINT AS t FROM slots),
r AS (SELECT *, CASE WHEN q > 40 THEN NULL WHEN d IS NULL THEN 'missing binding d' WHEN q - d < 0 THEN 'underflow' WHEN t = 0 THEN 'division by zero' END AS error FROM b)
SELECT l_orderkey, slot_index, CASE WHEN error IS NULL THEN q > 40 OR (q - d) // nullif(t, 0) >= 3 END AS holds, error, CASE WHEN error IS NOT NULL THEN 'UNKNOWN' WHEN q > 40 OR (q - d) // nullif(t, 0) >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""",
    "antecedent_reachability": f"""WITH {SLOTS}, t AS (SELECT l_orderkey, min(slot_index) FILTER (l_discount <> 0 AND l_quantity > 45) AS h, min(slot_index) FILTER (l_discount = 0) AS x FROM slots GROUP BY 1)
SELECT l_orderkey, CASE WHEN x IS NOT NULL AND (h IS NULL OR x < h) THEN 'unknown' WHEN h IS NOT NULL THEN 'reachable' ELSE 'bounded_unsat' END AS status, CASE WHEN NOT (x IS NOT NULL AND (h IS NULL OR x < h)) THEN h END AS witness FROM t""",
    "bfs_search": """WITH RECURSIVE s AS (
  SELECT 0 AS depth, []::INT[] AS pending, []::INT[] AS committed, []::INT[] AS delivered, ''::VARCHAR AS log, 0::BIGINT AS rank
  UNION ALL
  SELECT * FROM (
    SELECT depth + 1, list_append(pending, m), list_append(committed, m), delivered, log || CASE WHEN log = '' THEN '' ELSE ', ' END || 'enqueue ' || m, rank * 4 + m - 1 FROM s, (VALUES (1), (2)) v(m) WHERE depth < 4 AND len(pending) < 2 AND NOT list_contains(committed, m)
    UNION ALL
    SELECT depth + 1, list_concat(pending[1:i - 1], pending[i + 1:]), committed, list_append(delivered, pending[i]), log || CASE WHEN log = '' THEN '' ELSE ', ' END || 'deliver ' || pending[i], rank * 4 + 1 + i FROM s, (VALUES (1), (2)) v(i) WHERE depth < 4 AND len(pending) >= i)
)
SELECT depth, count(*) AS states, count(*) FILTER (list_contains(delivered, 2)) AS violations, arg_min(log, rank) FILTER (list_contains(delivered, 2)) AS witness FROM s GROUP BY 1""",
    "import_closure": """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 > 0), c AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT c.src, e.dst, hops + 1 FROM c JOIN e ON c.dst = e.src)
SELECT src, dst, min(hops)::INT AS hops FROM c GROUP BY 1, 2""",
    "manifest_rules": """SELECT o_orderkey, 'negative_total' AS rule FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'open_and_urgent' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'""",
    "pair_rules": """WITH r AS (SELECT o_orderkey AS k, o_custkey % 7 AS l, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 6 = 1 THEN o_orderkey - 1 END AS o FROM orders)
SELECT * FROM (SELECT a.k, CASE WHEN b.k IS NULL THEN 'pair_absent' WHEN b.l <> a.l THEN 'pair_lineage_differs' WHEN b.o IS DISTINCT FROM a.k THEN 'pair_not_reciprocal' END AS error FROM r a LEFT JOIN r b ON a.o = b.k WHERE a.o IS NOT NULL) WHERE error IS NOT NULL""",
    "inventory": "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "support_coverage": """WITH s AS (SELECT DISTINCT l_partkey AS p, 's' || l_suppkey % 4 AS m FROM lineitem WHERE l_suppkey % 4 < 3), e AS (SELECT p, count(*) AS c, bool_or(m = 's0') AS s0, bool_or(m = 's1') AS s1, bool_or(m = 's2') AS s2 FROM s GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (c = 3) AS by_all, count(*) FILTER (s0) AS a, count(*) FILTER (s1) AS b, count(*) FILTER (s2) AS c FROM e)
SELECT method, eligible, total - eligible AS unsupported, round(eligible / total, 9) AS fraction, by_all FROM (SELECT 's0' AS method, a AS eligible, total, by_all FROM t UNION ALL SELECT 's1', b, total, by_all FROM t UNION ALL SELECT 's2', c, total, by_all FROM t)""",
    "trace_rewrite": """SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 AND event_type = 'click' THEN 'TAP' WHEN event_type = 'click' THEN 'CLICK' WHEN event_type = 'view' THEN 'VIEW' ELSE event_type END AS public FROM events""",
    "content_hash": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "json_extract": "SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, max((props::JSON->>'k')::BIGINT) AS most FROM events GROUP BY 1",
    "response_classes": """SELECT class, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'provider_failure' WHEN event_id % 11 = 0 THEN 'truncated' WHEN event_id % 7 = 0 THEN 'refusal' WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 3 = 0 THEN 'abstain' ELSE 'invalid' END AS class FROM events) GROUP BY 1""",
    "label_reconcile": "SELECT doc_id AS id, CASE WHEN quality = toxic THEN quality::VARCHAR ELSE 'unresolved' END AS status, CASE WHEN quality <> toxic THEN 'raters_disagree' END AS reason FROM labels",
    "gate_status": f"""WITH {OUTCOMES} SELECT method, gate, count(*) AS n FROM (SELECT method, CASE WHEN coalesce(NOT detected, false) OR coalesce(NOT native_witness, false) THEN 'fail' WHEN detected IS NULL OR native_witness IS NULL THEN 'pending' ELSE 'pass' END AS gate FROM outcomes) GROUP BY 1, 2""",
    "status_history": f"""WITH {LOG} SELECT attempt_id, seq, event_type, lag(event_type) OVER w AS previous, lead(1) OVER w IS NULL AS effective FROM log WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)""",
    "pending_batch": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 50""",
    "set_differences": """(SELECT o_custkey AS k, 'left' AS only_in FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) UNION ALL (SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))""",
}

ORACLES |= {
    "candidate_projection": f"""WITH {SLOTS} SELECT l_orderkey AS attempt_id, slot_index::INT AS slot_index, CASE WHEN slot_index % 2 = 0 THEN 's' || identity ELSE l_orderkey || ':slot:' || slot_index END AS slot_id,
  CASE WHEN verified_finding THEN 'candidate' ELSE 'abstain' END AS status, CASE WHEN verified_finding THEN identity::VARCHAR END AS payload FROM slots""",
    "failure_reasons": f"""WITH {SLOTS} SELECT CASE WHEN grounding <> 'passed' THEN 'grounding_' || grounding WHEN symbolic_search <> 'passed' THEN 'symbolic_search_' || symbolic_search WHEN witness_check <> 'passed' THEN 'witness_check_' || witness_check
  WHEN independent_replay <> 'passed' THEN 'independent_replay_' || independent_replay END AS reason, count(*) AS n FROM slots GROUP BY 1""",
    "unknown_outcomes": "SELECT l_orderkey AS campaign_id, min(l_linenumber * 1000000 + l_partkey) AS seq, NULL::BOOLEAN AS detected, 'unknown' AS availability FROM lineitem GROUP BY 1",
    "strict_match": f"""WITH {OUTCOMES}, t AS (SELECT instance_id, replicate, count(*) FILTER (method = 'X') AS n_left, count(*) FILTER (method = 'P') AS n_right FROM outcomes WHERE method IN ('X', 'P') GROUP BY 1, 2) SELECT *, n_left = 1 AND n_right = 1 AS matched FROM t""",
    "run_terminal_report": """WITH e AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderstatus AS status, CASE WHEN k IS NULL THEN 'terminal_missing' WHEN s <> o_orderstatus THEN 'status_differs' ELSE 'matched' END AS "check", count(*) AS n FROM orders LEFT JOIN e ON k = o_orderkey GROUP BY 1, 2""",
    "design_balance": """WITH f AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1), w(v, n) AS (VALUES ('BUILDING', 10), ('MACHINERY', 0), ('absent', 3))
SELECT coalesce(f.v, w.v) AS value, coalesce(w.n, 0)::BIGINT AS expected, coalesce(f.n, 0) AS found FROM f FULL JOIN w ON f.v = w.v WHERE coalesce(w.n, 0) <> coalesce(f.n, 0)""",
    "registry_differences": """WITH r AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal > 0)
SELECT coalesce(s_suppkey, k) AS k, CASE WHEN k IS NULL THEN 'only_in_left' WHEN s_suppkey IS NULL THEN 'only_in_right' ELSE 'differs:nation' END AS problem FROM supplier FULL JOIN r ON k = s_suppkey WHERE k IS NULL OR s_suppkey IS NULL OR n <> s_nationkey""",
    "symbol_bindings": """WITH s AS (SELECT p_partkey AS id, 'n' || p_partkey % 97 AS name, ['bool', 'uint256', 'address', 'string'][p_partkey % 4 + 1] AS t FROM part), l AS (SELECT 'n' || s_suppkey AS label, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS slot, (s_suppkey % 20 - 1)::INT AS o FROM supplier),
j AS (SELECT *, CASE WHEN t = 'string' THEN 'unsupported_type' WHEN label IS NULL THEN 'layout_missing' WHEN slot IS NULL THEN 'slot_missing' WHEN o < 0 THEN 'bad_offset' WHEN o + CASE t WHEN 'bool' THEN 1 WHEN 'address' THEN 20 ELSE 32 END > 32 THEN 'packing_exceeds_slot' ELSE 'bound' END AS status FROM s LEFT JOIN l ON name = label)
SELECT id AS symbol_id, status, CASE WHEN status = 'bound' THEN slot END AS slot, CASE WHEN status = 'bound' THEN o END AS "offset" FROM j""",
    "action_bindings": """WITH a AS (SELECT c_custkey AS action, 'f' || c_custkey % 30 AS name, 'c' || c_custkey % 3 AS target FROM customer), f AS (SELECT 'f' || s_suppkey % 20 AS fn, 'x.c' || s_suppkey % 4 AS contract FROM supplier),
j AS (SELECT a.*, f.*, coalesce(suffix(contract, target), false) AS hit FROM a LEFT JOIN f ON name = fn), k AS (SELECT *, bool_or(hit) OVER (PARTITION BY action) AS any_hit FROM j), t AS (SELECT action, count(fn) AS n, min(contract) AS contract FROM k WHERE hit = any_hit GROUP BY 1)
SELECT action, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'bound' END AS status, CASE WHEN n = 1 THEN contract END AS contract FROM t""",
    "legitimacy": """SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'unwarranted' WHEN p_size < 10 OR p_partkey % 7 = 0 THEN 'unknown' ELSE 'eligible' END AS legitimacy,
  concat_ws(',', CASE WHEN p_size < 10 THEN 'single_domain' END, CASE WHEN p_partkey % 7 = 0 THEN 'no_post_state' END, CASE WHEN p_retailprice < 950 THEN 'constant_body' END) AS reasons FROM part""",
    "verified_findings": f"""WITH {SLOTS}, f AS (SELECT l_orderkey, CASE WHEN independent_replay = 'passed' THEN l_quantity > 20 AND NOT l_discount > 0.05 AND l_tax < 0.04 END AS v FROM slots) SELECT l_orderkey, count(*) FILTER (v) AS verified, count(v) AS known, count(*) AS total FROM f GROUP BY 1""",
    "eligible_by_all": "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) = 3",
    "split_leakage": f"WITH {OUTCOMES} SELECT lineage_id, count(DISTINCT key % 5 = 0) AS splits FROM outcomes GROUP BY 1 HAVING count(DISTINCT key % 5 = 0) > 1",
    "telemetry_windows": "SELECT epoch(time_bucket(INTERVAL 5 minutes, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
}

ORACLES |= {
    "preflight_panel": """WITH t AS (SELECT (p_partkey % 6)::VARCHAR AS f, bool_and(p_size > 0 AND p_partkey % 35 <> 4) AS ok, count(*) AS n FROM part GROUP BY 1)
SELECT w.f AS family, coalesce(n, 0) AS rows, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM (SELECT i::VARCHAR AS f FROM range(8) r(i)) w LEFT JOIN t ON t.f = w.f""",
    "admission_blockers": """SELECT c_custkey, 'lock_missing' AS blocker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'review_missing' FROM customer WHERE NOT c_acctbal > 5000""",
    "launch_guard": """SELECT count(*) AS unplanned, 'budget,review' AS closed_gates, false AS allowed FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)""",
    "resume_actions": """WITH r AS (SELECT ['worker_restart', 'lost_response', 'provider_outage', 'version_drift'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN 'v' || o_custkey % 2 END AS version FROM orders)
SELECT kind, CASE WHEN version IS DISTINCT FROM 'v1' OR kind = 'version_drift' THEN 'block' ELSE 'resume_same_attempt' END AS action, count(*) AS n FROM r GROUP BY 1, 2""",
    "timing_summary": """WITH f AS (SELECT l_returnflag, 'wall' AS field, CASE WHEN l_discount > 0 THEN l_extendedprice END AS v FROM lineitem UNION ALL SELECT l_returnflag, 'solver', l_quantity - CASE WHEN l_returnflag = 'A' THEN 10 ELSE 0 END FROM lineitem UNION ALL SELECT l_returnflag, 'queue', l_tax FROM lineitem)
SELECT l_returnflag, field, round(CASE WHEN count(*) FILTER (v >= 0) = count(*) THEN sum(v) END, 6) AS value, count(*) FILTER (v >= 0) AS known, count(*) AS total, count(*) - count(*) FILTER (v >= 0) AS missing FROM f GROUP BY 1, 2""",
    "benchmark_rows": """SELECT substr(sha256(l || '|' || m || '|' || k), 1, 16) AS instance_id, l AS lineage_id, m AS mutation, k AS kind, substr(sha256(l || '|' || m || '|' || CASE k WHEN 'mutant' THEN 'control' ELSE 'mutant' END), 1, 16) AS paired_instance_id
FROM (VALUES ('l1'), ('l2'), ('l3')) a(l), (SELECT 'm' || i AS m FROM range(10) r(i)) b, (VALUES ('mutant'), ('control')) c(k)""",
    "power_table": """WITH g AS (SELECT n, rate, ceil(0.5 * n)::INT AS least FROM (VALUES (5), (10), (20), (40)) a(n), (VALUES (0.3::DOUBLE), (0.5), (0.7)) b(rate))
SELECT n, rate, least, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate)))), 9) AS power FROM g, range(0, 41) r(k) WHERE k BETWEEN least AND n GROUP BY 1, 2, 3""",
}

ORACLES |= {
    "predicate_wide": f"""WITH {SLOTS}, b AS (SELECT l_orderkey, slot_index, l_quantity::BIGINT AS q, CASE WHEN l_discount > 0 THEN round(l_discount * 100)::BIGINT END AS d FROM slots),
r AS (SELECT l_orderkey, slot_index, q * xor(q, 5) >= 2048 AS a, d % 64 > 4 AS b, CASE WHEN q * xor(q, 5) >= 2048 AND d IS NULL THEN 'missing binding d' END AS error FROM b)
SELECT l_orderkey, slot_index, CASE WHEN error IS NULL THEN a AND b END AS holds, error, CASE WHEN error IS NOT NULL THEN 'UNKNOWN' WHEN a AND b THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""",
    "uint256_arith": """WITH k AS (SELECT o_orderkey, o_orderkey % 65536 AS top FROM orders)
SELECT o_orderkey, lpad(lower(to_hex(top)), 4, '0') || repeat('0', 60) AS big, lpad(lower(to_hex(top)), 4, '0') || lpad(lower(to_hex(o_orderkey)), 60, '0') AS sum,
  CASE WHEN top * o_orderkey < 65536 THEN lpad(lower(to_hex(top * o_orderkey)), 4, '0') || repeat('0', 60) END AS product, CASE WHEN top * o_orderkey >= 65536 THEN 'overflow' END AS error FROM k""",
}

RESPONSES = """
a AS (
  SELECT user_id AS attempt_id, event_id AS slot, event_id % 29 = 0 AND event_type <> 'error' AS other, event_type = 'error' AS failed, event_id % 23 = 0 AS part, event_id % 13 = 0 AS blank, event_id % 17 = 0 AS junk, event_id % 19 = 0 AS abstain, 'n' || event_id % 7 AS id,
    CASE WHEN event_id % 50 > 45 THEN 'input_cap_exceeded' WHEN event_id % 31 > 28 THEN 'output_cap_exceeded' END AS over FROM events
), b AS (
  SELECT *, CASE WHEN other OR failed THEN 'provider_failure' WHEN part THEN 'truncated' WHEN blank THEN 'refusal' WHEN junk THEN 'invalid' WHEN abstain THEN 'abstain' ELSE 'candidate' END AS s,
    CASE WHEN other THEN 'response_model_mismatch' WHEN failed THEN 'http_500' WHEN part THEN 'provider_response_partial' WHEN blank THEN 'empty_response' WHEN junk THEN 'response_not_json' WHEN abstain THEN 'none' END AS r FROM a
), c AS (
  SELECT *, s = 'candidate' AND coalesce(slot > min(slot) FILTER (s = 'candidate' AND over IS NULL) OVER (PARTITION BY attempt_id, CASE WHEN s = 'candidate' THEN id END), false) AS again FROM b
), m AS (
  SELECT attempt_id, slot, CASE WHEN again THEN 'duplicate' WHEN over IS NOT NULL AND s <> 'provider_failure' THEN 'invalid' ELSE s END AS status,
    CASE WHEN again THEN 'duplicate_candidate' WHEN over IS NOT NULL AND s <> 'provider_failure' THEN over ELSE r END AS reason, id FROM c
), run AS (SELECT attempt_id, slot, status, reason, CASE WHEN status IN ('candidate', 'duplicate') THEN id END AS identity FROM m)"""

ORACLES |= {
    "method_run": f"WITH {RESPONSES} SELECT * FROM run",
    "unique_candidates": f"WITH {RESPONSES} SELECT attempt_id, count(DISTINCT identity) AS unique_candidates, count(*) FILTER (status = 'candidate') AS candidates, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) AS slots FROM run GROUP BY 1",
    "slot_ledger": """WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS slot, l_partkey AS k, CASE WHEN l_partkey % 11 = 0 THEN 'pending' WHEN l_returnflag = 'A' THEN 'candidate' WHEN l_partkey % 5 = 0 THEN 'odd' ELSE 'abstain' END AS status, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
e AS (SELECT l_orderkey, slot, unnest([CASE WHEN slot < 0 OR slot >= 5 THEN 'out_of_bounds' END, CASE WHEN status = 'odd' THEN 'unknown_status' END, CASE WHEN status = 'pending' THEN 'not_terminal' END, CASE WHEN n > 1 THEN 'several_records' END,
  CASE WHEN status = 'candidate' AND k % 3 = 0 THEN 'candidate_without_payload' END, CASE WHEN status <> 'candidate' AND k % 3 <> 0 THEN 'payload_without_candidate' END, CASE WHEN (k % 4 = 0 OR k % 9 = 0) AND status <> 'candidate' THEN 'hash_without_candidate' END, CASE WHEN k % 4 <> 0 AND k % 9 = 0 THEN 'malformed_hash' END]) AS error FROM s)
SELECT DISTINCT l_orderkey, slot, error FROM e WHERE error IS NOT NULL""",
    "missing_slots": """SELECT o_orderkey AS l_orderkey, i::INT AS slot FROM orders, range(4) r(i) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber - 1 = i AND l_returnflag <> 'R')""",
    "version_block": """WITH r AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'h' || o_orderkey % 3 END AS h, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 2 = 0 END AS ok, CASE WHEN o_orderkey % 11 = 0 THEN 'approved' END AS d FROM orders)
SELECT CASE WHEN d IS NOT NULL THEN 'deviation' WHEN h IS DISTINCT FROM 'h1' OR ok IS DISTINCT FROM true THEN 'blocked' ELSE 'passed' END AS status,
  CASE WHEN d IS NOT NULL THEN d WHEN h IS DISTINCT FROM 'h1' THEN 'version identity drift; explicit deviation required' WHEN ok IS DISTINCT FROM true THEN 'canary panel failed' END AS reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "status_errors": """WITH r AS (SELECT o_orderkey, o_custkey % 7 = 0 AS v, CASE WHEN o_custkey % 9 <> 0 THEN o_orderstatus END AS c, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS s FROM orders)
SELECT * FROM (SELECT o_orderkey, unnest([CASE WHEN v THEN 'unsupported status_mapping_version' END, CASE WHEN c IS NULL OR c NOT IN ('F', 'O') THEN 'invalid campaign_status: ' || coalesce(c, 'none') END, CASE WHEN s NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'invalid search_status: ' || s END]) AS error FROM r) WHERE error IS NOT NULL""",
    "parity": """WITH t AS (SELECT l_partkey, l_returnflag AS f, CASE WHEN l_partkey % 6 = 0 AND l_returnflag = 'A' THEN 'partial' ELSE 'done' END AS status, 's' || l_suppkey % 2 || ':' || CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS x, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_returnflag <> 'N'),
g AS (SELECT l_partkey, f, max(status) AS status, list(x ORDER BY o, x) AS found FROM t GROUP BY 1, 2), j AS (SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, a.status AS s, b.status AS u, a.found AS p, b.found AS q FROM (SELECT * FROM g WHERE f = 'A') a FULL JOIN (SELECT * FROM g WHERE f = 'R') b ON a.l_partkey = b.l_partkey),
d AS (SELECT l_partkey, concat_ws(',', CASE WHEN s IS DISTINCT FROM u THEN 'status:' || coalesce(s, 'none') || '!=' || coalesce(u, 'none') END, CASE WHEN p IS DISTINCT FROM q THEN 'finding_ids_or_categories_differ' END) AS differences FROM j)
SELECT l_partkey, differences = '' AS equal, differences FROM d""",
    "worker_isolation": """WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
  SELECT k, 'mount' AS operation, CASE WHEN k % 7 = 0 THEN 'private gold mount is forbidden' WHEN k % 3 = 0 THEN 'writable bind mount is forbidden' WHEN k % 5 = 0 THEN 'model-weight/cache mount is forbidden' END AS reason FROM c
  UNION ALL SELECT k, 'evm_broadcast', CASE WHEN k % 10 = 0 THEN 'execution must not broadcast' END FROM c
  UNION ALL SELECT k, 'network', CASE k % 4 WHEN 1 THEN 'endpoint must be an HTTP(S) URL' WHEN 2 THEN 'endpoint is outside provider allowlist' END FROM c WHERE k % 4 <> 3)
SELECT k AS c_custkey, operation, CASE WHEN reason IS NULL THEN 'allowed' ELSE 'blocked' END AS status, reason FROM r""",
    "support_admits": """WITH q AS (SELECT DISTINCT l_orderkey, l_suppkey % 30 AS c, l_returnflag FROM lineitem)
SELECT l_orderkey, bool_and(c < 25 AND c % 9 <> 0) AS admitted, count(*) FILTER (c >= 25) AS unknown FROM q GROUP BY 1""",
    "artifact_status": """WITH c AS (SELECT p_partkey % 40 AS lineage, sum(p_size)::BIGINT AS functions, count(*) FILTER (p_size > 10) AS events, 2 * count(*) AS slots FROM part GROUP BY 1), b AS (SELECT s_suppkey % 53 AS lineage, bool_or(s_suppkey % 8 = 0) AS short FROM supplier GROUP BY 1)
SELECT c.*, CASE WHEN short IS NULL THEN 'Missing' WHEN short THEN 'Incomplete (empty/placeholder)' ELSE 'Non-empty (unverified)' END AS bytecode FROM c LEFT JOIN b ON b.lineage = c.lineage""",
    "batch_report": """SELECT 'runs' AS part, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'telemetry', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
    "ablation_plan": """WITH s(study, study_id, factor, treatment, control, diagnostic) AS (VALUES (0, 'learned-vs-t0', 'proposer', 'learned', 't0', false), (1, 'primitive-vs-generic-typed-core', 'property_representation', 'primitive', 'generic', false), (2, 'grounding-early-vs-deferred', 'grounding_timing', 'early', 'deferred', false),
  (3, 'replay-on-vs-off', 'replay_filter', 'replay-on', 'replay-off', false), (4, 'adversarial-channel-vs-fifo', 'channel_mode', 'adversarial', 'fifo', false), (5, 'gold-diagnostic-after-primary-freeze', 'property_source', 'automatic', 'gold', true))
SELECT study, study_id, factor, diagnostic, 0 AS side, treatment AS arm FROM s UNION ALL SELECT study, study_id, factor, diagnostic, 1, control FROM s""",
    "campaign_envelope": f"""WITH {OUTCOMES}, {SLOTS}, t AS (SELECT l_orderkey, count(*)::INT AS n, string_agg(identity::VARCHAR, ',' ORDER BY slot_index) AS identities, CASE WHEN count(elapsed) = count(*) THEN 'available' ELSE 'unavailable' END AS timing, round(CASE WHEN count(elapsed) = count(*) THEN sum(elapsed) END, 6) AS seconds FROM slots GROUP BY 1)
SELECT key AS l_orderkey, method, coalesce(n, 0) AS n, identities, timing, seconds FROM outcomes LEFT JOIN t ON t.l_orderkey = key""",
    "adjudication_reconcile": """WITH l AS (SELECT 'f' || doc_id AS finding_id, doc_id AS k, quality::VARCHAR AS q, toxic::VARCHAR AS t FROM labels), e AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN 'unknown_finding' WHEN k % 7 = 0 THEN 'exactly_two_labels' WHEN k % 11 = 0 THEN 'same_rater' WHEN k % 10 = 5 THEN 'adjudicator_is_rater' END AS error FROM l)
SELECT finding_id, CASE WHEN error IS NULL THEN CASE WHEN q = t THEN q ELSE 'unresolved' END END AS status, CASE WHEN error IS NULL AND q <> t THEN 'timeout_or_unsupported' WHEN error IS NULL AND k % 4 = 0 THEN 'late' END AS first_failure,
  CASE WHEN error IS NULL THEN true END AS role_overlap, error FROM e""",
    "requirement_mappings": """WITH m AS (SELECT l_partkey * 3 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT 'f' || k AS finding_id, CASE WHEN p_partkey IS NULL THEN 'unknown_finding' ELSE 'several_mappings' END AS error FROM m LEFT JOIN part ON p_partkey = k WHERE p_partkey IS NULL OR n > 1""",
    "adjudication_templates": """SELECT n_name AS instance_id, n_regionkey AS lineage_id, 'template_pending_independent_review' AS record_status, sha256('{"cohort":"dev","instance_id":"' || n_name || '","lineage_id":' || n_regionkey || ',"property_family":null}') AS source_manifest_row_hash, 0 AS labels, 'independent_rater_1,independent_rater_2,third_adjudicator' AS reviewer_roles FROM nation""",
    "distinct_findings": """WITH f AS (SELECT l_orderkey || ':' || l_linenumber AS finding_id, l_partkey AS instance_id, CASE WHEN l_suppkey % 3 <> 0 THEN 'c' || l_suppkey % 4 END AS root_cause_id, l_orderkey * 10 + l_linenumber AS o FROM lineitem)
SELECT instance_id, coalesce(root_cause_id, finding_id) AS cause, arg_min(finding_id, o) AS finding_id FROM f GROUP BY 1, 2""",
}
