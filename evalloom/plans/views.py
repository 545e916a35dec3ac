"""Fact views over the relational tables on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHODS = ["X", "P", "T0"]
STAGES = ["grounding", "symbolic_search", "witness_check", "independent_replay"]


class Views:
    """Lazily read tables and derived views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def outcomes(self) -> DataFrame:
        """One campaign for each order."""
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        who = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey"), F.col("n_name").alias("lineage_id"))
        o = self.table("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
        method = F.when(key % 3 == 0, "X").when(key % 3 == 1, "P").otherwise("T0")
        turn = Window.partitionBy("o_custkey", key % 3).orderBy("o_orderkey")
        case = F.col("o_custkey") % 5
        truth = F.when(case <= 2, "positive").when(case == 3, "negative").otherwise("unresolved")
        seen = F.when(status != "P", F.col("o_totalprice") > 200000)
        priority = F.col("o_orderpriority")
        state = F.when(priority.isin("1-URGENT", "2-HIGH"), "available").when(priority == "3-MEDIUM", "timeout").when(priority == "4-NOT SPECIFIED", "provider_failure").otherwise(F.when(status == "F", "unsupported").otherwise("unknown"))
        base = o.select(
            F.concat(F.lit("c"), key).alias("campaign_id"), F.concat(F.lit("i"), F.col("o_custkey")).alias("instance_id"), "lineage_id", method.alias("method"), F.row_number().over(turn).alias("replicate"),
            truth.alias("ground_truth"), seen.alias("detected"), state.alias("availability"), F.lit(3600.0).alias("horizon_seconds"), key.alias("key"),
        )
        hit = F.col("detected")
        return base.select(
            "*", hit.alias("useful_proposal"), (hit & (F.col("key") % 4 != 0)).alias("native_witness"), (hit & (F.col("key") % 4 != 0) & (F.col("key") % 7 != 0)).alias("independent_replay"), hit.alias("claim_emitted"),
            F.when(hit, F.col("ground_truth") == "positive").alias("correct_claim"), F.when(hit, ((F.col("key") * 37) % 5000).cast("double")).alias("claim_time_seconds"), F.when(hit, ((F.col("key") * 53) % 4800).cast("double")).alias("witness_time_seconds"),
        )

    def slots(self) -> DataFrame:
        """The first eight lines of each order, with the four stages each ends in."""
        line = self.table("lineitem")
        order = Window.partitionBy("l_orderkey").orderBy(*(c for c in line.columns if c != "l_orderkey"))
        s = line.withColumn("slot_index", F.row_number().over(order) - 1).where("slot_index < 8")
        first = F.when(F.col("l_quantity") >= 10, "passed").otherwise("failed")
        second = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "A", "timeout").otherwise("unknown")
        third = F.when(F.col("l_linestatus") == "F", "passed").otherwise("failed")
        fourth = F.when(F.col("l_tax") < 0.05, "passed").otherwise("unsupported")
        out, done = [], F.lit(True)
        for name, status in zip(STAGES, (first, second, third, fourth), strict=True):
            out.append(F.when(done, status).otherwise("not_applicable").alias(name))
            done = done & (status == "passed")
        return s.select("l_orderkey", "slot_index", F.col("l_partkey").alias("identity"), F.when(F.col("l_discount") != 0, F.col("l_extendedprice") / 1000).alias("elapsed"), *out, done.alias("verified_finding"), "l_quantity", "l_discount", "l_tax")

    def stages(self) -> DataFrame:
        """Slots with a row for each stage."""
        s = self.slots()
        return s.select("l_orderkey", "slot_index", "elapsed", "verified_finding", F.inline(F.array(*(F.struct(F.lit(i).alias("stage_index"), F.lit(n).alias("stage"), F.col(n).alias("status")) for i, n in enumerate(STAGES)))))

    def facts(self) -> DataFrame:
        """Outcomes under the names of verification campaigns."""
        return self.outcomes().select("key", "campaign_id", "instance_id", "lineage_id", "replicate", F.col("method").alias("arm"), "ground_truth", "availability")

    def hits(self, prefixes: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
        """Campaigns and prefixes with whether a slot within the prefix is verified."""
        # one aggregation gives both which orders have slots and their first verified one
        first = self.slots().groupBy("l_orderkey").agg(F.min(F.when(F.col("verified_finding"), F.col("slot_index"))).alias("first"))
        rows = self.facts().join(first, F.col("key") == F.col("l_orderkey")).drop("l_orderkey")
        return rows.select("*", F.explode(F.array(*map(F.lit, prefixes))).alias("prefix")).withColumn("hit", F.coalesce(F.col("first") < F.col("prefix"), F.lit(False)))

    def log(self) -> DataFrame:
        """Events as an attempt log, in order of event_id."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("attempt_id"), F.col("event_id").alias("seq"), F.col("event_type"), F.col("value"), "props", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("monotonic_seconds"), (F.col("event_type") == "purchase").alias("terminal"))
