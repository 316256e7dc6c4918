"""Queries of running state over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from collatium.functions import folds
from collatium.operators import order
from collatium.plans.catalog import query
from collatium.plans.common import BY, ORDER, OVER, events, skeleton_sql
from collatium.sources.tables import load

UPTO, BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _w():
    return Window.partitionBy(*BY).orderBy(*ORDER)


def of(kind: str):
    return F.col("event_type") == kind


@query("w1_constrained_fill", f"SELECT conv_id, turn, coalesce(max(CASE WHEN length(text) % 3 = 0 AND turn BETWEEN 1 AND 6 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, text {UPTO}), 1) AS filled FROM conversations")
def w1(spark, d):
    valid = F.when((F.length("text") % 3 == 0) & F.col("turn").between(1, 6), F.col("turn"))
    rows = load(spark, d, "conversations", "conv_id", "turn", "text")
    return order.monotone_fill(rows, ["conv_id"], ["turn", "text"], valid, F.lit(1)).select("conv_id", "turn", "filled")


@query("w2_terminated_islands", f"""
WITH i AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER ({OVER} {BEFORE}), 0) AS island FROM events)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id, bool_or(event_type = 'purchase') AS ended FROM i GROUP BY ALL""")
def w2(spark, d):
    rows = order.islands(events(spark, d), BY, ORDER, of("purchase"))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.bool_or(of("purchase")).alias("ended"))


@query("w3_initiated_islands", f"""
WITH i AS (SELECT *, sum(CAST(event_type = 'signup' AS INTEGER)) OVER ({OVER} {UPTO}) AS island FROM events)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY ALL""")
def w3(spark, d):
    return order.islands(events(spark, d), BY, ORDER, of("signup"), initiator=True).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("w4_lookahead", f"SELECT event_id, lead(value) OVER ({OVER}) AS next_value, coalesce(lead(value) OVER ({OVER}) - value > 100, false) AS gap FROM events")
def w4(spark, d):
    ahead = F.lead("value").over(_w())
    return events(spark, d).select("event_id", ahead.alias("next_value"), F.coalesce(ahead - F.col("value") > 100, F.lit(False)).alias("gap"))


@query("w5_gated_carry", f"""
WITH n AS (SELECT *, coalesce(lead(event_type) OVER ({OVER}) = 'purchase', false) AS holds FROM events)
SELECT event_id, holds, CASE WHEN coalesce(lag(holds) OVER ({OVER}), false) THEN coalesce(lag(value) OVER ({OVER}), 0) ELSE 0 END AS carried FROM n""")
def w5(spark, d):
    rows = events(spark, d).withColumn("holds", F.coalesce(F.lead("event_type").over(_w()) == "purchase", F.lit(False)))
    return rows.select("event_id", "holds", F.when(F.coalesce(F.lag("holds").over(_w()), F.lit(False)), F.coalesce(F.lag("value").over(_w()), F.lit(0.0))).otherwise(0.0).alias("carried"))


@query("w6_last_position", f"SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER ({OVER} {UPTO}) AS carried FROM events")
def w6(spark, d):
    return order.carry(events(spark, d), BY, ORDER, F.when(~of("view"), F.col("value"))).select("event_id", "carried")


@query("w7_mark_with_base", f"""
WITH b AS (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER ({OVER} {UPTO}) AS base FROM events)
SELECT event_id, CASE WHEN event_type = 'click' AND abs(value - base) <= 7 THEN base ELSE value END AS sort_key FROM b""")
def w7(spark, d):
    rows = order.carry(events(spark, d), BY, ORDER, F.when(~of("click"), F.col("value")), "base")
    return rows.select("event_id", F.when(of("click") & (F.abs(F.col("value") - F.col("base")) <= 7), F.col("base")).otherwise(F.col("value")).alias("sort_key"))


@query("w8_symmetric_frame", f"SELECT event_id, first_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM events")
def w8(spark, d):
    return order.near_first(events(spark, d), BY, ORDER, F.when(of("signup"), F.col("value"))).select("event_id", "near")


@query("w9_fill_with_flush", f"""
WITH i AS (SELECT *, sum(CAST(event_type IN ('signup', 'error') AS INTEGER)) OVER ({OVER} {UPTO}) AS part FROM events)
SELECT user_id, CAST(part AS BIGINT) AS part, max(CASE WHEN event_type = 'signup' THEN event_id END) AS verse, string_agg(CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY ts, event_id) AS marks FROM i GROUP BY user_id, part""")
def w9(spark, d):
    rows = order.islands(events(spark, d), BY, ORDER, F.col("event_type").isin("signup", "error"), "part", initiator=True)
    marks = rows.withColumn("m", F.when(of("click"), F.col("event_id").cast("string")))
    joined = F.array_join(F.array_compact(order.ordered(ORDER, "m")), ",")
    return marks.groupBy("user_id", "part").agg(F.max(F.when(of("signup"), F.col("event_id"))).alias("verse"), F.nullif(joined, F.lit("")).alias("marks"))


@query("w10_number_fill", f"SELECT event_id, last_value(CASE WHEN value < 5 THEN CAST(floor(value) AS BIGINT) END IGNORE NULLS) OVER ({OVER} {BEFORE}) AS number FROM events")
def w10(spark, d):
    return order.carry(events(spark, d), BY, ORDER, F.when(F.col("value") < 5, F.floor("value")), "number", strictly=True).select("event_id", "number")


@query("w11_anchor_position", f"SELECT conv_id, turn, CAST(coalesce(sum(length({skeleton_sql('text')})) OVER (PARTITION BY conv_id ORDER BY turn, text {BEFORE}), 0) AS BIGINT) AS upto FROM conversations")
def w11(spark, d):
    rows = load(spark, d, "conversations", "conv_id", "turn", "text")
    return order.running_sum(rows, ["conv_id"], ["turn", "text"], F.length(folds.skeleton(F.col("text"))), strictly=True).select("conv_id", "turn", "upto")


@query("w12_clamped_depth", """
WITH s AS (SELECT user_id, list(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END ORDER BY ts, event_id) AS steps FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_transform(steps, lambda x: {'now': x, 'most': 0}), lambda a, x: {'now': greatest(a.now + x.now, 0), 'most': greatest(a.most, a.now + x.now)}, {'now': 0, 'most': 0}) AS f FROM s)
SELECT user_id, f.now AS depth, f.most AS deepest FROM f""")
def w12(spark, d):
    rows = events(spark, d).withColumn("step", F.when(of("signup"), 1).when(of("error"), -1).otherwise(0))
    folded = rows.groupBy("user_id").agg(order.ordered(ORDER, "step").alias("s")).select("user_id", order.clamped_depth(F.col("s")).alias("f"))
    return folded.select("user_id", F.col("f.now").alias("depth"), F.col("f.most").alias("deepest"))


@query("w13_run_length_merge", f"""
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER ({OVER}) IS DISTINCT FROM event_type AND row_number() OVER ({OVER}) > 1 THEN 1 ELSE 0 END AS new FROM events),
r AS (SELECT *, sum(new) OVER ({OVER} {UPTO}) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), '+' ORDER BY ts, event_id) AS merged FROM r GROUP BY user_id, run""")
def w13(spark, d):
    rows = order.runs_of_equal(events(spark, d), BY, ORDER, F.col("event_type")).withColumn("id", F.col("event_id").cast("string"))
    return rows.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"), F.array_join(order.ordered(ORDER, "id"), "+").alias("merged"))


@query("w14_glued_groups", f"""
WITH g AS (SELECT *, coalesce(sum(CAST(value >= 20 AS INTEGER)) OVER ({OVER} {BEFORE}), 0) AS part FROM events)
SELECT event_id, CAST(part AS BIGINT) AS part, lead(part) OVER ({OVER}) IS DISTINCT FROM part AS last_of_group FROM g""")
def w14(spark, d):
    rows = order.islands(events(spark, d), BY, ORDER, F.col("value") >= 20, "part")
    return rows.select("event_id", "part", (~F.lead("part").over(_w()).eqNullSafe(F.col("part"))).alias("last_of_group"))


@query("w15_neighbour_links", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS next FROM conversations")
def w15(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return load(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.lag("turn").over(w).alias("prev"), F.lead("turn").over(w).alias("next"))


@query("w16_first_occurrence_id", "WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS code FROM f")
def w16(spark, d):
    first = events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return first.withColumn("code", (F.dense_rank().over(Window.partitionBy("user_id").orderBy("first_id")) - 1).cast("long"))


@query("w17_whitespace_state", """SELECT conv_id, turn, coalesce(lag(right(text, 1)) OVER (PARTITION BY conv_id ORDER BY turn, text) IN (' ', '.', '!', '?'), true) AS ended FROM conversations""")
def w17(spark, d):
    last = F.lag(F.substring("text", -1, 1)).over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return load(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.coalesce(last.isin(" ", ".", "!", "?"), F.lit(True)).alias("ended"))


@query("j24_neighbours", f"SELECT event_id, greatest(coalesce(lag(value, 2) OVER ({OVER}), -1), coalesce(lag(value) OVER ({OVER}), -1), coalesce(lead(value) OVER ({OVER}), -1), coalesce(lead(value, 2) OVER ({OVER}), -1)) AS around FROM events")
def j24(spark, d):
    near = [F.coalesce(f("value", k).over(_w()), F.lit(-1.0)) for f in (F.lag, F.lead) for k in (1, 2)]
    return events(spark, d).select("event_id", F.greatest(*near).alias("around"))
