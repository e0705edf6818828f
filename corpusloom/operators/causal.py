"""Causal statistics: run states, running confidence, averages, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


@query(
    "run_state",
    """
WITH e AS (SELECT user_id, event_type, row_number() OVER u AS i, row_number() OVER k AS j FROM events
           WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id), k AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, least(127, count(*)) AS run FROM e GROUP BY user_id, event_type, i - j)
SELECT event_type, CAST(run AS INT) AS run, count(*) AS n FROM r GROUP BY ALL
""",
)
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same event type of a user, by length (at most 127 counts)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(u))).cast("int")).withColumn("run_id", F.sum("new").over(u))
    runs = e.groupBy("user_id", "run_id").agg(F.first("event_type").alias("event_type"), F.least(F.lit(127), F.count("*")).cast("int").alias("run"))
    return runs.groupBy("event_type", "run").agg(F.count("*").alias("n"))


CONFIDENCE_SQL = """
WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS hit FROM events),
c AS (SELECT *, avg(hit) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)
"""


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, hit, p): p is the mean of the earlier hits of the same user and type, null at first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("hit", F.when(F.col("event_type") == F.lag("event_type").over(u), 1).otherwise(0))
    k = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("p", F.avg("hit").over(k))


@query("running_confidence", CONFIDENCE_SQL + "SELECT event_type, count(*) AS n, count(p) AS n_known, round(avg(p), 6) AS mean_confidence FROM c GROUP BY event_type")
def running_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidence(spark, sf_dir)
    return c.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p").alias("n_known"), F.round(F.avg("p"), 6).alias("mean_confidence"))


@query(
    "calibration_table",
    CONFIDENCE_SQL
    + """, q AS (SELECT hit, least(0.99, greatest(0.01, p)) AS p FROM c WHERE p IS NOT NULL)
SELECT CAST(round_even(ln(p / (1 - p)) * 2, 0) AS INT) AS bucket, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(hit), 6) AS observed FROM q GROUP BY 1
""",
)
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against observed frequency in buckets of the stretched probability."""
    c = confidence(spark, sf_dir).filter("p IS NOT NULL").withColumn("p", F.least(F.lit(0.99), F.greatest(F.lit(0.01), "p")))
    bucket = F.rint(F.ln(F.col("p") / (1 - F.col("p"))) * 2).cast("int")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("hit"), 6).alias("observed"))


@query(
    "ema_fold",
    """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, 0.0 + 0.1 * value AS ema FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, f.ema + 0.1 * (e.value - f.ema) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, i AS n, round(ema, 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS last FROM f) WHERE last = 1
""",
)
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean p += (x - p) / 10 of a user's values, unrolled: the k-th last value weighs 0.1 * 0.9^(k-1)."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = e.select("user_id", "value", k.alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.lit(0.1) * F.pow(F.lit(0.9), F.col("k") - 1) * F.col("value")), 6).alias("ema"))


@query(
    "recency_rank",
    """
WITH l AS (SELECT user_id, event_type, max(struct_pack(ts := ts, event_id := event_id)) AS last FROM events GROUP BY ALL),
r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS r FROM l)
SELECT user_id, event_type, CAST(r - 1 AS INT) AS mtf FROM r WHERE r <= 4
""",
)
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move-to-front list (four places) of each user's event types after the last event."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    r = last.withColumn("mtf", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"))) - 1)
    return r.filter("mtf < 4").select("user_id", "event_type", F.col("mtf").cast("int").alias("mtf"))


@query(
    "trust_history",
    """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS hit FROM events),
r AS (SELECT user_id, hit, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM e)
SELECT user_id, CAST(sum(hit * (1 << k)) AS INT) AS history FROM r WHERE k < 8 GROUP BY user_id
""",
)
def trust_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight outcomes of each user as bits, the latest lowest."""
    u = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    e = e.withColumn("hit", F.when(F.col("event_type") == F.lag("event_type").over(u.orderBy("ts", "event_id")), 1).otherwise(0))
    e = e.withColumn("k", F.row_number().over(u.orderBy(F.desc("ts"), F.desc("event_id"))) - 1).filter("k < 8")
    return e.groupBy("user_id").agg(F.sum(F.col("hit") * F.expr("shiftleft(1, k)")).cast("int").alias("history"))
