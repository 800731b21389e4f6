"""Split, sampling and set queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket, hash_place
from ..operators import panel as P
from ..operators import splits as L
from ..sources.views import TX, canonical_txns
from .panel_queries import FRAME, _sql, panel, rounded
from .registry import register

_PLACE = lambda key, seed: f"md5(concat_ws('|', {key}, '{seed}'))"
_BUCKET = lambda key, seed, n: f"CAST(('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 8))::BIGINT % {n} AS INT)"


def _time(cuts):
    n = "(SELECT count(*) FROM txns)"
    if len(cuts) == 1:
        case = f"CASE WHEN rn < CAST(floor({n} * {cuts[0]}) AS BIGINT) THEN 'train' ELSE 'test' END"
    else:
        case = f"CASE WHEN rn < CAST(floor({n} * {cuts[0]}) AS BIGINT) THEN 'train' WHEN rn < CAST(floor({n} * {cuts[1]}) AS BIGINT) THEN 'val' ELSE 'test' END"
    return f"{TX}, ranked AS (SELECT *, row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS rn FROM txns), split AS (SELECT *, {case} AS split FROM ranked)"


@register("L1", _sql(_time([0.8]), "SELECT transaction_id, split FROM split"))
def l1(spark, sf_dir):
    return L.temporal_split(canonical_txns(spark, sf_dir)).select("transaction_id", "split")


@register("W10", _sql(_time([0.8]), "SELECT split, count(*) AS n, CAST(CAST(min(timestamp) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(timestamp) AS DATE) AS VARCHAR) AS last_day FROM split GROUP BY split"))
def w10(spark, sf_dir):
    d = L.temporal_split(canonical_txns(spark, sf_dir))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").cast("date").cast("string").alias("first_day"), F.max("timestamp").cast("date").cast("string").alias("last_day"))


@register("L2", _sql(_time([0.8, 0.9]), "SELECT transaction_id, split FROM split"))
def l2(spark, sf_dir):
    return L.temporal_split(canonical_txns(spark, sf_dir), (0.8, 0.9)).select("transaction_id", "split")


@register("A16", _sql(_time([0.8, 0.9]), """, novel AS (SELECT count(*) AS k FROM (SELECT merchant_key FROM split WHERE split = 'test' EXCEPT SELECT merchant_key FROM split WHERE split = 'train'))
  SELECT split, count(*) AS n, CAST(CAST(min(timestamp) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(timestamp) AS DATE) AS VARCHAR) AS last_day, count(DISTINCT user_id) AS users, count(DISTINCT merchant_key) AS merchants,
  CASE WHEN split = 'test' THEN (SELECT k FROM novel) END AS novel_merchants FROM split GROUP BY split"""))
def a16(spark, sf_dir):
    return L.summary(L.temporal_split(canonical_txns(spark, sf_dir), (0.8, 0.9)))


@register("L8", _sql(_time([0.8, 0.9]), """SELECT count(*) = count(DISTINCT transaction_id) AS disjoint, count(*) = (SELECT count(*) FROM txns) AS complete,
  min(timestamp) FILTER (split = 'test') >= max(timestamp) FILTER (split = 'val') AS ordered FROM split"""))
def l8(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    at = lambda f, s: f(F.when(F.col("split") == s, F.col("timestamp")))
    total = F.lit(t.count())
    return L.temporal_split(t, (0.8, 0.9)).agg((F.count("*") == F.countDistinct("transaction_id")).alias("disjoint"), (F.count("*") == total).alias("complete"), (at(F.min, "test") >= at(F.max, "val")).alias("ordered"))


def _keyed(key, fraction):
    return f"{TX}, ks AS (SELECT {key}, row_number() OVER (ORDER BY {_PLACE(key, 42)}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM txns)), split AS (SELECT t.*, CASE WHEN rn <= CAST(floor(n * {fraction}) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM txns t JOIN ks USING ({key}))"


@register("L3", _sql(_keyed("merchant_key", 0.8), "SELECT transaction_id, split FROM split"))
def l3(spark, sf_dir):
    return L.key_split(canonical_txns(spark, sf_dir), "merchant_key", 0.8).select("transaction_id", "split")


@register("L4", _sql(_keyed("merchant_raw", 0.9), "SELECT transaction_id, split FROM split"))
def l4(spark, sf_dir):
    return L.key_split(canonical_txns(spark, sf_dir), "merchant_raw", 0.9).select("transaction_id", "split")


@register("J5", _sql(_keyed("merchant_key", 0.8), "SELECT transaction_id FROM txns WHERE merchant_key NOT IN (SELECT merchant_key FROM split WHERE split = 'train')"))
def j5(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    train = L.key_split(t, "merchant_key", 0.8).where("split = 'train'").select("merchant_key").distinct()
    return t.join(train, "merchant_key", "left_anti").select("transaction_id")


@register("U3", _sql(_time([0.8]), "SELECT merchant_key FROM split WHERE split = 'test' EXCEPT SELECT merchant_key FROM split WHERE split = 'train'"))
def u3(spark, sf_dir):
    s = L.temporal_split(canonical_txns(spark, sf_dir))
    return s.where("split = 'test'").select("merchant_key").subtract(s.where("split = 'train'").select("merchant_key"))


@register("U4", _sql(_time([0.8]), "SELECT count(*) = 0 AS empty FROM (SELECT transaction_id FROM split WHERE split = 'test' INTERSECT SELECT transaction_id FROM split WHERE split = 'train')"))
def u4(spark, sf_dir):
    s = L.temporal_split(canonical_txns(spark, sf_dir))
    return s.where("split = 'test'").select("transaction_id").intersect(s.where("split = 'train'").select("transaction_id")).agg((F.count("*") == 0).alias("empty"))


_NOISE = f"""CASE WHEN {_BUCKET('transaction_id', 7, 10000)} >= 2000 THEN description WHEN {_BUCKET('transaction_id', 8, 100)} < 25 THEN lower(description) WHEN {_BUCKET('transaction_id', 8, 100)} < 50 THEN upper(description)
  WHEN {_BUCKET('transaction_id', 8, 100)} < 75 THEN replace(description, ' ', '') ELSE description || ' REF 1234' END"""


@register("P10", _sql(TX, f"SELECT transaction_id, {_NOISE} AS description FROM txns"))
def p10(spark, sf_dir):
    return canonical_txns(spark, sf_dir).select("transaction_id", L.noisy_text("description", "transaction_id").alias("description"))


@register("L5", _sql(_time([0.8]), f"SELECT transaction_id, split, CASE WHEN split = 'test' THEN {_NOISE} ELSE description END AS description FROM split"))
def l5(spark, sf_dir):
    s = L.temporal_split(canonical_txns(spark, sf_dir))
    return s.select("transaction_id", "split", F.when(F.col("split") == "test", L.noisy_text("description", "transaction_id")).otherwise(F.col("description")).alias("description"))


@register("P11", _sql(TX, f""", r AS (SELECT *, row_number() OVER (ORDER BY {_PLACE('transaction_id', 13)}) <= CAST(floor((SELECT count(*) FROM txns) * 0.01) AS BIGINT) AS hit FROM txns)
  SELECT transaction_id, CAST(hit AS INT) AS is_anomaly, round(CASE WHEN hit AND {_BUCKET('transaction_id', 15, 2)} = 0 THEN CAST(amount AS DOUBLE) * (5 + {_BUCKET('transaction_id', 14, 1001)} / 100) ELSE CAST(amount AS DOUBLE) END, 3) AS amount,
  CASE WHEN hit AND {_BUCKET('transaction_id', 15, 2)} = 1 THEN 'misc' ELSE category END AS category FROM r"""))
def p11(spark, sf_dir):
    return rounded(L.inject_anomalies(canonical_txns(spark, sf_dir)).select("transaction_id", "is_anomaly", "amount", "category"), 3)


@register("L6", _sql(FRAME, """, ms AS (SELECT DISTINCT month FROM frame), c AS (SELECT min(month) AS first_test FROM (SELECT month, row_number() OVER (ORDER BY month DESC) AS rn FROM ms) WHERE rn <= greatest(1, floor(0.2 * (SELECT count(*) FROM ms) + 0.5)))
  SELECT user_id, category, CAST(month AS VARCHAR) AS month, CASE WHEN month >= first_test THEN 'test' ELSE 'train' END AS split FROM frame, c"""))
def l6(spark, sf_dir):
    return rounded(P.forecast_frame(L.month_cutoff(panel(spark, sf_dir)), keep=("split",)).select("user_id", "category", "month", "split"))


@register("L7", _sql(FRAME, "SELECT user_id, category, CAST(month AS VARCHAR) AS month, CASE WHEN month = max(month) OVER (PARTITION BY user_id) THEN 'test' ELSE 'train' END AS split FROM frame"))
def l7(spark, sf_dir):
    return rounded(P.forecast_frame(L.last_month(panel(spark, sf_dir)), keep=("split",)).select("user_id", "category", "month", "split"))


@register("T4", _sql(TX, f"SELECT transaction_id FROM (SELECT transaction_id FROM txns ORDER BY {_PLACE('transaction_id', 42)} LIMIT 1000)"))
def t4(spark, sf_dir):
    """A seeded sample of fixed size."""
    return canonical_txns(spark, sf_dir).orderBy(hash_place(F.col("transaction_id"), 42)).limit(1000).select("transaction_id")


@register("T5", _sql(TX, f"SELECT transaction_id, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY {_PLACE('transaction_id', 42)}) <= count(*) OVER (PARTITION BY category) * 0.8 THEN 'train' ELSE 'test' END AS split FROM txns"))
def t5(spark, sf_dir):
    return L.stratified(canonical_txns(spark, sf_dir), "category", "transaction_id").select("transaction_id", "category", "split")


@register("T1", _sql(TX, "SELECT user_id, transaction_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id) AS place FROM txns"))
def t1(spark, sf_dir):
    """Rows clustered by user and sorted within; the place shows the order."""
    from pyspark.sql import Window as W

    d = canonical_txns(spark, sf_dir).repartition("user_id").sortWithinPartitions("user_id", "timestamp", "transaction_id")
    return d.select("user_id", "transaction_id", F.row_number().over(W.partitionBy("user_id").orderBy("timestamp", "transaction_id")).cast("long").alias("place"))


@register("J4", _sql(TX, f"SELECT transaction_id FROM txns WHERE user_id IN (SELECT user_id FROM txns WHERE {_BUCKET('user_id', 5, 100)} < 20)"))
def j4(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    return t.join(t.where(hash_bucket(F.col("user_id"), 5, 100) < 20).select("user_id").distinct(), "user_id", "left_semi").select("transaction_id")


@register("U2", _sql(TX, "SELECT DISTINCT description, category FROM txns"))
def u2(spark, sf_dir):
    return canonical_txns(spark, sf_dir).select("description", "category").dropDuplicates()


@register("U1", _sql(f"{TX}, evs AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events)", "SELECT user_id, CAST(sum(amount) AS DOUBLE) AS total FROM (SELECT user_id, amount FROM txns UNION ALL SELECT user_id, amount FROM evs) GROUP BY user_id"))
def u1(spark, sf_dir):
    from ..sources.views import canonical_events

    both = canonical_txns(spark, sf_dir).select("user_id", "amount").unionByName(canonical_events(spark, sf_dir).select("amount", "user_id"))
    return both.groupBy("user_id").agg(F.sum("amount").cast("double").alias("total"))
