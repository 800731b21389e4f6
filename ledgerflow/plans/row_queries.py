"""Row feature, report and sequence queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import rows as R
from ..sources.files import stored
from ..sources.views import EV, TX, canonical_events, canonical_txns, table
from .panel_queries import _r, _sql, rounded
from .registry import register

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, transaction_id), p AS (PARTITION BY user_id ORDER BY timestamp, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUN = f"""{TX},
running AS (SELECT *, coalesce(CAST(sum(amount) OVER p AS DOUBLE), 0) AS cumulative_spend, row_number() OVER w - 1 AS rolling_tx_count,
  coalesce(avg(CAST(amount AS DOUBLE)) OVER p, 0) AS user_mean_amount, coalesce(stddev_samp(CAST(amount AS DOUBLE)) OVER p, 0) AS user_std_amount,
  coalesce(epoch(timestamp - lag(timestamp) OVER w) / 86400, 0) AS days_since_previous, coalesce(epoch(timestamp - lag(timestamp) OVER w) / 3600, 0) AS time_gap_hours,
  CAST(sum(CASE direction WHEN 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance_proxy FROM txns {_W})"""
STATS = """ustats AS (SELECT user_id, count(*) AS history_length, CAST(coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS DOUBLE) AS total_debit,
  CAST(coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS DOUBLE) AS total_credit, CAST(sum(CAST(is_recurring AS INT)) AS BIGINT) AS recurring_count FROM txns GROUP BY user_id),
ratios AS (SELECT *, greatest(0, least(10, total_credit / (total_debit + 1e-9))) AS cashflow_ratio, recurring_count / (history_length + 1e-9) AS recurring_ratio FROM ustats),
mstats AS (SELECT merchant_key, count(*) AS merchant_frequency, avg(CAST(amount AS DOUBLE)) AS merchant_mean_amount FROM txns GROUP BY merchant_key)"""


def _running(name, *cols):
    sql = _sql(RUN, f"SELECT transaction_id, {', '.join(c if c == 'rolling_tx_count' else f'round({c}, 3) AS {c}' for c in cols)} FROM running")
    register(name, sql)(lambda spark, sf_dir: rounded(R.running(canonical_txns(spark, sf_dir)).select("transaction_id", *[F.col(c).cast("long") if c == "rolling_tx_count" else c for c in cols]), 3))


_running("W1", "cumulative_spend", "rolling_tx_count")
_running("W2", "user_mean_amount", "user_std_amount")
_running("W3", "days_since_previous", "time_gap_hours")
_running("W4", "running_balance_proxy")


@register("W7", _sql(EV, """SELECT transaction_id, CAST(epoch(timestamp - lag(timestamp) OVER m) AS BIGINT) AS same_merchant_gap, CAST(epoch(timestamp - lag(timestamp) OVER c) AS BIGINT) AS same_category_gap
  FROM (SELECT * REPLACE (date_trunc('second', timestamp) AS timestamp) FROM evs) WINDOW m AS (PARTITION BY user_id, merchant_raw ORDER BY timestamp, transaction_id), c AS (PARTITION BY user_id, category ORDER BY timestamp, transaction_id)"""))
def w7(spark, sf_dir):
    e = canonical_events(spark, sf_dir).withColumn("timestamp", F.date_trunc("second", "timestamp"))
    return R.same_key_gaps(e).select("transaction_id", "same_merchant_gap", "same_category_gap")


@register("W8", _sql(EV, """, s AS (SELECT *, CAST(floor(epoch(timestamp)) AS BIGINT) AS s FROM evs)
  SELECT transaction_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW) AS tx_count_7d,
  count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2591999 PRECEDING AND CURRENT ROW) AS tx_count_30d FROM s"""))
def w8(spark, sf_dir):
    return R.trailing_counts(canonical_events(spark, sf_dir)).select("transaction_id", "tx_count_7d", "tx_count_30d")


@register("W9", _sql(f"{TX}, {STATS}", "SELECT transaction_id, merchant_frequency, round(merchant_mean_amount, 3) AS merchant_mean_amount FROM txns JOIN mstats USING (merchant_key)"))
def w9(spark, sf_dir):
    return rounded(R.merchant_stats(canonical_txns(spark, sf_dir)).select("transaction_id", "merchant_frequency", "merchant_mean_amount"), 3)


@register("A4", _sql(f"{TX}, {STATS}", f"SELECT user_id, history_length, recurring_count, {_r(['total_debit', 'total_credit', 'cashflow_ratio', 'recurring_ratio'])} FROM ratios"))
def a4(spark, sf_dir):
    return rounded(R.user_stats(canonical_txns(spark, sf_dir)))


FEATURES = ["cumulative_spend", "user_mean_amount", "user_std_amount", "days_since_previous", "running_balance_proxy", "merchant_mean_amount", "cashflow_ratio", "recurring_ratio"]
_cal = "hour(timestamp) AS hour, CAST(isodow(timestamp) - 1 AS INT) AS weekday, CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend, month(timestamp) AS month_no, quarter(timestamp) AS quarter, day(timestamp) AS day, CAST(day(timestamp) <= 7 AS INT) AS is_salary_week"


@register("W15", _sql(f"{RUN}, {STATS}", f"SELECT transaction_id, rolling_tx_count, merchant_frequency, history_length, {_r(FEATURES, 3)}, {_cal} FROM running JOIN mstats USING (merchant_key) JOIN ratios USING (user_id)"))
def w15(spark, sf_dir):
    d = R.row_features(canonical_txns(spark, sf_dir))
    return rounded(d.select("transaction_id", F.col("rolling_tx_count").cast("long").alias("rolling_tx_count"), "merchant_frequency", "history_length", *FEATURES, *S.calendar()), 3)


@register("F2", _sql(EV, f"SELECT transaction_id, {_cal} FROM evs"))
def f2(spark, sf_dir):
    return canonical_events(spark, sf_dir).select("transaction_id", *[c.alias(k) for k, c in S.calendar().items()])


_cyc = ", ".join(f"round({f}(2 * pi() * {v}), 6) AS {k}_{f}" for k, v in (("hour", "hour(timestamp) / 24"), ("dow", "(isodow(timestamp) - 1) / 7"), ("dom", "(day(timestamp) - 1) / 31"), ("month", "(month(timestamp) - 1) / 12")) for f in ("sin", "cos"))


@register("F1", _sql(EV, f"SELECT transaction_id, {_cyc} FROM evs"))
def f1(spark, sf_dir):
    return canonical_events(spark, sf_dir).select("transaction_id", *[S.rnd(c, 6).alias(k) for k, c in S.cyclical().items()])


@register("F3", _sql(TX, "SELECT transaction_id, CAST(CAST(date_trunc('month', timestamp) AS DATE) AS VARCHAR) AS month, round(sin(2 * pi() * month(timestamp) / 12), 6) AS moy_sin, round(cos(2 * pi() * month(timestamp) / 12), 6) AS moy_cos FROM txns"))
def f3(spark, sf_dir):
    d = canonical_txns(spark, sf_dir).withColumn("month", S.month_start())
    return d.select("transaction_id", F.col("month").cast("string").alias("month"), *[S.rnd(c, 6).alias(k) for k, c in S.month_angle().items()])


@register("A5", _sql(EV, """, t AS (SELECT *, CAST(timestamp AS DATE) AS day_, CAST(isodow(timestamp) >= 6 AS INT) AS weekend, CAST(hour(timestamp) >= 22 OR hour(timestamp) < 6 AS INT) AS night FROM evs),
daily AS (SELECT user_id, day_, CAST(coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS DOUBLE) AS spend, CAST(coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS DOUBLE) AS income, count(*) AS n, sum(weekend) AS weekend, sum(night) AS night FROM t GROUP BY ALL),
u AS (SELECT user_id, avg(spend) AS avg_daily_spend, median(spend) AS median_daily_spend, stddev_samp(spend) AS std_daily_spend, sum(n) / count(*) AS tx_per_active_day, sum(weekend) / sum(n) AS weekend_ratio,
  sum(night) / sum(n) AS night_ratio, stddev_samp(income) / (avg(income) + 1e-12) AS income_cv, CASE WHEN sum(income) > 0 THEN (sum(income) - sum(spend)) / sum(income) END AS savings_estimate FROM daily GROUP BY user_id),
me AS (SELECT user_id, -sum(p * log2(p + 1e-12)) AS merchant_entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM t GROUP BY user_id, merchant_raw) GROUP BY user_id),
ce AS (SELECT user_id, -sum(p * log2(p + 1e-12)) AS category_entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM t GROUP BY user_id, category) GROUP BY user_id)
SELECT user_id, """ + _r(["avg_daily_spend", "median_daily_spend", "std_daily_spend", "tx_per_active_day", "weekend_ratio", "night_ratio", "income_cv", "savings_estimate", "merchant_entropy", "category_entropy"]) + " FROM u JOIN me USING (user_id) JOIN ce USING (user_id)"))
def a5(spark, sf_dir):
    return rounded(R.behaviour(canonical_events(spark, sf_dir)))


@register("A6", _sql(TX, "SELECT count(DISTINCT user_id) AS users, count(DISTINCT merchant_key) AS merchants, count(DISTINCT category) AS categories, count(DISTINCT date_trunc('month', timestamp)) AS months FROM txns"))
def a6(spark, sf_dir):
    return canonical_txns(spark, sf_dir).agg(*[F.countDistinct(c).alias(n) for n, c in (("users", F.col("user_id")), ("merchants", F.col("merchant_key")), ("categories", F.col("category")), ("months", S.month_start()))])


def quality_report(txns):
    """(metric, value) over the whole table: sizes, distincts, duplicates, nulls by column, rows a user and a class."""
    copies = txns.groupBy(*txns.columns).agg(F.count("*").alias("k"))
    ids = copies.groupBy("transaction_id").agg(F.sum("k").alias("k"), F.sum(F.col("k") - 1).alias("again"))
    one = txns.agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.countDistinct("merchant_key").alias("merchants"), F.countDistinct("category").alias("categories"),
        (F.avg((F.col("merchant_key") != "").cast("int")) * 100).alias("merchant_resolution_rate"), *[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"missing_percent_{c}") for c in txns.columns],
        F.unix_date(F.min("timestamp").cast("date")).alias("first_day"), F.unix_date(F.max("timestamp").cast("date")).alias("last_day"))
    dup = ids.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_transaction_ids"), F.coalesce(F.sum("again"), F.lit(0)).alias("duplicate_rows"))
    per_user = txns.groupBy("user_id").agg(F.count("*").alias("k")).agg(F.avg("k").alias("average_sequence_length"), F.median("k").alias("median_sequence_length"))
    parts = [d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in d.columns])).alias("x")).select("x.*") for d in (one, dup, per_user)]
    classes = [txns.groupBy(F.concat(F.lit(f"{name}_"), F.col(c)).alias("metric")).agg(F.count("*").cast("double").alias("value")) for name, c in (("class", "category"), ("direction", "direction"))]
    return reduce(lambda a, b: a.unionByName(b), [*parts, *classes])


_COLUMNS = ("user_id", "transaction_id", "timestamp", "amount", "direction", "category", "merchant_raw", "merchant_key", "description", "is_recurring")
QUALITY = f"""{TX}, one AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, CAST(count(DISTINCT merchant_key) AS DOUBLE) AS merchants, CAST(count(DISTINCT category) AS DOUBLE) AS categories,
  avg(CAST(merchant_key <> '' AS INT)) * 100 AS merchant_resolution_rate, {', '.join(f'avg(CAST({c} IS NULL AS INT)) * 100 AS missing_percent_{c}' for c in _COLUMNS)}, CAST(date_diff('day', DATE '1970-01-01', CAST(min(timestamp) AS DATE)) AS DOUBLE) AS first_day, CAST(date_diff('day', DATE '1970-01-01', CAST(max(timestamp) AS DATE)) AS DOUBLE) AS last_day,
  CAST(count(*) - count(DISTINCT transaction_id) AS DOUBLE) AS duplicate_transaction_ids, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_COLUMNS)} FROM txns)) AS DOUBLE) AS duplicate_rows, CAST(count(*) AS DOUBLE) / count(DISTINCT user_id) AS average_sequence_length,
  (SELECT median(k) FROM (SELECT count(*) AS k FROM txns GROUP BY user_id)) AS median_sequence_length FROM txns),
quality AS (SELECT metric, value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'class_' || category, CAST(count(*) AS DOUBLE) FROM txns GROUP BY category UNION ALL SELECT 'direction_' || direction, CAST(count(*) AS DOUBLE) FROM txns GROUP BY direction)"""


@register("A7", _sql(QUALITY, "SELECT metric, round(value, 3) AS value FROM quality"))
def a7(spark, sf_dir):
    return rounded(quality_report(canonical_txns(spark, sf_dir)), 3)


@register("A8", _sql(QUALITY, "SELECT metric, round(value, 1) AS value FROM quality WHERE metric IN ('rows', 'users', 'merchants', 'categories', 'duplicate_transaction_ids', 'average_sequence_length', 'median_sequence_length', 'merchant_resolution_rate')"))
def a8(spark, sf_dir):
    wanted = ("rows", "users", "merchants", "categories", "duplicate_transaction_ids", "average_sequence_length", "median_sequence_length", "merchant_resolution_rate")
    return rounded(quality_report(canonical_txns(spark, sf_dir)).where(F.col("metric").isin(*wanted)), 1)


@register("A9", _sql(TX, "SELECT category, count(*) AS n FROM txns GROUP BY category"))
def a9(spark, sf_dir):
    return canonical_txns(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@register("A11", _sql(TX, """, c AS (SELECT merchant_key, count(*) AS n FROM txns GROUP BY merchant_key), q AS (SELECT quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.75) AS hi FROM c)
  SELECT merchant_key, n, CASE WHEN n >= hi THEN 'Head' WHEN n < lo THEN 'Tail' ELSE 'Torso' END AS tier FROM c, q"""))
def a11(spark, sf_dir):
    return merchant_tiers(canonical_txns(spark, sf_dir))


def merchant_tiers(txns):
    """Head, torso or tail by the quartiles of merchants' counts, exact with linear interpolation."""
    c = txns.groupBy("merchant_key").agg(F.count("*").alias("n"))
    q = F.broadcast(c.agg(F.percentile("n", F.lit(0.25)).alias("lo"), F.percentile("n", F.lit(0.75)).alias("hi")))
    return c.join(q, F.lit(True)).select("merchant_key", "n", F.when(F.col("n") >= F.col("hi"), "Head").when(F.col("n") < F.col("lo"), "Tail").otherwise("Torso").alias("tier"))


_word = lambda k: f"sum(('0x' || substr(md5(transaction_id), {8 * k + 1}, 8))::BIGINT)"


@register("A15", _sql(TX, f"SELECT sha256(concat_ws(',', {', '.join(f'CAST({_word(k)} AS VARCHAR)' for k in range(4))}, CAST(count(*) AS VARCHAR))) AS dataset_hash, count(*) AS n FROM txns"))
def a15(spark, sf_dir):
    """A digest of all ids in any order: the sums of the four words of their md5, digested; nothing is collected."""
    word = lambda k: F.sum(F.conv(F.substring(F.md5("transaction_id"), 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    n = F.count("*")
    return canonical_txns(spark, sf_dir).agg(F.sha2(F.concat_ws(",", *[word(k) for k in range(4)], n.cast("string")), 256).alias("dataset_hash"), n.alias("n"))


_leak = ("cumulative_spend", "user_mean_amount", "days_since_previous", "merchant_frequency", "merchant_mean_amount", "history_length", "cashflow_ratio")


def _features_sql(prefix, where):
    names = {"txns AS (": f"{prefix}txns AS (", "FROM txns": f"FROM {prefix}txns", "running AS": f"{prefix}running AS", "ustats": f"{prefix}ustats", "ratios AS": f"{prefix}ratios AS", "mstats AS": f"{prefix}mstats AS"}
    body = f"{RUN}, {STATS}"
    for a, b in names.items():
        body = body.replace(a, b)
    return body.replace(f"{prefix}txns AS (\n", f"{prefix}all AS (\n").replace(f"{prefix}running AS (", f"{prefix}txns AS (SELECT * FROM {prefix}all WHERE {where}),\n{prefix}running AS (")


#: Features are audited up to a day four fifths into the time range.
_AUDITED = "\"timestamp\" <= (SELECT CAST(min(\"timestamp\") AS DATE) + CAST(floor(date_diff('day', min(\"timestamp\"), max(\"timestamp\")) * 0.8) AS INT) FROM pall)"


@register("P5", _sql(f"{_features_sql('f', 'TRUE')}, {_features_sql('p', _AUDITED)}",
    ", ".join(["", *[f"{x}all_ AS (SELECT * FROM {x}running JOIN {x}mstats USING (merchant_key) JOIN {x}ratios USING (user_id))" for x in "fp"]])
    + f", one AS (SELECT count(*) AS rows, {', '.join(f'CAST(sum(CAST(round(f.{n}, 3) IS DISTINCT FROM round(p.{n}, 3) AS INT)) AS BIGINT) AS {n}' for n in _leak)} FROM fall_ f JOIN pall_ p USING (transaction_id)) "
    + f"SELECT rows, feature, changed, changed > 0 AS leaks FROM (UNPIVOT one ON {', '.join(_leak)} INTO NAME feature VALUE changed)"))
def p5(spark, sf_dir):
    t = stored(canonical_txns(spark, sf_dir).select("user_id", "transaction_id", "timestamp", "amount", "direction", "merchant_key", "is_recurring"), "audited-rows")
    first, last = F.min("timestamp").cast("date"), F.max("timestamp").cast("date")
    cutoff = t.agg(F.date_add(first, F.floor(F.datediff(last, first) * 0.8).cast("int")).cast("string")).first()[0]
    return R.leakage_audit(t, cutoff)


SEQ = f"""{TX}, voc AS (SELECT category, row_number() OVER (ORDER BY category) AS category_id FROM (SELECT DISTINCT category FROM txns)),
back AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, transaction_id DESC) AS back FROM txns JOIN voc USING (category))"""


def _seq_sql(skip):
    return f"SELECT user_id, array_to_string(list(category_id ORDER BY back DESC), ',') AS ids, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM back WHERE back > {skip} AND back <= {64 + skip} GROUP BY user_id"


def _flat(d):
    used = lambda c: F.slice(c, F.lit(1), F.col("n"))
    total = F.aggregate(used("amounts"), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x.cast("decimal(18,2)")).cast("decimal(18,2)")).cast("double")
    return d.select("user_id", F.array_join(used("categories"), ",").alias("ids"), total.alias("total"), F.col("n").cast("long").alias("n"))


@register("F13", _sql(SEQ, _seq_sql(0)))
def f13(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    return _flat(R.sequences(t, R.category_ids(t)))


@register("F14", _sql(SEQ, f", s AS ({_seq_sql(1)}) SELECT s.*, t.category AS target_category, CAST(t.amount AS DOUBLE) AS target_amount FROM s JOIN back t ON s.user_id = t.user_id AND t.back = 1"))
def f14(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    last = t.groupBy("user_id").agg(F.max_by(F.struct("category", "amount"), F.struct("timestamp", "transaction_id")).alias("t"))
    d = _flat(R.sequences(t, R.category_ids(t), skip=1)).join(last, "user_id")
    return d.select("user_id", "ids", "total", "n", F.col("t.category").alias("target_category"), F.col("t.amount").cast("double").alias("target_amount"))


@register("S3", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem")
def s3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@register("P1", "SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS day FROM lineitem WHERE l_quantity > 45")
def p1(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("day"))
