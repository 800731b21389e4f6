"""Panel, profile and frame queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..functions.taxonomy import EXPENSE_CATEGORIES
from ..operators import panel as P
from ..sources.views import TX, canonical_txns, table
from .registry import register

CATS = EXPENSE_CATEGORIES
_sum = ", ".join(f"coalesce(sum(amount) FILTER (category = '{c}'), 0) AS {c}" for c in CATS)
_zero = ", ".join(f"coalesce(w.{c}, 0) AS {c}" for c in CATS)
_total = " + ".join(CATS)
_dbl = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CATS)
WIDE = f"""{TX},
wide AS (SELECT user_id, CAST(date_trunc('month', timestamp) AS DATE) AS month, {_sum} FROM txns WHERE direction = 'debit' GROUP BY ALL),
inc AS (SELECT user_id, CAST(date_trunc('month', timestamp) AS DATE) AS month, sum(amount) AS income FROM txns WHERE direction = 'credit' GROUP BY ALL)"""
PANEL = f"""{WIDE},
grid AS (SELECT user_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM wide GROUP BY user_id),
dense AS (SELECT g.user_id, g.month, {_zero}, income FROM grid g LEFT JOIN wide w ON g.user_id = w.user_id AND g.month = w.month LEFT JOIN inc i ON w.user_id = i.user_id AND w.month = i.month),
filled AS (SELECT * REPLACE (coalesce(last_value(income IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(income IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS income), {_total} AS total_expense FROM dense),
panel AS (SELECT user_id, month, {_dbl}, coalesce(CAST(income AS DOUBLE), avg(CAST(total_expense AS DOUBLE)) OVER (PARTITION BY user_id) * 1.1) AS income, CAST(total_expense AS DOUBLE) AS total_expense FROM filled)"""
LONG = f"""{PANEL},
long AS (UNPIVOT panel ON {", ".join(CATS)} INTO NAME category VALUE target)"""
FRAME = f"""{LONG},
frame AS (SELECT user_id, month, category, target, income AS cur_income,
  coalesce(lag(target, 1) OVER s, 0) AS lag_1, coalesce(lag(target, 2) OVER s, 0) AS lag_2, coalesce(lag(target, 3) OVER s, 0) AS lag_3,
  coalesce(avg(target) OVER p, 0) AS roll_mean_3, coalesce(stddev_samp(target) OVER p, 0) AS roll_std_3, coalesce(lag(total_expense) OVER s, 0) AS tot_lag_1,
  round(sin(2 * pi() * month(month) / 12), 6) AS moy_sin, round(cos(2 * pi() * month(month) / 12), 6) AS moy_cos
  FROM long WINDOW s AS (PARTITION BY user_id, category ORDER BY month), p AS (PARTITION BY user_id, category ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
BASE = f"""{LONG},
base AS (SELECT user_id, category, avg(target) FILTER (back <= 6) AS mean, stddev_pop(target) FILTER (back <= 6) AS std, avg(income) FILTER (back <= 6) AS income, count(*) AS n_months,
  CASE WHEN count(*) >= 4 THEN avg(target) FILTER (back BETWEEN 2 AND 4) END AS past_mean
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY month DESC) AS back FROM long) GROUP BY user_id, category)"""


def panel(spark, sf_dir, back=False):
    return P.monthly_panel(canonical_txns(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), back)


def rounded(df, digits=4):
    """Doubles to so many digits, dates as text: what both engines print alike."""
    out = [rnd(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(*out)


_r = lambda cols, d=4: ", ".join(f"round({c}, {d}) AS {c}" for c in cols)
_cast = lambda cols: ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
_sql = lambda ctes, body: f"WITH {ctes} {body}"


@register("A1", _sql(WIDE, f"SELECT user_id, CAST(month AS VARCHAR) AS month, {_cast(CATS)} FROM wide"))
def a1(spark, sf_dir):
    d = P.category_sums(canonical_txns(spark, sf_dir))
    return rounded(d.select("user_id", "month", *[F.col(c).cast("double").alias(c) for c in CATS]), 2)


@register("J2", _sql(WIDE, "SELECT w.user_id, CAST(w.month AS VARCHAR) AS month, CAST(income AS DOUBLE) AS income FROM wide w LEFT JOIN inc i ON w.user_id = i.user_id AND w.month = i.month"))
def j2(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    return rounded(P.with_income(P.category_sums(t), P.monthly_income(t)).select("user_id", "month", F.col("income").cast("double").alias("income")), 2)


@register("J6", _sql(PANEL, "SELECT user_id, CAST(month AS VARCHAR) AS month, CAST(groceries AS DOUBLE) AS groceries FROM dense"))
def j6(spark, sf_dir):
    d = P.dense_months(P.category_sums(canonical_txns(spark, sf_dir)))
    return d.select("user_id", F.col("month").cast("string").alias("month"), F.coalesce(F.col("groceries").cast("double"), F.lit(0.0)).alias("groceries"))


@register("W5", _sql(PANEL, "SELECT user_id, CAST(month AS VARCHAR) AS month, CAST(income AS DOUBLE) AS income FROM filled"))
def w5(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    d = P.fill_within(P.dense_months(P.with_income(P.category_sums(t), P.monthly_income(t))), "income")
    return d.select("user_id", F.col("month").cast("string").alias("month"), F.col("income").cast("double").alias("income"))


@register("A2", _sql(PANEL, f"SELECT user_id, CAST(month AS VARCHAR) AS month, {_r([*CATS, 'income', 'total_expense'], 2)} FROM panel"))
def a2(spark, sf_dir):
    return rounded(panel(spark, sf_dir), 2)


PROFILE = f"""{PANEL},
idx AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) - 1 AS x FROM panel),
profile AS (SELECT user_id, ln(1 + avg(income)) AS log_income,
  CASE WHEN avg(income) > 0 THEN greatest(-1, least(1, 1 - avg(total_expense) / avg(income))) ELSE 0 END AS savings_rate,
  stddev_pop(total_expense) / (avg(total_expense) + 1e-9) AS volatility,
  coalesce(CASE WHEN count(*) > 1 THEN regr_slope(total_expense, x) END / (avg(total_expense) + 1e-9), 0) AS trend, avg(total_expense) AS mean_expense,
  {", ".join(f"coalesce(avg({c} / nullif(total_expense, 0)), 0) AS share_{c}" for c in CATS)} FROM idx GROUP BY user_id)"""
PROFILE_COLS = ["log_income", "savings_rate", "volatility", "trend", "mean_expense", *[f"share_{c}" for c in CATS]]


@register("A3", _sql(PROFILE, f"SELECT user_id, {_r(PROFILE_COLS)} FROM profile"))
def a3(spark, sf_dir):
    return rounded(P.user_profiles(panel(spark, sf_dir)))


@register("P6", _sql(LONG, "SELECT user_id, CAST(month AS VARCHAR) AS month, category, round(target, 2) AS target FROM long"))
def p6(spark, sf_dir):
    return rounded(P.long_panel(panel(spark, sf_dir)).select("user_id", "month", "category", "target"), 2)


FRAME_COLS = ["target", "cur_income", "lag_1", "lag_2", "lag_3", "roll_mean_3", "roll_std_3", "tot_lag_1", "moy_sin", "moy_cos"]


@register("W6", _sql(FRAME, f"SELECT user_id, CAST(month AS VARCHAR) AS month, category, {_r(FRAME_COLS)} FROM frame"))
def w6(spark, sf_dir):
    return rounded(P.forecast_frame(panel(spark, sf_dir)))


SERVING = f"""{LONG},
serving AS (SELECT user_id, category, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS month, max(income) FILTER (back = 1) AS cur_income,
  max(target) FILTER (back = 1) AS lag_1, max(target) FILTER (back = 2) AS lag_2, max(target) FILTER (back = 3) AS lag_3,
  avg(target) FILTER (back <= 3) AS roll_mean_3, stddev_pop(target) FILTER (back <= 3) AS roll_std_3, max(total_expense) FILTER (back = 1) AS tot_lag_1
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY month DESC) AS back FROM long) GROUP BY user_id, category HAVING count(*) >= 3)"""


@register("W11", _sql(SERVING, f"""SELECT user_id, category, CAST(month AS VARCHAR) AS month, {_r(FRAME_COLS[1:8])},
  round(sin(2 * pi() * month(month) / 12), 4) AS moy_sin, round(cos(2 * pi() * month(month) / 12), 4) AS moy_cos FROM serving"""))
def w11(spark, sf_dir):
    return rounded(P.serving_frame(panel(spark, sf_dir, back=True)))


@register("W12", _sql(BASE, f"SELECT user_id, category, {_r(['mean', 'std', 'income'])} FROM base"))
def w12(spark, sf_dir):
    return rounded(P.baselines(panel(spark, sf_dir, back=True)).select("user_id", "category", "mean", "std", "income"))


@register("W13", _sql(BASE, "SELECT user_id, round(past_mean, 4) AS past_mean FROM base WHERE category = 'subscriptions'"))
def w13(spark, sf_dir):
    return rounded(P.baselines(panel(spark, sf_dir, back=True)).where("category = 'subscriptions'").select("user_id", "past_mean"))


@register("M9", _sql(FRAME, "SELECT user_id, CAST(month AS VARCHAR) AS month, category, round(greatest(lag_1, 0), 4) AS naive, round(greatest(roll_mean_3, 0), 4) AS rolling FROM frame"))
def m9(spark, sf_dir):
    f = P.forecast_frame(panel(spark, sf_dir))
    return rounded(f.select("user_id", "month", "category", F.greatest("lag_1", F.lit(0.0)).alias("naive"), F.greatest("roll_mean_3", F.lit(0.0)).alias("rolling")))


@register("M15", _sql(LONG, """SELECT user_id, category, round(greatest(0, CASE WHEN count(*) < 3 THEN avg(target) ELSE
  sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * target) END), 4) AS forecast FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id, category ORDER BY month) AS i, count(*) OVER (PARTITION BY user_id, category) AS n FROM long) GROUP BY user_id, category"""))
def m15(spark, sf_dir):
    return rounded(P.exponential_smoothing(P.long_panel(panel(spark, sf_dir))))


@register("J1", _sql(f"{FRAME}, {PROFILE.split('panel AS', 1)[1].partition('FROM filled),')[2].strip()}", "SELECT f.user_id, CAST(month AS VARCHAR) AS month, category, round(target, 4) AS target, round(log_income, 4) AS log_income, round(savings_rate, 4) AS savings_rate FROM frame f LEFT JOIN profile p ON f.user_id = p.user_id"))
def j1(spark, sf_dir):
    p = panel(spark, sf_dir)
    f = P.forecast_frame(p.join(P.user_profiles(p).select("user_id", "log_income", "savings_rate"), "user_id", "left"), keep=("log_income", "savings_rate"))
    return rounded(f.select("user_id", "month", "category", "target", "log_income", "savings_rate"))


@register("J9", _sql(FRAME, """, seen AS (SELECT user_id, category, month(month) AS moy, arg_max(target, month) AS same FROM frame WHERE month < DATE '2000-01-01' GROUP BY ALL)
  SELECT f.user_id, f.category, CAST(f.month AS VARCHAR) AS month, round(greatest(0, coalesce(same, lag_1)), 4) AS forecast FROM frame f
  LEFT JOIN seen s ON f.user_id = s.user_id AND f.category = s.category AND month(f.month) = s.moy WHERE f.month >= DATE '2000-01-01'"""))
def j9(spark, sf_dir):
    """Seasonal naive: the same calendar month when last seen before the cut, else the month before."""
    f = P.seasonal_naive(panel(spark, sf_dir), "2000-01-01")
    return rounded(f.select("user_id", "category", "month", "forecast"))


@register("A17", _sql(FRAME, "SELECT category, round(avg(target), 4) AS mean, count(*) AS n, count(*) < 40 AS fallback FROM frame GROUP BY category"))
def a17(spark, sf_dir):
    f = P.forecast_frame(panel(spark, sf_dir))
    return rounded(f.groupBy("category").agg(F.avg("target").alias("mean"), F.count("*").alias("n"), (F.count("*") < 40).alias("fallback")))


@register("A12", _sql(TX, "SELECT user_id, round(stddev_samp(CAST(amount AS DOUBLE)) / avg(CAST(amount AS DOUBLE)), 4) AS volatility FROM txns GROUP BY user_id HAVING avg(amount) > 0"))
def a12(spark, sf_dir):
    a = F.col("amount").cast("double")
    d = canonical_txns(spark, sf_dir).groupBy("user_id").agg(F.avg(a).alias("m"), (F.stddev_samp(a) / F.avg(a)).alias("volatility"))
    return rounded(d.where("m > 0").drop("m"))


@register("A13", _sql(PANEL, "SELECT user_id, round(avg(total_expense), 4) AS mean_spend, round(avg(total_expense) * 0.85, 4) AS target_spend FROM panel GROUP BY user_id"))
def a13(spark, sf_dir):
    return rounded(panel(spark, sf_dir).groupBy("user_id").agg(F.avg("total_expense").alias("mean_spend"), (F.avg("total_expense") * 0.85).alias("target_spend")))
