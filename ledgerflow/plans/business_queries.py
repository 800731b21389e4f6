"""Recommendation, health, drift and tracker queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket, rnd
from ..functions.taxonomy import DISCRETIONARY, EXPENSE_CATEGORIES, LABELS
from ..operators import drift as D
from ..operators import panel as P
from ..operators import recommend as B
from ..operators import rows as R
from ..operators.quantiles import quantiles
from ..sources.files import work_dir
from ..sources.views import EV, TX, canonical_events, canonical_txns
from ..streaming.tracker import category_totals, latest
from .metric_queries import _PT
from .panel_queries import BASE, PANEL, PROFILE, SERVING, _r, _sql, panel, rounded
from .registry import register
from .row_queries import STATS
from .split_queries import _BUCKET

CATS = EXPENSE_CATEGORIES
_serv = SERVING.split("long AS (", 1)[1].split("),\nserving", 1)[1]
_prof = PROFILE[len(PANEL) :]
#: Forecast: each user's last month; cohorts by a hash of users.
INPUTS = f"""{BASE},
serving{_serv}{_prof},
inp AS (SELECT b.*, greatest(s.lag_1, 0) AS forecast, {_BUCKET('b.user_id', 3, 6)} AS cohort, sum(greatest(s.lag_1, 0)) OVER (PARTITION BY b.user_id) AS total FROM base b JOIN serving s ON b.user_id = s.user_id AND b.category = s.category),
norms AS (SELECT cohort, category, median(share) AS peer_share FROM (SELECT {_BUCKET('user_id', 3, 6)} AS cohort, * FROM (UNPIVOT (SELECT user_id, {', '.join(f'share_{c} AS {c}' for c in CATS)} FROM profile) ON {', '.join(CATS)} INTO NAME category VALUE share)) GROUP BY cohort, category)"""
_HC = "greatest(0.3, least(1, n_months / 12))"
_DISC = ", ".join(f"'{c}'" for c in DISCRETIONARY)
B1 = f"b1 AS (SELECT user_id, 'overspend' AS kind, category, forecast - mean AS impact, {_HC} * greatest(0.3, least(1, (forecast - mean) / (std + 1e-9) / 3)) AS confidence FROM inp WHERE std > 0 AND forecast - mean > 0.75 * std AND forecast - mean > 0.02 * income)"
B2 = f"b2 AS (SELECT user_id, 'peer' AS kind, category, (forecast / total - peer_share) * total AS impact, {_HC} * 0.7 AS confidence FROM inp JOIN norms USING (cohort, category) WHERE category IN ({_DISC}) AND total > 0 AND peer_share > 0 AND forecast / total > 1.3 * peer_share AND forecast > 0.03 * income)"
B3 = f"b3 AS (SELECT user_id, 'subscription_creep' AS kind, category, forecast - past_mean AS impact, {_HC} * 0.8 AS confidence FROM inp WHERE category = 'subscriptions' AND past_mean > 0 AND forecast > 1.25 * past_mean)"
B4 = f"""fx AS (SELECT *, 0.25 * income - (income - total) AS gap, least(std + 0.1 * mean, 0.4 * forecast) AS flex, list_position([{_DISC}], category) AS place FROM inp WHERE category IN ({_DISC}) AND income > 0 AND 0.25 * income - (income - total) > 0),
ct AS (SELECT *, least(flex, greatest(gap - coalesce(sum(flex) OVER (PARTITION BY user_id ORDER BY flex DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS cut FROM fx),
b4 AS (SELECT * FROM ct WHERE cut > 0.005 * income), pl AS (SELECT user_id, max(gap) AS gap, sum(cut) AS closed, max(gap) - sum(cut) <= 1e-6 AS feasible, max(n_months) AS n_months FROM b4 GROUP BY user_id)"""
ALL = f"""{INPUTS}, {B1}, {B2}, {B3}, {B4},
found AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT user_id, 'reallocation', 'misc', closed, {_HC} * 0.9 FROM pl WHERE closed > 0),
b5 AS (SELECT user_id, 'positive' AS kind, 'income' AS category, CAST(0 AS DOUBLE) AS impact, {_HC} AS confidence FROM (SELECT user_id, sum(forecast) AS total, max(income) AS income, max(n_months) AS n_months FROM inp GROUP BY user_id) WHERE user_id NOT IN (SELECT user_id FROM found) AND income > 0 AND (income - total) / income > 0.2),
every AS (SELECT *, impact * (0.5 + 0.5 * confidence) AS priority FROM (SELECT * FROM found UNION ALL SELECT * FROM b5)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, kind, category) AS rank FROM every)"""
_REC = "user_id, kind, category, round(impact, 2) AS impact, round(confidence, 4) AS confidence"


def inputs(spark, sf_dir):
    return P.recommendation_inputs(panel(spark, sf_dir, back=True)).where("forecast IS NOT NULL").withColumn("cohort", hash_bucket(F.col("user_id"), 3, 6))


def norms(spark, sf_dir):
    d = P.recommendation_inputs(panel(spark, sf_dir, back=True)).withColumn("cohort", hash_bucket(F.col("user_id"), 3, 6))
    return quantiles(d, "share", {"peer_share": 0.5}, "cohort", "category")


def written(spark, sf_dir):
    """inputs and norms from one pass over the transactions, which is written in between."""
    path = work_dir(spark, "recommendation-inputs")
    P.recommendation_inputs(panel(spark, sf_dir, back=True)).withColumn("cohort", hash_bucket(F.col("user_id"), 3, 6)).write.parquet(path)
    d = spark.read.parquet(path)
    return d.where("forecast IS NOT NULL"), quantiles(d, "share", {"peer_share": 0.5}, "cohort", "category")


def _rec(d):
    return d.select("user_id", "kind", "category", rnd(F.col("impact"), 2).alias("impact"), rnd(F.col("confidence")).alias("confidence"))


register("B1", _sql(f"{INPUTS}, {B1}", f"SELECT {_REC} FROM b1"))(lambda s, d: _rec(B.overspend(inputs(s, d))))
register("B2", _sql(f"{INPUTS}, {B2}", f"SELECT {_REC} FROM b2"))(lambda s, d: _rec(B.peer(*written(s, d))))
register("B3", _sql(f"{INPUTS}, {B3}", f"SELECT {_REC} FROM b3"))(lambda s, d: _rec(B.subscription_creep(inputs(s, d))))


@register("B4", _sql(f"{INPUTS}, {B4}", "SELECT user_id, category, round(cut, 2) AS cut, round(gap, 2) AS gap FROM b4"))
def b4(spark, sf_dir):
    return rounded(B.reallocation(inputs(spark, sf_dir)).select("user_id", "category", "cut", "gap"), 2)


@register("B5", _sql(ALL, f"SELECT {_REC} FROM b5"))
def b5(spark, sf_dir):
    return _rec(B.recommendations(*written(spark, sf_dir)).where("kind = 'positive'"))


@register("W14", _sql(ALL, "SELECT user_id, kind, category, rank FROM ranked"))
def w14(spark, sf_dir):
    return B.recommendations(*written(spark, sf_dir), top=1000).select("user_id", "kind", "category", F.col("rank").cast("long").alias("rank"))


@register("T2", _sql(ALL, "SELECT user_id, kind, category FROM ranked WHERE rank <= 5"))
def t2(spark, sf_dir):
    return B.recommendations(*written(spark, sf_dir)).select("user_id", "kind", "category")


@register("B6", _sql(ALL, """, rec AS (SELECT user_id, string_agg(kind || ':' || category, ',' ORDER BY rank) AS recommendations FROM ranked WHERE rank <= 5 GROUP BY user_id),
  us AS (SELECT user_id, max(income) AS income, max(total) AS total FROM inp GROUP BY user_id), cl AS (SELECT user_id, string_agg(category, ',' ORDER BY flex DESC, place) AS cuts FROM b4 GROUP BY user_id)
  SELECT user_id, round(income, 2) AS avg_income, coalesce(recommendations, '') AS recommendations, round(0.25 * income, 2) AS target_savings, round(coalesce(closed, 0), 2) AS shortfall_closed, coalesce(feasible, 0.25 * income - (income - us.total) <= 1e-6) AS feasible, coalesce(cuts, '') AS cuts
  FROM us LEFT JOIN rec USING (user_id) LEFT JOIN pl USING (user_id) LEFT JOIN cl USING (user_id)""")) 
def b6(spark, sf_dir):
    d = B.bundle(*written(spark, sf_dir))
    names = F.array_join(F.transform("recommendations", lambda r: F.concat_ws(":", r["kind"], r["category"])), ",")
    money = {"avg_income": "summary.avg_income", "target_savings": "plan.target_savings", "shortfall_closed": "plan.shortfall_closed"}
    return d.select("user_id", *[rnd(F.col(v), 2).alias(k) for k, v in money.items()], names.alias("recommendations"), F.col("plan.feasible").alias("feasible"), F.array_join(F.map_keys("plan.cuts"), ",").alias("cuts"))


@register("J10", _sql(INPUTS, f"SELECT user_id, category, cohort, {_r(['mean', 'std', 'income', 'forecast', 'peer_share'], 3)} FROM inp JOIN norms USING (cohort, category)"))
def j10(spark, sf_dir):
    d, n = written(spark, sf_dir)
    d = d.join(n, ["cohort", "category"])
    return rounded(d.select("user_id", "category", "cohort", "mean", "std", "income", "forecast", "peer_share"), 3)


_label = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_money = lambda x: f"'₹' || format('{{:,}}', CAST(floor(round({x}, 2) + 0.5) AS BIGINT))"
_pct = lambda x: f"CAST(floor(round({x} * 100, 2) + 0.5) AS BIGINT) || '%'"


@register("F15", _sql(ALL, f""", ps AS (SELECT pl.user_id, pl.gap, pl.closed, feasible, max(income) AS income, string_agg({_label('category')} || ' −' || {_money('cut')}, ', ' ORDER BY flex DESC, place) AS parts FROM pl JOIN b4 ON b4.user_id = pl.user_id GROUP BY ALL),
  us AS (SELECT user_id, max(income) AS income, max(total) AS total FROM inp GROUP BY user_id)
  SELECT r.user_id, r.kind, r.category, CASE r.kind WHEN 'overspend' THEN {_label('r.category')} || ' trending above your usual' WHEN 'peer' THEN {_label('r.category')} || ' is high for users like you' WHEN 'subscription_creep' THEN 'Subscription spend is creeping up' WHEN 'reallocation' THEN 'Plan to hit a 25% savings goal' ELSE 'You''re on track' END AS title,
  CASE r.kind WHEN 'overspend' THEN 'Projected ' || {_money('i.forecast')} || ' next month vs your typical ' || {_money('i.mean')} || ' (' || format('{{:,.1f}}', round((i.forecast - i.mean) / (i.std + 1e-9), 1)) || 'σ high). Trimming here saves ~' || {_money('i.forecast - i.mean')} || '.'
  WHEN 'peer' THEN 'You put ' || {_pct('(i.forecast / i.total)')} || ' of spend here vs ' || {_pct('n.peer_share')} || ' for your cohort. Aligning frees ~' || {_money('(i.forecast / i.total - n.peer_share) * i.total')} || '/mo.'
  WHEN 'subscription_creep' THEN 'Recurring charges up ~' || {_pct('(i.forecast / i.past_mean - 1)')} || ' vs 3 months ago. Audit unused subscriptions to reclaim ~' || {_money('i.forecast - i.past_mean')} || '.'
  WHEN 'reallocation' THEN CASE WHEN ps.feasible THEN 'Reallocate ' || {_money('ps.closed')} || '/mo (' || parts || ') to reach ' || {_money('0.25 * ps.income')} || ' saved.' ELSE 'Cutting ' || parts || ' recovers ' || {_money('ps.closed')} || '/mo, but the goal needs ' || {_money('ps.gap')} || ' — consider a gentler target or boosting income.' END
  ELSE 'Projected to save ' || {_pct('((us.income - us.total) / us.income)')} || ' of income next month with no category running hot. Consider auto-investing the surplus.' END AS detail
  FROM ranked r LEFT JOIN inp i ON i.user_id = r.user_id AND i.category = r.category LEFT JOIN norms n ON n.cohort = i.cohort AND n.category = i.category LEFT JOIN ps ON ps.user_id = r.user_id LEFT JOIN us ON us.user_id = r.user_id WHERE rank <= 5"""))
def f15(spark, sf_dir):
    return B.recommendations(*written(spark, sf_dir)).select("user_id", "kind", "category", "title", "detail")


@register("P9", _sql(INPUTS, """, o AS (SELECT user_id, category, round(forecast, 2) AS current_spend, round(mean, 2) AS baseline_spend, round(greatest(0, forecast - mean), 2) AS overspend, round(forecast - greatest(0, forecast - mean), 2) AS target, round(greatest(0, forecast - mean) / 30, 2) AS per_day FROM inp)
  SELECT *, 'If spend in ''' || category || ''' is reduced by INR ' || format('{:.2f}', overspend) || ' (approx. INR ' || format('{:.2f}', per_day) || '/day), overspend probability drops to 0% and savings target is preserved.' AS statement FROM o"""))
def p9(spark, sf_dir):
    """What would undo an overspend: the target, its cost a day, and the sentence that says so."""
    return B.counterfactual(inputs(spark, sf_dir), "forecast", "mean").select("user_id", "category", "current_spend", "baseline_spend", "overspend", "target", "per_day", "statement")


@register("A10", _sql(INPUTS, "SELECT cohort, category, round(peer_share, 4) AS peer_share FROM norms"))
def a10(spark, sf_dir):
    return rounded(norms(spark, sf_dir))


@register("B7", _sql(PANEL, """, h AS (SELECT user_id, greatest(0, 100 - stddev_pop(income - total_expense) / (avg(income) + 1e-9) * 100) AS stability, avg(CAST(income - total_expense > 0 AS INT)) * 100 AS consistency,
  greatest(0, 100 - avg((housing + groceries + utilities + healthcare + transportation) / (income + 1e-9)) * 100) AS essential FROM panel GROUP BY user_id)
  SELECT user_id, round(stability, 3) AS stability, round(consistency, 3) AS consistency, round(essential, 3) AS essential, round(greatest(0, least(100, 0.3 * stability + 0.4 * consistency + 0.3 * essential)), 3) AS overall FROM h"""))
def b7(spark, sf_dir):
    return rounded(B.health_v1(panel(spark, sf_dir)), 3)


_lim = lambda x, hi: f"greatest(0, least({hi}, {x}))"


@register("B8", _sql(f"{PROFILE}, {STATS}", f""", c AS (SELECT user_id, {_lim('savings_rate / 0.2 * 25', 25)} AS savings, {_lim('20 * (1 - least(1, volatility))', 20)} AS stability, {_lim('20 * (1 - least(1, (share_groceries + share_housing + share_utilities) / 0.6))', 20)} AS essential,
  {_lim(f"20 * (1 - least(1, ({' + '.join(f'share_{c}' for c in DISCRETIONARY)}) / 0.4))", 20)} AS control, {_lim('least(1.5, coalesce(cashflow_ratio, 1.2)) * 10', 15)} AS regularity FROM profile LEFT JOIN ratios USING (user_id)),
  t AS (SELECT *, round(savings + stability + essential + control + regularity, 1) AS total FROM c) SELECT user_id, {_r(['savings', 'stability', 'essential', 'control', 'regularity'], 3)}, total, CASE WHEN total >= 80 THEN 'Excellent' WHEN total >= 65 THEN 'Good' WHEN total >= 50 THEN 'Fair' ELSE 'Needs Attention' END AS tier FROM t"""))
def b8(spark, sf_dir):
    d = B.health_v2(P.user_profiles(panel(spark, sf_dir)), R.user_stats(canonical_txns(spark, sf_dir)))
    return d.select("user_id", *[rnd(F.col(c), 3).alias(c) for c in ("savings", "stability", "essential", "control", "regularity")], "total", "tier")


@register("B9", _sql(_PT.replace("roll_mean_3 AS b FROM", "roll_mean_3 AS b, roll_std_3 AS sd FROM"), """, f AS (SELECT category, y > b + 0.75 * sd AND sd > 0 AS truth, a > b + 0.75 * sd AND sd > 0 AS said FROM pt), k AS (SELECT category, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said) AS said, count(*) FILTER (truth) AS truth FROM f GROUP BY category)
  SELECT category, tp, said, truth, round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 4) AS precision, round(CASE WHEN truth > 0 THEN tp / truth ELSE 0 END, 4) AS recall FROM k"""))
def b9(spark, sf_dir):
    f = P.forecast_frame(panel(spark, sf_dir))
    flag = lambda c: (F.col(c) > F.col("roll_mean_3") + 0.75 * F.col("roll_std_3")) & (F.col("roll_std_3") > 0)
    n = lambda c: F.count(F.when(c, 1))
    d = f.groupBy("category").agg(n(flag("target") & flag("lag_1")).alias("tp"), n(flag("lag_1")).alias("said"), n(flag("target")).alias("truth"))
    ratio = lambda k: rnd(F.when(F.col(k) > 0, F.col("tp") / F.col(k)).otherwise(0.0))
    return d.withColumns({"precision": ratio("said"), "recall": ratio("truth")})


_both = lambda src: f"SELECT period, 'q' AS side, * EXCLUDE (period) FROM {src} WHERE period <> (SELECT min(period) FROM {src}) UNION ALL SELECT l.period, 'p', s.* EXCLUDE (period) FROM {src} s, (SELECT DISTINCT period FROM {src} WHERE period <> (SELECT min(period) FROM {src})) l WHERE s.period = (SELECT min(period) FROM {src})"
DRIFT = f"""vals AS (SELECT period, CAST(amount AS DOUBLE) AS value, count(*) AS n FROM src GROUP BY ALL), labs AS (SELECT period, category, count(*) AS n FROM src GROUP BY ALL),
vb AS ({_both('vals')}), lb AS ({_both('labs')}), ends AS (SELECT period, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM vb GROUP BY period),
bn AS (SELECT period, CAST(1 + len(list_filter(range(1, 10), lambda j: value >= lo + (hi - lo) * j / 10)) AS INT) AS bin, coalesce(sum(n) FILTER (side = 'p'), 0) AS p, coalesce(sum(n) FILTER (side = 'q'), 0) AS q FROM vb JOIN ends USING (period) GROUP BY ALL),
bg AS (SELECT e.period, g.bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM ends e CROSS JOIN (SELECT unnest(range(1, 11)) AS bin) g LEFT JOIN bn ON e.period = bn.period AND g.bin = bn.bin),
bs AS (SELECT period, CASE WHEN p = 0 THEN 1e-6 ELSE p / sum(p) OVER w END AS p, CASE WHEN q = 0 THEN 1e-6 ELSE q / sum(q) OVER w END AS q FROM bg WINDOW w AS (PARTITION BY period)),
psi AS (SELECT period, sum((q - p) * ln(q / p)) AS psi FROM bs GROUP BY period),
lg AS (SELECT e.period, c.category, coalesce(sum(n) FILTER (side = 'p'), 0) AS p, coalesce(sum(n) FILTER (side = 'q'), 0) AS q FROM ends e CROSS JOIN (SELECT DISTINCT category FROM labs) c LEFT JOIN lb ON e.period = lb.period AND c.category = lb.category GROUP BY ALL),
ls AS (SELECT period, CASE WHEN p = 0 THEN 1e-6 ELSE p / sum(p) OVER w END AS p, CASE WHEN q = 0 THEN 1e-6 ELSE q / sum(q) OVER w END AS q FROM lg WINDOW w AS (PARTITION BY period)),
ln_ AS (SELECT period, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM ls WINDOW w AS (PARTITION BY period)), kl AS (SELECT period, sum(p * ln(p / q)) AS kl FROM ln_ GROUP BY period),
vv AS (SELECT period, value, coalesce(sum(n) FILTER (side = 'p'), 0) AS p, coalesce(sum(n) FILTER (side = 'q'), 0) AS q FROM vb GROUP BY period, value),
vc AS (SELECT period, abs(sum(p) OVER u / sum(p) OVER w - sum(q) OVER u / sum(q) OVER w) * (lead(value) OVER o - value) AS area FROM vv WINDOW w AS (PARTITION BY period), o AS (PARTITION BY period ORDER BY value), u AS (PARTITION BY period ORDER BY value ROWS UNBOUNDED PRECEDING)),
ws AS (SELECT period, coalesce(sum(area), 0) AS wasserstein FROM vc GROUP BY period),
dt AS (SELECT period, round(psi, 4) AS psi, wasserstein, kl, CASE WHEN round(psi, 4) < 0.1 THEN 'STABLE' WHEN round(psi, 4) < 0.25 THEN 'MODERATE' ELSE 'DRIFT_ALERT' END AS status FROM psi JOIN ws USING (period) JOIN kl USING (period))"""
MONTHS = f"{TX}, src AS (SELECT *, strftime(timestamp, '%Y-%m') AS period FROM txns), {DRIFT}"
HALVES = f"{EV}, src AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, transaction_id) - 1 < CAST(floor((SELECT count(*) FROM evs) / 2) AS BIGINT) THEN 'first_half' ELSE 'second_half' END AS period FROM evs), {DRIFT}"


def drift(spark, sf_dir, *measures):
    d = D.drift_table(canonical_txns(spark, sf_dir), F.date_format("timestamp", "yyyy-MM"), measures)
    return d.withColumn("psi", rnd(F.col("psi"))) if "psi" in measures else d


def _drift_column(name, column, digits, *more):
    cols = ", ".join(["period", f"round({column}, {digits}) AS {column}" if column != "psi" else "psi", *more])
    register(name, _sql(MONTHS, f"SELECT {cols} FROM dt"))(lambda s, d: drift(s, d, column).select("period", (rnd(F.col(column), digits) if column != "psi" else F.col("psi")).alias(column), *more))


_drift_column("D1", "psi", 4)
_drift_column("D2", "wasserstein", 3)
_drift_column("D3", "kl", 4)
_drift_column("D4", "psi", 4, "status")


@register("D5", _sql(HALVES, "SELECT period, psi, round(wasserstein, 3) AS wasserstein, round(kl, 4) AS kl, status FROM dt"))
def d5(spark, sf_dir):
    """One month of data: its first half of rows against its second."""
    from ..operators.splits import temporal_split

    e = temporal_split(canonical_events(spark, sf_dir), (0.5,))
    d = D.drift_table(e, F.when(F.col("split") == "train", "first_half").otherwise("second_half"))
    return d.select("period", rnd(F.col("psi")).alias("psi"), rnd(F.col("wasserstein"), 3).alias("wasserstein"), rnd(F.col("kl")).alias("kl"), "status")


@register("D6", _sql(MONTHS, "SELECT max(psi) AS max_psi, count(*) FILTER (status = 'DRIFT_ALERT') AS alerts, count(*) AS periods FROM dt"))
def d6(spark, sf_dir):
    return drift(spark, sf_dir, "psi").agg(F.max("psi").alias("max_psi"), F.count(F.when(F.col("status") == "DRIFT_ALERT", 1)).alias("alerts"), F.count("*").alias("periods"))


#: Event types stand for categories, so that the tracker has several and an unknown one.
_EVCAT = {"click": "shopping", "view": "entertainment", "purchase": "groceries"}
_evcat_sql = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVCAT.items()) + " ELSE 'misc' END"
TRACK = f"""{EV}, e AS (SELECT * REPLACE ({_evcat_sql} AS category), CAST(date_trunc('month', timestamp) AS DATE) AS month FROM evs), eb AS (SELECT user_id, category, avg(CAST(amount AS DOUBLE)) * 5 AS mean, stddev_pop(CAST(amount AS DOUBLE)) AS std FROM e GROUP BY 1, 2),
tr AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY user_id, month, category ORDER BY timestamp, transaction_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent, max(day(timestamp)) OVER (PARTITION BY user_id, month ORDER BY timestamp, transaction_id ROWS UNBOUNDED PRECEDING) AS max_day FROM e),
tp AS (SELECT tr.*, spent / greatest(1e-3, least(1, max_day / 30)) AS projected, mean, std FROM tr LEFT JOIN eb ON tr.user_id = eb.user_id AND tr.category = eb.category)"""


def tracked_events(spark, sf_dir):
    e = canonical_events(spark, sf_dir)
    kind = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in _EVCAT.items()], F.col("category"))
    return e.withColumn("category", kind)


def event_baselines(events):
    known = F.when(F.col("category").isin(*CATS), F.col("category")).otherwise("misc")
    a = F.col("amount").cast("double")
    return events.groupBy("user_id", known.alias("category")).agg((F.avg(a) * 5).alias("mean"), F.stddev_pop(a).alias("std"))


@register("R2", _sql(TRACK, "SELECT transaction_id, category, round(projected, 3) AS projected, coalesce(std > 0 AND projected > mean + 0.75 * std, false) AS alert FROM tp"))
def r2(spark, sf_dir):
    e = tracked_events(spark, sf_dir)
    return rounded(B.month_tracker(e, event_baselines(e)).select("transaction_id", "category", "projected", "alert"), 3)


#: Days of the month that arrive together.
WEEKS = ((1, 7), (8, 14), (15, 21), (22, 31))


@register("R3", _sql(TRACK, "SELECT user_id, category, round(CAST(sum(amount) AS DOUBLE) / greatest(1e-3, least(1, (SELECT max(day(timestamp)) FROM e x WHERE x.user_id = e.user_id) / 30)), 3) AS projected FROM e GROUP BY user_id, category"))
def r3(spark, sf_dir):
    """The totals as a stream over the events' files, a micro-batch a week, in update mode; the last of each is read back."""
    path = work_dir(spark, "totals")
    e = tracked_events(spark, sf_dir).select("user_id", "transaction_id", "timestamp", "category", "amount")
    # an update sink: each micro-batch is added under its number, so that a repeated one replaces itself
    put = lambda d, k: d.write.mode("overwrite").parquet(f"{path}/out/batch={k}")
    for low, high in WEEKS:  # as many files a week as Spark makes
        e.where(F.dayofmonth("timestamp").between(low, high)).repartition("user_id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        q = category_totals(stream).writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    d = latest(spark.read.parquet(f"{path}/out"))
    return rounded(d.select("user_id", "category", "projected"), 3)


def weeks(events, path):
    """Writes events as files in the order of time, a user's events of a week in one file."""
    for low, high in WEEKS:
        events.where(F.dayofmonth("timestamp").between(low, high)).repartition(2, "user_id").write.mode("append").parquet(path)
