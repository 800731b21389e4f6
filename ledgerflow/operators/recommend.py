"""Recommendations, reallocation plans, health scores and online month tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..functions.taxonomy import DISCRETIONARY, EXPENSE_CATEGORIES, FLEX_STD, LABELS, OVERSPEND_Z, TOP_K
from .canonical import mapped


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def history_confidence(n: Column) -> Column:
    return clip(n / 12.0, 0.3, 1.0)


def money(c: Column) -> Column:
    """Whole units, half up from whole cents, so that equal amounts read alike."""
    return F.concat(F.lit("₹"), F.format_number(F.floor(rnd(c, 2) + 0.5), 0))


def percent(c: Column) -> Column:
    return F.concat(F.floor(rnd(c * 100, 2) + 0.5).cast("string"), F.lit("%"))


def label(category: Column) -> Column:
    return mapped(category, LABELS)


def with_shares(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("total", F.sum("forecast").over(W.partitionBy("user_id")))


def _found(hit: Column, kind: str, category: Column, impact: Column, confidence: Column, title: Column, detail: list) -> Column:
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in detail])
    return F.when(hit, F.struct(F.lit(kind).alias("kind"), category.alias("category"), impact.alias("impact"), (history_confidence(F.col("n_months")) * confidence).alias("confidence"), title.alias("title"), text.alias("detail")))


# Each kind as a struct, null where it doesn't apply. The texts are fixed formats.
def _overspend() -> Column:
    gap = F.col("forecast") - F.col("mean")
    hit = (F.col("std") > 0) & (gap > OVERSPEND_Z * F.col("std")) & (gap > 0.02 * F.col("income"))
    z = gap / (F.col("std") + 1e-9)
    detail = ["Projected ", money(F.col("forecast")), " next month vs your typical ", money(F.col("mean")), " (", F.format_number(rnd(z, 1), 1), "σ high). Trimming here saves ~", money(gap), "."]
    return _found(hit, "overspend", F.col("category"), gap, clip(z / 3, 0.3, 1.0), F.concat(label(F.col("category")), F.lit(" trending above your usual")), detail)


def _peer() -> Column:
    share = F.col("forecast") / F.when(F.col("total") > 0, F.col("total"))
    hit = F.col("category").isin(*DISCRETIONARY) & (F.col("total") > 0) & (F.col("peer_share") > 0) & (share > 1.3 * F.col("peer_share")) & (F.col("forecast") > 0.03 * F.col("income"))
    impact = (share - F.col("peer_share")) * F.col("total")
    detail = ["You put ", percent(share), " of spend here vs ", percent(F.col("peer_share")), " for your cohort. Aligning frees ~", money(impact), "/mo."]
    return _found(hit, "peer", F.col("category"), impact, F.lit(0.7), F.concat(label(F.col("category")), F.lit(" is high for users like you")), detail)


def _creep() -> Column:
    hit = (F.col("category") == "subscriptions") & (F.col("past_mean") > 0) & (F.col("forecast") > 1.25 * F.col("past_mean"))
    more = F.col("forecast") / F.when(F.col("past_mean") > 0, F.col("past_mean")) - 1
    impact = F.col("forecast") - F.col("past_mean")
    detail = ["Recurring charges up ~", percent(more), " vs 3 months ago. Audit unused subscriptions to reclaim ~", money(impact), "."]
    return _found(hit, "subscription_creep", F.col("category"), impact, F.lit(0.8), F.lit("Subscription spend is creeping up"), detail)


def _reallocation(goal: float) -> Column:
    parts = F.array_join(F.transform("cuts", lambda x: F.concat(label(x["category"]), F.lit(" −"), money(x["cut"]))), ", ")
    reached = F.concat(F.lit("Reallocate "), money(F.col("closed")), F.lit("/mo ("), parts, F.lit(") to reach "), money(goal * F.col("income")), F.lit(" saved."))
    short = F.concat(F.lit("Cutting "), parts, F.lit(" recovers "), money(F.col("closed")), F.lit("/mo, but the goal needs "), money(F.col("gap")), F.lit(" — consider a gentler target or boosting income."))
    title = F.concat(F.lit("Plan to hit a "), percent(F.lit(goal)), F.lit(" savings goal"))
    return _found((F.col("place_in_user") == 1) & (F.col("closed") > 0), "reallocation", F.lit("misc"), F.col("closed"), F.lit(0.9), title, [F.when(F.col("feasible"), reached).otherwise(short)])


def _positive() -> Column:
    rate = (F.col("income") - F.col("total")) / F.when(F.col("income") > 0, F.col("income"))
    detail = ["Projected to save ", percent(rate), " of income next month with no category running hot. Consider auto-investing the surplus."]
    return _found((F.col("place_in_user") == 1) & ~F.col("any_other") & (rate > 0.2), "positive", F.lit("income"), F.lit(0.0), F.lit(1.0), F.lit("You're on track"), detail)


def _one_kind(d: DataFrame, kind: Column) -> DataFrame:
    return d.withColumn("_k", kind).where("_k IS NOT NULL").select("user_id", "_k.*")


def overspend(inputs: DataFrame) -> DataFrame:
    """Forecasts well above the user's own mean, of inputs (user, category, forecast, mean, std, income, n_months)."""
    return _one_kind(inputs, _overspend())


def peer(inputs: DataFrame, norms: DataFrame) -> DataFrame:
    """Discretionary shares beyond 1.3 times the cohort's median share; norms (cohort, category, peer_share)."""
    return _one_kind(with_shares(inputs).join(norms, ["cohort", "category"]), _peer())


def subscription_creep(inputs: DataFrame) -> DataFrame:
    return _one_kind(inputs, _creep())


def with_cuts(inputs: DataFrame, goal: float = 0.25) -> DataFrame:
    """inputs with total, gap and cut (null: none): by user, towards a savings goal.

    The most flexible category comes first, each up to its flexibility; the greedy loop is a prefix
    sum: a cut is what the gap leaves after all more flexible ones. Ties go by the order of the
    discretionary list; cuts of 0.5% of income or less are left out.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in DISCRETIONARY]), F.col("category"))
    d = with_shares(inputs).withColumn("gap", goal * F.col("income") - (F.col("income") - F.col("total")))
    open_ = F.col("category").isin(*DISCRETIONARY) & (F.col("gap") > 0) & (F.col("income") > 0)
    flex = F.when(open_, F.least(FLEX_STD * F.col("std") + 0.1 * F.col("mean"), 0.4 * F.col("forecast")))
    d = d.withColumns({"flex": flex, "place": order})
    before = W.partitionBy("user_id").orderBy(F.col("flex").desc_nulls_last(), "place").rowsBetween(W.unboundedPreceding, -1)
    cut = F.least("flex", F.greatest(F.col("gap") - F.coalesce(F.sum("flex").over(before), F.lit(0.0)), F.lit(0.0)))
    return d.withColumn("cut", F.when(F.col("flex").isNotNull() & (cut > 0.005 * F.col("income")), cut))


def reallocation(inputs: DataFrame, goal: float = 0.25) -> DataFrame:
    """Cuts by category towards a savings goal."""
    return with_cuts(inputs, goal).where("cut IS NOT NULL").select("user_id", "category", "gap", "income", "n_months", "cut")


def assessed(inputs: DataFrame, norms: DataFrame, goal: float = 0.25) -> DataFrame:
    """inputs with the user's plan (cuts, closed, feasible) and `kinds`: every kind that applies to the row.

    All windows are by user, so that rows are dealt out once; norms has a row a cohort and category.
    """
    user = W.partitionBy("user_id")
    d = with_cuts(inputs, goal).join(F.broadcast(norms), ["cohort", "category"], "left")
    cuts = F.transform(F.sort_array(F.collect_list(F.when(F.col("cut").isNotNull(), F.struct((-F.col("flex")).alias("f"), "place", "category", "cut"))).over(user)), lambda x: F.struct(x["category"].alias("category"), rnd(x["cut"], 2).alias("cut")))
    closed = F.coalesce(F.sum("cut").over(user), F.lit(0.0))
    d = d.withColumns({"cuts": cuts, "closed": closed, "feasible": (F.col("gap") <= 0) | (F.col("gap") - closed <= 1e-6), "place_in_user": F.row_number().over(user.orderBy("category"))})
    d = d.withColumn("kinds", F.array(_overspend(), _peer(), _creep(), _reallocation(goal)))
    d = d.withColumn("any_other", F.max(F.exists("kinds", lambda k: k.isNotNull())).over(user))
    return d.withColumn("kinds", F.filter(F.concat("kinds", F.array(_positive())), lambda k: k.isNotNull()))


def _ranked(d: DataFrame, top: int) -> DataFrame:
    d = d.withColumn("priority", F.col("impact") * (0.5 + 0.5 * F.col("confidence")))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("priority").desc(), "kind", "category"))
    return d.withColumn("rank", rank).where(F.col("rank") <= top)


def recommendations(inputs: DataFrame, norms: DataFrame, goal: float = 0.25, top: int = TOP_K) -> DataFrame:
    """All kinds, ranked by impact and confidence, the best `top` of each user; praise where there is none."""
    return _ranked(assessed(inputs, norms, goal).select("user_id", F.explode("kinds").alias("_k")).select("user_id", "_k.*"), top)


def bundle(inputs: DataFrame, norms: DataFrame, goal: float = 0.25, top: int = TOP_K) -> DataFrame:
    """A row a user: summary, forecast map, ranked recommendations and the savings plan, nested; amounts of map entries have two digits."""
    d = assessed(inputs, norms, goal)
    d = d.groupBy("user_id").agg(
        F.max("income").alias("income"), F.max("total").alias("projected"), F.max("n_months").alias("n_months"), F.max("gap").alias("gap"), F.max("closed").alias("closed"), F.first("feasible").alias("feasible"),
        F.first("cuts").alias("cuts"), F.map_from_entries(F.collect_list(F.struct("category", F.round("forecast", 2)))).alias("forecast"), F.flatten(F.collect_list("kinds")).alias("kinds"),
    )
    priority = lambda k: k["impact"] * (0.5 + 0.5 * k["confidence"])
    ranked = F.array_sort(F.transform("kinds", lambda k: F.struct((-priority(k)).alias("p"), k["kind"].alias("kind"), k["category"].alias("category"), k["title"].alias("title"), k["detail"].alias("detail"), k["impact"].alias("impact"), k["confidence"].alias("confidence"), priority(k).alias("priority"))))
    recs = F.transform(F.slice(ranked, 1, top), lambda k: F.struct(*[k[x].alias(x) for x in ("kind", "category", "title", "detail", "impact", "confidence", "priority")]))
    rate = F.when(F.col("income") > 0, 1 - F.col("projected") / F.col("income")).otherwise(0.0)
    summary = F.struct(F.col("income").alias("avg_income"), F.col("projected").alias("projected_expense"), rate.alias("projected_savings_rate"), F.col("n_months").alias("history_months"))
    plan = F.when(F.col("income") > 0, F.struct(
        (goal * F.col("income")).alias("target_savings"), (F.col("income") - F.col("projected")).alias("projected_savings"), "gap",
        F.map_from_entries("cuts").alias("cuts"), F.col("closed").alias("shortfall_closed"), "feasible",
    ))
    return d.select("user_id", summary.alias("summary"), "forecast", recs.alias("recommendations"), plan.alias("plan"))


def health_v1(panel: DataFrame, essentials=("housing", "utilities", "groceries", "healthcare", "transportation")) -> DataFrame:
    net = F.col("income") - F.col("total_expense")
    burden = sum((F.col(c) for c in essentials), F.lit(0.0)) / (F.col("income") + 1e-9)
    d = panel.groupBy("user_id").agg(
        F.greatest(F.lit(0.0), 100 - F.stddev_pop(net) / (F.avg("income") + 1e-9) * 100).alias("stability"), (F.avg((net > 0).cast("int")) * 100).alias("consistency"),
        F.greatest(F.lit(0.0), 100 - F.avg(burden) * 100).alias("essential"),
    )
    return d.withColumn("overall", clip(0.3 * F.col("stability") + 0.4 * F.col("consistency") + 0.3 * F.col("essential"), 0.0, 100.0))


def health_v2(profiles: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Five components of 25, 20, 20, 20 and 15 points, the total to one digit, and a tier."""
    d = profiles.join(stats.select("user_id", "cashflow_ratio"), "user_id", "left") if stats is not None else profiles.withColumn("cashflow_ratio", F.lit(1.2))
    ratio = F.coalesce("cashflow_ratio", F.lit(1.2))
    essential = F.col("share_groceries") + F.col("share_housing") + F.col("share_utilities")
    free = sum((F.col(f"share_{c}") for c in DISCRETIONARY[1:]), F.col(f"share_{DISCRETIONARY[0]}"))
    left = lambda share, most: clip(20 * (1 - F.least(F.lit(1.0), share / most)), 0.0, 20.0)
    d = d.withColumns({
        "savings": clip(F.col("savings_rate") / 0.2 * 25, 0.0, 25.0), "stability": clip(20 * (1 - F.least(F.lit(1.0), F.col("volatility"))), 0.0, 20.0),
        "essential": left(essential, 0.6), "control": left(free, 0.4), "regularity": clip(F.least(F.lit(1.5), ratio) * 10, 0.0, 15.0),
    })
    d = d.withColumn("total", rnd(F.col("savings") + F.col("stability") + F.col("essential") + F.col("control") + F.col("regularity"), 1))
    tier = F.when(F.col("total") >= 80, "Excellent").when(F.col("total") >= 65, "Good").when(F.col("total") >= 50, "Fair").otherwise("Needs Attention")
    return d.select("user_id", "savings", "stability", "essential", "control", "regularity", "total", tier.alias("tier"))


def counterfactual(df: DataFrame, current: str, baseline: str) -> DataFrame:
    """df with current_spend, baseline_spend, overspend, target, per_day (a thirtieth of the cut) and the statement."""
    over = F.greatest(F.lit(0.0), F.col(current) - F.col(baseline))
    d = df.withColumns({"current_spend": rnd(F.col(current), 2), "baseline_spend": rnd(F.col(baseline), 2), "overspend": rnd(over, 2), "target": rnd(F.col(current) - over, 2), "per_day": rnd(over / 30, 2)})
    shown = "If spend in '%s' is reduced by INR %.2f (approx. INR %.2f/day), overspend probability drops to 0%% and savings target is preserved."
    return d.withColumn("statement", F.format_string(shown, "category", "overspend", "per_day"))


def month_tracker(events: DataFrame, base: DataFrame) -> DataFrame:
    """The online tracker as windows: each event's category total, month-end projection and alert."""
    month = F.date_trunc("month", "timestamp").cast("date")
    known = F.when(F.col("category").isin(*EXPENSE_CATEGORIES), F.col("category")).otherwise("misc")
    d = events.withColumns({"month": month, "category": known, "day": F.dayofmonth("timestamp")})
    in_category = W.partitionBy("user_id", "month", "category").orderBy("timestamp", "transaction_id").rowsBetween(W.unboundedPreceding, 0)
    in_month = W.partitionBy("user_id", "month").orderBy("timestamp", "transaction_id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"spent": F.sum("amount").over(in_category).cast("double"), "max_day": F.max("day").over(in_month)})
    d = d.withColumn("projected", F.col("spent") / clip(F.col("max_day") / 30, 1e-3, 1.0)).join(base.select("user_id", "category", "mean", "std"), ["user_id", "category"], "left")
    return d.withColumn("alert", F.coalesce((F.col("std") > 0) & (F.col("projected") > F.col("mean") + OVERSPEND_Z * F.col("std")), F.lit(False)))
