"""Distribution drift between periods: PSI, Wasserstein-1, Kullback-Leibler, and their status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import stored
from .quantiles import cumulated, lookup

EPS = 1e-6


def status(psi: Column) -> Column:
    return F.when(psi < 0.1, "STABLE").when(psi < 0.25, "MODERATE").otherwise("DRIFT_ALERT")


def _split(df: DataFrame, first: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("period") == first).drop("period"), df.where(F.col("period") != first)


def _share(count: Column, total: Column) -> Column:
    """A share, EPS for none."""
    return F.coalesce(F.nullif(F.coalesce(count, F.lit(0)) / total, F.lit(0.0)), F.lit(EPS))


def psi(values: DataFrame, first: str, bins: int = 10) -> DataFrame:
    """psi by period of (period, value, n): equal-width bins over both samples, [edge, next edge), the last one closed.

    The reference is counted once, as cumulative counts by value; the edges of all periods look
    their counts up there, so that it isn't copied for each period.
    """
    ref, cur = _split(values, first)
    index = stored(cumulated(ref, "value", "n"), "drift-reference")
    r = index.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max("total").alias("_ref"))
    ends = cur.groupBy("period").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("_cur")).join(F.broadcast(r), F.lit(True))
    ends = ends.select("period", "_cur", "_ref", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = stored(ends.withColumns({"lo": F.col("lo") - half, "hi": F.col("hi") + half}), "drift-ends")
    edges = ends.select("period", "_cur", "_ref", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / bins)).alias("bin", "edge"))
    found = lookup(edges.select("edge"), index.select(F.col("value").alias("edge"), F.col("value").alias("at"), "upto", "below"), "edge", "at", "upto", "below")
    under = F.when(F.col("at") == F.col("edge"), F.col("below")).otherwise(F.coalesce("upto", F.lit(0)))
    p = edges.join(found, "edge", "left").select("period", "_ref", "bin", under.alias("under"))
    # the last bin ends where all of the reference lies below
    p = p.unionByName(ends.select("period", "_ref", F.lit(bins - 1).alias("bin"), F.col("_ref").alias("under")))
    p = p.select("period", "_ref", "bin", (F.col("under") - F.coalesce(F.lag("under").over(W.partitionBy("period").orderBy("bin")), F.lit(0))).alias("p"))
    inside = F.expr(f"size(filter(sequence(1, {bins - 1}), j -> value >= lo + (hi - lo) * j / {bins}))")
    q = cur.join(ends.select("period", "lo", "hi", "_cur"), "period").groupBy("period", inside.alias("bin"), "_cur").agg(F.sum("n").alias("q"))
    d = p.join(q.drop("_cur"), ["period", "bin"], "left").join(ends.select("period", "_cur"), "period")
    d = d.select("period", _share(F.col("p"), F.col("_ref")).alias("p"), _share(F.col("q"), F.col("_cur")).alias("q"))
    return d.groupBy("period").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def kl(categories: DataFrame, first: str) -> DataFrame:
    """Kullback-Leibler divergence of the reference from each period, of (period, category, n), on all categories."""
    ref, cur = _split(categories, first)
    every = categories.select("category").distinct().join(ref.groupBy("category").agg(F.sum("n").alias("p")), "category", "left")
    periods = cur.groupBy("period").agg(F.sum("n").alias("_q"))
    grid = periods.join(every.withColumn("_p", F.sum("p").over(W.partitionBy())), F.lit(True))  # the result's own size: periods x categories
    d = grid.join(cur.groupBy("period", "category").agg(F.sum("n").alias("q")), ["period", "category"], "left")
    d = d.select("period", _share(F.col("p"), F.col("_p")).alias("p"), _share(F.col("q"), F.col("_q")).alias("q"))
    whole = W.partitionBy("period")
    p, q = F.col("p") / F.sum("p").over(whole), F.col("q") / F.sum("q").over(whole)
    d = d.select("period", p.alias("p"), q.alias("q"))
    return d.groupBy("period").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def wasserstein(values: DataFrame, first: str) -> DataFrame:
    """Distance between the distributions of (period, value, n) and the reference: the area between the cumulative shares.

    Between two values that follow each other in a period its share c is constant. The reference's
    share F rises from below c to above it at one value t, so the area is that of c - F up to t and
    of F - c from there; both follow from the integral G of F, which is looked up at the period's
    values and at t. So each row of a period is looked up twice, and the reference is never copied.
    """
    ref, cur = _split(values, first)
    index = stored(cumulated(ref, "value", "n").withColumn("share", F.col("upto") / F.col("total")), "drift-reference")
    ends = index.agg(F.min("value").alias("least"), F.max(F.struct("value", "area")).alias("top")).select("least", F.col("top.value").alias("most"), F.col("top.area").alias("whole"))
    d = stored(cumulated(cur, "value", "n", "period"), "drift-periods").select("period", "value", "next", "below", (F.col("upto") / F.col("total")).alias("c"))
    by_value = stored(lookup(d.select("value"), index.select("value", F.col("value").alias("at"), "share", "area"), "value", "at", "share", "area"), "drift-values")
    integral = by_value.select("value", F.coalesce(F.col("area") + F.col("share") * (F.col("value") - F.col("at")), F.lit(0.0)).alias("g"))
    by_share = lookup(d.select(F.col("c").alias("share")), index.select("share", F.col("share").alias("own"), "value", "next", "area"), "share", "own", "value", "next", "area")
    cross = by_share.select(F.col("share").alias("c"), F.lit(True).alias("seen"), F.col("next").alias("t"), F.col("value").alias("v"), (F.col("area") + F.col("own") * (F.col("next") - F.col("value"))).alias("gt"))
    d = d.join(integral, "value").join(integral.select(F.col("value").alias("next"), F.col("g").alias("g_next")), "next", "left").join(cross, "c", "left").join(F.broadcast(ends), F.lit(True))
    # no share at or below c: F exceeds it from the least value on; no next value: it never does
    t = F.when(F.col("v").isNull(), F.col("least")).otherwise(F.coalesce("t", F.lit(float("inf"))))
    g_t = F.when(F.col("v").isNull(), F.lit(0.0)).otherwise(F.col("gt"))
    a, b, ga, gb = F.col("value"), F.col("next"), F.col("g"), F.col("g_next")
    cut = F.greatest(a, F.least(b, t))
    g_cut = F.when(t <= a, ga).when(t >= b, gb).otherwise(g_t)
    between = (F.col("c") * (cut - a) - (g_cut - ga)) + ((gb - g_cut) - F.col("c") * (b - cut))
    head = F.when(F.col("below") == 0, ga).otherwise(0.0)
    tail = F.when(b.isNull() & (F.col("most") > a), (F.col("most") - a) - (F.col("whole") - ga)).otherwise(0.0)
    return d.groupBy("period").agg(F.sum(head + tail + F.coalesce(between, F.lit(0.0))).alias("wasserstein"))


def drift_table(txns: DataFrame, periods: Column, measures=("psi", "wasserstein", "kl")) -> DataFrame:
    """Each period of amounts and categories against the first one, by the measures asked for; status goes with psi."""
    d = txns.withColumn("period", periods)
    values = stored(d.groupBy("period", "category", F.col("amount").cast("double").alias("value")).agg(F.count("*").alias("n")), "drift-counts")
    first = values.agg(F.min("period")).first()[0]
    made = {"psi": lambda: psi(values.drop("category"), first), "wasserstein": lambda: wasserstein(values.drop("category"), first), "kl": lambda: kl(values.drop("value"), first)}
    t = reduce(lambda a, b: a.join(b, "period"), [made[m]() for m in measures])
    return t.withColumn("status", status(F.round("psi", 4))) if "psi" in measures else t
