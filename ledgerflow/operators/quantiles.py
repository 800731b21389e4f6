"""Exact quantiles and cumulative lookups of groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import stored

#: A group with at most so many distinct values is ranked in one task; a larger one is narrowed first.
LIMIT = 500_000
#: A round of narrowing splits into so many parts.
PARTS = 64


def _bounds(column: str, parts: int) -> Column:
    return F.array_distinct(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float | Column], *by: str) -> DataFrame:
    """A row a group of `by` with the named quantiles of value, exact, with linear interpolation; null values don't count.

    Selection by rank: equal values are counted first. A group with more than LIMIT distinct values
    is split at approximate quantiles of these into PARTS intervals, sums of counts tell which
    intervals hold the ranks, and only these go on, until each is small enough to be ranked in a
    task. The approximation decides how even the parts are, never the result.
    """
    keys = list(by)
    live = stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k")), "quantile-counts")
    p = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    sizes = live.groupBy(*keys).agg(F.sum("_k").alias("_n"), F.count("*").alias("_m"))
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), (p(x) * (F.col("_n") - 1)).alias("_at")) for name, x in probabilities.items()])).alias("_x")
    wanted = sizes.where("_n > 0").select(*keys, "_n", at).select(*keys, "_x._name", "_x._at")
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("_end"), F.floor("_at").alias("_rank")), F.struct(F.lit("hi").alias("_end"), F.ceil("_at").alias("_rank")))).alias("_y")
    wanted = wanted.select(*keys, "_name", "_at", ends).select(*keys, "_name", "_at", "_y._end", F.col("_y._rank").cast("long").alias("_rank"))
    live, wanted = live.withColumn("_node", F.lit("")), wanted.withColumn("_node", F.lit(""))
    node = [*keys, "_node"]
    while (live.groupBy(*node).agg(F.count("*").alias("_m")).agg(F.max("_m")).first()[0] or 0) > LIMIT:
        parts = live.groupBy(*node).agg(_bounds("_v", PARTS).alias("_b"))
        split = _same(live, parts, node).withColumn("_part", F.expr("size(filter(_b, x -> x < _v))")).drop("_b")
        sums = split.groupBy(*node, "_part").agg(F.sum("_k").alias("_s"))
        upto = F.sum("_s").over(W.partitionBy(*node).orderBy("_part"))
        sums = sums.withColumn("_before", upto - F.col("_s"))
        found = _same(wanted, sums, node).where("_rank >= _before AND _rank < _before + _s")
        deeper = F.concat_ws(",", "_node", "_part")
        wanted = stored(found.select(*keys, "_name", "_at", "_end", (F.col("_rank") - F.col("_before")).alias("_rank"), deeper.alias("_node")), "quantile-ranks")
        split = split.select(*keys, "_v", "_k", deeper.alias("_node"))
        live = stored(_same(split, wanted.select(*node).distinct(), node), "quantile-part")
    upto = F.sum("_k").over(W.partitionBy(*node).orderBy("_v"))
    placed = live.withColumn("_upto", upto)
    d = _same(wanted, placed, node).where("_rank < _upto AND _rank >= _upto - _k")
    part = F.col("_at") - F.floor("_at")
    end = lambda e: F.max(F.when(F.col("_end") == e, F.col("_v")))
    d = d.groupBy(*keys, "_name", "_at").agg(end("lo").alias("_lo"), end("hi").alias("_hi")).select(*keys, "_name", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("_q"))
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probabilities])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; right's keys go."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    rest = [c for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in rest])


def lookup(queries: DataFrame, index: DataFrame, column: str, *values: str, parts: int = 256) -> DataFrame:
    """queries' distinct `column` with the values of the last row of index at or below it, null where there is none.

    index has a row a value of its column. Both are dealt into intervals at approximate quantiles
    of all their values, so that no interval holds many; the last index row of the intervals before
    goes with each.
    """
    q = queries.select(F.col(column).alias("_x")).distinct().withColumn("_row", F.lit(None).cast(index.select(F.struct(column, *values)).schema[0].dataType))
    both = q.unionByName(index.select(F.col(column).alias("_x"), F.struct(column, *values).alias("_row")))
    both = both.join(F.broadcast(both.agg(_bounds("_x", parts).alias("_b"))), F.lit(True)).withColumn("_part", F.expr("size(filter(_b, x -> x < _x))")).drop("_b")
    heads = both.where("_row IS NOT NULL").groupBy("_part").agg(F.max("_row").alias("_last"))
    every = both.select("_part").distinct().join(heads, "_part", "left")  # `parts` rows at most
    before = F.max("_last").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    both = both.join(F.broadcast(every.select("_part", before.alias("_before"))), "_part")
    inner = W.partitionBy("_part").orderBy("_x").rangeBetween(W.unboundedPreceding, 0)
    d = both.withColumn("_at", F.coalesce(F.max("_row").over(inner), "_before")).where("_row IS NULL")
    return d.select(F.col("_x").alias(column), *[F.col(f"_at.{v}").alias(v) for v in values])


def cumulated(counts: DataFrame, value: str, n: str, *by: str, parts: int = 256) -> DataFrame:
    """(by, value, upto, below, total, next, area), a row a distinct value of a group.

    upto and below count the group's rows at or below, and below, the value; next is the group's
    next value; area is the integral of the share of rows up to the value. Groups are dealt into
    intervals of about equally many values; sums of intervals are carried on between these.
    """
    keys, inner_keys = list(by), [*by, "_part"]
    d = stored(counts.groupBy(*by, F.col(value).alias("value")).agg(F.sum(n).alias("n")), "cumulated-counts")
    d = _same(d, d.groupBy(*keys).agg(_bounds("value", parts).alias("_b")), keys).withColumn("_part", F.expr("size(filter(_b, x -> x < value))")).drop("_b")
    sums = d.groupBy(*inner_keys).agg(F.sum("n").alias("_n"), F.min("value").alias("_least"))
    order = W.partitionBy(*keys).orderBy("_part")
    sums = sums.select(*inner_keys, (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("total"), F.lead("_least").over(order).alias("_next"))
    inner = W.partitionBy(*inner_keys).orderBy("value")
    d = _same(d, sums, inner_keys).withColumn("upto", F.col("_before") + F.sum("n").over(inner)).withColumn("next", F.coalesce(F.lead("value").over(inner), "_next"))
    d = d.withColumn("_step", F.coalesce(F.col("upto") / F.col("total") * (F.col("next") - F.col("value")), F.lit(0.0)))
    areas = d.groupBy(*inner_keys).agg(F.sum("_step").alias("_a"))
    d = _same(d, areas.select(*inner_keys, (F.sum("_a").over(order) - F.col("_a")).alias("_areas")), inner_keys)
    own = F.coalesce(F.sum("_step").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return d.select(*keys, "value", "upto", (F.col("upto") - F.col("n")).alias("below"), "total", "next", (F.col("_areas") + own).alias("area"))
