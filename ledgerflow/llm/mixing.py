"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, broadcast_up_to, materialize

#: A plan has a row a source; beyond so many rows it is joined by shuffle instead of broadcast.
PLAN_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A seeded place of each document in its source's order, as lower-case hexadecimal text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets by source from (source, source_size): a level times the weight, clamped at max_epochs.

    Sources take the weights in turn by code point, null last. Clamping a source passes its excess
    to the others by weight until none is above its cap; in order of cap / weight that ends at the
    first source that the level so far doesn't lift above its cap.
    """
    ring = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "turn")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    d = (
        sizes.withColumn("turn", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(ring, ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("budget") - F.col("spent")) / F.col("open"))
        .withColumn("first_open", F.min(F.when(F.col("level_here") <= F.col("ratio"), F.col("place"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level_here"))).over(everything))
    )
    target = F.when(F.col("place") < F.coalesce("first_open", F.lit(1 << 30)), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return d.select("source", "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(plan, sized): a row a source with its target, whole repetitions and the last place of the
    partial one; and each document's size and place.

    The partial repetition takes documents in the order of their seeded places until the source's
    rest is reached. The cut is found from sums by the first three digits of the place, and then
    within that one bucket, so no task orders a whole source.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("place")), "mixing-sized")
    buckets = materialize(sized.groupBy("source", F.substring("place", 1, 3).alias("bucket")).agg(F.sum("size").alias("words")), "mixing-buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets, "mixing-targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    summed = buckets.withColumn("upto", F.sum("words").over(up_to))
    cut = (
        summed.alias("b").join(targets.alias("t"), same(summed, targets)).where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .select("b.source", "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))
    )
    cut = materialize(cut, "mixing-cut")
    inside = (
        sized.alias("d").join(broadcast_up_to(cut, PLAN_ROWS).alias("c"), sized["source"].eqNullSafe(cut["source"]) & (F.substring("place", 1, 3) == cut["bucket"]))
        .groupBy(F.col("d.source").alias("source"), "place").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    )
    ordered = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("size").over(ordered)).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    ends = inside.groupBy("source").agg(F.max("place").alias("inside_last"))
    plan = (
        targets.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left").join(ends.alias("e"), F.expr("t.source <=> e.source"), "left")
        .select("t.source", "t.source_size", "t.target", "t.whole", F.coalesce("inside_last", "bucket", F.lit("")).alias("last_place"))
    )
    return materialize(plan, "mixing-plan"), sized


def copies(plan_of: DataFrame) -> Column:
    """Repetitions of a row that has the plan's columns and its place."""
    return F.col("whole") + F.when(F.col("place") <= F.col("last_place"), 1).otherwise(0)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken (its words times its repetitions).

    Null text has size 0, a null source is a source of its own, a null id is placed as an empty one;
    repeated rows share their place and so their fate. An empty table gives no rows. Other columns
    are not read. A source's taken words differ from its target by half of the documents that share
    one place at most.
    """
    plan, sized = mixing_plan(docs, **options)
    small = broadcast_up_to(plan, PLAN_ROWS)
    return sized.alias("d").join(small.alias("p"), F.expr("d.source <=> p.source")).select(
        "d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * copies(plan)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: each document as often as its source's plan says, columns unchanged."""
    plan, _ = mixing_plan(docs, seed=seed, **options)
    small = broadcast_up_to(plan, PLAN_ROWS).select(F.col("source").alias("_source"), *[c for c in plan.columns if c not in ("source",)])
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), draw(F.col("doc_id"), seed).alias("place"))
    joined = mine.join(small, F.col("_doc.source").eqNullSafe(F.col("_source")))
    return joined.select("_doc", F.explode(F.array_repeat(F.lit(0), copies(plan).cast("int")))).select("_doc.*")


def op10_mixing(spark, sf_dir):
    from .common import table

    return mix_counts(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS turn FROM sizes),
weighted AS (SELECT *, [5.0, 2.0, 1.0][(turn - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM turns),
placed AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, turn) AS nth FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level_here
  FROM placed WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firsts AS (SELECT min(nth) AS first_open, arg_min(level_here, nth) AS level FROM levels WHERE level_here <= ratio),
targets AS (
  SELECT source, source_size, CASE WHEN first_open IS NULL OR nth < first_open THEN cap ELSE level * weight END AS target
  FROM levels CROSS JOIN firsts),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
places AS (SELECT source, place, sum(size) AS size FROM sized GROUP BY source, place),
upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
ends AS (
  SELECT p.source, max(u.place) AS last_place FROM upto u JOIN plans p ON u.source IS NOT DISTINCT FROM p.source
  WHERE u.upto - u.size / 2.0 <= p.target - p.whole * p.source_size GROUP BY p.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN d.place <= e.last_place THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
"""
