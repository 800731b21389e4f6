"""Quality of predictions: classification, regression, calibration, intervals; each groupable."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def _number(rows: str | None) -> Column:
    return F.sum(rows) if rows else F.count("*")


def confusion(df: DataFrame, *by: str, rows: str | None = None) -> DataFrame:
    """rows: a column with the number of rows that each row stands for; here and below."""
    return df.groupBy(*by, "y", "yhat").agg(_number(rows).alias("n"))


def per_class(df: DataFrame, *by: str, rows: str | None = None) -> DataFrame:
    """precision, recall, f1 and support by label of truth or prediction; 0 where undefined."""
    c = confusion(df, *by, rows=rows)
    sides = c.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said")))).alias("s")).select(*by, "s.*")
    d = sides.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("truth").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "said")


def classification(df: DataFrame, *by: str, rows: str | None = None) -> DataFrame:
    """accuracy, macro and weighted scores over truth and predictions' labels, balanced over truth's."""
    p = per_class(df, *by, rows=rows)
    truth = F.col("support") > 0
    total = F.sum("support")
    return p.groupBy(*by).agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("micro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.avg(F.when(truth, F.col("recall"))).alias("balanced_accuracy"), total.alias("n"),
    )


def regression(df: DataFrame, *by: str, variant: str = "zero") -> DataFrame:
    """mae, rmse, mape, wape, smape and r2 of (y, yhat).

    variant "zero": MAPE skips zero truths, empty denominators give 0; "floor": MAPE divides by
    max(|y|, 1) and empty denominators give NaN.
    """
    e = F.abs(F.col("y") - F.col("yhat"))
    empty = F.lit(0.0) if variant == "zero" else F.lit(float("nan"))
    mape = F.avg(F.when(F.col("y") != 0, e / F.abs("y"))) if variant == "zero" else F.avg(e / F.greatest(F.abs("y"), F.lit(1.0)))
    both = F.abs("y") + F.abs("yhat")
    smape = F.avg(F.when(both > 0, 2 * e / both))
    return df.groupBy(*by).agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(mape, F.lit(0.0)).alias("mape"),
        F.when(F.sum(F.abs("y")) > 0, F.sum(e) / F.sum(F.abs("y"))).otherwise(empty).alias("wape"), F.coalesce(smape, empty).alias("smape"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"),
    )


def detector(df: DataFrame, *by: str) -> DataFrame:
    """tp, precision, recall and f1 of (truth, said); 0 where undefined."""
    n = lambda c: F.count(F.when(c, 1))
    d = df.groupBy(*by).agg(n(F.col("truth") & F.col("said")).alias("tp"), n(F.col("said")).alias("said"), n(F.col("truth")).alias("truth"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("truth"))})
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def harness(protocols: dict, fit, predict, rows: str | None = None) -> DataFrame:
    """classification() by protocol: the same fit(train) and predict(model, test) -> (y, yhat) under each split.

    protocols: name to a DataFrame with `split`, train or test.
    """
    parts = [predict(fit(s.where("split = 'train'")), s.where("split = 'test'")).select("y", "yhat", *([rows] if rows else []), F.lit(name).alias("protocol")) for name, s in protocols.items()]
    return classification(reduce(DataFrame.unionByName, parts), "protocol", rows=rows)


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """A row a bin (lo, hi] of (confidence, correct): n, mean confidence and accuracy; 0 is left out."""
    d = df.where("confidence > 0").withColumn("bin", F.ceil(F.col("confidence") * bins).cast("int"))
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    c = calibration(df, bins)
    n = df.agg(F.count("*").alias("total"))
    return c.join(F.broadcast(n), F.lit(True)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))


def brier(df: DataFrame) -> DataFrame:
    """Mean squared error of (y, labels, probabilities) over rows and classes."""
    each = df.select("y", F.explode(F.arrays_zip("labels", "probabilities")).alias("p"))
    return each.agg(F.avg(F.pow(F.col("p.probabilities") - (F.col("p.labels") == F.col("y")).cast("int"), 2)).alias("brier"))


def intervals(df: DataFrame, *by: str) -> DataFrame:
    """coverage, sharpness, distance from 0.8 and pinball losses of (y, p10, p50, p90)."""
    def pinball(q: float, c: str) -> Column:
        d = F.col("y") - F.col(c)
        return F.avg(F.greatest(q * d, (q - 1) * d))

    cover = F.avg(((F.col("y") >= F.col("p10")) & (F.col("y") <= F.col("p90"))).cast("int"))
    return df.groupBy(*by).agg(cover.alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("sharpness"), F.abs(cover - 0.8).alias("calibration_error"), pinball(0.1, "p10").alias("pinball_10"), pinball(0.5, "p50").alias("pinball_50"), pinball(0.9, "p90").alias("pinball_90"))


def modal(df: DataFrame, label: str, *by: str, rows: str | None = None) -> DataFrame:
    """The most frequent label by key, the first by name of equals."""
    c = df.groupBy(*by, label).agg(_number(rows).alias("k"))
    return c.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("k"), F.col(label))).alias("modal"), F.sum("k").alias("rows"), F.count("*").alias("labels"))


def personal_predictions(train: DataFrame, test: DataFrame, cohorts: DataFrame | Column | None = None) -> DataFrame:
    """test with global_pred, cohort_pred, personal_pred: merchants' modal categories, users' own where they have enough.

    cohorts: user_id and cohort, or the cohort as a column of both tables, for which no rows move.
    """
    overall = modal(train, "category").select(F.col("modal").alias("g"))
    merchant = modal(train, "category", "merchant_key").select("merchant_key", F.col("modal").alias("m"))
    user = modal(train, "category", "user_id").select("user_id", F.col("modal").alias("u"), F.col("rows").alias("history"), F.col("labels").alias("kinds"))
    own = modal(train, "category", "user_id", "merchant_key").select("user_id", "merchant_key", F.col("modal").alias("um"))
    d = test.join(merchant, "merchant_key", "left").join(user, "user_id", "left").join(own, ["user_id", "merchant_key"], "left").join(F.broadcast(overall), F.lit(True))
    base = F.coalesce("m", "g")
    enough = (F.col("history") >= 5) & (F.col("kinds") > 1)
    d = d.withColumn("global_pred", base).withColumn("personal_pred", F.when(enough, F.coalesce("um", "u")).otherwise(base))
    if cohorts is not None:
        mine = isinstance(cohorts, Column)
        known = train.withColumn("cohort", cohorts) if mine else train.join(cohorts, "user_id")
        by_cohort = modal(known, "category", "cohort", "merchant_key").select("cohort", "merchant_key", F.col("modal").alias("c"))
        d = d.withColumn("cohort", cohorts) if mine else d.join(cohorts, "user_id", "left")
        d = d.join(by_cohort, ["cohort", "merchant_key"], "left").withColumn("cohort_pred", F.coalesce("c", base))
    return d.withColumn("history", F.coalesce("history", F.lit(0)))


def split_conformal(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """q: the linear quantile of residuals at min(ceil((n + 1)(1 - alpha)) / n, 1)."""
    n = F.col("_n")
    p = F.least(F.ceil((n + 1) * (1 - alpha)) / n, F.lit(1.0))
    return quantiles(df, "resid", {"q": p})


def paired_t(df: DataFrame, *by: str) -> DataFrame:
    d = F.col("a") - F.col("b")
    return df.groupBy(*by).agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("n"))


def signed_rank(df: DataFrame, *by: str) -> DataFrame:
    """min(W+, W-) of a - b: zeros dropped, average ranks from counts of equal sizes."""
    d = df.withColumn("d", F.round(F.col("a") - F.col("b"), 6)).where("d <> 0").withColumn("size", F.abs("d"))
    c = d.groupBy(*by, "size").agg(F.count("*").alias("k"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    before = F.coalesce(F.sum("k").over(W.partitionBy(*by).orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("rank", before + (F.col("k") + 1) / 2)
    return c.groupBy(*by).agg(F.least(F.sum(F.col("rank") * F.col("plus")), F.sum(F.col("rank") * (F.col("k") - F.col("plus")))).alias("w"), F.sum("k").alias("n"))


#: Modulus and multipliers of the replicates' weights, and the shares of Poisson(1) at or below 0 to 5.
PRIME, STEPS = 2147483647, ((1103515245, 12345), (69621, 7))
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


class _Replicates:
    """Partial sums of weights and weighted values by group, an array with an entry a replicate, for mapInPandas."""

    def __init__(self, by: list[str], replicates: int, groups: int = 256, rows: int = 2048):
        self.by, self.replicates, self.groups, self.rows = by, replicates, groups, rows

    def __call__(self, batches):
        rep = np.arange(1, self.replicates + 1, dtype=np.int64)
        k1, k2 = ((rep * a + b) % PRIME for a, b in STEPS)
        least = [int(p * PRIME) for p in POISSON]
        held: dict[tuple, list] = {}

        def flush():
            rows = [(*g, w, x) for g, (w, x) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*self.by, "w", "x"])

        for batch in batches:
            for group, part in batch.groupby(self.by, dropna=False, sort=False) if self.by else [((), batch)]:
                group = tuple(None if g != g else g for g in group)
                sums = held.setdefault(group, [np.zeros(self.replicates, np.int64), np.zeros(self.replicates)])
                for i in range(0, len(part), self.rows):
                    rows = part.iloc[i : i + self.rows]
                    v = (rows["h1"].to_numpy()[:, None] * k1 + rows["h2"].to_numpy()[:, None] * k2) % PRIME
                    weight = sum((v >= t).astype(np.int64) for t in least)
                    sums[0] += weight.sum(axis=0)
                    sums[1] += rows["value"].to_numpy() @ weight
                if len(held) >= self.groups:
                    yield flush()
        yield flush()


def bootstrap_ci(df: DataFrame, key: str, value: str, *by: str, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by group, and its mean over the replicates; a group of one row has its value.

    Each row has a Poisson(1) weight, from a hash of its key, in each replicate. A row stays one
    row: tasks keep an array of sums a group, and only those are shuffled. Null values don't count.
    """
    part = lambda i: (F.conv(F.substring(F.md5(F.col(key)), i, 8), 16, 10).cast("long") % PRIME)
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"), part(1).alias("h1"), part(9).alias("h2"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*by).schema)
    sums = d.mapInPandas(_Replicates(list(by), replicates), f"{kinds + ', ' if by else ''}w array<bigint>, x array<double>")
    each = sums.select(*by, F.posexplode(F.arrays_zip("w", "x")).alias("rep", "s")).groupBy(*by, "rep").agg(F.sum("s.w").alias("w"), F.sum("s.x").alias("x"))
    low = (1 - level) / 2
    means = each.withColumn("mean", F.col("x") / F.nullif(F.col("w"), F.lit(0)))
    ends = means.groupBy(*by).agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(1 - low)).alias("high"), F.avg("mean").alias("mean"))  # `replicates` values a group
    alone = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("value").alias("_one"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    one = lambda c: F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col(c)).alias(c)
    return ends.alias("e").join(alone.alias("a"), same).select(*[f"e.{c}" for c in by], one("low"), one("high"), one("mean"))


def p_values(df: DataFrame) -> DataFrame:
    """df of aggregated rows (t, w, n) with p_t and p_w; the only Python here, a row a group."""
    def student(t: float, n: int) -> float:
        v = n - 1
        x, a, b = v / (v + t * t), v / 2, 0.5
        flip = x > (a + 1) / (a + b + 2)
        a, b, x = (b, a, 1 - x) if flip else (a, b, x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300))) / a
        f, c, d = 1.0, 1.0, 0.0
        for i in range(400):  # Lentz's method for the continued fraction of the incomplete beta function
            m = i // 2
            k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-12:
                break
        value = front * (f - 1)
        return min(1.0, max(0.0, 1 - value if flip else value))

    def wilcoxon(w: float, n: int) -> float:
        if n <= 50 and w == int(w):
            ways = [1] + [0] * (n * (n + 1) // 2)
            for r in range(1, n + 1):
                for s in range(len(ways) - 1, r - 1, -1):
                    ways[s] += ways[s - r]
            return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        return math.erfc(abs(z) / math.sqrt(2))

    @F.pandas_udf("double")
    def p_t(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student(a, int(b)) if b > 1 and a == a else None for a, b in zip(t, n)], dtype=float)

    @F.pandas_udf("double")
    def p_w(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon(a, int(b)) if b > 0 and a == a else None for a, b in zip(w, n)], dtype=float)

    return df.withColumns({"p_t": p_t("t", "n"), "p_w": p_w("w", "n_w")})
