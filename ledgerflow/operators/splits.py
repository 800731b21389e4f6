"""Honest train and test splits; a global order never goes through one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket, hash_place
from ..sources.files import stored


#: Rows whose order one task finds; of a longer range so many rows mark its parts.
SORTED, MARKS = 200_000, 256
_DAY = 86_400_000_000


def _order():
    return F.struct(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.col("transaction_id").alias("id"))


def _literal(df: DataFrame, key):
    return F.struct(F.lit(key["at"]).cast("long").alias("at"), F.lit(key["id"]).cast(df.schema["transaction_id"].dataType).alias("id"))


def _holding(counts, rank: int):
    """Of sorted (bucket, n) the one that holds the 0-based rank, and the rows before it."""
    before = 0
    for bucket, n in counts:
        if rank < before + n:
            return bucket, n, before
        before += n


def keys_at(df: DataFrame, fractions) -> list:
    """The (time, id) at the place int(n * fraction) in the order of both; None where there is no such row.

    Counts by day find the day of each place. A day with more than SORTED rows is cut at MARKS of
    its rows, drawn by hash, and the part with the place is counted and cut again until it is small
    or holds one key only; so a table of one instant is no single task. What comes to the driver is
    bounded by the calendar's days and by MARKS.
    """
    keys = df.select(_order().alias("k"))
    days = sorted(keys.groupBy(F.floor(F.col("k.at") / _DAY).alias("d")).count().collect(), key=lambda r: (r["d"] is not None, r["d"] or 0))
    total = sum(r["count"] for r in days)
    out = []
    for rank in (int(total * f) for f in fractions):
        found = _holding([(r["d"], r["count"]) for r in days], rank)
        if found is None:
            out.append(None)
            continue
        day, n, before = found
        at = F.col("k.at")
        inside = keys.where(at.isNull() if day is None else (at >= day * _DAY) & (at < (day + 1) * _DAY))
        out.append(_key_at(df, inside, n, rank - before))
    return out


def _key_at(df: DataFrame, keys: DataFrame, n: int, rank: int):
    while n > SORTED:
        marks = keys.orderBy(F.xxhash64("k")).limit(MARKS).agg(F.array_sort(F.collect_set("k"))).first()[0]
        known = F.array(*[_literal(df, m) for m in marks])
        # even parts lie between marks, odd ones are the rows of a mark
        part = 2 * F.size(F.filter(known, lambda m: m < F.col("k"))) + F.array_contains(known, F.col("k")).cast("int")
        counts = sorted(tuple(r) for r in keys.groupBy(part.alias("part")).count().collect())
        bucket, n, before = _holding(counts, rank)
        i, equal = divmod(bucket, 2)
        if equal:
            return marks[i]
        if i > 0:
            keys = keys.where(F.col("k") > _literal(df, marks[i - 1]))
        if i < len(marks):
            keys = keys.where(F.col("k") < _literal(df, marks[i]))
        rank -= before
    return keys.orderBy("k").limit(rank + 1).agg(F.max("k")).first()[0]


def temporal_split(df: DataFrame, fractions=(0.8,)) -> DataFrame:
    """split by (timestamp, transaction_id): train, then val and test (or test alone), cut at int(n * fraction).

    Rows are held against the cuts' keys and not shuffled. Rows equal in both columns lie on the same
    side, the later; a null timestamp is earliest.
    """
    return df.withColumn("split", _by_time(df, fractions))


def _by_time(df: DataFrame, fractions):
    names = ("train", "test") if len(fractions) == 1 else ("train", "val", "test")
    split = F.lit(names[0])
    for name, key in zip(names[1:], keys_at(df, fractions)):
        if key is not None:
            split = F.when(_order() >= _literal(df, key), name).otherwise(split)
    return split


def key_split(df: DataFrame, key: str, train: float, seed: int = 42) -> DataFrame:
    """split by distinct keys in hashed order: the first int(n * train) keys are train."""
    return df.withColumn("split", _by_key(df, key, train, seed))


def _by_key(df: DataFrame, key: str, train: float, seed: int = 42):
    place = hash_place(F.col(key), seed)
    head = F.substring(place, 1, 3)
    counts = sorted(tuple(r) for r in df.select(key).distinct().groupBy(head.alias("b")).count().collect())  # 4096 at most
    cut, count = "", int(sum(n for _, n in counts) * train)
    if count > 0:
        bucket, _, before = _holding(counts, count - 1)
        inside = df.select(key).where(head == bucket).distinct().select(place.alias("place")).orderBy("place")
        cut = inside.limit(count - before).agg(F.max("place")).first()[0]
    return F.when(place <= cut, "train").otherwise("test")


def ranked_cut(keys: DataFrame, count: int) -> str:
    """The `count`-th smallest place: counts by its first digits, then one bucket's order."""
    if count <= 0:
        return ""
    buckets = keys.groupBy(F.substring("place", 1, 3).alias("b")).agg(F.count("*").alias("n"))
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    row = buckets.withColumn("upto", F.sum("n").over(before)).where(F.col("upto") >= count).orderBy("b").first()
    inside = keys.where(F.substring("place", 1, 3) == row["b"]).select("place").orderBy("place")
    return inside.limit(count - (row["upto"] - row["n"])).agg(F.max("place")).first()[0]


def noisy_text(text: str, key: str, fraction: float = 0.2, seed: int = 7, shares=(25, 25, 25, 25)):
    """Lower, upper, unspaced or suffixed text on a hashed share of rows."""
    pick = hash_bucket(F.col(key), seed) < int(fraction * 10_000)
    how = hash_bucket(F.col(key), seed + 1, 100)
    ends = [sum(shares[: i + 1]) for i in range(len(shares))]
    noise = F.when(how < ends[0], F.lower(text)).when(how < ends[1], F.upper(text)).when(how < ends[2], F.regexp_replace(text, " ", "")).otherwise(F.concat(F.col(text), F.lit(" REF 1234")))
    return F.when(pick, noise).otherwise(F.col(text))


def protocols(txns: DataFrame) -> dict[str, DataFrame]:
    """The four split protocols by name; under "noisy" the test part's descriptions are noisy."""
    later = temporal_split(txns)
    noisy = later.withColumn("description", F.when(F.col("split") == "test", noisy_text("description", "transaction_id")).otherwise(F.col("description")))
    return {"temporal": later, "merchant_disjoint": key_split(txns, "merchant_key", 0.8), "novel_merchant": key_split(txns, "merchant_raw", 0.9), "noisy": noisy}


def protocol_counts(txns: DataFrame) -> dict[str, DataFrame]:
    """protocols() as counts: description, category, split, and rows, the number of such rows.

    The columns that splits read are written once; all splits are then columns of one pass.
    """
    t = stored(txns.select("transaction_id", "timestamp", "merchant_key", "merchant_raw", "description", "category"), "protocol-rows")
    parts = {"temporal": _by_time(t, (0.8,)), "merchant_disjoint": _by_key(t, "merchant_key", 0.8), "novel_merchant": _by_key(t, "merchant_raw", 0.9)}
    d = t.withColumns({f"_{n}": c for n, c in parts.items()})
    d = d.withColumn("_noisy", F.when(F.col("_temporal") == "test", noisy_text("description", "transaction_id")).otherwise(F.col("description")))
    d = stored(d.groupBy("description", "category", "_noisy", *[f"_{n}" for n in parts]).agg(F.count("*").alias("rows")), "protocol-counts")
    out = {n: d.select("description", "category", F.col(f"_{n}").alias("split"), "rows") for n in parts}
    return out | {"noisy": d.select(F.col("_noisy").alias("description"), "category", F.col("_temporal").alias("split"), "rows")}


def month_cutoff(frame: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The latest max(1, round(fraction * months)) months are test. The months, which the calendar bounds, come to the driver once."""
    months = sorted((r["month"] for r in frame.select("month").distinct().collect()), key=lambda m: (m is not None, m), reverse=True)
    latest = [m for m in months[: max(1, math.floor(fraction * len(months) + 0.5))] if m is not None]
    first = F.lit(min(latest, default=None)).cast(frame.schema["month"].dataType)
    return frame.withColumn("split", F.when(F.col("month") >= first, "test").otherwise("train"))


def last_month(frame: DataFrame) -> DataFrame:
    """Each user's last month is test."""
    return frame.withColumn("split", F.when(F.col("month") == F.max("month").over(W.partitionBy("user_id")), "test").otherwise("train"))


def inject_anomalies(df: DataFrame, rate: float = 0.01, seed: int = 13) -> DataFrame:
    """Exactly int(n * rate) rows by hashed place: amount times 5 to 15, or another category."""
    n = df.count()
    cut = ranked_cut(df.select(hash_place(F.col("transaction_id"), seed).alias("place")), int(n * rate))
    hit = hash_place(F.col("transaction_id"), seed) <= cut
    factor = 5 + hash_bucket(F.col("transaction_id"), seed + 1, 1001) / 100
    how = hash_bucket(F.col("transaction_id"), seed + 2, 2)
    return df.withColumns({
        "is_anomaly": hit.cast("int"), "amount": F.when(hit & (how == 0), F.col("amount").cast("double") * factor).otherwise(F.col("amount").cast("double")),
        "category": F.when(hit & (how == 1), "misc").otherwise(F.col("category")),
    })


def stratified(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """split by hashed order within each label: the first int(n * train) rows are train.

    Counts by the first digits of the place tell where the cut lies; only rows with those digits are
    numbered, the others share no window.
    """
    d = df.withColumn("_place", hash_place(F.col(key), seed)).withColumn("_b", F.substring("_place", 1, 3))
    counts = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(label)
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_b")) - F.col("_n"), "_cut": F.floor(F.sum("_n").over(whole) * train)})
    d = d.join(counts, [label, "_b"])
    inside = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_n") > F.col("_cut"))
    spread = F.when(inside, F.lit("")).otherwise(F.substring("_place", 1, 8))
    number = F.row_number().over(W.partitionBy(label, "_b", spread).orderBy("_place"))
    first = F.when(inside, F.col("_before") + number <= F.col("_cut")).otherwise(F.col("_before") < F.col("_cut"))
    return d.withColumn("split", F.when(first, "train").otherwise("test")).drop("_place", "_b", "_n", "_before", "_cut")


def summary(split: DataFrame) -> DataFrame:
    """Rows, time range, users and merchants by split, and test merchants unseen in train."""
    per = split.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").cast("date").cast("string").alias("first_day"), F.max("timestamp").cast("date").cast("string").alias("last_day"), F.countDistinct("user_id").alias("users"), F.countDistinct("merchant_key").alias("merchants"))
    novel = split.where("split = 'test'").select("merchant_key").subtract(split.where("split = 'train'").select("merchant_key")).agg(F.count("*").alias("k"))
    return per.join(F.broadcast(novel), F.lit(True)).select(*per.columns, F.when(F.col("split") == "test", F.col("k")).alias("novel_merchants"))
