"""Row features over a user's history; all of them share one exchange by user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..sources.files import stored


def _user():
    return W.partitionBy("user_id").orderBy("timestamp", "transaction_id")


def _past():
    return _user().rowsBetween(W.unboundedPreceding, -1)


#: Users with more rows than this are worked on in blocks of time with about so many rows.
HOT_ROWS = 2_000_000


def hot_users(txns: DataFrame, hot_rows: int) -> DataFrame:
    """user_id, _n, _from, _to of users with more than hot_rows rows: fewer than rows / hot_rows."""
    hot = txns.groupBy("user_id").agg(F.count("*").alias("_n"), F.min(F.unix_micros("timestamp")).alias("_from"), F.max(F.unix_micros("timestamp")).alias("_to")).where(F.col("_n") > hot_rows)
    return stored(hot, "hot-users")


def running(txns: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Spend, count, mean and sample deviation before the row; gaps to the row before; balance with it.

    A user with more than hot_rows rows isn't one task: see in_blocks(). hot: hot_users(), if known.
    """
    hot = hot_users(txns, hot_rows) if hot is None else hot
    if not hot.limit(1).count():
        return _running(txns)
    width = F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / hot_rows)))
    d = txns.join(F.broadcast(hot.select("user_id", "_from", width.alias("_width"))), "user_id", "left")
    few = _running(d.where("_from IS NULL").drop("_from", "_width"))
    many = in_blocks(d.where("_from IS NOT NULL").withColumn("_block", F.floor((F.unix_micros("timestamp") - F.col("_from")) / F.col("_width"))).drop("_from", "_width"))
    return few.unionByName(many.select(*few.columns))


def _signed():
    return F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def _running(txns: DataFrame) -> DataFrame:
    amount = F.col("amount").cast("double")
    gap = (F.unix_seconds("timestamp") - F.lag(F.unix_seconds("timestamp")).over(_user())).cast("double")
    return txns.withColumns({
        "cumulative_spend": F.coalesce(F.sum("amount").over(_past()).cast("double"), F.lit(0.0)),
        "rolling_tx_count": F.row_number().over(_user()) - 1,
        "user_mean_amount": F.coalesce(F.avg(amount).over(_past()), F.lit(0.0)),
        "user_std_amount": F.coalesce(F.stddev_samp(amount).over(_past()), F.lit(0.0)),
        "days_since_previous": F.coalesce(gap / 86400, F.lit(0.0)), "time_gap_hours": F.coalesce(gap / 3600, F.lit(0.0)),
        "running_balance_proxy": F.sum(_signed()).over(_user().rowsBetween(W.unboundedPreceding, 0)).cast("double"),
    })


def in_blocks(txns: DataFrame) -> DataFrame:
    """running() of rows with a _block of time: windows within (user, block), and what the blocks before add.

    Counts, sums and squared deviations of blocks are carried on from block to block, a row each;
    a block's first row has the last time of the blocks before as its previous one.
    """
    keys = ["user_id", "_block"]
    d = stored(txns, "running-blocks")
    x, s = F.col("amount").cast("double"), F.unix_seconds("timestamp")
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("amount").alias("spend"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(_signed()).alias("balance"), F.max(s).alias("last"))
    before = W.partitionBy("user_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    carried = sums.select(*keys, *[none(F.sum(c).over(before)).alias(f"_{c}") for c in ("n", "spend", "sx", "sxx", "balance")], F.max("last").over(before).alias("_last"))
    own = W.partitionBy(*keys).orderBy("timestamp", "transaction_id")
    past = own.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"_n1": F.row_number().over(own) - 1, "_spend1": none(F.sum("amount").over(past)), "_sx1": none(F.sum(x).over(past)), "_sxx1": none(F.sum(x * x).over(past)),
        "_balance1": F.sum(_signed()).over(own.rowsBetween(W.unboundedPreceding, 0)), "_s1": F.lag(s).over(own)})
    d = d.join(carried, keys)
    n, sx, sxx = (F.col(f"_{c}") + F.col(f"_{c}1") for c in ("n", "sx", "sxx"))
    gap = (s - F.coalesce("_s1", "_last")).cast("double")
    d = d.withColumns({
        "cumulative_spend": (F.col("_spend") + F.col("_spend1")).cast("double"), "rolling_tx_count": n.cast("int"),
        "user_mean_amount": F.when(n > 0, sx / n).otherwise(0.0), "user_std_amount": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (sxx - sx * sx / n) / (n - 1)))).otherwise(0.0),
        "days_since_previous": F.coalesce(gap / 86400, F.lit(0.0)), "time_gap_hours": F.coalesce(gap / 3600, F.lit(0.0)), "running_balance_proxy": (F.col("_balance") + F.col("_balance1")).cast("double"),
    })
    return d.drop("_block", *[f"_{c}{k}" for c in ("n", "spend", "sx", "sxx", "balance") for k in ("", "1")], "_last", "_s1")


def same_key_gaps(txns: DataFrame) -> DataFrame:
    """Seconds since the user's previous row of the same merchant and of the same category (null: none)."""
    since = lambda key: F.unix_seconds("timestamp") - F.lag(F.unix_seconds("timestamp")).over(W.partitionBy("user_id", key).orderBy("timestamp", "transaction_id"))
    return txns.withColumns({"same_merchant_gap": since("merchant_raw"), "same_category_gap": since("category")})


def trailing_counts(txns: DataFrame, days=(7, 30)) -> DataFrame:
    """Rows of the user within (t - days, t], the row and others of its second included."""
    by_time = W.partitionBy("user_id").orderBy("_s")
    d = txns.withColumn("_s", F.unix_seconds("timestamp"))
    return d.withColumns({f"tx_count_{n}d": F.count("*").over(by_time.rangeBetween(-n * 86400 + 1, 0)) for n in days}).drop("_s")


def merchant_stats(txns: DataFrame) -> DataFrame:
    """Count and mean amount of the row's merchant: an aggregate joined back, as merchants are skewed."""
    stats = txns.groupBy("merchant_key").agg(F.count("*").alias("merchant_frequency"), F.avg(F.col("amount").cast("double")).alias("merchant_mean_amount"))
    return txns.join(stats, "merchant_key", "left")


def user_stats(txns: DataFrame) -> DataFrame:
    part = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast("double")
    d = txns.groupBy("user_id").agg(F.count("*").alias("history_length"), part("debit").alias("total_debit"), part("credit").alias("total_credit"), F.sum(F.col("is_recurring").cast("long")).alias("recurring_count"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("total_credit") / (F.col("total_debit") + 1e-9)))
    return d.withColumns({"cashflow_ratio": ratio, "recurring_ratio": F.col("recurring_count") / (F.col("history_length") + 1e-9)})


def row_features(txns: DataFrame) -> DataFrame:
    """The full table: running features, merchant and user statistics, calendar parts.

    Merchants' statistics are joined before rows have features, and users' where the rows are by user
    anyway: rows move twice, by merchant and by user.
    """
    from ..functions.scalars import calendar

    stats = user_stats(txns).select("user_id", "history_length", "cashflow_ratio", "recurring_ratio")
    return running(merchant_stats(txns), hot=hot_users(txns, HOT_ROWS)).join(stats, "user_id", "left").withColumns(calendar())


def behaviour(txns: DataFrame) -> DataFrame:
    """A row a user: daily spend statistics, activity, weekend and night shares, entropies, income variation."""
    t = txns.withColumns({"day": F.col("timestamp").cast("date"), "weekend": (F.weekday("timestamp") >= 5).cast("int"), "night": ((F.hour("timestamp") >= 22) | (F.hour("timestamp") < 6)).cast("int")})
    debit, credit = F.when(F.col("direction") == "debit", F.col("amount")), F.when(F.col("direction") == "credit", F.col("amount"))
    daily = t.groupBy("user_id", "day").agg(F.coalesce(F.sum(debit), F.lit(0)).cast("double").alias("spend"), F.coalesce(F.sum(credit), F.lit(0)).cast("double").alias("income"), F.count("*").alias("n"), F.sum("weekend").alias("weekend"), F.sum("night").alias("night"))
    user = daily.groupBy("user_id").agg(
        F.avg("spend").alias("avg_daily_spend"), F.median("spend").alias("median_daily_spend"), F.stddev_samp("spend").alias("std_daily_spend"),
        (F.sum("n") / F.count("*")).alias("tx_per_active_day"), (F.sum("weekend") / F.sum("n")).alias("weekend_ratio"), (F.sum("night") / F.sum("n")).alias("night_ratio"),
        (F.stddev_samp("income") / (F.avg("income") + 1e-12)).alias("income_cv"),
        F.when(F.sum("income") > 0, (F.sum("income") - F.sum("spend")) / F.sum("income")).alias("savings_estimate"),
    )
    for name, key in (("merchant_entropy", "merchant_raw"), ("category_entropy", "category")):
        counts = t.groupBy("user_id", key).agg(F.count("*").alias("k"))
        total = counts.withColumn("p", F.col("k") / F.sum("k").over(W.partitionBy("user_id")))
        user = user.join(total.groupBy("user_id").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias(name)), "user_id", "left")
    return user


def leakage_audit(txns: DataFrame, cutoff: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows up to cutoff whose features differ when worked out without anything after it, by feature.

    Merchants' and users' statistics are held against each other a row a merchant and user, with the
    number of its rows up to cutoff. Running features are windows by user, over all rows and over
    those up to cutoff, in one exchange; users with more than hot_rows rows go by running() twice.
    txns is read four times.
    """
    past = F.col("timestamp") <= cutoff
    differs = lambda a, b: ~rnd(a, 3).eqNullSafe(rnd(b, 3))
    changed = lambda n, a, b: F.sum(differs(a, b).cast("long") * F.col("_past")).alias(n)
    rows = F.count(F.when(past, 1)).alias("_past")
    amount = F.col("amount").cast("double")
    on_past = lambda c: F.when(past, c)
    merchants = txns.groupBy("merchant_key").agg(rows, F.count("*").alias("n"), F.avg(amount).alias("a"), F.avg(on_past(amount)).alias("b")).where("_past > 0 AND merchant_key IS NOT NULL")
    merchants = merchants.agg(changed("merchant_frequency", F.col("n"), F.col("_past")), changed("merchant_mean_amount", F.col("a"), F.col("b")))
    users = txns.withColumn("_at", past)
    stats = user_stats(users).select("user_id", "history_length", "cashflow_ratio").join(user_stats(users.where("_at")).select("user_id", F.col("history_length").alias("_past"), F.col("cashflow_ratio").alias("b")), "user_id")
    stats = stats.agg(F.sum("_past").alias("rows"), changed("history_length", F.col("history_length"), F.col("_past")), changed("cashflow_ratio", F.col("cashflow_ratio"), F.col("b")))
    names = ("cumulative_spend", "user_mean_amount", "days_since_previous")
    hot = hot_users(txns, hot_rows)
    d, few = txns.select("user_id", "transaction_id", "timestamp", "amount", "direction"), txns
    many = hot.limit(1).count() > 0
    if many:
        few = d.join(F.broadcast(hot.select("user_id")), "user_id", "left_anti")
    both = _running_twice(few.select(*d.columns), past, names)
    if many:
        d = d.join(F.broadcast(hot.select("user_id")), "user_id")
        full, own = running(d, hot_rows).where(past), running(d.where(past), hot_rows)
        both = both.unionByName(full.select("user_id", "transaction_id", *names).join(own.select("user_id", "transaction_id", *[F.col(n).alias(f"_{n}") for n in names]), ["user_id", "transaction_id"]).drop("user_id", "transaction_id"))
    runs = both.agg(*[F.sum(differs(F.col(n), F.col(f"_{n}")).cast("long")).alias(n) for n in names])
    every = (*names, "merchant_frequency", "merchant_mean_amount", "history_length", "cashflow_ratio")
    one = runs.join(F.broadcast(merchants), F.lit(True)).join(F.broadcast(stats), F.lit(True))  # a row each
    one = one.select(F.coalesce("rows", F.lit(0)).alias("rows"), *every)
    return one.unpivot(["rows"], list(every), "feature", "changed").withColumn("leaks", F.col("changed") > 0)


def _running_twice(txns: DataFrame, past, names) -> DataFrame:
    """Of rows that are past, the running features over all rows, and as _<name> over past rows only."""
    base = ("user_id", "transaction_id", "timestamp", "amount", "direction")
    d = _running(txns).where(past).select(*base, *[F.col(n).alias(f"_{n}") for n in names])
    own = _running(d)
    return own.select(*[F.col(f"_{n}").alias(n) for n in names], *[F.col(n).alias(f"_{n}") for n in names])


def sequences(txns: DataFrame, vocabulary: DataFrame, length: int = 64, skip: int = 0) -> DataFrame:
    """A user's last rows as arrays: category ids, amounts and mask, padded on the right."""
    back = W.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc())
    d = txns.join(F.broadcast(vocabulary), "category").withColumn("back", F.row_number().over(back)).where((F.col("back") > skip) & (F.col("back") <= length + skip))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "category_id", F.col("amount").cast("double").alias("a"))))
    pad = lambda col, zero: F.concat(col, F.array_repeat(zero, length - F.size("_r")))
    d = d.groupBy("user_id").agg(rows.alias("_r"))
    return d.select(
        "user_id", pad(F.transform("_r", lambda r: r["category_id"]), F.lit(0)).alias("categories"), pad(F.transform("_r", lambda r: r["a"]), F.lit(0.0)).alias("amounts"),
        pad(F.transform("_r", lambda r: F.lit(True)), F.lit(False)).alias("mask"), F.size("_r").alias("n"),
    )


def category_ids(txns: DataFrame) -> DataFrame:
    """Categories numbered from 1 by name; 0 is padding. Distinct first: a dozen rows are ranked."""
    return txns.select("category").distinct().withColumn("category_id", F.row_number().over(W.orderBy("category")))
