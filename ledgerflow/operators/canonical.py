"""Raw feeds to canonical transactions: coercion, validation, labels, merchants, statements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_merchant, merchant_key, payment_forms, resolver_form
from ..functions.taxonomy import ALIASES, EXPENSE_CATEGORIES, INCOME

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("user_id", "transaction_id")]
    + [T.StructField("timestamp", T.TimestampType()), T.StructField("amount", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("direction", "merchant_raw", "merchant_normalized", "merchant_key", "description", "category", "source", "currency", "city", "state", "country")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.BooleanType()) for n in ("is_recurring", "is_transfer", "is_cash")]
)
DEFAULTS = {"category": "misc", "currency": "INR", "city": "", "state": "", "country": "IN"}


def canonicalize(df: DataFrame, source: str = "unknown") -> DataFrame:
    """The 19 canonical columns from any frame with user_id, amount and timestamp or date.

    Bad amounts count as 0, signs are dropped, rows without a time go, missing columns get defaults,
    others are left out; a missing id is made of the row's natural key.
    """
    have = set(df.columns)
    time = next((c for c in ("timestamp", "date") if c in have), None)
    if not {"user_id", "amount"} <= have or not time:
        raise ValueError(f"[{source}] needs user_id, amount, and timestamp or date")
    text = lambda c: F.col(c).cast("string")
    amount = F.abs(F.coalesce(F.expr("try_cast(amount AS double)"), F.lit(0.0)))
    ts = F.expr(f"try_cast(`{time}` AS timestamp)")
    if "direction" in have:
        direction = F.lower(text("direction"))
    elif "type" in have:
        direction = F.when(F.col("type") == "income", "credit").otherwise("debit")
    else:
        direction = F.lit("debit")
    raw = next((text(c) for c in ("merchant_raw", "merchant", "description") if c in have), F.lit(""))
    given = lambda c, other: text(c) if c in have else other
    made = F.substring(F.md5(F.concat_ws("_", text("user_id"), ts.cast("string"), amount.cast("string"), raw)), 1, 16)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False)
    out = {
        "user_id": text("user_id"), "transaction_id": given("transaction_id", made), "timestamp": ts, "amount": amount, "direction": direction, "merchant_raw": raw,
        "merchant_normalized": given("merchant_normalized", raw), "merchant_key": given("merchant_key", merchant_key(raw)), "description": given("description", raw),
        "source": given("source", F.lit(source)), **{c: given(c, F.lit(v)) for c, v in DEFAULTS.items()},
        "confidence": F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(1.0)) if "confidence" in have else F.lit(1.0),
        **{c: flag(c) for c in ("is_recurring", "is_transfer", "is_cash")},
    }
    return df.select(*[out[f.name].alias(f.name) for f in SCHEMA]).where(F.col("timestamp").isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """df with direction from the sign where missing, and an array of errors."""
    checks = F.array(
        F.when(F.col("user_id").isNull(), "missing user_id"), F.when(F.expr("try_cast(timestamp AS timestamp)").isNull(), "bad timestamp"),
        F.when(F.expr("try_cast(amount AS double)").isNull(), "bad amount"),
    )
    sign = F.when(F.expr("try_cast(amount AS double)") > 0, "credit").otherwise("debit")
    direction = F.coalesce(F.col("direction"), sign) if "direction" in df.columns else sign
    return df.withColumns({"direction": direction, "errors": F.filter(checks, lambda e: e.isNotNull())})


def union_sources(sources: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """One table of several sources by columns' names: user ids get the source's prefix, `source` its name; a column that one lacks is null there."""
    parts = [d.withColumns({"user_id": F.concat(F.lit(prefix), F.col("user_id").cast("string")), "source": F.lit(name)}) for name, (prefix, d) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_status(union: DataFrame, names: Sequence[str]) -> DataFrame:
    """(source, n, users, status) of each expected source, also of those without rows."""
    found = union.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    d = union.sparkSession.createDataFrame([(x,) for x in names], "source string").join(found, "source", "left").na.fill(0, ["n", "users"])
    return d.withColumn("status", F.when(F.col("n") > 0, F.format_string("OK (%d rows)", "n")).otherwise("EMPTY"))


def with_payment_forms(labelled: DataFrame) -> DataFrame:
    """(description, category) with each description also as statements write it, joined in upper case and joined; once each, longer than a letter."""
    forms = F.explode(F.concat(F.array("description"), F.slice(payment_forms(F.col("description")), 1, 2))).alias("description")
    return labelled.select(forms, "category").dropDuplicates().where("length(description) > 1")


def mapped(column: Column, values: Mapping[str, str]) -> Column:
    """The value of a fixed map, null if there is none: a literal map for equality look-ups."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


#: Tokens are found by one of their runs of so many letters.
GRAM = 4


def token_index(rules: DataFrame) -> DataFrame:
    """rules with gram: of each token's runs of GRAM letters (all of a shorter token), the one that fewest tokens have."""
    runs = F.expr(f"transform(sequence(1, greatest(1, length(token) - {GRAM - 1})), i -> substring(token, i, {GRAM}))")
    each = rules.select("rank", "token", "hit", F.explode(F.array_distinct(runs)).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("_n"))
    return each.join(common, "gram").groupBy("rank", "token", "hit").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))


def first_contained(df: DataFrame, column: str, rules: Sequence[tuple[int, str, str]] | DataFrame, out: str) -> DataFrame:
    """df with `out`: the hit of the rule of least rank whose token is contained in the lower-cased value; null if none.

    rules are (rank, token, hit), a list or a table of any size. Distinct values are looked up once:
    their runs of letters meet the tokens' by an equi-join, and only such pairs are verified. A null
    value has no rule; an empty token is in every value.
    """
    table = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame(list(rules), "rank int, token string, hit string")
    index = token_index(table.select("rank", "token", "hit"))
    keys = df.select(F.col(column).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_text", F.lower("_key"))
    runs = F.expr(f"array_distinct(flatten(transform(sequence(0, {GRAM}), n -> if(length(_text) < n, array(), transform(sequence(1, length(_text) - n + 1), i -> substring(_text, i, n))))))")
    found = keys.select("_key", "_text", F.explode(runs).alias("gram")).join(index, "gram").where(F.contains("_text", F.col("token")))
    return df.join(found.groupBy("_key").agg(F.min_by("hit", "rank").alias(out)), F.col(column) == F.col("_key"), "left").drop("_key")


def normalize_category(df: DataFrame, column: str, out: str = "category") -> DataFrame:
    """Exact alias, else the first alias contained, else a valid label, else misc."""
    key = F.lower(F.trim(F.col(column)))
    d = first_contained(df.withColumn("_label", key), "_label", [(i, *a) for i, a in enumerate(ALIASES)], "_contained")
    valid = F.when(F.col("_label").isin(*EXPENSE_CATEGORIES, INCOME), F.col("_label"))
    exact = dict(reversed(ALIASES))
    return d.withColumn(out, F.coalesce(mapped(F.col("_label"), exact), "_contained", valid, F.lit("misc"))).drop("_label", "_contained")


def merchant_map(txns: DataFrame) -> DataFrame:
    """merchant_raw, merchant_normalized, merchant_key, stage: worked out on distinct strings."""
    raw = txns.select("merchant_raw").where("trim(merchant_raw) <> ''").distinct()
    name, key, stage = clean_merchant(F.col("merchant_raw"))
    return raw.select("merchant_raw", name.alias("merchant_normalized"), key.alias("merchant_key"), stage.alias("stage"))


def resolve(queries: DataFrame, train: DataFrame) -> DataFrame:
    """merchant, resolved, state for queries against the merchants of train (merchant, first_seen).

    The exact string, else the first seen with the same normalized form: KNOWN_MERCHANT. Others stay
    as they are, and are UNKNOWN_MERCHANT. Blank merchants of train and empty forms match nothing.
    """
    vocabulary = train.where("trim(merchant) <> ''").groupBy("merchant").agg(F.min("first_seen").alias("first_seen"))
    forms = vocabulary.withColumn("form", resolver_form(F.col("merchant"))).where("form <> ''")
    forms = forms.groupBy("form").agg(F.min_by("merchant", F.struct("first_seen", "merchant")).alias("by_form"))
    d = queries.select("merchant").withColumn("form", resolver_form(F.col("merchant")))
    d = d.join(vocabulary.select("merchant", F.lit(True).alias("exact")), "merchant", "left").join(forms, "form", "left")
    known = F.coalesce(F.when(F.col("exact"), F.col("merchant")), "by_form")
    state = F.when(known.isNotNull(), "KNOWN_MERCHANT").otherwise("UNKNOWN_MERCHANT")
    return d.select("merchant", F.coalesce(known, "merchant", F.lit("UNKNOWN_MERCHANT_KEY")).alias("resolved"), state.alias("state"))


# The statement's line formats.
STATEMENT_DATE = r"^([A-Z][a-z]{2}\s\d{1,2},?\s\d{4})"
STATEMENT_ROW = r"^(Paid to|Received from|Sent to)\s+(.+?)\s+₹\s*([\d,]+\.?\d*)\s*(\d{2}:\d{2}:\d{2})?"


def statement_rows(lines: DataFrame) -> DataFrame:
    """Transactions of statement lines (doc_id, page, line_no, text); rejected ones have a reason."""
    from pyspark.sql import Window as W

    d = lines.withColumn("text", F.trim("text")).withColumn("found", F.nullif(F.regexp_extract("text", STATEMENT_DATE, 1), F.lit("")))
    so_far = W.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("day", F.last("found", ignorenulls=True).over(so_far)).where(F.col("text").rlike(STATEMENT_ROW))
    part = lambda k: F.regexp_extract("text", STATEMENT_ROW, k)
    clock = F.coalesce(F.nullif(part(4), F.lit("")), F.lit("00:00:00"))
    time = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace("day", ",", ""), clock), F.lit("MMM d yyyy HH:mm:ss"))
    return d.select(
        "doc_id", "page", "line_no", F.when(part(1) == "Received from", "credit").otherwise("debit").alias("direction"), F.trim(part(2)).alias("merchant_raw"),
        F.regexp_replace(part(3), ",", "").cast("decimal(18,2)").alias("amount"), F.when(F.col("day").isNotNull(), time).alias("timestamp"),
        F.when(F.col("day").isNull() | time.isNull(), "Missing or invalid timestamp").alias("rejected"),
    )


def reconcile(lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Extracted against printed totals by document: SUCCESS, FAILED or NO_STATEMENT_TOTALS."""
    printed = F.nullif(F.regexp_replace(F.regexp_extract("text", r"₹?\s*([\d,]+\.?\d*)", 1), ",", ""), F.lit("")).cast("decimal(18,2)")
    totals = lines.groupBy("doc_id").agg(*[F.max(F.when(F.col("text").rlike(p), F.struct("page", "line_no", printed.alias("v"))))["v"].alias(n) for n, p in (("debit_printed", "Total Debits|Total Withdrawals"), ("credit_printed", "Total Credits|Total Deposits"))])
    got = statement_rows(lines).where("rejected IS NULL").groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).alias(f"{d}_extracted") for d in ("debit", "credit")])
    d = totals.join(got, "doc_id", "left").fillna(0, ["debit_extracted", "credit_extracted"])
    off = lambda k: F.coalesce(F.abs(F.col(f"{k}_extracted") - F.col(f"{k}_printed")) > tolerance, F.lit(False))
    status = F.when(F.col("debit_printed").isNull() & F.col("credit_printed").isNull(), "NO_STATEMENT_TOTALS").when(off("debit") | off("credit"), "FAILED").otherwise("SUCCESS")
    return d.withColumn("status", status)
