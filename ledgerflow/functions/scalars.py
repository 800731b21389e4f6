"""Scalar column functions: calendar, merchant text, labels and formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payment noise in merchant names; not anchored, so it also eats these letters inside words.
NOISE = r"(?i)\s*(upi|ref|txn|pos|paytm\*|#)\s*\d*"


def rnd(value: Column, digits: int = 4) -> Column:
    """value rounded after a thousandth of the last digit is added, so that exact halves go one way.

    The nearest whole multiple in doubles, as round() in SQL engines; Spark's own goes through a
    decimal number for each value.
    """
    return F.rint((value + 0.00123 * 10.0**-digits) * 10.0**digits) / 10.0**digits + 0.0  # no minus zero


def cyclical(ts: str = "timestamp") -> dict[str, Column]:
    """sin and cos of hour / 24, weekday / 7 (Monday 0), (day - 1) / 31 and (month - 1) / 12."""
    parts = {"hour": F.hour(ts) / 24, "dow": F.weekday(ts) / 7, "dom": (F.dayofmonth(ts) - 1) / 31, "month": (F.month(ts) - 1) / 12}
    return {f"{k}_{f.__name__}": f(2 * math.pi * v) for k, v in parts.items() for f in (F.sin, F.cos)}


def calendar(ts: str = "timestamp") -> dict[str, Column]:
    return {
        "hour": F.hour(ts), "weekday": F.weekday(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"), "month_no": F.month(ts),
        "quarter": F.quarter(ts), "day": F.dayofmonth(ts), "is_salary_week": (F.dayofmonth(ts) <= 7).cast("int"),
    }


def month_start(ts: str = "timestamp") -> Column:
    return F.date_trunc("month", F.col(ts)).cast("date")


def month_angle(month: str = "month") -> dict[str, Column]:
    """Of month / 12, unlike cyclical()."""
    return {"moy_sin": F.sin(2 * math.pi * F.month(month) / 12), "moy_cos": F.cos(2 * math.pi * F.month(month) / 12)}


def merchant_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]", "_")


def clean_merchant(raw: Column) -> tuple[Column, Column, Column]:
    """(normalized, key, stage) of a merchant string."""
    trimmed = F.trim(raw)
    cleaned = F.trim(F.regexp_replace(trimmed, NOISE, ""))
    changed = (cleaned != "") & (cleaned != trimmed)
    name = F.when(changed, cleaned).otherwise(trimmed)
    return name, F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), "[^a-z0-9_]", ""), F.when(changed, "regex").otherwise("exact")


def resolver_form(text: Column) -> Column:
    """Lower case without UPI prefixes, reference and transaction numbers; ASCII letters and digits with single blanks."""
    t = F.regexp_replace(F.lower(text), r"upi/|ref\s*\d+|txn\s*\d+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def person_like(name: Column, business_tokens) -> Column:
    business = F.exists(F.array(*[F.lit(t) for t in business_tokens]), lambda t: F.contains(F.lower(F.trim(name)), t))
    letters = F.regexp_replace(name, " ", "")
    return ~business & letters.rlike(r"^\p{L}+$") & (F.length(letters) >= 5)


def payment_forms(text: Column) -> Column:
    """A description as statements show it: joined in upper case, joined, and with single blanks."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    joined = F.regexp_replace(t, "[ -]", "")
    return F.array(F.upper(joined), joined, t)


def router_weight(n: Column, half_life: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-(n - half_life) / 5))


def history_bucket(n: Column) -> Column:
    return F.when(n <= 5, "0-5").when(n <= 20, "6-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise("100+")


def hash_place(key: Column, seed: int) -> Column:
    """A seeded pseudo-random place, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", key, F.lit(str(seed))))


def hash_bucket(key: Column, seed: int, buckets: int = 10_000) -> Column:
    return (F.conv(F.substring(hash_place(key, seed), 1, 8), 16, 10).cast("long") % buckets).cast("int")
