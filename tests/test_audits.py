"""Audits and protocols that read the transactions few times, against the rows themselves."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import metrics as M
from ledgerflow.operators import rows as R
from ledgerflow.operators import splits as L
from ledgerflow.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"


def transactions(spark, n=60):
    rows = [(f"u{i % 3}", f"t{i:03}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i % 11), "credit" if i % 5 == 0 else "debit", f"m{i % 7 if i < 50 else 9}", i % 2 == 0, f"text {i % 4}", "ab"[i % 4 // 2]) for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, transaction_id string, timestamp timestamp, amount double, direction string, merchant_key string, is_recurring boolean, description string, category string").withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("merchant_raw", F.col("merchant_key"))


@pytest.mark.parametrize("hot_rows", [1000, 15])
def test_audit_equals_features_worked_out_twice(spark, hot_rows):
    t, cutoff = transactions(spark), "2024-01-14"
    full, past = (R.row_features(d).where(F.col("timestamp") <= cutoff) for d in (t, t.where(F.col("timestamp") <= cutoff)))
    both = full.alias("f").join(past.alias("p"), "transaction_id")
    got = {r.feature: r for r in R.leakage_audit(t, cutoff, hot_rows).collect()}
    assert len(got) == 7 and got["cumulative_spend"].changed == got["days_since_previous"].changed == 0
    for name, r in got.items():
        assert (r.rows, r.changed) == (both.count(), both.where(~F.round(f"f.{name}", 3).eqNullSafe(F.round(f"p.{name}", 3))).count())
        assert r.leaks == (r.changed > 0)


def test_audit_moves_rows_by_user_only(spark):
    """Rows are not joined by their ids, and the joined tables are not read again."""
    d = QUERIES["P5"](spark, SF)
    assert not any("lineitem" in f for f in d.inputFiles())
    text = d._jdf.queryExecution().optimizedPlan().toString()
    assert "(transaction_id#" not in "".join(x for x in text.splitlines() if "Join " in x)


def test_protocol_counts_are_the_protocols(spark):
    t = transactions(spark)
    columns = ["description", "category", "split"]
    counts = L.protocol_counts(t)
    for name, d in L.protocols(t).items():
        want = {tuple(r[c] for c in columns): r["count"] for r in d.groupBy(*columns).count().collect()}
        assert {tuple(r[c] for c in columns): r.rows for r in counts[name].groupBy(*columns).agg(F.sum("rows").alias("rows")).collect()} == want


def test_scores_of_counted_rows(spark):
    rows = [("a", "a", 3), ("a", "b", 1), ("b", "b", 2)]
    counted = spark.createDataFrame(rows, "y string, yhat string, rows long")
    single = spark.createDataFrame([(y, p) for y, p, n in rows for _ in range(n)], "y string, yhat string")
    assert M.classification(counted, rows="rows").first() == M.classification(single).first()
    assert M.modal(counted, "yhat", rows="rows").first().modal == "a"


def test_harness_reads_counts(spark):
    assert not any("lineitem" in f for f in QUERIES["E10"](spark, SF).inputFiles())
