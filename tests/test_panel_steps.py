"""How the panel's steps are worked out: their tasks, orders and what they leave out; results against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import scalars as S
from ledgerflow.operators import panel as P
from ledgerflow.operators import splits as L
from ledgerflow.plans.registry import QUERIES, load
from ledgerflow.sources.views import canonical_txns

load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def wide_panel(spark, rows):
    """(user, month number, food_dining, income) as a panel."""
    d = spark.createDataFrame([(u, dt.date(2024, m, 1), None if v is None else float(v), 100.0) for u, m, v in rows], "user_id string, month date, food_dining double, income double")
    return d.withColumns({**{c: F.lit(1.0) for c in P.EXPENSE_CATEGORIES if c != "food_dining"}, "total_expense": F.lit(1.0)})


def test_rounding_needs_no_decimals(spark):
    values = [0.12345, -0.12345, 1 / 3, -0.00001, 2.5, 123456789.987654321, float("nan"), float("inf"), None]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.rnd(F.col("v")).alias("new"), F.round(F.col("v") + 0.00123e-4, 4).alias("old"))
    assert all(r.new == r.old or math.isnan(r.new) and math.isnan(r.old) for r in d.collect())
    assert math.copysign(1.0, [r.new for r in d.collect() if r.v == -0.00001][0]) == 1.0
    assert "round(" not in plan(d.select("new").limit(1))


def test_frame_rolls_without_sliding_windows(spark):
    values = [10, 0.1, 0.1, 0.1, None, 7, 5]
    f = P.forecast_frame(wide_panel(spark, [("u", i + 1, v) for i, v in enumerate(values)]))
    assert "stddev_samp" not in plan(f)
    got = {r.month.month: (r.roll_mean_3, r.roll_std_3) for r in f.where("category = 'food_dining'").collect()}
    for i in range(len(values)):
        past = [v for v in values[max(0, i - 3) : i] if v is not None]
        want = (sum(past) / len(past) if past else 0.0, statistics.stdev(past) if len(past) > 1 else 0.0)
        assert got[i + 1] == pytest.approx(want, abs=1e-12)
    assert got[5][1] == 0.0  # three equal months deviate by nothing at all


def test_frame_leaves_out_what_nobody_reads(spark):
    f = P.forecast_frame(wide_panel(spark, [("u", 1, 1)]))
    assert "lag(" not in plan(f.select("user_id", "month", "category"))
    one = plan(f.select("user_id", "category", "lag_1"))
    assert "_1#" in one and "lag(food_dining#" in one and ", -3, null" not in one


def test_panel_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 500)
    t = canonical_txns(spark, SF)
    n = t.count()
    p = P.monthly_panel(t, n, back=True)
    assert p.rdd.getNumPartitions() == -(-n // 500)
    whole = P.recent_months(P.monthly_panel(t))
    columns = sorted(p.columns)
    assert p.select(columns).exceptAll(whole.select(columns)).count() == whole.select(columns).exceptAll(p.select(columns)).count() == 0


def test_baselines_order_no_months(spark):
    """Months count back from the user's last one, which the panel knows before its empty months are made."""
    p = P.baselines(P.monthly_panel(canonical_txns(spark, SF), 1000, back=True))
    assert "row_number()" not in plan(p) and plan(p).count("Generate") == 1


def test_income_is_filled_in_one_pass(spark):
    assert "0, unboundedfollowing" not in plan(P.fill_within(wide_panel(spark, [("u", 1, 1)]), "income")).replace("currentrow$()", "0").lower().replace("unboundedfollowing$()", "unboundedfollowing")
    d = spark.createDataFrame([("u", 1, None), ("u", 2, 5.0), ("u", 3, None), ("u", 4, 7.0), ("v", 1, None)], "user_id string, month int, income double")
    assert sorted(tuple(r) for r in P.fill_within(d, "income").where("income IS NOT NULL").collect()) == [("u", 1, 5.0), ("u", 2, 5.0), ("u", 3, 5.0), ("u", 4, 7.0)]


def test_profiles_meet_months_not_categories(spark):
    """J1 joins a user's profile to its months, before rows multiply by category."""
    text = plan(QUERIES["J1"](spark, SF))
    assert text.index("Expand") < text.index("Join")


def test_seasonal_naive_joins_nothing_back(spark):
    rows = [("u", m, 10 * m) for m in range(1, 13)]
    d = wide_panel(spark, rows).unionByName(wide_panel(spark, [("u", 1, 99)]).withColumn("month", F.lit(dt.date(2025, 1, 1))))
    f = P.seasonal_naive(d, "2024-12-01").where("category = 'food_dining'")
    assert {str(r.month): r.forecast for r in f.collect()} == {"2024-12-01": 110.0, "2025-01-01": 10.0}
    panel_joins = plan(P.monthly_panel(canonical_txns(spark, SF))).count("Join ")
    assert plan(QUERIES["J9"](spark, SF)).count("Join ") == panel_joins


def test_month_cutoff_reads_months_once(spark):
    count = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    d = wide_panel(spark, [("u", m, 1) for m in range(1, 11)])
    s = L.month_cutoff(d.mapInArrow(rows, d.schema))
    assert count.value == 10
    assert {r.month.month for r in s.where("split = 'test'").collect()} == {9, 10} and count.value == 20
    assert L.month_cutoff(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["E6", "J10", "B2"])
def test_transactions_are_read_once(spark, name):
    """What is joined or ranked comes from a written step, not from the transactions again."""
    assert not any("lineitem" in f for f in QUERIES[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["W15", "M8"])
def test_rows_with_features_move_once_by_user(spark, name):
    """Users' statistics meet the rows where the windows left them: by user are the rows and the statistics, nothing else."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(user_id") == 2
