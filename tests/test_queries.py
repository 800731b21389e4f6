"""Queries against their SQL on the smallest tables, and hand-computed cases of rules that are easy to get wrong."""

from __future__ import annotations

import datetime as dt
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import canonical as C
from ledgerflow.operators import drift as D
from ledgerflow.operators import metrics as M
from ledgerflow.operators import panel as P
from ledgerflow.operators import recommend as B
from ledgerflow.functions import scalars as S
from ledgerflow.operators import rows as R
from ledgerflow.operators import splits as L
from ledgerflow.plans.registry import ORACLE_SQL, QUERIES, load

load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family; the driver compares all of them.
NAMES = ["A2", "A3", "W6", "W11", "W15", "W8", "P5", "F13", "L2", "L3", "P11", "S7", "S5", "S6", "F7", "J8", "E1", "E9", "M15", "D5", "B4", "B6", "B8", "R2"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    clean = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = lambda xs: sorted((tuple(clean(v) for v in x) for x in xs), key=repr)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want)


def panel_of(spark, values, category="food_dining"):
    return spark.createDataFrame([("u", dt.date(2024, i + 1, 1), category, float(v), 100.0, float(v)) for i, v in enumerate(values)], "user_id string, month date, category string, target double, income double, total_expense double")


def test_merchant_cleaning(spark):
    d = spark.createDataFrame([(x,) for x in ("PAYTM*Swiggy order", "Amazon purchase", "Starbucks #1234", "SIP deposit")], "merchant_raw string")
    got = {r[0]: tuple(r)[1:] for r in C.merchant_map(d).collect()}
    assert got["PAYTM*Swiggy order"] == ("Swiggy order", "swiggy_order", "regex")
    assert got["Amazon purchase"] == ("Amazon purchase", "amazon_purchase", "exact")
    assert got["Starbucks #1234"] == ("Starbucks", "starbucks", "regex")
    assert got["SIP deposit"] == ("SIP deit", "sip_deit", "regex")


def test_label_normalization(spark):
    d = spark.createDataFrame([(None,), ("Food & Dining",), ("Travel Insurance",), ("gadgets",)], "label string")
    got = {r["label"]: r["category"] for r in C.normalize_category(d, "label").collect()}
    assert got == {None: "misc", "Food & Dining": "food_dining", "Travel Insurance": "transportation", "gadgets": "misc"}


def test_resolver(spark):
    train = spark.createDataFrame([("Starbucks Store 12", 1), ("UBER EATS", 2)], "merchant string, first_seen int")
    got = {r["merchant"]: (r["resolved"], r["state"]) for r in C.resolve(spark.createDataFrame([("uber eats txn12345",), ("Amazon India",)], "merchant string"), train).collect()}
    assert got == {"uber eats txn12345": ("UBER EATS", "KNOWN_MERCHANT"), "Amazon India": ("Amazon India", "UNKNOWN_MERCHANT")}


def test_resolver_forms(spark):
    forms = {"Café_Noir  REF 12": "caf noir", "UPI/Shop#7 txn99": "shop 7", "###": "", "UNKNOWN": "unknown"}
    d = spark.createDataFrame([(k,) for k in forms], "m string")
    assert {r.m: r.f for r in d.select("m", S.resolver_form(F.col("m")).alias("f")).collect()} == forms
    train = spark.createDataFrame([("UNKNOWN", 1), ("###", 2), ("  ", 3)], "merchant string, first_seen int")
    got = {r["merchant"]: (r["resolved"], r["state"]) for r in C.resolve(spark.createDataFrame([("unknown",), ("!!!",), ("UNKNOWN",)], "merchant string"), train).collect()}
    assert got == {"unknown": ("UNKNOWN", "KNOWN_MERCHANT"), "!!!": ("!!!", "UNKNOWN_MERCHANT"), "UNKNOWN": ("UNKNOWN", "KNOWN_MERCHANT")}


def test_health_counts_transport_as_essential(spark):
    spent = {"housing": 300.0, "utilities": 100.0, "groceries": 200.0, "healthcare": 50.0, "transportation": 150.0}
    rows = [("u", 2000.0, total, *(spent.get(c, 0.0) for c in P.EXPENSE_CATEGORIES)) for total in (1000.0, 1600.0)]
    d = spark.createDataFrame(rows, "user_id string, income double, total_expense double, " + ", ".join(f"{c} double" for c in P.EXPENSE_CATEGORIES))
    r = B.health_v1(d).first()
    # nets 1000 and 400: deviation 300 of 2000; both positive; 800 of 2000 essential
    assert [round(x, 6) for x in (r.stability, r.consistency, r.essential, r.overall)] == [85.0, 100.0, 60.0, 83.5]


def test_term_frequencies_are_logarithmic(spark):
    from pyspark.ml import Pipeline

    from ledgerflow.operators import models as X

    d = spark.createDataFrame([("tea tea tea milk",), ("tea milk",)], "text string")
    model = Pipeline(stages=X.text_features()).fit(d)
    vector = model.transform(d).first()["grams_tf"]
    assert sorted(round(x, 6) for x in vector.values) == sorted([round(1 + math.log(3), 6), 1.0, 1.0])


def test_same_harness_under_noise(spark):
    rows = [(str(i), f"u{i % 7}", f"m{i % 10}", f"m{i % 10}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "Big Shop" if i % 2 else "Small Cafe", "shopping" if i % 2 else "food_dining") for i in range(400)]
    t = spark.createDataFrame(rows, "transaction_id string, user_id string, merchant_key string, merchant_raw string, timestamp timestamp, description string, category string")

    def fit(train):
        return M.modal(train, "category", "description").select("description", F.col("modal").alias("m"))

    def predict(model, test):
        return test.join(model, "description", "left").select(F.col("category").alias("y"), F.coalesce("m", F.lit("none")).alias("yhat"))

    got = {r.protocol: r.accuracy for r in M.harness(L.protocols(t), fit, predict).collect()}
    assert got["temporal"] == got["merchant_disjoint"] == got["novel_merchant"] == 1.0 and 0.5 < got["noisy"] < 1.0


def test_files_of_each_kind(spark, tmp_path):
    from ledgerflow.sources import files

    one = {"user_id": "u", "timestamp": "2024-01-01", "amount": "1"}
    (tmp_path / "a.json").write_text(json.dumps([one, {**one, "amount": "2"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"transactions": [{**one, "amount": "3"}]}, indent=1))
    (tmp_path / "d.csv").write_text("user_id,timestamp,amount\nu,2024-01-01,4\n")
    (tmp_path / "e.tsv").write_text("user_id\ttimestamp\tamount\nu\t2024-01-01\t5,5\n")
    (tmp_path / "f.csv").write_text(" User ID ,Timestamp, Amount\nu,2024-01-01,6\n")
    assert sorted(r.amount for r in files.read_json(spark, f"file://{tmp_path}/a.json").collect()) == ["1", "2"]
    assert [r.amount for r in files.read_json(spark, f"file://{tmp_path}/b.json").collect()] == ["3"]
    assert [r.user_id for r in files.read_csv(spark, f"file://{tmp_path}/f.csv", cleanup=True).collect()] == ["u"]
    (tmp_path / "f.csv").unlink()
    (tmp_path / "b.json").unlink()
    assert sorted(r.amount for r in files.read_folder(spark, f"file://{tmp_path}").collect()) == ["1", "2", "4", "5,5"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_folder(spark, f"file://{tmp_path}/none")


def test_stratified_cuts_each_label(spark):
    d = spark.createDataFrame([(str(i), "a" if i % 3 else "b") for i in range(1000)], "k string, label string")
    n = {(r.label, r.split): r.n for r in L.stratified(d, "label", "k").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {("a", "train"): 532, ("a", "test"): 134, ("b", "train"): 267, ("b", "test"): 67}


def test_missing_columns_fail(spark):
    for cols in ("user_id string, amount string", "amount string, timestamp string", "user_id string, timestamp string"):
        with pytest.raises(ValueError):
            C.canonicalize(spark.createDataFrame([], cols))


def test_lags_and_deviations(spark):
    d = panel_of(spark, [100, 0, 50, 150])
    wide = d.groupBy("user_id", "month", "income", "total_expense").pivot("category", ["food_dining"]).agg(F.sum("target"))
    wide = wide.withColumns({c: F.lit(0.0) for c in P.EXPENSE_CATEGORIES if c != "food_dining"})
    last = P.forecast_frame(wide).where("category = 'food_dining'").orderBy(F.col("month").desc()).first()
    assert (last.lag_1, last.lag_2, last.lag_3, last.roll_mean_3, last.roll_std_3) == (50, 0, 100, 50, 50)
    s = P.serving_frame(wide).where("category = 'food_dining'").first()
    assert (s.lag_1, round(s.roll_mean_3, 4), round(s.roll_std_3, 4)) == (150, 66.6667, 62.361)


def test_trailing_window_is_half_open(spark):
    d = spark.createDataFrame([("u", "a", dt.datetime(2024, 1, 1)), ("u", "b", dt.datetime(2024, 1, 8))], "user_id string, transaction_id string, timestamp timestamp")
    assert [r.tx_count_7d for r in R.trailing_counts(d).orderBy("transaction_id").collect()] == [1, 1]


def test_smoothing(spark):
    assert abs(P.exponential_smoothing(panel_of(spark, [10, 20, 40])).first().forecast - 21.1) < 1e-9


@pytest.mark.parametrize("flex, cuts", [([800, 500, 300, 40, 30], [720, 500, 280]), ([800, 500, 40, 30, 10], [720, 500])])
def test_reallocation(spark, flex, cuts):
    """The gap is 1500; a cut is 40% of the forecast at most, and over 0.5% of the income."""
    names = ["food_dining", "shopping", "entertainment", "subscriptions", "misc"]
    rows = [("u", c, float(f), 0.0, 1800.0, 10000.0, 12) for c, f in zip(names, flex)]
    d = spark.createDataFrame(rows, "user_id string, category string, std double, mean double, forecast double, income double, n_months int")
    assert [round(r.cut, 6) for r in B.reallocation(d).orderBy(F.col("cut").desc()).collect()] == cuts


def test_classification(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, yhat string")
    r = M.classification(d).first()
    assert [round(x, 4) for x in (r.accuracy, r.macro_precision, r.macro_recall, r.macro_f1, r.weighted_f1, r.balanced_accuracy)] == [0.5, 0.4444, 0.5, 0.3889, 0.4583, 0.5]


def test_regression(spark):
    d = spark.createDataFrame([(100.0, 80.0), (0.0, 10.0), (50.0, 50.0)], "y double, yhat double")
    r = M.regression(d).first()
    assert [round(x, 4) for x in (r.mae, r.rmse, r.mape, r.wape, r.smape, r.r2)] == [10, 12.9099, 0.1, 0.2, 0.7407, 0.9]


def test_drift(spark):
    rows = [("a", 0.0, 2), ("a", 10.0, 2), ("b", 0.0, 1), ("b", 10.0, 3)]
    v = spark.createDataFrame(rows, "period string, value double, n long")
    assert round(D.psi(v, "a").first().psi, 4) == 0.2747
    assert round(D.wasserstein(v, "a").first().wasserstein, 4) == 2.5
    assert round(D.kl(v.withColumn("category", F.col("value").cast("string")).drop("value"), "a").first().kl, 4) == 0.1438


def test_health_total_rounds_as_its_sql(spark):
    """25 + 12.04995 is rounded after the nudge, as every compared value is."""
    shares = ", ".join(f"{0.6 if c == 'groceries' else 0.4 if c == 'shopping' else 0.0}D AS share_{c}" for c in P.EXPENSE_CATEGORIES)
    profile = spark.sql(f"SELECT 'u' AS user_id, 0.2D AS savings_rate, 1D AS volatility, {shares}")
    assert B.health_v2(profile, spark.sql("SELECT 'u' AS user_id, 1.204995D AS cashflow_ratio")).first().total == 37.1
