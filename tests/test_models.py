"""How often trained models read their input, and what they hold of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import boosting, forest
from ledgerflow.operators import models as X
from ledgerflow.plans import model_queries as Q
from ledgerflow.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"


def counted(df, count):
    """df, whose rows count adds up each time they are worked out."""

    def rows(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    return df.mapInArrow(rows, df.schema)


def test_alike_rows_are_one_cell(spark, monkeypatch):
    """5000 rows of ten kinds are ten cells, and a tree of them is the tree of the rows."""
    seen = {}

    def kept(df, name):
        seen.setdefault(name, []).append(df.count())
        return df

    monkeypatch.setattr(boosting, "stored", kept)
    monkeypatch.setattr(boosting, "dropped", lambda df: None)
    d = spark.range(5000).select((F.col("id") % 10).cast("double").alias("p"), ((F.col("id") % 10) * 3 + F.col("id") % 7).cast("double").alias("target"))
    model = boosting.fit(d, ["p"], rounds=1, depth=1, rate=1.0, l2=0.0)
    assert seen["boosting-cells"] == [10]
    got = {r.p: r.prediction for r in model.transform(d.select("p").distinct()).collect()}
    low, high = (d.where(c).agg(F.avg("target")).first()[0] for c in ("p < 5", "p >= 5"))
    assert all(abs(v - (low if p < 5 else high)) < 1e-3 for p, v in got.items())


def test_buckets_without_a_word_go(spark):
    """Of 4096 buckets only those of words that tell rows apart are left."""
    from pyspark.ml import Pipeline

    d = spark.createDataFrame([("pos alpha", 1.0), ("pos beta", 2.0)], "text string, amount double")
    r = Pipeline(stages=X.behaviour_features(["amount"])).fit(d).transform(d).first()
    assert r.features.size == 3


def test_calibration_is_fitted_on_distinct_forecasts(spark, monkeypatch):
    sizes = []
    fit = X.IsotonicRegression.fit
    monkeypatch.setattr(X.IsotonicRegression, "fit", lambda self, d: sizes.append(d.count()) or fit(self, d))
    rows = [(float(i % 4), float((i * 7) % 5)) for i in range(400)]
    model = X.isotonic(spark.createDataFrame(rows, "p double, y double"), "p")
    means = [sum(y for p, y in rows if p == k) / 100 for k in range(4)]
    assert sizes == [4] and list(model.predictions) == pytest.approx([means[0]] * len(model.predictions))


@pytest.mark.parametrize("name", ["M2", "S16"])
def test_transactions_are_read_once(spark, monkeypatch, name):
    count, rows = spark.sparkContext.accumulator(0), Q.canonical_txns(spark, SF)
    monkeypatch.setattr(Q, "canonical_txns", lambda s, d: counted(rows, count))
    QUERIES[name](spark, SF).count()
    assert count.value == rows.count()


def test_profiles_are_made_once(spark, monkeypatch):
    count, panel = spark.sparkContext.accumulator(0), Q.panel(spark, SF)
    monkeypatch.setattr(Q, "panel", lambda s, d: counted(panel, count))
    QUERIES["M14"](spark, SF).count()
    assert count.value == panel.count()


@pytest.mark.parametrize("name", ["L7", "B10"])
def test_last_months_are_found_before_rows_multiply(spark, name):
    """No window stands over the rows by category."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    by_category = max(plan.rfind("Generate explode(array(struct(category"), plan.find("Generate explode([food_dining"))
    assert by_category > 0 and "Window [" not in plan[:by_category].split("Join Inner")[-1]


def test_forest_reads_its_rows_a_fixed_number_of_times(spark, monkeypatch):
    """M10's forest reads rows twice, for bins and for cells, however many trees and levels; alike rows are one cell with their number."""
    seen = {}

    def kept(df, name):
        rows = df.collect()
        seen[name] = rows
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(forest, "stored", kept)
    monkeypatch.setattr(forest, "dropped", lambda df: None)
    count = spark.sparkContext.accumulator(0)
    d = spark.range(5000).select(*[(F.col("id") % 10).cast("double").alias(c) for c in X.FRAME], (F.col("id") % 7).cast("double").alias("target"))
    X.forest_regressor(counted(d, count), trees=5)
    assert count.value == 2 * 5000
    assert len(seen["forest-cells"]) == 70 and sum(r.n for r in seen["forest-cells"]) == 5000


def test_forest_is_as_near_as_sparks_and_the_same_again(spark):
    from pyspark.ml.regression import RandomForestRegressor

    x = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("double").alias(f"c{i}")
    columns = [f"c{i}" for i in range(6)]
    d = spark.range(4000).select("id", *[x(i) for i in range(6)]).withColumn("target", F.col("c0") + F.when(F.col("c1") > 20, 3 * F.col("c2")).otherwise(0.0) + F.col("c5") * F.col("c4") / 50)
    train, test = d.where("id % 4 != 0").cache(), d.where("id % 4 = 0").cache()
    error = lambda p: p.agg(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))).first()[0]
    one, two = (forest.fit(train, columns, trees=30, depth=6) for _ in range(2))
    theirs = RandomForestRegressor(labelCol="target", numTrees=30, maxDepth=6, maxBins=64, seed=42).fit(X.assembled(train, columns))
    assert error(one.transform(test)) < 1.05 * error(theirs.transform(X.assembled(test, columns)))
    assert all((a[2] == b[2]).all() for a, b in zip(one.trees, two.trees))
    kept = {i for feature, *_ in one.trees for i in feature[0, :1]}
    assert len(kept) > 1 and abs(sum(v for _, v in one.importances()) - 1) < 1e-9


def test_forest_of_constants_nulls_and_nothing(spark):
    d = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (float("nan"), 5.0), (2.0, None)], "a double, target double")
    assert {round(r.prediction, 3) for r in forest.fit(d, ["a"], trees=20).transform(d).collect()} == {5.0}
    assert [r.prediction for r in forest.fit(d.where("false"), ["a"]).transform(d).collect()] == [0.0] * 4


def test_importance_scores_a_row_once_for_a_linear_model(spark, monkeypatch):
    """The arms of a linear model are moved predictions, and as any other model's by scoring every arm."""
    x = lambda i: F.when(F.col("id") % 9 != i, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40))).cast("double")
    d = spark.range(300).select(F.col("id").cast("string").alias("user_id"), F.lit("c").alias("category"), F.lit("m").alias("month"), x(0).alias("a"), x(1).alias("b"))
    d = d.withColumn("target", 3 * F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) + F.col("user_id").cast("int") % 3)
    model = X.regressor().fit(X.assembled(d, ["a", "b"]))
    sizes, assembled = [], X.assembled
    monkeypatch.setattr(X, "assembled", lambda df, columns: sizes.append(df.count()) or assembled(df, columns))
    other = type("Other", (), {"transform": lambda self, df: model.transform(df)})()
    got, plain = ({r.feature: r.importance for r in X.permutation_importance(m, d, ["a", "b"], rows_a_block=100).collect()} for m in (model, other))
    assert sizes == [300, 300 * (1 + 5 * 2)]
    assert got == pytest.approx(plain) and 0 < got["b"] < got["a"]


def test_tasks_add_alike_rows_up_before_a_shuffle(spark):
    """A task hands on a cell for rows that are alike in every bin."""
    d = spark.range(5000).select(F.lit("g").alias("grp"), (F.col("id") % 10).cast("double").alias("p"), (F.col("id") % 7).cast("double").alias("target"))
    rows = boosting.numbers(d, "grp", "target", ["p"]).toArrow().to_batches(500)
    known, edges = boosting.quantile_bins(boosting.numbers(d, "grp", "target", ["p"]), 1)
    cells = [c for b in boosting._Binned({"g": 0}, [edges["g"]], boosting.np.array([False]), 1.0)(iter(rows)) for c in b.to_pylist()]
    assert len(cells) == 10 and sum(c["n"] for c in cells) == 5000 and sum(c["y"] for c in cells) == sum(i % 7 for i in range(5000))
    assert known["g"][0] == 5000


def test_forecasts_in_the_queries_have_all_rounds(spark, monkeypatch):
    """B9_model's and B10_model's forecaster may grow the 300 rounds that the operator has by default."""
    seen = []
    frame = spark.createDataFrame([("u", "2024-01-01", "misc", 1.0, s, *[0.0] * len(X.FRAME)) for s in ("train", "test")], ["user_id", "month", "category", "target", "split", *X.FRAME])
    monkeypatch.setattr(Q, "frame", lambda s, d: frame)
    fitted = X.forecaster
    monkeypatch.setattr(X, "forecaster", lambda d, **more: seen.append(more.get("rounds", 300)) or fitted(d, **more))
    Q.backtest(spark, SF).collect()
    assert seen == [300]


def test_boosted_classes_equal_sparks_one_against_the_rest(spark):
    """Trees of all classes in shared jobs label rows as Spark's boosting of a class at a time does."""
    x = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    d = spark.range(1200).select(x(1, 7).alias("a"), x(2, 20).cast("double").alias("p"), x(3, 15).cast("double").alias("q"))
    d = d.withColumns({"text": F.concat(F.lit("pos shop"), "a"), "label": F.when(F.col("a") < 2, "food").when((F.col("p") > 11) & (F.col("q") < 8), "rent").otherwise("misc")})
    train = X.balanced(d).localCheckpoint()
    model = X.boosted_categorizer(train, ["p", "q"], rounds=3)
    theirs = X.categorizer("boosted", X.behaviour_features(["p", "q"]), 3).fit(train)
    ours, plain = (sorted((r.text, r.label, r.yhat) for r in p.select("text", "label", "yhat").collect()) for p in (model.transform(d), X.predict(theirs, d.withColumn("weight", F.lit(1.0)))))
    assert model.rounds == 3 and ours == plain and all(label == yhat for _, label, yhat in ours)


def test_boosted_classes_of_nothing_and_of_one(spark):
    d = spark.createDataFrame([(None, "a", 1.0, None), ("x x", "a", 1.0, 2.0), ("y", None, 1.0, 2.0)], "text string, label string, weight double, p double")
    assert {r.yhat for r in X.boosted_categorizer(d, ["p"], rounds=2).transform(d).collect()} == {"a"}
    assert X.boosted_categorizer(d.where("false"), ["p"]).rounds == 0


def test_m7_has_all_rounds(spark, monkeypatch):
    seen, fitted = [], X.boosted_categorizer
    monkeypatch.setattr(X, "boosted_categorizer", lambda d, **more: seen.append(more.get("rounds", 100)) or fitted(d, **{**more, "rounds": 1}))
    assert QUERIES["M7"](spark, SF).count() == 1 and seen == [100]


def test_routers_join_the_transactions_once_and_move_none_for_cohorts(spark, monkeypatch):
    """B11 works its transactions out for the cut and for one written table; every count reads that."""
    from ledgerflow.plans import metric_queries as E

    count, rows = spark.sparkContext.accumulator(0), E.canonical_txns(spark, SF).localCheckpoint()
    monkeypatch.setattr(E, "canonical_txns", lambda s, d: counted(rows, count))
    monkeypatch.setattr(E.L, "_by_time", lambda df, fractions: F.when(F.col("timestamp") < "1997-01-01", "train").otherwise("test"))
    QUERIES["B11"](spark, SF).collect()
    assert count.value == rows.count()
