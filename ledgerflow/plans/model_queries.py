"""Trained models, ablations and robustness over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import hash_bucket, rnd
from ..operators import metrics as M
from ..operators import models as X
from ..operators import panel as P
from ..operators import rows as R
from ..operators import splits as L
from ..sources.files import stored
from ..sources.views import canonical_txns, table
from .panel_queries import FRAME, PROFILE_COLS, _sql, panel, rounded
from .registry import register



def labelled(spark, sf_dir):
    """(text, label, count) of distinct descriptions, so that training grows with distinct texts; a fifth is test. Written, as training reads them often."""
    d = canonical_txns(spark, sf_dir).groupBy(F.col("description").alias("text"), F.col("category").alias("label")).count()
    return stored(d.withColumn("test", hash_bucket(F.concat("text", "label"), 42, 5) == 0), "labelled")


def behavioural(spark, sf_dir):
    """(text, label, behavioural columns) of every transaction, written; the same fifth of texts is test."""
    d = R.row_features(canonical_txns(spark, sf_dir)).withColumns({"text": F.col("description"), "label": F.col("category")})
    return stored(d.withColumn("test", hash_bucket(F.concat("text", "label"), 42, 5) == 0).select("text", "label", "test", *X.BEHAVIOUR), "behavioural")


#: Boosting rounds in the queries: a class of M7, the regressor, the forecaster. The operators' own are
#: 100, 100 and 300; README has the reason and the figures.
ROUNDS, REGRESSOR_ROUNDS, FORECAST_ROUNDS = 100, 30, 300


def _fit(spark, sf_dir, kind, features=None):
    d = behavioural(spark, sf_dir) if kind in ("forest", "boosted") else labelled(spark, sf_dir)
    if kind == "boosted":
        model = X.boosted_categorizer(X.balanced(d.where("NOT test")), rounds=ROUNDS)
        return model, model.transform(d.where("test"))
    model = X.categorizer(kind, features, 100).fit(X.balanced(d.where("NOT test")))
    return model, X.predict(model, d.where("test").withColumn("weight", F.lit(1.0)))


def _scores(out):
    return rounded(M.classification(out.select(F.col("label").alias("y"), "yhat")))


@register("M1")
def m1(spark, sf_dir):
    """The fitted TF-IDF features: how many are set, and their length, by text."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    d = labelled(spark, sf_dir).select("text").distinct()
    v = vector_to_array("features")
    out = Pipeline(stages=X.text_features()).fit(d).transform(d)
    return out.select("text", F.size(F.filter(v, lambda x: x != 0)).alias("terms"), rnd(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@register("M2")
def m2(spark, sf_dir):
    return _fit(spark, sf_dir, "logistic")[1].select("text", "label", "yhat", rnd(F.col("confidence")).alias("confidence"))


@register("M3")
def m3(spark, sf_dir):
    """Text beside a dense vector: documents' language, with the embedding whose number is the document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = X.with_vector(docs.join(emb, "doc_id").where("text IS NOT NULL"))
    d = X.balanced(d).withColumn("test", hash_bucket(F.col("doc_id").cast("string"), 42, 5) == 0)
    out = X.predict(X.categorizer("logistic", X.hybrid_features()).fit(d.where("NOT test")), d.where("test"))
    return _scores(out)


register("M5")(lambda s, d: _scores(_fit(s, d, "svm")[1]))
register("M6")(lambda s, d: _scores(_fit(s, d, "forest")[1]))
register("M7")(lambda s, d: _scores(_fit(s, d, "boosted")[1]))


def frame(spark, sf_dir):
    return P.forecast_frame(L.last_month(panel(spark, sf_dir)), keep=("split",))


@register("M8")
def m8(spark, sf_dir):
    """The behavioural columns as one vector, by transaction."""
    from pyspark.ml.functions import vector_to_array

    d = X.assembled(R.row_features(canonical_txns(spark, sf_dir)), X.BEHAVIOUR)
    v = vector_to_array("features")
    return d.select("transaction_id", F.size(v).alias("n_features"), rnd(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@register("M10")
def m10(spark, sf_dir):
    """Errors of the linear, forest and boosted regressors on each user's last month."""
    d = stored(frame(spark, sf_dir), "regressor-frame")
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    fitted = {"linear": X.regressor().fit(X.assembled(train)), "forest": X.forest_regressor(train), "boosted": X.boosted_regressor(train, rounds=REGRESSOR_ROUNDS)}
    out = None
    for kind, model in fitted.items():
        p = model.transform(X.assembled(test) if kind == "linear" else test)
        r = M.regression(p.select(F.col("target").alias("y"), F.greatest("prediction", F.lit(0.0)).alias("yhat"))).withColumn("model", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


_CORR = ", ".join(f"('{c}', (SELECT abs(corr({c}, target)) FROM frame))" for c in X.FRAME)


@register("T3", _sql(FRAME, f", fi AS (SELECT * FROM (VALUES {_CORR}) t(feature, importance)) SELECT feature, round(importance, 4) AS importance FROM fi ORDER BY importance DESC LIMIT 15"))
def t3(spark, sf_dir):
    """The features that go most with the target, by correlation."""
    d = P.forecast_frame(panel(spark, sf_dir)).agg(*[F.abs(F.corr(c, "target")).alias(c) for c in X.FRAME])
    return rounded(d.select(F.lit(0).alias("i"), "*").unpivot(["i"], X.FRAME, "feature", "importance").drop("i").orderBy(F.col("importance").desc()).limit(15))


@register("T3_boosted")
def t3_boosted(spark, sf_dir):
    """The most important features of the boosted regressor."""
    d = stored(frame(spark, sf_dir), "importances-frame")
    scores = X.boosted_regressor(d.where("split = 'train'"), rounds=REGRESSOR_ROUNDS).importances()
    return rounded(spark.createDataFrame(scores, "feature string, importance double").orderBy(F.col("importance").desc()).limit(15))


@register("M11")
def m11(spark, sf_dir):
    p = stored(panel(spark, sf_dir), "forecast-panel")
    out = X.forecast(X.forecaster(P.forecast_frame(p), rounds=FORECAST_ROUNDS), P.serving_frame(p))
    return out.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.round("forecast", 2)))))).alias("forecast"))


def backtest(spark, sf_dir):
    """Every user's last month with y, the naive and rolling forecasts and the fitted forecaster's."""
    d = stored(frame(spark, sf_dir), "backtest-frame")
    out = X.forecaster(d.where("split = 'train'"), rounds=FORECAST_ROUNDS).transform(d.where("split = 'test'"))
    return out.select("user_id", "category", "target", "lag_1", "roll_mean_3", "roll_std_3", F.greatest("prediction", F.lit(0.0)).alias("model"))


@register("B10_model")
def b10_model(spark, sf_dir):
    """The backtest report with the fitted forecaster beside the naive and rolling forecasts."""
    from .metric_queries import _skill

    arms = F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).alias("yhat")) for n, c in (("model", "model"), ("naive", "lag_1"), ("rolling", "roll_mean_3"))])
    return _skill(backtest(spark, sf_dir).select("category", F.col("target").alias("y"), F.explode(arms).alias("x")).select("category", "y", "x.*"))


@register("B9_model")
def b9_model(spark, sf_dir):
    """Overspending months as the forecaster and the last month tell them: precision, recall and F1."""
    from ..operators.metrics import detector

    limit = F.col("roll_mean_3") + 0.75 * F.col("roll_std_3")
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), (F.col(c) > limit).alias("said")) for n, c in (("model", "model"), ("naive", "lag_1"))])
    d = backtest(spark, sf_dir).where("roll_std_3 > 0").select((F.col("target") > limit).alias("truth"), F.explode(arms).alias("x"))
    return rounded(detector(d.select("truth", "x.*"), "arm"))


@register("M14")
def m14(spark, sf_dir):
    out, silhouette = X.cohorts(stored(P.user_profiles(panel(spark, sf_dir)), "profiles"), [c for c in PROFILE_COLS if c != "mean_expense"])
    return out.select("user_id", "cohort", F.lit(round(silhouette, 4)).alias("silhouette"))


@register("M17")
def m17(spark, sf_dir):
    """Isotonic calibration of the three quantiles, fitted on the earlier months that have them and applied to the latest."""
    from .metric_queries import interval_forecasts

    d = L.month_cutoff(stored(interval_forecasts(spark, sf_dir), "calibration-intervals"), 0.5)
    out = X.calibrated(d.where("split = 'train'"), d.where("split = 'test'"), ("p10", "p50", "p90"))
    return rounded(out.select("user_id", "category", "month", "p10", "p50", "p90", "calibrated_p10", "calibrated_p50", "calibrated_p90"))


@register("M19")
def m19(spark, sf_dir):
    """Permutation importance of the linear regressor on each user's last month."""
    d = stored(frame(spark, sf_dir), "importance-frame")
    model = X.regressor().fit(X.assembled(d.where("split = 'train'")))
    return rounded(X.permutation_importance(model, d.where("split = 'test'").drop("split"), X.FRAME))


@register("M20")
def m20(spark, sf_dir):
    """Scores of the logistic categorizer on subsets of the columns, and the change from all of them."""
    d = behavioural(spark, sf_dir).withColumn("resolved", S.clean_merchant(F.col("text"))[0])
    clock = ("hour", "weekday", "month_no", "quarter")
    arms = {
        "full": ("resolved", X.BEHAVIOUR), "no_merchant_resolution": ("text", X.BEHAVIOUR),
        "no_temporal": ("resolved", [c for c in X.BEHAVIOUR if c not in clock]), "text_only": ("resolved", []),
    }
    out = None
    for name, (text, columns) in arms.items():
        a = X.balanced(d.withColumn("text", F.col(text)))
        features = X.behaviour_features(columns)
        p = X.predict(X.categorizer("logistic", features).fit(a.where("NOT test")), a.where("test"))
        r = M.classification(p.select(F.col("label").alias("y"), "yhat")).select(F.lit(name).alias("arm"), "macro_f1", "accuracy")
        out = r if out is None else out.unionByName(r)
    base = out.where("arm = 'full'").select(F.col("macro_f1").alias("base"))
    return rounded(out.join(F.broadcast(base), F.lit(True)).select("arm", "macro_f1", "accuracy", (F.col("macro_f1") - F.col("base")).alias("change")))


@register("E7")
def e7(spark, sf_dir):
    """Macro F1 under 0, 5, 10 and 20% of noisy texts, all levels predicted in one pass."""
    d = labelled(spark, sf_dir)
    model = X.categorizer("logistic").fit(X.balanced(d.where("NOT test")))
    test = d.where("test").withColumn("weight", F.lit(1.0))
    levels = [test.withColumns({"text": L.noisy_text("text", "text", f, shares=(30, 30, 40)), "noise": F.lit(f)}) for f in (0.0, 0.05, 0.1, 0.2)]
    noisy = levels[0]
    for x in levels[1:]:
        noisy = noisy.unionByName(x)
    return rounded(M.classification(X.predict(model, noisy).select(F.col("label").alias("y"), "yhat", "noise"), "noise").select("noise", "macro_f1", "accuracy"))


@register("S16")
def s16(spark, sf_dir):
    """Batch inference: a saved model, read again, labels texts, and the result is written and read."""
    from pyspark.ml import PipelineModel

    from ..sources.files import work_dir

    d = labelled(spark, sf_dir)
    model = X.categorizer("logistic").fit(X.balanced(d.where("NOT test")))
    path = work_dir(spark, "categorizer")
    model.write().overwrite().save(f"{path}/model")
    texts = d.select("text").distinct().withColumns({"label": F.lit("misc"), "weight": F.lit(1.0)})
    X.predict(PipelineModel.load(f"{path}/model"), texts).select("text", "yhat").write.parquet(f"{path}/labels")
    return spark.read.parquet(f"{path}/labels")
