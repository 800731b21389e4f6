"""Models trained with pyspark.ml: text categorizers, regressors, cohorts, calibration."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import IsotonicRegression, LinearRegression, LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import boosting, classes, forest

FRAME = ["lag_1", "lag_2", "lag_3", "roll_mean_3", "roll_std_3", "tot_lag_1", "moy_sin", "moy_cos", "cur_income"]

#: Character 3- to 5-grams of words padded with a blank, as SQL.
_CHARS = """SELECT *, flatten(transform(words, w -> flatten(transform(sequence(3, 5), n ->
  if(length(w) + 2 < n, array(), transform(sequence(1, length(w) + 3 - n), i -> substring(concat(' ', w, ' '), i, n))))))) AS chars FROM __THIS__"""


#: A vocabulary's size is left to min_df.
ALL_TERMS = (1 << 31) - 1


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to 1 + ln(count).

    pyspark.ml has no such stage. A sparse vector's values are reached by unwrapping it, and only
    the JSON reader makes a vector of its parts again; so no Python runs.
    """

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = F.unwrap_udt(self.getInputCol())
        logged = F.struct(F.lit(0).cast("byte").alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), F.transform(v["values"], lambda x: 1 + F.log(x)).alias("values"))
        made = F.from_json(F.to_json(F.struct(logged.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
        return dataset.withColumn(self.getOutputCol(), made)


def text_features(size: int = ALL_TERMS, min_df: int = 2) -> list:
    """Stages from `text` to `features`: sublinear TF-IDF of word 1-2-grams and character 3-5-grams."""
    stages: list = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement=_CHARS)]
    stages.append(SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"))
    for name in ("grams", "chars"):
        stages += [
            CountVectorizer(inputCol=name, outputCol=f"{name}_n0", vocabSize=size, minDF=min_df), SublinearTF(inputCol=f"{name}_n0", outputCol=f"{name}_tf"),
            IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf"), Normalizer(inputCol=f"{name}_idf", outputCol=f"{name}_n"),
        ]
    return [*stages, VectorAssembler(inputCols=["grams_n", "chars_n"], outputCol="features")]


#: Behavioural columns of the row features that models see beside the text.
BEHAVIOUR = [
    "amount", "hour", "weekday", "is_weekend", "month_no", "quarter", "day", "is_salary_week", "cumulative_spend", "rolling_tx_count", "user_mean_amount", "user_std_amount",
    "merchant_frequency", "merchant_mean_amount", "days_since_previous", "running_balance_proxy", "history_length", "cashflow_ratio", "recurring_ratio",
]


def behaviour_features(columns=BEHAVIOUR) -> list:
    """Stages from `text` and behavioural columns (null: 0) to `features`: hashed words and the columns.

    Buckets that are the same in all rows tell nothing apart and go, as trees hold every feature of a row.
    """
    filled = "".join(f", coalesce(CAST({c} AS DOUBLE), 0) AS _{c}" for c in columns)
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="hashed", numFeatures=1 << 12),
        VarianceThresholdSelector(featuresCol="hashed", outputCol="varied", varianceThreshold=0.0),
        SQLTransformer(statement=f"SELECT *{filled} FROM __THIS__"), VectorAssembler(inputCols=["varied", *[f"_{c}" for c in columns]], outputCol="features"),
    ]


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: total / (classes * class size), times the row's own count if it has one."""
    own = F.col("count") if "count" in df.columns else F.lit(1)
    sizes = df.groupBy(label).agg(F.sum(own).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(sizes), label).join(F.broadcast(total), F.lit(True)).withColumn("weight", own * F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def categorizer(kind: str = "logistic", features: list | None = None, trees: int = 100):
    """A pipeline from (text, label, weight) to prediction text; kinds: logistic, svm, forest, boosted.

    trees: of the forest, or boosting rounds a class. Forest and boosted models read the behavioural
    columns beside the text.
    """
    estimators = {
        "logistic": lambda: LogisticRegression(labelCol="y", weightCol="weight", maxIter=30, regParam=0.01),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), labelCol="y", weightCol="weight", parallelism=4),
        "forest": lambda: RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=12, minInstancesPerNode=5, maxMemoryInMB=1024, seed=42),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=6, stepSize=0.1, maxMemoryInMB=1024, seed=42), labelCol="y", weightCol="weight", parallelism=4),
    }
    if features is None:
        features = behaviour_features() if kind in ("forest", "boosted") else text_features()
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"), *features, estimators[kind]()])


def boosted_categorizer(df: DataFrame, columns=BEHAVIOUR, rounds: int = 100) -> classes.BoostedClasses:
    """The boosted categorizer with all classes' trees grown in the same jobs: depth 6, rate 0.1, on the features of behaviour_features()."""
    return classes.fit(df, columns, rounds=rounds, depth=6, rate=0.1)


def predict(model, df: DataFrame) -> DataFrame:
    """df with yhat and, where the model has probabilities, confidence."""
    out = IndexToString(inputCol="prediction", outputCol="yhat", labels=model.stages[0].labels).transform(model.transform(df))
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))) if "probability" in out.columns else out


def hybrid_features(array: str = "embedding") -> list:
    """TF-IDF beside a dense vector that comes as an array column."""
    dense = SQLTransformer(statement="SELECT * FROM __THIS__")
    return [*text_features()[:-1], dense, VectorAssembler(inputCols=["grams_n", "chars_n", f"{array}_v"], outputCol="features")]


def with_vector(df: DataFrame, array: str = "embedding") -> DataFrame:
    return df.withColumn(f"{array}_v", array_to_vector(F.col(array).cast("array<double>")))


def assembled(df: DataFrame, columns=FRAME) -> DataFrame:
    d = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(d)


def regressor(kind: str = "linear") -> LinearRegression:
    """linear, of `target` on `features`; others are forest_regressor() and boosted_regressor()."""
    return {"linear": lambda: LinearRegression(labelCol="target", regParam=0.1)}[kind]()


def forest_regressor(frame: DataFrame, columns=FRAME, trees: int = 100) -> boosting.Boosted:
    """A forest of `target` for all rows: depth 8, a third of the columns a node."""
    return forest.fit(frame, columns, trees=trees, depth=8)


def boosted_regressor(frame: DataFrame, columns=FRAME, rounds: int = 100) -> boosting.Boosted:
    """One boosted model of `target` for all rows: depth 6, rate 0.1."""
    return boosting.fit(frame, columns, rounds=rounds, depth=6, rate=0.1)


def forecaster(frame: DataFrame, columns=FRAME, rounds: int = 300, min_rows: int = 40) -> boosting.Boosted:
    """A boosted model a category, or its mean where it has few rows: depth 4, rate 0.06; all grow in the same jobs."""
    return boosting.fit(frame, columns, group="category", rounds=rounds, depth=4, rate=0.06, least=min_rows)


def forecast(model: boosting.Boosted, serving: DataFrame) -> DataFrame:
    """user_id, category, forecast (floored at 0) of serving rows."""
    return model.transform(serving).select("user_id", "category", F.greatest("prediction", F.lit(0.0)).alias("forecast"))


def cohorts(profiles: DataFrame, columns, k: int = 6, seed: int = 42):
    """(user_id with cohort, silhouette) by k-means on standardized profiles."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed, predictionCol="cohort")]
    out = Pipeline(stages=stages).fit(profiles).transform(profiles)
    return out, ClusteringEvaluator(predictionCol="cohort").evaluate(out)


def isotonic(df: DataFrame, column: str):
    """Calibration of a quantile forecast column against y; rows with equal forecasts are one, with their mean and number."""
    d = df.groupBy(column).agg(F.avg("y").alias("y"), F.count("y").cast("double").alias("weight"))
    return IsotonicRegression(labelCol="y", weightCol="weight").fit(VectorAssembler(inputCols=[column], outputCol="features").transform(d))


def calibrated(fit_on: DataFrame, df: DataFrame, columns) -> DataFrame:
    """df with calibrated_<column> for each quantile column, lowest first; a row's calibrated quantiles never cross.

    Each column has an isotonic fit of y of its own; beyond the fitted range the ends hold. Where
    fits cross in a row, its values are put in order.
    """
    out = df
    for c in columns:
        made = VectorAssembler(inputCols=[c], outputCol="_x").transform(out)
        out = isotonic(fit_on, c).setFeaturesCol("_x").setPredictionCol(f"_{c}").transform(made).drop("_x")
    ordered = F.array_sort(F.array(*[F.col(f"_{c}") for c in columns]))
    return out.withColumn("_all", ordered).withColumns({f"calibrated_{c}": F.get("_all", F.lit(i)) for i, c in enumerate(columns)}).drop("_all", *[f"_{c}" for c in columns])


def permutation_importance(model, frame: DataFrame, columns, repeats: int = 5, rows_a_block: int = 100_000, loss=None) -> DataFrame:
    """(feature, importance): the rise of the mean loss when a column is dealt anew, positive parts normalized.

    All columns and repeats are arms of one join: rows have a place in their hashed block by key,
    and one more a repeat by a seeded hash; a row meets the rows whose places are its own, one a
    repeat, and takes one column from it an arm. frame is read twice, and scored in one pass; a
    linear model scores each row once, as a column moves its prediction by itself. loss is a column
    over target and prediction, their absolute difference by default.
    """
    columns = list(columns)
    loss = F.abs(F.col("target") - F.col("prediction")) if loss is None else loss
    key = F.concat_ws("|", "user_id", "category", "month")
    blocks = 1 + frame.count() // rows_a_block
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    place = lambda *order: F.row_number().over(W.partitionBy("_b").orderBy(*order, "_key"))
    d = frame.select("target", *columns, key.alias("_key"), block.alias("_b"))
    d = d.withColumns({"_p0": place(), **{f"_p{r}": place(F.xxhash64("_key", F.lit(r))) for r in range(1, repeats + 1)}})
    linear = isinstance(model, LinearRegressionModel)
    own = d.select("_b", F.col("_p0").alias("_p"), "target", *columns)
    if linear:
        own = model.transform(assembled(own, columns)).select(*own.columns, "prediction")
    there = d.select("_b", F.explode(F.array(*[F.struct(F.lit(r).alias("_r"), F.col(f"_p{r}").alias("_p")) for r in range(1, repeats + 1)])).alias("_x"), F.struct(*columns).alias("_v")).select("_b", "_x._p", "_x._r", "_v")
    met, first = own.join(there, ["_b", "_p"]), "_r = 1 OR _arm IS NOT NULL"  # the arm without a change once
    if linear:
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        moved = [F.col("prediction") + float(model.coefficients[i]) * (value(f"_v.{c}") - value(c)) for i, c in enumerate(columns)]
        scored = met.select("target", "_r", F.posexplode(F.array(F.col("prediction"), *moved)).alias("_at", "prediction"))
        scored = scored.select("target", "prediction", "_r", F.when(F.col("_at") > 0, F.col("_at") - 1).alias("_arm")).where(first)
    else:
        arms = F.explode(F.array(F.lit(None).cast("int"), *map(F.lit, range(len(columns))))).alias("_arm")
        dealt = met.select("target", *columns, "_r", "_v", arms).where(first)
        changed = dealt.select("target", "_arm", *[F.when(F.col("_arm") == i, F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)])
        scored = model.transform(assembled(changed, columns))
    mean = scored.groupBy("_arm").agg(F.avg(loss).alias("loss"))
    base = mean.where("_arm IS NULL").select(F.col("loss").alias("base"))
    rise = mean.where("_arm IS NOT NULL").join(F.broadcast(base), F.lit(True)).select(F.get(F.array(*map(F.lit, columns)), F.col("_arm")).alias("feature"), F.greatest(F.lit(0.0), F.col("loss") - F.col("base")).alias("rise"))
    total = F.sum("rise").over(W.partitionBy())  # a row a column
    return rise.select("feature", F.coalesce(F.col("rise") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("importance"))
