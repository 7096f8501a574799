"""Analysis tools: heat maps, scaling, clustering, classification and results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import RobustScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import exact_quantiles
from siteframe.functions.scalars import round_stored
from siteframe.operators import aggregates as A
from siteframe.operators.mutate import get_or_create, upsert_map
from siteframe.operators.relational import finite

# Grids the classifiers are searched over. Penalties are the reciprocals of the usual cost values.
# A forest of depth 30, the deepest that can be grown here, stands for one without a limit; weights are none or balanced.
FOREST_GRID = {"numTrees": [3, 6, 12, 24], "maxDepth": [3, 6, 12, 30], "minInstancesPerNode": [1, 2, 4], "weightCol": ["_balanced", "_even"]}
SVM_GRID = {"regParam": [2.0 ** -(-5 + 20 * i / 9) for i in range(10)]}
LOGISTIC_GRID = {"regParam": [10.0 ** (-6 + 5 * i / 9) for i in range(10)], "elasticNetParam": [i / 9 for i in range(10)]}


MAX_CLASSES = 10_000


def heatmap(values: DataFrame, feature_id: int | str, result_name: str) -> DataFrame:
    """Result that colours objects by a feature between its extrema; a feature
    without any number is an error."""
    extrema = A.feature_extrema(values, [feature_id])
    if extrema.first().minimum is None:
        raise ValueError(f"feature {feature_id} has no values")
    return extrema.select(F.lit(result_name).alias("name"), F.to_json(F.struct(
        F.col("feature_id"), F.col("minimum").alias("min"), F.col("maximum").alias("max"))).alias("attributes"))


def scale_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median and outer percentiles of each column, over all rows."""
    out = None
    for c in columns:
        one = exact_quantiles(df.select(F.when(finite(c), F.col(c)).alias(c)), c, (0.01, 0.5, 0.99))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def robust_scale(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre by the median and divide by the range of the middle 98 percent."""
    named = F.broadcast(bounds.select(*[F.col(c).alias(f"_b_{c}") for c in columns]))

    def scaled(c):
        q = [F.get(f"_b_{c}", F.lit(i)) for i in range(3)]
        return F.coalesce(F.try_divide(F.col(c) - q[1], q[2] - q[0]), F.col(c) - q[1])

    return df.join(named).select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_raw", array_to_vector(F.transform(column, lambda v: v.cast("double"))))


def _scaler() -> RobustScaler:
    return RobustScaler(inputCol="_raw", outputCol="_features", lower=0.01, upper=0.99,
                        withCentering=True, withScaling=True, relativeError=1e-4)


def cluster(df: DataFrame, column: str, k: int, key: str = "mapobject_id", seed: int = 0) -> DataFrame:
    """k-means classes of all objects; scaler and centres are fitted on all of them."""
    data = _vectors(df, column)
    model = Pipeline(stages=[_scaler(), KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_class")]).fit(data)
    return model.transform(data).select(key, F.col("_class").cast("double").alias("label"))


def label_index(classes: Sequence[Mapping]) -> dict[float, dict[str, str]]:
    """Names and colours of the user's classes keyed by their position."""
    return {float(i): {"name": c["name"], "color": c["color"]} for i, c in enumerate(classes)}


def _classifier(method: str, grid: Mapping | None):
    if method == "randomforest":
        model, grid = RandomForestClassifier(featuresCol="_raw", labelCol="target", seed=0), grid or FOREST_GRID
        builder = ParamGridBuilder()
        owner = model
    elif method == "svm":
        base = LinearSVC(featuresCol="_features", labelCol="target", maxIter=20)
        model, grid, owner, builder = OneVsRest(classifier=base, featuresCol="_features", labelCol="target", parallelism=4), grid or SVM_GRID, None, ParamGridBuilder()
        # Each grid point of a one-vs-rest model is a classifier of its own.
        options = [base.copy({base.getParam(n): v}) for n, vs in grid.items() for v in vs]
        return model, builder.addGrid(model.classifier, options).build(), True
    elif method == "logisticregression":
        model, grid = LogisticRegression(featuresCol="_features", labelCol="target", fitIntercept=False), grid or LOGISTIC_GRID
        owner, builder = model, ParamGridBuilder()
    else:
        raise ValueError(f"unknown method: {method}")
    for name, values in grid.items():
        builder = builder.addGrid(owner.getParam(name), values)
    return model, builder.build(), method != "randomforest"


def train_supervised(training: DataFrame, column: str, method: str, n_folds: int, grid: Mapping | None = None,
                     key: str = "mapobject_id"):
    """Grid search with folds that are consecutive in the order of object ids, as
    unshuffled folds are. `training` holds the objects the user labelled."""
    data = _vectors(training, column)
    edges = data.agg(F.percentile_approx(key, [i / n_folds for i in range(1, n_folds)], 10000)).first()[0]
    fold = F.lit(0)
    for edge in edges:
        fold = fold + (F.col(key) > F.lit(edge)).cast("int")
    model, params, scaled = _classifier(method, grid)
    stages = [_scaler()] if scaled else []
    # Classes are few: those that a user has named.
    sizes = F.broadcast(data.groupBy("target").agg(F.count(F.lit(1)).alias("_size")))
    whole = F.broadcast(data.agg(F.count(F.lit(1)).alias("_all"), F.countDistinct("target").alias("_classes")))
    weighted = data.join(sizes, "target").join(whole).withColumns(
        {"_even": F.lit(1.0), "_balanced": F.col("_all") / (F.col("_classes") * F.col("_size"))}).drop("_size", "_all", "_classes")
    labelled = weighted.withColumns({"_fold": fold.cast("int"), "target": F.col("target").cast("double")}).persist()
    estimator = Pipeline(stages=[*stages, model])
    try:
        if len(params) == 1:
            # Nothing to choose from: folds would only be scored, not used.
            return estimator.fit(labelled, params[0])
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=params, numFolds=n_folds, foldCol="_fold",
            evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy"), parallelism=4)
        return search.fit(labelled)
    finally:
        labelled.unpersist()


def predict(df: DataFrame, column: str, model, key: str = "mapobject_id") -> DataFrame:
    return model.transform(_vectors(df, column)).select(key, F.col("prediction").alias("label"))


def classify(df: DataFrame, column: str, training: DataFrame, method: str, n_folds: int,
             grid: Mapping | None = None, key: str = "mapobject_id") -> DataFrame:
    """Labels of all objects from classes of some of them (`training`: key, target)."""
    model = train_supervised(df.join(training, key), column, method, n_folds, grid, key)
    return predict(df, column, model, key)


# --- results ------------------------------------------------------------------------

def register_result(results: DataFrame, name: str, kind: str, labels: DataFrame,
                    label_map: Mapping[float, Mapping[str, str]] | None = None) -> DataFrame:
    """Add a result with its unique labels and their names and colours. Labels are
    classes, whose list is an attribute of one row; more than MAX_CLASSES of them,
    as of a continuous measure, are an error."""
    if labels.select("label").distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} different labels")
    out = get_or_create(results.select("id", "name"), results.sparkSession.createDataFrame([(name,)], "name string"), "id", "name")
    unique = labels.agg(F.array_sort(F.collect_set("label")).alias("unique_labels"))
    parts = [F.col("unique_labels")]
    if label_map:
        entries = [e for k, v in label_map.items() for e in (F.lit(str(k)), F.struct(
            F.lit(v["name"]).alias("name"), F.lit(v["color"]).alias("color")))]
        parts.append(F.create_map(*entries).alias("label_map"))
    attributes = F.to_json(F.struct(*parts)).alias("_new")
    kept = results.select("id", F.col("kind").alias("_kind"), F.col("attributes").alias("_old"))
    return (out.join(kept, "id", "left").join(F.broadcast(unique.select(attributes))).select(
        "id", "name", F.coalesce("_kind", F.lit(kind)).alias("kind"), F.coalesce("_old", "_new").alias("attributes")))


def save_labels(stored: DataFrame, predicted: DataFrame, result_id: int, keys: Sequence[str]) -> DataFrame:
    """Merge predicted labels, rounded to six decimals, into the stored maps."""
    updates = predicted.select(*keys, F.create_map(
        F.lit(str(result_id)), round_stored("label")).alias("values"))
    return upsert_map(stored, updates, list(keys), "values")


def feature_pairs(values: DataFrame, x: int | str, y: int | str) -> DataFrame:
    """Two features of all objects next to each other, for scatter plots."""
    pair = values.select("mapobject_id", F.col("values")[str(x)].alias("x"), F.col("values")[str(y)].alias("y"))
    return pair.filter(finite("x") & finite("y"))


def selection_histogram(values: DataFrame, selection: DataFrame, feature: int | str, lower: float,
                        upper: float, bins: int) -> DataFrame:
    """Distribution of a feature over selected objects, one histogram per selection."""
    chosen = values.join(selection, "mapobject_id").select("selection", F.col("values")[str(feature)].alias("v"))
    return A.histogram(chosen, "v", lower, upper, bins, ["selection"])


def list_results(results: DataFrame, name: str | None = None, submission_id: int | None = None) -> DataFrame:
    if name is not None:
        results = results.filter(F.col("name") == name)
    if submission_id is not None:
        results = results.filter(F.col("submission_id") == submission_id)
    return results.orderBy("submission_id")


def rename_result(results: DataFrame, result_id: int, name: str) -> DataFrame:
    return results.withColumn("name", F.when(F.col("id") == result_id, name).otherwise(F.col("name")))


def delete_result(results: DataFrame, labels: DataFrame, result_id: int) -> tuple[DataFrame, DataFrame]:
    """Remove a result and the labels it stored."""
    return (results.filter(F.col("id") != result_id),
            labels.withColumn("values", F.map_filter("values", lambda k, v: k != str(result_id))))


def accuracy(predicted: DataFrame, truth: DataFrame, key: str = "mapobject_id") -> float:
    joined = predicted.join(truth, key)
    share = joined.agg(F.avg((F.col("label") == F.col("target")).cast("double"))).first()[0]
    return math.nan if share is None else share
