"""Training and scoring with MLlib (M1-M4).

The split is a hash of the row key, so a row's side does not change with
partitioning or retries (``randomSplit`` depends on partition layout).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.operators.evaluate import regression_metrics
from retailcast.plans.core_table import MODEL_FEATURES
from retailcast.session import cut_lineage

# The tuned settings of the source's booster that MLlib's
# GBTRegressor can express (300 trees, depth 3, rate 0.2, all rows/columns).
GBT_PARAMS = {"maxIter": 300, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0,
              "featureSubsetStrategy": "all", "seed": 42}
TRAIN_SHARE = 80  # percent


def split_bucket(keys: list[str]):
    """0-99 from the first 8 hex digits of md5 over the key columns."""
    s = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % 100).cast("int")


def train_test_split(df: DataFrame, keys: list[str], train_share: int = TRAIN_SHARE) -> DataFrame:
    """M1: adds ``is_train`` (about ``train_share`` % of rows)."""
    return df.withColumn("is_train", split_bucket(keys) < train_share)


def gbt_pipeline(features=MODEL_FEATURES, target: str = "total_qty", **params) -> Pipeline:
    p = dict(GBT_PARAMS)
    p.update(params)
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")   # no row is dropped here: the row filter is P13
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", **p)
    return Pipeline(stages=[va, gbt])


def train_gbt(train: DataFrame, features=MODEL_FEATURES, target: str = "total_qty", **params) -> PipelineModel:
    """M2: boosted trees over the feature vector (MLlib has no L1/L2 terms)."""
    # MLlib reads its input several times (split finding, binned tree input);
    # a checkpoint of just the needed columns keeps the feature plan from
    # being recomputed for each pass.
    t = cut_lineage(train.select(*features, F.col(target).cast("double").alias(target)))
    return gbt_pipeline(features, target, **params).fit(t)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("features")


def gbt_metrics(model: PipelineModel, test: DataFrame, target: str = "total_qty") -> DataFrame:
    """M3: score the held-out rows and report A13's metrics."""
    return regression_metrics(score(model, test), target, "prediction")


def grid_search(train: DataFrame, grid: dict[str, list], features=MODEL_FEATURES, target: str = "total_qty",
                folds: int = 3, parallelism: int = 2, keys: list[str] | None = None):
    """M4: cross-validated grid search over GBT settings (MLlib CrossValidator).

    ``keys`` (default: product and month, else the features) decide a row's fold."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    pipe = gbt_pipeline(features, target)
    gbt = pipe.getStages()[1]
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(gbt.getParam(name), values)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=b.build(), numFolds=folds, seed=42,
                        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
                        parallelism=parallelism, foldCol="fold")
    # folds follow the row key, not the partitions, and every fit reads the checkpoint, not the feature plan
    keys = keys or [c for c in ("product_key", "month") if c in train.columns] or list(features)
    keyed = train.withColumn("fold", (split_bucket(keys) % folds).cast("int"))
    return cv.fit(cut_lineage(keyed.select(*features, F.col(target).cast("double").alias(target), "fold")))
