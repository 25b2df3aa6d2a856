"""Model artifacts (S4): a fitted model is a one-row table (JSON spec) in the
shared folder -- readable by any executor, versionable, no pickles.  Spark's
task retry replaces hand-written save retries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.autoreg import RegressionModel
from ..session import scratch_path


def save_model(spark: SparkSession, model: RegressionModel, path: str | None = None) -> str:
    path = path or scratch_path(spark, "model")
    spark.createDataFrame([(model.to_json(),)], "spec string").coalesce(1) \
        .write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> RegressionModel:
    row = spark.read.parquet(path).first()
    if row is None:
        raise FileNotFoundError(f"no model at {path}")
    return RegressionModel.from_json(row["spec"])
