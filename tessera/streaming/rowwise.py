"""Row-wise operators on streaming DataFrames.

The derived-column graph (when it has no ``normalize`` node), a fitted
model's prediction and the point checks are plain projections, so they apply
unchanged to a ``readStream`` source; aggregates (norms, profiles, fits) are
batch-only and are rejected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.dag import apply_dag, rowwise_only


def derive_stream(stream: DataFrame, config) -> DataFrame:
    """Append the graph's derived columns to every micro-batch."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    if not rowwise_only(config):
        raise ValueError("normalize needs a whole-column aggregate; not available on a stream")
    return apply_dag(stream, config)


def predict_stream(stream: DataFrame, model, col: str = "prediction") -> DataFrame:
    """Score every arriving row with a fitted model (one projection)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return model.predict(stream, col)


def parquet_stream(spark: SparkSession, path: str, schema: StructType,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Drain the available input into files (exactly-once file sink with a
    checkpoint in the shared folder), then stop."""
    q = (stream.writeStream.format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
