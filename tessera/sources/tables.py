"""Readers for the given Parquet tables and for user datasets (CSV/Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table.  Parquet keeps column pruning and filter pushdown."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema=None, infer: bool = True) -> DataFrame:
    """Scan a user dataset.

    CSV is read with a header; types are inferred once (``infer``) or taken
    from ``schema``.  Production data should be converted to Parquet once and
    read from there (``fmt='parquet'``).
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        reader = spark.read.option("header", True)
        if schema is not None:
            return reader.schema(schema).csv(path)
        df = reader.option("inferSchema", infer).csv(path)
        # inferred whole numbers become 64-bit, as a CSV reader of a dataframe
        # library types them (Spark would pick int when the values fit)
        return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                           if isinstance(f.dataType, IntegerType) else F.col(f"`{f.name}`")
                           for f in df.schema.fields])
    raise ValueError(f"unsupported format {fmt!r}")


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Write a DataFrame (CSV with header, or Parquet)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def write_results(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("model_id",)) -> str:
    """A result table by model.  The partitions that df has rows for are replaced,
    all others stay, so a run repeated after a failure leaves one copy.  A table read
    from ``path`` must not feed df."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    return path
