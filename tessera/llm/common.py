"""Tables in the shared folder, and row keys, for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Stands for a null document id in join keys.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator call, written as Parquet in the
    shared folder (``spark.checkpoint.dir``).  A written table cuts lineage: a
    lost executor re-reads it, nothing upstream runs again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = path  # keeps the frame and its folder together
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(conf).delete(path, True)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(rid, tkey): tells rows apart by id and whole text.  Equal rows share a
    key, and whatever is computed for one holds for the other."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("rid"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey")]


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, tkey, text (null: empty) and the id itself as ``did``."""
    return docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("did"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("body"))
