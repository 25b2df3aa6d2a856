"""Session helpers: a tuned local session for tests and benches, and the
shared folder used to cut lineage (checkpoints, written tables).

On a cluster the session is created by the platform; we only read its
``spark.checkpoint.dir`` and never point at a machine-local folder there.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "tessera") -> SparkSession:
    """Local session for tests and benches (AQE on, UI off, UTC, Arrow on)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Uses the cluster's ``spark.checkpoint.dir`` (or an already set
    SparkContext checkpoint dir).  When neither is set, a local session gets a
    fresh folder under the system temp dir; any other master is an error, as
    its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _own_folder(spark: SparkSession) -> str:
    """This application's tables in the shared folder; other applications that share
    it have folders of their own."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-tables/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique table path inside the shared checkpoint folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a lineage cut.  The
    folder belongs to the session's owner, who clears it with its other
    checkpoints; a table must outlive the lazy frames that read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every table that this application wrote below the shared folder; for
    the end of a session, when no lazy frame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
