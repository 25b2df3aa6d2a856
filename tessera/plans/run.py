"""Run log and stage results of a fit.

``FitRun`` keeps a fit in a folder: an append-only log of its stages and the
result of every stage as a table.  A fit started again on the same folder, after
its driver was lost, finds the finished stages there and goes on with the first
one that is missing.  ``NoRun`` is the fit without a folder: stage results are
scratch tables and nothing is logged.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import RUN_LOG
from ..session import scratch_table

# The status texts of the stages, and of a failed one.
STAGES = {
    1: "Loading and validating data",
    2: "Loading hyper-parameters",
    3: "Initializing automated linear regressor",
    4: "Constructing pipeline",
    5: "Saving fitted model",
    6: "Complete",
}
FAILED = "Failed to complete"
MESSAGES = {
    3: "Error setting data. Issue with input data",
    4: "Error setting the pipeline.",
    5: "Error saving the fitted model",
}


class NoRun:
    def stage(self, number: int) -> None:
        pass

    def failed(self, error: Exception) -> None:
        pass

    def value(self, name: str, build: Callable[[], dict]) -> dict:
        return build()

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return scratch_table(build(), name)


class FitRun:
    """path: a folder that driver and executors share.  spec: what the fit is of; a
    folder that holds another fit is refused."""

    def __init__(self, spark: SparkSession, path: str, model_id: int):
        self.spark, self.path, self.model_id, self.at = spark, path.rstrip("/"), model_id, 0

    def _done(self, path: str) -> bool:
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def claim(self, spec: dict) -> None:
        found = self.value("spec", lambda: spec)
        if found != json.loads(json.dumps(spec)):
            raise ValueError(f"{self.path} holds the run of another fit")

    def log(self) -> DataFrame:
        """The run log so far, in the columns of :func:`registry.run_status`."""
        return self.spark.read.schema(RUN_LOG).parquet(f"{self.path}/run_log")

    def _write(self, status: str, stage: str, message: str | None = None) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        row = (self.model_id, now, int(now.timestamp() * 1e6), status, stage, message)
        self.spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/run_log")

    def stage(self, number: int) -> None:
        self.at = number
        self._write(STAGES[number], f"{number}/{len(STAGES)}")

    def failed(self, error: Exception) -> None:
        self._write(FAILED, f"-1/{len(STAGES)}", MESSAGES.get(self.at, f"{type(error).__name__}: {error}"))

    def value(self, name: str, build: Callable[[], dict]) -> dict:
        """A few numbers of the driver, kept as JSON."""
        path = f"{self.path}/{name}"
        if not self._done(path):
            self.spark.createDataFrame([(json.dumps(build()),)], "value string").coalesce(1).write.mode("overwrite").parquet(path)
        return json.loads(self.spark.read.parquet(path).first()["value"])

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: read where it is finished, else made."""
        path = f"{self.path}/{name}"
        if not self._done(path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
