"""Evaluation metrics (E1-E7) as single aggregates over (actual, predicted).

Classification (accuracy, confusion counts) and regression (max error, MAE,
MSE, RMSE, R^2) are separate, as the classification ones only make sense for
discrete labels.  R^2 uses ``n * var_pop(actual)`` for the total sum of
squares (a numerically stable one-pass moment); constant actuals give 1 when
the fit is exact, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def accuracy(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    a, p = _c(actual), _c(predicted)
    return df.agg(F.avg(F.when(a == p, 1.0).otherwise(0.0)).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Sparse confusion matrix: (actual, predicted, count) for observed pairs."""
    return (df.groupBy(_c(actual).alias("actual"), _c(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion_grid(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """(actual, predicted, count) over the full grid of the labels seen on
    either side, zeros included.  Each label is paired with the array of all
    labels; the grid is the result's own size."""
    counts = confusion_counts(df, actual, predicted)
    labels = counts.select(F.col("actual").alias("l")).union(counts.select(F.col("predicted").alias("l"))).where("l is not null").distinct()
    every = labels.agg(F.array_sort(F.collect_list("l"))).scalar()
    grid = labels.select(F.col("l").alias("actual"), F.explode(every).alias("predicted"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def confusion_matrix(df: DataFrame, actual="actual", predicted="predicted",
                     labels: list | None = None) -> DataFrame:
    """Wide confusion matrix: one row per actual label, one column per label
    (sorted union of both label sets unless given), so as wide as there are
    labels; ``confusion_grid`` is the long form."""
    counts = confusion_counts(df, actual, predicted)
    if labels is None:
        labels = sorted(r["l"] for r in counts.select(F.explode(F.array("actual", "predicted")).alias("l")).where("l is not null").distinct().collect())
    return (counts.groupBy("actual").pivot("predicted", labels).agg(F.sum("count"))
            .na.fill(0, [str(x) for x in labels]).orderBy("actual"))


def regression_metrics(df: DataFrame, actual="actual", predicted="predicted",
                       by: list[str] | None = None) -> DataFrame:
    a, p = _c(actual).cast("double"), _c(predicted).cast("double")
    err = a - p
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(err)).alias("max_error"),
        F.avg(F.abs(err)).alias("mean_absolute_error"),
        F.avg(err * err).alias("mean_squared_error"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(a) * F.count(F.lit(1))).alias("_sst"),
    ]
    g = df.groupBy(*by) if by else df
    out = g.agg(*aggs)
    sse, sst = F.col("_sse"), F.col("_sst")
    r2 = (F.when(sst > 0, F.lit(1.0) - sse / sst)
          .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return (out.withColumn("root_mean_squared_error", F.sqrt("mean_squared_error"))
            .withColumn("r2", r2).drop("_sse", "_sst"))
