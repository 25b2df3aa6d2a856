"""Value histogram with exact ranks, for the Anderson-Darling statistic.

``value_table``  (variable, value, cnt, part): counts of every value of every
                 column (variable: the column's number; null and NaN as the null
                 value), sorted by (variable, value) over range partitions and written
                 once to the shared folder.  One scan of the profiled frame;
                 counts combine map-side, so repeated values shrink before the
                 shuffle.
``ranked``       adds ``r``: rows of the same variable with a smaller value
                 (exact, ties share one rank)
``global_rank``  the same for one key column of any orderable type

A window over ``partitionBy(variable)`` would put a whole column in one task.
The range partitioner cuts columns by their own distribution, however large
one is; partition totals are prefix-summed on a table of (variable, part) rows
and the running count is a window over (variable, part).  ``part`` is written
with the rows, so recomputation gives the same ranks.  Small and large inputs
take this one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import scratch_table


def _range_sorted(df: DataFrame, keys: list[str], name: str, rows_per_part: int | None) -> DataFrame:
    """df sorted by keys over range partitions, with ``part``, written once.  A part
    is a range partition, or ``rows_per_part`` rows of one (parts ascend with keys)."""
    out = df.repartitionByRange(*keys)
    if rows_per_part is None:
        out = out.withColumn("part", F.spark_partition_id().cast("long"))
    else:
        # ids count on inside a partition and leap between partitions
        out = out.sortWithinPartitions(*keys).withColumn("part", F.floor(F.monotonically_increasing_id() / rows_per_part).cast("long"))
    return scratch_table(out, name)


def clean(c: str) -> Column:
    """A column's value as double, NaN as null; -0.0 and 0.0 are one value."""
    x = q(c).cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def values_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, value): every value, variable a column's number."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("variable"), clean(c).alias("value")) for i, c in enumerate(cols)])))


def value_table(df: DataFrame, cols: list[str], rows_per_part: int | None = None) -> DataFrame:
    counts = values_long(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return _range_sorted(counts, ["variable", "value"], "values", rows_per_part)


def part_totals(values: DataFrame) -> DataFrame:
    """A row per variable and part of a value table, nulls apart: rows, values, sum,
    extremes, zeros.  Written, as both the totals of a variable and the ranks' offsets
    come from it."""
    v, c = F.col("value"), F.col("cnt")
    return scratch_table(values.groupBy("variable", "part", v.isNull().alias("none")).agg(
        F.sum(c).alias("total"), F.count(v).alias("values"), F.sum(c * v).alias("sum"), F.max(v).alias("top"), F.min(v).alias("low"),
        F.coalesce(F.sum(F.when(v == 0, c)), F.lit(0)).alias("zeros")), "parts")


def ranked(values: DataFrame, totals: DataFrame) -> DataFrame:
    """(variable, value, cnt, r) of the non-null values of a value table."""
    before = Window.partitionBy("variable").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.where(~F.col("none"))
               .select("variable", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("variable", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (values.where(F.col("value").isNotNull()).withColumn("r", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
            .join(offsets, ["variable", "part"])
            .select("variable", "value", "cnt", (F.col("r") + F.col("offset")).alias("r")))


def global_rank(keys: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """Rows of ``keys`` (column k, null-free, any orderable type) with ``r``,
    their 0-based position; equal keys in any order among themselves."""
    rows = _range_sorted(keys, ["k"], "keys", rows_per_part)
    before = Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    offsets = (rows.groupBy("part").agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
               .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("part").orderBy("k")
    return (rows.withColumn("r", F.row_number().over(inside) - 1).join(offsets, "part")
            .withColumn("r", F.col("r") + F.col("offset")).drop("part", "offset"))
