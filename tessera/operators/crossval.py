"""Cross-validated R^2 of a one-predictor least-squares fit, from per-fold
moments only: one scan, one grouped aggregate (map-side combined), then
arithmetic on the k-row fold table.

Per fold the stable built-ins give n, means, population (co)variances.
They are re-centred on the pooled mean (a window over the fold table), so
the complement of fold f -- its training set -- is "all folds minus f" in
plain sums without cancellation.  The fold's own SSE under the complement's
line follows from its moments as well; no second pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_r2(df: DataFrame, y: str, x: str, fold_col: str) -> DataFrame:
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    per = df.groupBy(F.col(fold_col).alias("fold")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(xd).alias("mx"), F.avg(yd).alias("my"),
        F.var_pop(xd).alias("vx"), F.var_pop(yd).alias("vy"), F.covar_pop(xd, yd).alias("cxy"))
    every = Window.partitionBy()  # the fold table has one row per fold
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    px = F.sum(n * mx).over(every) / F.sum(n).over(every)
    py = F.sum(n * my).over(every) / F.sum(n).over(every)
    per = per.withColumn("px", px).withColumn("py", py)
    dx, dy = mx - F.col("px"), my - F.col("py")
    # fold moments about the pooled means
    per = per.select("fold", "n",
                     (n * dx).alias("sx"), (n * dy).alias("sy"),
                     (n * (F.col("vx") + dx * dx)).alias("sxx"),
                     (n * (F.col("cxy") + dx * dy)).alias("sxy"),
                     (n * (F.col("vy") + dy * dy)).alias("syy"))
    tot = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    fitted = per.select("*", *[v.alias(f"t{c}") for c, v in tot.items()])
    tn, tsx, tsy, tsxx, tsxy = (F.col(f"t{c}") for c in ("n", "sx", "sy", "sxx", "sxy"))
    # a training set without spread in x has slope 0; without rows, no line
    spread = tsxx - tsx * tsx / F.nullif(tn, F.lit(0.0))
    b = F.when(spread > 0, (tsxy - tsx * tsy / F.nullif(tn, F.lit(0.0))) / F.nullif(spread, F.lit(0.0))).otherwise(
        F.when(tn > 0, F.lit(0.0)))
    fitted = fitted.withColumn("b", b).withColumn("a", (tsy - F.col("b") * tsx) / F.nullif(tn, F.lit(0.0)))
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    a, b = F.col("a"), F.col("b")
    sse = syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx
    sst = syy - sy * sy / n  # a fold of the table has rows, so n > 0
    r2 = F.when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0))).when(sse == 0, F.lit(1.0)).when(sse.isNotNull(), F.lit(0.0))
    return fitted.select("fold", n.cast("bigint").alias("n"), r2.alias("r2"))
