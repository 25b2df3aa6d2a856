"""Column profile (16 fields per column) on two paths.

``moment_summary``  counts, extremes, zeros, mean, variance, kurtosis, skewness of
                    every column from one wide aggregate (built-in functions that
                    merge map-side; one row is exchanged per task)
``exact_medians``   a quantile sketch per column brackets the middle ranks, a
                    counting pass over the sketch's values settles them or narrows
                    the bracket; no value is exchanged
``distinct_counts`` exact, from (column number, value) pairs that are made distinct
                    map-side before the one exchange that they need
``rank_summary``    every field from one scan that counts and sorts the values (see
                    ``histogram``): Anderson-Darling needs each value's rank

A-D (normal, sample sd) with one rank per distinct value: a value with count
``c`` and ``r`` smaller rows adds
    c*(2r+c) * ln Phi(w) + c*(2(N-r)-c) * ln(1-Phi(w)),   w = (v-mean)/sd
and  A2 = -N - sum/N.  The statistic is invariant under affine maps, so the
reference's test of (value - fitted response) equals the test of the column
itself unless the fitted slope is exactly one; ``ad_mode='reference'`` gives 0
for the response column itself, as the reference's residual is noise there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.columns import q
from ..functions.normal import ad_pvalue, log_upper_tail
from .histogram import clean, part_totals, ranked, value_table, values_long

PROFILE_FIELDS = [
    "variable", "row_count", "null_count", "maximum", "minimum", "average", "unique_values",
    "zero_count", "median", "data_range", "ad_stat", "ad_pvalue", "mean", "std_dev",
    "variance", "kurtosis", "skewness",
]


def numeric_columns(df: DataFrame, strict: bool = False) -> list[str]:
    cols, bad = [], []
    for f in df.schema.fields:
        (cols if isinstance(f.dataType, NumericType) else bad).append(f.name)
    if strict and bad:
        raise TypeError(f"non-numeric columns cannot be profiled: {bad}")
    return cols


def moment_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per variable, in the order of cols: row_count, value_count, maximum, minimum,
    zero_count, average, data_range, variance, std_dev, kurtosis, skewness.  Nulls and
    NaN are left out of values; an infinite value leaves the mean infinite and the
    central moments NaN; a column without values has nulls.  One aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = clean(c)
        aggs += [F.count(x).alias(f"n{i}"), F.max(x).alias(f"mx{i}"), F.min(x).alias(f"mn{i}"), F.count_if(x == 0).alias(f"z{i}"),
                 F.avg(x).alias(f"av{i}"), F.var_pop(x).alias(f"vr{i}"), F.kurtosis(x).alias(f"ku{i}"), F.skewness(x).alias(f"sk{i}")]
    wide = df.agg(*aggs)

    def fields(i: int, c: str) -> Column:
        n, top, low = F.col(f"n{i}"), F.col(f"mx{i}"), F.col(f"mn{i}")
        varied, some = top > low, n > 0
        variance = F.when(varied, F.col(f"vr{i}")).otherwise(F.when(some, F.lit(0.0)))
        return F.struct(
            F.lit(c).alias("variable"), F.col("_rows").alias("row_count"), n.alias("value_count"), top.alias("maximum"), low.alias("minimum"),
            F.coalesce(F.col(f"z{i}"), F.lit(0)).cast("bigint").alias("zero_count"), F.col(f"av{i}").alias("average"),
            F.when(varied, top - low).otherwise(F.when(some, F.lit(0.0))).alias("data_range"),
            variance.alias("variance"), F.sqrt(variance).alias("std_dev"),
            F.when(some, F.when(varied, F.coalesce(F.col(f"ku{i}"), F.lit(-3.0))).otherwise(F.lit(-3.0))).alias("kurtosis"),
            F.when(some, F.when(varied, F.coalesce(F.col(f"sk{i}"), F.lit(0.0))).otherwise(F.lit(0.0))).alias("skewness"))

    return wide.select(F.inline(F.array(*[fields(i, c) for i, c in enumerate(cols)])))


def exact_medians(df: DataFrame, cols: list[str], accuracy: int = 10000) -> dict[str, float | None]:
    """The midpoint median of each column (null and NaN left out; none: None).

    A pass takes a quantile sketch (rank error 1/accuracy) of the values inside each
    open bracket, the next one counts the rows below and at a few of the sketch's
    values, which are values of the column.  That settles a middle rank or narrows
    its bracket by about accuracy / 4, so 10**8 rows take two rounds."""
    if not cols:
        return {}
    x = {c: clean(c) for c in cols}
    around = (-2 / accuracy, 0, 2 / accuracy)
    middle = sorted({max(0.0, min(1.0, 0.5 + d)) for d in around})
    # the first sketch comes with the counts
    row = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.percentile_approx(x[c], middle, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    # per column: bracket (both ends open), rows below it, rows inside
    open_ = {c: (None, None, 0, row[f"n{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}
    ranks = {c: sorted({(row[f"n{i}"] - 1) // 2, row[f"n{i}"] // 2}) for i, c in enumerate(cols)}
    tried = {c: sorted(set(row[f"q{i}"])) for i, c in enumerate(cols) if c in open_}
    while open_:
        counts = df.agg(*[F.count_if(x[c] < F.lit(v)).alias(f"a{i}_{j}") for i, c in enumerate(open_) for j, v in enumerate(tried[c])],
                        *[F.count_if(x[c] == F.lit(v)).alias(f"b{i}_{j}") for i, c in enumerate(open_) for j, v in enumerate(tried[c])]).first()
        left = {}
        for i, (c, (lo, hi, below, inside)) in enumerate(open_.items()):
            places = [(v, counts[f"a{i}_{j}"], counts[f"a{i}_{j}"] + counts[f"b{i}_{j}"]) for j, v in enumerate(tried[c])]
            for t in ranks[c]:
                for v, a, b in places:
                    if a <= t < b:
                        found[c][t] = v
            missing = [t for t in ranks[c] if t not in found[c]]
            if missing:
                top = below + inside
                for v, a, b in places:
                    if b <= missing[0]:
                        lo, below = v, b
                    if a > missing[-1] and a < top:
                        hi, top = v, a
                left[c] = (lo, hi, below, top - below)
        open_ = left
        if open_:
            sketch = []
            for i, (c, (lo, hi, below, inside)) in enumerate(open_.items()):
                at = {max(0.0, min(1.0, (t - below + 0.5) / inside + d)) for t in ranks[c] if t not in found[c] for d in around}
                within = F.lit(True)
                if lo is not None:
                    within = within & (x[c] > F.lit(lo))
                if hi is not None:
                    within = within & (x[c] < F.lit(hi))
                sketch.append(F.percentile_approx(F.when(within, x[c]), sorted(at), accuracy).alias(f"q{i}"))
            row = df.agg(*sketch).first()
            tried = {c: sorted(set(row[f"q{i}"])) for i, c in enumerate(open_)}
    return {c: (found[c][ranks[c][0]] + found[c][ranks[c][-1]]) / 2 if found[c] else None for c in cols}


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, unique_values), exact; columns without values have no row."""
    per = values_long(df, cols).where(F.col("value").isNotNull()).distinct().groupBy("variable").agg(F.count(F.lit(1)).alias("unique_values"))
    return per.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("variable") + 1).alias("variable"), "unique_values")


def median_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, unique_values, median)."""
    medians = df.sparkSession.createDataFrame(list(exact_medians(df, cols).items()), "variable string, median double")
    return medians.join(F.broadcast(distinct_counts(df, cols)), "variable", "left").select(  # one row per column
        "variable", F.coalesce("unique_values", F.lit(0)).alias("unique_values"), "median")


def rank_summary(df: DataFrame, cols: list[str], rows_per_bucket: int | None = None,
                 response: str | None = None, ad_mode: str = "column") -> DataFrame:
    """Per variable: rows, values, distinct values, extremes, zeros, moments, median, A-D.
    One scan of df writes its value table; the rest reads that.  Every column
    has a row, one without values has nulls.  ``rows_per_bucket``: distinct values
    that are ranked together (default: those of a range partition)."""
    values = value_table(df, cols, rows_per_bucket)
    totals = part_totals(values)
    some = ~F.col("none")
    stats = {r["variable"]: r for r in totals.groupBy("variable").agg(
        F.sum("total").alias("rows"), F.sum(F.when(some, F.col("total"))).alias("n"), F.sum("values").alias("unique"), F.max("top").alias("top"),
        F.min("low").alias("low"), F.sum("zeros").alias("zeros"), F.sum("sum").alias("sum")).collect()}  # one row per column
    n = [(stats[i]["n"] or 0) if i in stats else 0 for i in range(len(cols))]
    mean = [stats[i]["sum"] / n[i] if n[i] else None for i in range(len(cols))]
    varied = [n[i] > 1 and stats[i]["top"] > stats[i]["low"] for i in range(len(cols))]

    def of(numbers: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in numbers]), F.col("variable") + 1)

    v, c, r = F.col("value"), F.col("cnt"), F.col("r")
    gap = F.col("d")
    central = {x["variable"]: x for x in values.where(v.isNotNull()).withColumn("d", v - of(mean, "double")).groupBy("variable").agg(
        F.sum(c * gap * gap).alias("m2"), F.sum(c * gap * gap * gap).alias("m3"), F.sum(c * gap * gap * gap * gap).alias("m4")).collect()}
    sd = [math.sqrt(central[i]["m2"] / (n[i] - 1)) if varied[i] and math.isfinite(central[i]["m2"]) else float("nan") if varied[i] else 0.0
          for i in range(len(cols))]

    # per-row terms computed once in a projection, then aggregated
    hist = ranked(values, totals).select("variable", "value", "cnt", "r", of(n, "bigint").alias("_n"), of(mean, "double").alias("_mean"),
                                         of(sd, "double").alias("_sd"))
    size, s = F.col("_n"), F.col("_sd")
    hist = hist.withColumn("_w", F.when((s > 0) & ~F.isnan(s), (v - F.col("_mean")) / s))
    hist = hist.withColumn("_tail", log_upper_tail(F.abs(F.col("_w"))))
    hist = hist.withColumn("_body", F.log1p(-F.exp(F.col("_tail"))))
    w, tail, body = F.col("_w"), F.col("_tail"), F.col("_body")
    ln_cdf = F.when(w < 0, tail).otherwise(body)
    ln_sf = F.when(w > 0, tail).otherwise(body)
    ad_term = c * (2 * r + c) * ln_cdf + c * (2 * (size - r) - c) * ln_sf
    hit = lambda pos: (r <= pos) & (pos < r + c)
    agg = hist.groupBy("variable").agg(
        ((F.sum(F.when(hit(F.floor((size - 1) / 2)), v)) + F.sum(F.when(hit(F.floor(size / 2)), v))) / 2).alias("median"),
        F.sum(ad_term).alias("ad_sum")).withColumnRenamed("variable", "i")

    def row(i: int, name: str) -> tuple:
        st, m = stats.get(i), central.get(i)
        if not n[i]:
            return (i, name, st["rows"] if st else 0, 0, 0, None, None, 0, None, False, None, None, None, None)
        m2 = m["m2"] / n[i] if varied[i] else 0.0
        flat = m2 == 0
        kurt = -3.0 if flat else m["m4"] * n[i] / m["m2"] ** 2 - 3
        skew = 0.0 if flat else math.sqrt(n[i]) * m["m3"] / m["m2"] ** 1.5
        spread = st["top"] - st["low"] if varied[i] else 0.0
        return (i, name, st["rows"], n[i], st["unique"], st["top"], st["low"], st["zeros"], mean[i], varied[i], spread, m2, kurt, skew)

    known = df.sparkSession.createDataFrame(
        [row(i, x) for i, x in enumerate(cols)],
        "i int, variable string, row_count long, value_count long, unique_values long, maximum double, minimum double, zero_count long, "
        "average double, varied boolean, data_range double, variance double, kurtosis double, skewness double")
    out = known.join(F.broadcast(agg), "i", "left")  # one row per column
    nn = F.col("value_count")
    a2 = F.when(F.col("varied"), -nn - F.col("ad_sum") / F.nullif(nn, F.lit(0))).otherwise(F.lit(0.0))
    a2 = F.when(nn > 0, F.when(a2.isNull() | F.isnan(a2), F.lit(0.0)).otherwise(a2))
    if ad_mode == "reference" and response is not None:
        a2 = F.when(F.col("variable") == response, F.lit(0.0)).otherwise(a2)
    return out.select("variable", "row_count", "value_count", "unique_values", "maximum", "minimum", "zero_count", "average", "median",
                      "data_range", a2.alias("ad_stat"), "variance", F.sqrt("variance").alias("std_dev"), "kurtosis", "skewness",
                      ).withColumn("ad_pvalue", ad_pvalue(F.col("ad_stat")))


def profile(df: DataFrame, cols: list[str] | None = None, response: str | None = None,
            strict: bool = False, rows_per_bucket: int | None = None,
            ad_mode: str = "column", normality: bool = True) -> DataFrame:
    """One row per variable with the 16 profile fields (plus null_count).

    ``response`` falls back as the reference does: given name, else
    ``Response``, else the first column.  Nulls/NaN are skipped in value
    statistics and counted in ``null_count``; ``strict`` raises on them and on
    text columns instead.  df is read once, so a derived input is computed once.

    Without ``normality`` the A-D fields are null and nothing is sorted: moments
    come from one aggregate, the median from sketches and counts, and only
    distinct values are exchanged, for their number; df is read about six times,
    its named columns only."""
    cols = cols or numeric_columns(df, strict)
    if normality:
        out = rank_summary(df, cols, rows_per_bucket, resolve_response(df, response), ad_mode)
    else:
        none = F.lit(None).cast("double")
        out = moment_summary(df, cols).join(F.broadcast(median_unique(df, cols)), "variable", "left").withColumns(  # one row per column
            {"ad_stat": none, "ad_pvalue": none})
    if strict:
        missing = [r["variable"] for r in out.where("value_count < row_count").select("variable").collect()]
        if missing:
            raise ValueError(f"null or NaN values in {missing}")
    return out.select(
        "variable", "row_count",
        (F.col("row_count") - F.col("value_count")).alias("null_count"),
        "maximum", "minimum", "average", "unique_values", "zero_count", "median",
        "data_range", "ad_stat", "ad_pvalue",
        F.col("average").alias("mean"), "std_dev", "variance", "kurtosis", "skewness",
    )


def approx_profile(df: DataFrame, cols: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """T1-T9, T12-T16 in one wide aggregate, no histogram shuffle: distinct
    count by HyperLogLog (``approx_count_distinct``) and the median by
    ``percentile_approx`` (rank error about 1/accuracy).  The A-D fields need
    exact ranks and are left empty (use :func:`profile`)."""
    cols = cols or numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.max(x).alias(f"mx{i}"), F.min(x).alias(f"mn{i}"),
                 F.avg(x).alias(f"av{i}"), F.approx_count_distinct(x).alias(f"u{i}"),
                 F.count_if(x == 0).alias(f"z{i}"), F.percentile_approx(x, 0.5, accuracy).alias(f"md{i}"),
                 F.stddev_pop(x).alias(f"sd{i}"), F.var_pop(x).alias(f"vr{i}"),
                 F.kurtosis(x).alias(f"ku{i}"), F.skewness(x).alias(f"sk{i}")]
    wide = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col("_rows").alias("row_count"),
        (F.col("_rows") - F.col(f"n{i}")).alias("null_count"),
        F.col(f"mx{i}").alias("maximum"), F.col(f"mn{i}").alias("minimum"), F.col(f"av{i}").alias("average"),
        F.col(f"u{i}").alias("unique_values"), F.col(f"z{i}").cast("bigint").alias("zero_count"),
        F.col(f"md{i}").alias("median"), (F.col(f"mx{i}") - F.col(f"mn{i}")).alias("data_range"),
        null_d.alias("ad_stat"), null_d.alias("ad_pvalue"), F.col(f"av{i}").alias("mean"),
        F.col(f"sd{i}").alias("std_dev"), F.col(f"vr{i}").alias("variance"),
        F.coalesce(F.col(f"ku{i}"), F.lit(-3.0)).alias("kurtosis"),
        F.coalesce(F.col(f"sk{i}"), F.lit(0.0)).alias("skewness")) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def resolve_response(df: DataFrame, response: str | None) -> str | None:
    """Metadata response, else 'Response', else the first column."""
    if response and response in df.columns:
        return response
    if "Response" in df.columns:
        return "Response"
    return df.columns[0] if df.columns else None


def simple_ols(df: DataFrame, response: str, cols: list[str] | None = None) -> DataFrame:
    """One-predictor least squares of the response on every column
    (slope, intercept, R^2) in one aggregate over the wide frame."""
    cols = cols or [c for c in numeric_columns(df) if c != response]
    y = q(response).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs += [F.regr_slope(y, x).alias(f"b{i}"), F.regr_intercept(y, x).alias(f"a{i}"),
                 F.regr_r2(y, x).alias(f"r{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"b{i}").alias("slope"),
                              F.col(f"a{i}").alias("intercept"), F.col(f"r{i}").alias("r2"))
                     for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))
