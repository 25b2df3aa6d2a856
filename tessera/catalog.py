"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the given tables (or data Spark derives from them); most have an equivalent
DuckDB SQL text over the same tables for the correctness check.

Floating results that depend on summation order are rounded to significant
digits with the same SQL formula on both sides (``functions.rounding``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions.rounding import sig, sig_col, sig_sql
from .functions.transforms import ExpT, LogMinPlus1, LogP1, LogSigned
from .functions.validate import point_errors, valid_point
from .operators import keys as K
from .operators import metrics as M
from .operators import registry as R
from .operators import selection as SEL
from .operators.crossval import fold_r2
from .operators.features import interactions, standardize
from .operators.frames import missing_inputs_column, parse_attribute_column
from .operators.profile import median_unique, moment_summary, profile, rank_summary, simple_ols
from .operators.split import both_splits, with_folds, with_repeated_folds, with_split
from .plans import autoreg as AR
from .plans.dag import apply_dag, apply_node
from .session import scratch_path
from .sources import fixtures as fx
from .sources.tables import read_dataset, table, write_dataset, write_results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_cte(body: str, **ctes: str) -> str:
    parts = ", ".join(f"{k} as ({v})" for k, v in ctes.items())
    return f"with {parts} {body}"


def rounded(df: DataFrame, digits: int = 9, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column to significant digits (same formula as SQL)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in skip:
            out.append(sig_col(f.name, digits))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# ============================================================== sources (2.1)

@register("scan_dataset", with_cte("select * from order_features", order_features=fx.ORDER_FEATURES_SQL))
def q_scan_dataset(spark, sf):
    """A dataset stored as CSV (header, inferred types) is scanned back.
    The CSV is written by Spark from the given tables into the shared folder."""
    path = scratch_path(spark, "dataset-csv")
    write_dataset(fx.order_features(spark, sf), path, fmt="csv")
    return read_dataset(spark, path, fmt="csv", infer=True)


# ===================================================== projections (2.2)

TRAIN_ATTRS = ["n_lines", "sum_qty", "avg_disc", "avg_tax"]


@register("training_frame", with_cte(
    "select sum_ext as label, n_lines, sum_qty, avg_disc, avg_tax from order_features",
    order_features=fx.ORDER_FEATURES_SQL))
def q_training_frame(spark, sf):
    """Drop the id, split response and the attribute list."""
    from .operators.frames import training_frame
    return training_frame(fx.order_features(spark, sf), response="sum_ext",
                          attributes=TRAIN_ATTRS, id_col="id")


# ======================================================= DAG nodes (2.3)

EXAMPLE_DAG = {
    "nodes": {
        "10": {"function": "subtract", "args": {"c1": "x2", "c2": "x4"}},
        "11": {"function": "log10", "args": {"c": "x1"}},
        "12": {"function": "square", "args": {"c": "x2-x4"}},
        "13": {"function": "normalize", "args": {"c": "(x2-x4)^2"}},
    },
    "edges": [[10, 12], [12, 13]],
}


def _dag_single(fn: str, args: dict, out: str, sql_expr: str, digits: int = 12):
    name = f"dag_{'ln' if fn == 'log' else fn}"
    sql = with_cte(f"select l_orderkey, l_linenumber, {sig_sql(sql_expr, digits)} as \"{out}\" from dag_frame",
                   dag_frame=fx.DAG_FRAME_SQL)

    @register(name, sql)
    def _q(spark, sf):
        df = apply_node(fx.dag_frame(spark, sf), fn, **args)
        return df.select("l_orderkey", "l_linenumber", sig_col(out, digits))
    return _q


_dag_single("add", {"c1": "x1", "c2": "x3"}, "x1+x3", "x1 + x3")
_dag_single("subtract", {"c1": "x3", "c2": "x1"}, "x3-x1", "x3 - x1")
_dag_single("square", {"c": "x3"}, "(x3)^2", "x3 * x3")
_dag_single("log", {"c": "x3"}, "ln(x3)", "ln(x3)")
_dag_single("log10", {"c": "x1"}, "log10(x1)", "log10(x1)")
_dag_single("normalize", {"c": "x5"}, "x5n", "x5 / (select sqrt(sum(x5 * x5)) from dag_frame)")

_CHAIN = {"log10(x1)": "log10(x1)", "x2-x4": "x2 - x4", "(x2-x4)^2": "(x2 - x4) * (x2 - x4)",
          "(x2-x4)^2n": "(x2 - x4) * (x2 - x4) / (select sqrt(sum(power(x2 - x4, 4))) from dag_frame)"}
_CHAIN_NAMES, _CHAIN_SQL_COLS = tuple(_CHAIN), tuple(_CHAIN.values())


@register("dag_chain", with_cte(
    "select l_orderkey, l_linenumber, x1, x2, x3, x4, x5, "
    + ", ".join(f"{sig_sql(e, 12)} as \"{n}\"" for e, n in zip(_CHAIN_SQL_COLS, _CHAIN_NAMES))
    + " from dag_frame", dag_frame=fx.DAG_FRAME_SQL))
def q_dag_chain(spark, sf):
    """The four-node example graph (edge ids given as ints)."""
    out = apply_dag(fx.dag_frame(spark, sf), EXAMPLE_DAG)
    return out.select(*[F.col(f"`{c}`") for c in out.columns[:7]], *[sig_col(n, 12) for n in _CHAIN_NAMES])


@register("dag_new_columns", with_cte(
    "select " + ", ".join(f"{sig_sql(e, 12)} as \"{n}\"" for e, n in zip(_CHAIN_SQL_COLS, _CHAIN_NAMES))
    + " from dag_frame", dag_frame=fx.DAG_FRAME_SQL))
def q_dag_new_columns(spark, sf):
    """P5: only the derived columns, in graph order."""
    out = apply_dag(fx.dag_frame(spark, sf), EXAMPLE_DAG, new_only=True)
    return out.select(*[sig_col(n, 12) for n in _CHAIN_NAMES])


_HYPOT_DAG = {"nodes": {"1": {"function": "hypot", "args": {"c1": "x1", "c2": "x3"}}, "2": {"function": "log", "args": {"c": "|x1,x3|"}}},
              "edges": [[1, 2]]}


@register("dag_vectorised", with_cte(
    "select l_orderkey, l_linenumber, " + sig_sql("sqrt(x1 * x1 + x3 * x3)") + ' as "|x1,x3|", '
    + sig_sql("ln(sqrt(x1 * x1 + x3 * x3))") + ' as "ln(|x1,x3|)" from dag_frame', dag_frame=fx.DAG_FRAME_SQL))
def q_dag_vectorised(spark, sf):
    """A graph with a node from a function of numpy arrays, run on Arrow
    batches, whose output a native node uses."""
    import numpy as np
    from .functions.columns import OPERATIONS, register_operation, vectorised
    if "hypot" not in OPERATIONS:
        register_operation(vectorised("hypot", ("c1", "c2"), lambda c1, c2: f"|{c1},{c2}|", lambda a, b: np.sqrt(a * a + b * b)))
    out = apply_dag(fx.dag_frame(spark, sf), _HYPOT_DAG)
    return out.select("l_orderkey", "l_linenumber", sig_col("|x1,x3|"), sig_col("ln(|x1,x3|)"))


@register("derived_roundtrip", with_cte(
    "select " + ", ".join(f"{sig_sql(e, 12)} as \"{n}\"" for e, n in zip(_CHAIN_SQL_COLS, _CHAIN_NAMES))
    + " from dag_frame", dag_frame=fx.DAG_FRAME_SQL))
def q_derived_roundtrip(spark, sf):
    """Derived columns written as CSV (header), read back with a schema."""
    out = apply_dag(fx.dag_frame(spark, sf), EXAMPLE_DAG, new_only=True)
    path = scratch_path(spark, "derived-csv")
    write_dataset(out, path, fmt="csv")
    back = read_dataset(spark, path, fmt="csv", schema=out.schema)
    return back.select(*[sig_col(n, 12) for n in _CHAIN_NAMES])


# ============================================================ profile (2.4)

PROFILE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_variable_sql(cols: list[str], select: str, source: str = "lineitem") -> str:
    return " union all ".join(
        f"select '{c}' as variable, {select.format(x=c)} from {source}" for c in cols)


@register("column_profile", _per_variable_sql(PROFILE_COLS, (
    "count(*) as row_count, max({x}) as maximum, min({x}) as minimum, "
    + sig_sql("avg({x})") + " as average, count(distinct {x}) as unique_values, "
    "count(*) filter (where {x} = 0) as zero_count, " + sig_sql("median({x})", 12) + " as median, "
    "max({x}) - min({x}) as data_range, " + sig_sql("avg({x})") + " as mean, "
    + sig_sql("stddev_pop({x})") + " as std_dev, " + sig_sql("var_pop({x})") + " as variance")))
def q_column_profile(spark, sf):
    """T1-T9, T12-T14 on four line-item measures."""
    p = profile(table(spark, sf, "lineitem"), PROFILE_COLS, normality=False)
    return p.select("variable", "row_count", "maximum", "minimum", sig_col("average"),
                    "unique_values", "zero_count", sig_col("median", 12), "data_range",
                    sig_col("mean"), sig_col("std_dev"), sig_col("variance"))


_ALL_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PROFILE_COLS, "ln_tax", "nothing"]
_ALL_SQL = "select *, case when l_tax > 0 then ln(l_tax) else '-infinity'::double end as ln_tax, null::double as nothing from lineitem"


@register("column_profile_all", with_cte(_per_variable_sql(_ALL_COLS, (
    "count(*) as row_count, count(*) - count({x}) as null_count, cast(max({x}) as double) as maximum, cast(min({x}) as double) as minimum, "
    "count(distinct {x}) as unique_values, count(*) filter (where {x} = 0) as zero_count, " + sig_sql("cast(median({x}) as double)", 12) + " as median"),
    "v"), v=_ALL_SQL))
def q_column_profile_all(spark, sf):
    """T1-T9 of every numeric line-item column, of a logarithm that is -inf for
    zeros and of a column of nulls, over many small range partitions."""
    li = table(spark, sf, "lineitem").withColumns({
        "ln_tax": F.when(F.col("l_tax") > 0, F.log("l_tax")).otherwise(F.lit(float("-inf"))), "nothing": F.lit(None).cast("double")})
    p = profile(li, _ALL_COLS, rows_per_bucket=500)
    return p.select("variable", "row_count", "null_count", "maximum", "minimum", "unique_values", "zero_count", sig_col("median", 12))


@register("column_profile_approx")
def q_column_profile_approx(spark, sf):
    """T1-T9, T12-T16 with the approximate options (HyperLogLog distinct
    count, percentile_approx median): one wide aggregate, no shuffle of
    values.  Rows-only: approximate values are checked in tests against the
    exact profile."""
    from .operators.profile import approx_profile
    return approx_profile(table(spark, sf, "lineitem"), PROFILE_COLS)


_MOMENTS_SQL = " union all ".join(
    f"""select '{c}' as variable,
        {sig_sql(f"case when m2 > 0 then m4 / (m2 * m2) - 3 else -3 end")} as kurtosis,
        {sig_sql(f"case when m2 > 0 then m3 / pow(m2, 1.5) else 0 end")} as skewness
      from (select avg(pow({c} - mu, 2)) as m2, avg(pow({c} - mu, 3)) as m3, avg(pow({c} - mu, 4)) as m4
            from lineitem, (select avg({c}) as mu from lineitem))""" for c in PROFILE_COLS)


@register("column_moments", _MOMENTS_SQL)
def q_column_moments(spark, sf):
    """Biased excess kurtosis and biased skewness."""
    r = moment_summary(table(spark, sf, "lineitem"), PROFILE_COLS)
    return r.select("variable", sig_col("kurtosis"), sig_col("skewness"))


@register("median_unique", _per_variable_sql(PROFILE_COLS, (
    "count(distinct {x}) as unique_values, " + sig_sql("median({x})", 12) + " as median")))
def q_median_unique(spark, sf):
    """Exact distinct count and exact (midpoint) median."""
    r = median_unique(table(spark, sf, "lineitem"), PROFILE_COLS)
    return r.select("variable", "unique_values", sig_col("median", 12))


def _ad_sql(cols: list[str], source: str = "lineitem") -> str:
    from .functions.normal import ad_pvalue_sql, log_cdf_pair_sql
    w = "((value - mu) / sd)"
    ln_cdf, ln_sf = log_cdf_pair_sql(w)
    longv = " union all ".join(f"select '{c}' as variable, cast({c} as double) as value from {source}"
                               for c in cols)
    a2 = ("case when max(sd) > 0 and max(n) > 1 then -max(n) - sum(cnt * (2 * r + cnt) * " + ln_cdf
          + " + cnt * (2 * (n - r) - cnt) * " + ln_sf + ") / max(n) else 0 end")
    return f"""
with longv as ({longv}),
hist as (select variable, value, count(*) as cnt from longv group by variable, value),
st as (select variable, count(*) as n, avg(value) as mu, stddev_samp(value) as sd from longv group by variable),
rk as (select h.variable, h.value, h.cnt, s.n, s.mu, s.sd,
              coalesce(sum(h.cnt) over (partition by h.variable order by h.value
                       rows between unbounded preceding and 1 preceding), 0) as r
       from hist h join st s on h.variable = s.variable),
ad as (select variable, {a2} as a2 from rk group by variable)
select variable, {sig_sql('a2')} as ad_stat, {sig_sql(ad_pvalue_sql('a2'), 6)} as ad_pvalue from ad
"""


@register("ad_normality", _ad_sql(PROFILE_COLS))
def q_ad_normality(spark, sf):
    """Anderson-Darling statistic and p-value per column."""
    r = rank_summary(table(spark, sf, "lineitem"), PROFILE_COLS)
    return r.select("variable", sig_col("ad_stat"), sig(  # p-value: 6 digits
        "`ad_pvalue`", 6).alias("ad_pvalue"))


@register("ad_normality_bucketed", _ad_sql(PROFILE_COLS))
def q_ad_normality_bucketed(spark, sf):
    """T10-T11 with the bucketed rank plan forced (many small value buckets),
    the form that keeps a heavy column off a single task."""
    r = rank_summary(table(spark, sf, "lineitem"), PROFILE_COLS, rows_per_bucket=500)
    return r.select("variable", sig_col("ad_stat"), sig("`ad_pvalue`", 6).alias("ad_pvalue"))


@register("simple_ols", " union all ".join(
    f"select '{c}' as variable, {sig_sql(f'regr_slope(l_extendedprice, {c})')} as slope, "
    f"{sig_sql(f'regr_intercept(l_extendedprice, {c})')} as intercept, "
    f"{sig_sql(f'regr_r2(l_extendedprice, {c})')} as r2 from lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"]))
def q_simple_ols(spark, sf):
    """One-predictor OLS of the response on each column."""
    s = simple_ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return s.select("variable", sig_col("slope"), sig_col("intercept"), sig_col("r2"))


# ============================================================ metrics (2.5)


CLASSIFIER_SQL = """
select l.doc_id, l.quality as actual, case when d.n_chars >= 1000 then 1 else 0 end as predicted
from labels l join documents d on l.doc_id = d.doc_id
"""


def _classifier(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("actual"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("predicted"))


@register("metric_accuracy", with_cte(
    f"select {sig_sql('avg(case when actual = predicted then 1.0 else 0.0 end)')} as accuracy, "
    "count(*) as n from c", c=CLASSIFIER_SQL))
def q_metric_accuracy(spark, sf):
    """Share of equal labels."""
    return rounded(M.accuracy(_classifier(spark, sf)))


@register("metric_confusion", with_cte(
    "select a.l as actual, p.l as predicted, (select count(*) from c where c.actual = a.l and c.predicted = p.l) as count "
    "from lab a, lab p", c=CLASSIFIER_SQL, lab="select actual as l from c union select predicted from c"))
def q_metric_confusion(spark, sf):
    """Confusion counts over the full label grid, zeros included."""
    return M.confusion_grid(_classifier(spark, sf))


REGRESSION_PAIRS_SQL = """
select l_extendedprice as actual, l_quantity * p_retailprice as predicted
from lineitem join part on l_partkey = p_partkey
"""


@register("metric_regression", with_cte(
    "select count(*) as n, " + ", ".join([
        sig_sql("max(abs(actual - predicted))") + " as max_error",
        sig_sql("avg(abs(actual - predicted))") + " as mean_absolute_error",
        sig_sql("avg((actual - predicted) * (actual - predicted))") + " as mean_squared_error",
        sig_sql("sqrt(avg((actual - predicted) * (actual - predicted)))") + " as root_mean_squared_error",
        sig_sql("case when var_pop(actual) > 0 then 1 - sum((actual - predicted) * (actual - predicted)) "
                "/ (var_pop(actual) * count(*)) when sum((actual - predicted) * (actual - predicted)) = 0 "
                "then 1.0 else 0.0 end") + " as r2"]) + " from p", p=REGRESSION_PAIRS_SQL))
def q_metric_regression(spark, sf):
    """E3-E7 on line items: list price (quantity x retail price) as the
    prediction of the extended price."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    pt = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    pairs = li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"))
    return rounded(M.regression_metrics(pairs))


# ============================================ split, folds, features (2.6)


OF = {"order_features": fx.ORDER_FEATURES_SQL}
_DIG = H.digest_sql("id", 42)


@register("train_test_split", with_cte(
    f"select id, case when {H.is_test_sql(_DIG, 0.2)} then 'test' else 'train' end as split "
    "from order_features", **OF))
def q_train_test_split(spark, sf):
    """M1: 20 % test rows by key hash (seed 42)."""
    return with_split(fx.order_features(spark, sf), "id", 0.2, 42).select("id", "split")


@register("fold_assignment", with_cte(
    f"select id, {H.fold_sql(_DIG, H.LEVEL_OUTER, 5)} as outer_fold, "
    f"{H.fold_sql(_DIG, H.LEVEL_INNER, 5)} as inner_fold, {H.fold_sql(_DIG, H.LEVEL_EN, 5)} as en_fold "
    "from order_features", **OF))
def q_fold_assignment(spark, sf):
    """M3: outer, inner and elastic-net folds (5 each) by key hash."""
    return with_folds(fx.order_features(spark, sf), "id", 42, 5).select(
        "id", "outer_fold", "inner_fold", "en_fold")


@register("fold_assignment_repeated", with_cte(
    "select id, " + ", ".join(f"{H.fold_sql(H.repeat_digest_sql(_DIG, r), H.LEVEL_OUTER, 5)} as fold_{r}" for r in range(3))
    + " from order_features", **OF))
def q_fold_assignment_repeated(spark, sf):
    """M3: the folds of three repeats of five."""
    out = with_repeated_folds(fx.order_features(spark, sf), "id", 42, 5, repeats=3)
    return out.select("id", *[F.col("folds")[r].alias(f"fold_{r}") for r in range(3)])


@register("both_splits", with_cte(
    "select 'held out' as mode, split, count(*) as n, " + sig_sql("sum(response)", 8) + " as total from "
    "(select *, case when " + H.is_test_sql(_DIG, 0.2) + " then 'test' else 'train' end as split from order_features) group by split union all "
    "select 'one_out', unnest(['train', 'test']), count(*), " + sig_sql("sum(response)", 8) + " from order_features", **OF))
def q_both_splits(spark, sf):
    """M1, M2: train and test as rows; under one_out every row is in both."""
    df = fx.order_features(spark, sf)
    out = None
    for mode, one_out in (("held out", False), ("one_out", True)):
        part = both_splits(df, "id", 0.2, 42, one_out).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("response").alias("total"))
        part = part.select(F.lit(mode).alias("mode"), "split", "n", sig_col("total", 8))
        out = part if out is None else out.unionByName(part)
    return out


_STD_COLS = ["n_lines", "sum_qty", "avg_disc", "avg_tax"]


@register("standardize", with_cte(
    "select id, " + ", ".join(
        sig_sql(f"({c} - (select avg({c}) from order_features)) / (select case when stddev_pop({c}) = 0 "
                f"then 1 else stddev_pop({c}) end from order_features)") + f" as {c}" for c in _STD_COLS)
    + " from order_features", **OF))
def q_standardize(spark, sf):
    """M4: (x - mean) / population sd, zero sd -> 1."""
    return rounded(standardize(fx.order_features(spark, sf), _STD_COLS, keep=["id"]))


_INT_COLS = ["n_lines", "sum_qty", "avg_disc"]


@register("interactions", with_cte(
    "select id, cast(1.0 as double) as \"1\", n_lines, sum_qty, avg_disc, "
    + sig_sql("n_lines * sum_qty") + " as \"n_lines*sum_qty\", "
    + sig_sql("n_lines * avg_disc") + " as \"n_lines*avg_disc\", "
    + sig_sql("sum_qty * avg_disc") + " as \"sum_qty*avg_disc\" from order_features", **OF))
def q_interactions(spark, sf):
    """M7: 1, x_i, x_i*x_j (i<j) -- no squares."""
    return rounded(interactions(fx.order_features(spark, sf), _INT_COLS, keep=["id"]))


# ============================================================ transforms


_ACCT = "select c_custkey, c_acctbal from customer"


def _acct(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal")


@register("target_log1p", with_cte(
    "select c_custkey, " + sig_sql("ln(1 + c_acctbal + s.shift)") + " as fwd, "
    + sig_sql("exp(ln(1 + c_acctbal + s.shift)) - 1 - s.shift", 6) + " as back "
    "from a, (select case when min(c_acctbal) < 0 then -min(c_acctbal) else 0 end as shift from a) s",
    a=_ACCT))
def q_target_log1p(spark, sf):
    """log1p with a shift for negative minima, and the inverse."""
    df = _acct(spark, sf)
    t = LogP1().fit(df, "c_acctbal")
    y = F.col("c_acctbal")
    out = df.select("c_custkey", t.forward(y).alias("fwd"), t.inverse(t.forward(y)).alias("back"))
    return out.select("c_custkey", sig_col("fwd"), sig("`back`", 6).alias("back"))


@register("target_log_min_plus1", with_cte(
    "select c_custkey, " + sig_sql("ln(c_acctbal - s.m + 1)") + " as fwd, "
    + sig_sql("exp(ln(c_acctbal - s.m + 1)) - 1 + s.m", 6) + " as back "
    "from a, (select min(c_acctbal) as m from a) s", a=_ACCT))
def q_target_log_min_plus1(spark, sf):
    """ln(x - min + 1) and its inverse."""
    df = _acct(spark, sf)
    t = LogMinPlus1().fit(df, "c_acctbal")
    y = F.col("c_acctbal")
    out = df.select("c_custkey", t.forward(y).alias("fwd"), t.inverse(t.forward(y)).alias("back"))
    return out.select("c_custkey", sig_col("fwd"), sig("`back`", 6).alias("back"))


@register("target_log_signed", with_cte(
    "select c_custkey, " + sig_sql("case when c_acctbal = 0 then 'NaN'::double else sign(c_acctbal) * ln(abs(c_acctbal)) end")
    + " as fwd from a", a=_ACCT))
def q_target_log_signed(spark, sf):
    """M9d: sign(y) * ln|y|."""
    df = _acct(spark, sf)
    return df.select("c_custkey", LogSigned().forward(F.col("c_acctbal")).alias("fwd")).select(
        "c_custkey", sig_col("fwd"))


@register("target_exp", with_cte(
    "select event_id, " + sig_sql("exp(value / 100)") + " as fwd, "
    + sig_sql("case when exp(value / 100) > 0 then ln(exp(value / 100)) else 0 end", 6) + " as back from e",
    e="select event_id, value from events"))
def q_target_exp(spark, sf):
    """M9e: exp and its guarded inverse on scaled event values."""
    ev = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("v"))
    t = ExpT()
    out = ev.select("event_id", t.forward(F.col("v")).alias("fwd"),
                    t.inverse(t.forward(F.col("v"))).alias("back"))
    return out.select("event_id", sig_col("fwd"), sig("`back`", 6).alias("back"))


# ============================================== least squares and the fit


_LABEL = "sum_ext"
# integer-valued predictors: their moment sums are exact in both engines, so
# rounding for the value hash never meets a summation-order tie
_GRAM_X = ["n_lines", "sum_qty", "max_size", "min_qty"]


def _gram_terms(xs, label):
    from itertools import combinations
    return ["1", *xs, *[f"{a}*{b}" for a, b in combinations(xs, 2)], label]


def _gram_sql_expr(term):
    return "1.0" if term == "1" else term.replace("*", " * ")


@register("gram_matrix", with_cte(" union all ".join(
    f"select {i} as i, {j} as j, '{a}' as term_i, '{b}' as term_j, "
    + sig_sql(f"sum(({_gram_sql_expr(a)}) * ({_gram_sql_expr(b)}))") + " as value from order_features"
    for i, a in enumerate(_gram_terms(_GRAM_X, _LABEL)) for j, b in enumerate(_gram_terms(_GRAM_X, _LABEL))
    if i <= j), **OF))
def q_gram_matrix(spark, sf):
    """Sum of z z' for z = [1, x, x_i*x_j, y] in one distributed pass."""
    from .operators.moments import gram_long
    df = fx.order_features(spark, sf)
    g = gram_long(df, [F.col(c).cast("double") for c in _GRAM_X], [F.col(_LABEL).cast("double")],
                  _gram_terms(_GRAM_X, _LABEL))
    return rounded(g)


_OLS_X = ["sum_qty", "n_lines"]


@register("ols_fit", with_cte(
    "select 'intercept' as term, " + sig_sql("my - b1 * m1 - b2 * m2", 9) + " as coef from b union all "
    "select 'sum_qty', " + sig_sql("b1", 9) + " from b union all "
    "select 'n_lines', " + sig_sql("b2", 9) + " from b",
    order_features=fx.ORDER_FEATURES_SQL,
    s="select var_pop(sum_qty) as s11, var_pop(n_lines) as s22, covar_pop(sum_qty, n_lines) as s12, "
      "covar_pop(sum_qty, sum_ext) as s1y, covar_pop(n_lines, sum_ext) as s2y, avg(sum_ext) as my, "
      "avg(sum_qty) as m1, avg(n_lines) as m2 from order_features",
    b="select (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, "
      "(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2, my, m1, m2 from s"))
def q_ols_fit(spark, sf):
    """M8: OLS with intercept from the Gram (two predictors)."""
    m = SEL.fit_ols(fx.order_features(spark, sf), _LABEL, _OLS_X)
    rows = [("intercept", m.intercept), *zip(m.features, m.coef)]
    df = spark.createDataFrame(rows, "term string, coef double")
    return df.select("term", sig("coef", 9).alias("coef"))


@register("ols_tiled", with_cte(
    "select 'intercept' as term, " + sig_sql("my - b1 * m1 - b2 * m2", 9) + " as coef from b union all "
    "select 'sum_qty', " + sig_sql("b1", 9) + " from b union all "
    "select 'n_lines', " + sig_sql("b2", 9) + " from b",
    order_features=fx.ORDER_FEATURES_SQL,
    s="select var_pop(sum_qty) as s11, var_pop(n_lines) as s22, covar_pop(sum_qty, n_lines) as s12, "
      "covar_pop(sum_qty, sum_ext) as s1y, covar_pop(n_lines, sum_ext) as s2y, avg(sum_ext) as my, "
      "avg(sum_qty) as m1, avg(n_lines) as m2 from order_features",
    b="select (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, "
      "(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2, my, m1, m2 from s"))
def q_ols_tiled(spark, sf):
    """M8 through Gram tiles and a block Cholesky factor, tiles of one column: the
    form that thousands of predictors take."""
    from .operators.wide import wide_ols
    b0, beta = wide_ols(fx.order_features(spark, sf), _LABEL, _OLS_X, block=1, hold=1 << 20)
    df = spark.createDataFrame([("intercept", b0), *zip(_OLS_X, map(float, beta))], "term string, coef double")
    return df.select("term", sig("coef", 9).alias("coef"))


@register("ols_fit_offset", "select " + sig_sql("regr_slope(value, epoch(ts))", 8) + " as slope, "
          + sig_sql("regr_intercept(value, epoch(ts) - 1704067200)", 8) + " as value_at_start from events")
def q_ols_fit_offset(spark, sf):
    """M8 on a predictor far from zero: epoch seconds, whose squares have no
    digits left for its spread."""
    ev = table(spark, sf, "events").select("value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    m = SEL.fit_ols(ev.select("value", (F.col("us") / 1e6).alias("t")), "value", ["t"])
    start = SEL.fit_ols(ev.select("value", (F.col("us") / 1e6 - 1704067200).alias("t")), "value", ["t"])
    df = spark.createDataFrame([(m.coef[0], start.intercept)], "slope double, value_at_start double")
    return df.select(sig_col("slope", 8), sig_col("value_at_start", 8))


_SPLIT_SQL = ("select *, case when " + H.is_test_sql(_DIG, 0.2) + " then 'test' else 'train' end as split "
              "from order_features")
_ONE_MODEL_SQL = ("select regr_slope(sum_ext, sum_qty) as b, regr_intercept(sum_ext, sum_qty) as a "
                  "from sp where split = 'train'")


def _one_predictor(spark, sf):
    df = with_split(fx.order_features(spark, sf), "id", 0.2, 42)
    model = SEL.fit_ols(df.where(F.col("split") == "train"), _LABEL, ["sum_qty"])
    return model, df


@register("predict_linear", with_cte(
    "select id, " + sig_sql("a + b * sum_qty", 8) + " as prediction from sp, m where split = 'test'",
    order_features=fx.ORDER_FEATURES_SQL, sp=_SPLIT_SQL, m=_ONE_MODEL_SQL))
def q_predict_linear(spark, sf):
    """A fitted model applied as one projection to the held-out rows."""
    model, df = _one_predictor(spark, sf)
    out = model.predict(df.where(F.col("split") == "test"))
    return out.select("id", sig("prediction", 8).alias("prediction"))


@register("residuals", with_cte(
    "select id, sum_ext - " + sig_sql("a + b * sum_qty", 8) + " as residual from sp, m where split = 'test'",
    order_features=fx.ORDER_FEATURES_SQL, sp=_SPLIT_SQL, m=_ONE_MODEL_SQL))
def q_residuals(spark, sf):
    """Actual - predicted on the held-out rows."""
    model, df = _one_predictor(spark, sf)
    out = model.predict(df.where(F.col("split") == "test"), "p")
    return out.select("id", (F.col(_LABEL) - sig("p", 8)).alias("residual"))


_SCORE_COLS = ("count(*) as n, " + sig_sql("avg(abs(sum_ext - p))") + " as mean_absolute_error, "
               + sig_sql("case when var_pop(sum_ext) > 0 then 1 - sum((sum_ext - p) * (sum_ext - p)) "
                         "/ (var_pop(sum_ext) * count(*)) else 0 end") + " as r2")


@register("split_scores", with_cte(
    "select split, " + _SCORE_COLS + " from (select split, sum_ext, a + b * sum_qty as p from sp, m) "
    "group by split", order_features=fx.ORDER_FEATURES_SQL, sp=_SPLIT_SQL, m=_ONE_MODEL_SQL))
def q_split_scores(spark, sf):
    """Train and test scores of the held-out fit, grouped by split."""
    model, df = _one_predictor(spark, sf)
    sc = M.regression_metrics(model.predict(df), F.col(_LABEL), F.col("prediction"), by=["split"])
    return sc.select("split", "n", sig_col("mean_absolute_error"), sig_col("r2"))


@register("resubstitution_score", with_cte(
    "select count(*) as n, " + sig_sql("regr_r2(sum_ext, sum_qty)") + " as r2 from order_features", **OF))
def q_resubstitution_score(spark, sf):
    """M2: one_out -- fit and score on every row."""
    df = with_split(fx.order_features(spark, sf), "id", one_out=True)
    model = SEL.fit_ols(df, _LABEL, ["sum_qty"])
    sc = M.regression_metrics(model.predict(df), F.col(_LABEL), F.col("prediction"))
    return sc.select("n", sig_col("r2"))


@register("cv_fold_r2", with_cte(
    "select fold, cast(n as bigint) as n, " + sig_sql(
        "case when sst > 0 then 1 - sse / sst when sse = 0 then 1.0 else 0.0 end") + " as r2 from ("
    "select fold, n, syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx as sse, "
    "syy - sy * sy / n as sst from ("
    "select *, (tsy - b * tsx) / tn as a from ("
    "select *, (tsxy - tsx * tsy / tn) / (tsxx - tsx * tsx / tn) as b from ("
    "select *, sum(n) over () - n as tn, sum(sx) over () - sx as tsx, sum(sy) over () - sy as tsy, "
    "sum(sxx) over () - sxx as tsxx, sum(sxy) over () - sxy as tsxy from ("
    "select " + H.fold_sql(_DIG, H.LEVEL_OUTER, 5) + " as fold, cast(count(*) as double) as n, "
    "sum(xc) as sx, sum(yc) as sy, sum(xc * xc) as sxx, sum(xc * yc) as sxy, sum(yc * yc) as syy from ("
    "select id, sum_qty - (select avg(sum_qty) from order_features) as xc, "
    "sum_ext - (select avg(sum_ext) from order_features) as yc from order_features) group by 1)))))",
    **OF))
def q_cv_fold_r2(spark, sf):
    """M12 (S form): per-fold R^2 of a one-predictor OLS fitted on the other folds."""
    df = with_folds(fx.order_features(spark, sf), "id", 42, 5, levels=("outer",))
    return fold_r2(df, _LABEL, "sum_qty", "outer_fold").select("fold", "n", sig_col("r2"))


_SEL_X = [c for c in fx.FEATURES if c != _LABEL]


@register("lars_select")
def q_lars_select(spark, sf):
    """M5: LARS (4 steps) keeps the columns with positive coefficients."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, _SEL_X, "lars", 4)
    rows = [(f, c, f in chosen) for f, c in zip(_SEL_X, coef)]
    return spark.createDataFrame(rows, "feature string, coef double, selected boolean")


_PAIR_SQL = " union all ".join(f"select '{a}' as f, '{b}' as g, corr({a}, {b}) as r from order_features" for a in _SEL_X for b in _SEL_X)
_LABEL_SQL = " union all ".join(f"select '{a}' as f, corr({a}, {_LABEL}) as c, stddev_pop({_LABEL}) / stddev_pop({a}) as scale from order_features"
                                for a in _SEL_X)


@register("lars_one_step", with_cte(
    "select c.f as feature, " + sig_sql("case when c.f = t.f then sign(t.c) * s.step * t.scale else 0.0 end", 8) + " as coef, "
    "c.f = t.f and t.c > 0 as selected from c, t, s",
    order_features=fx.ORDER_FEATURES_SQL, c=_LABEL_SQL, r=_PAIR_SQL,
    t="select * from c order by abs(c) desc limit 1",
    w="select abs(t.c) as level, c.c, r.r * sign(t.c) as a from c join t on c.f <> t.f join r on r.f = c.f and r.g = t.f",
    j="select (level - c) / (1 - a) as x, level from w union all select (level + c) / (1 + a), level from w",
    s="select min(x) as step from j where x > 0 and x < level"))
def q_lars_one_step(spark, sf):
    """M5: the first LAR step: the column of the largest correlation moves until
    another one ties."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, _SEL_X, "lars", 1)
    rows = [(f, c, f in chosen) for f, c in zip(_SEL_X, coef)]
    return spark.createDataFrame(rows, "feature string, coef double, selected boolean").select("feature", sig_col("coef", 8), "selected")


@register("lars_two_steps", with_cte(
    "select c.f as feature, " + sig_sql("(case when c.f = f1 then s1 * step1 + step2 * d1 when c.f = f2 then step2 * d2 else 0.0 end) * c.scale", 8)
    + " as coef, (case when c.f = f1 then s1 * step1 + step2 * d1 when c.f = f2 then step2 * d2 else 0.0 end) > 0 as selected from c, e",
    order_features=fx.ORDER_FEATURES_SQL, c=_LABEL_SQL, r=_PAIR_SQL,
    t="select f as f1, abs(c) as l1, sign(c) as s1 from c order by abs(c) desc limit 1",
    w="select c.f, c.c, r.r * s1 as a, t.* from c join t on c.f <> f1 join r on r.f = c.f and r.g = f1",
    j="select *, (l1 - c) / (1 - a) as x, 1 as side from w union all select *, (l1 + c) / (1 + a), -1 from w",
    k="select f as f2, f1, s1, side as s2, x as step1, l1 - x as l2 from j where x > 0 and x < l1 order by x limit 1",
    v="select k.*, (s1 - r.r * s2) / (1 - r.r * r.r) as d1, (s2 - r.r * s1) / (1 - r.r * r.r) as d2 from k join r on r.f = f1 and r.g = f2",
    u="select v.*, c.c - step1 * ra.r * s1 as c2, ra.r * d1 + rb.r * d2 as a2 from v, c join r ra on ra.f = c.f join r rb on rb.f = c.f "
      "where c.f not in (f1, f2) and ra.g = f1 and rb.g = f2",
    z="select *, (l2 - c2) / (1 - a2) as y from u where a2 < 1 union all select *, (l2 + c2) / (1 + a2) from u where a2 > -1",
    e="select f1, f2, s1, step1, d1, d2, least(min(y) filter (where y > 0), l2) as step2 from z group by f1, f2, s1, step1, d1, d2, l2"))
def q_lars_two_steps(spark, sf):
    """M5: two LAR steps; the second moves both columns along their joint direction."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, _SEL_X, "lars", 2)
    rows = [(f, c, f in chosen) for f, c in zip(_SEL_X, coef)]
    return spark.createDataFrame(rows, "feature string, coef double, selected boolean").select("feature", sig_col("coef", 8), "selected")


@register("lars_tied", with_cte(
    "select unnest(['a', 'b', 'c']) as feature, unnest([" + ", ".join(sig_sql(x, 8) for x in ("ba", "ba", "bc")) + "]) as coef from m",
    order_features=fx.ORDER_FEATURES_SQL,
    # a and b have equal coefficients, so the fit is one on a + b and c
    p="select sum_qty + max_size as a, n_lines as c, sum_ext as y from order_features",
    v="select var_pop(a) as aa, var_pop(c) as cc, covar_pop(a, c) as ac, covar_pop(a, y) as ay, covar_pop(c, y) as cy, "
      "(select var_pop(sum_qty - max_size) + power(avg(sum_qty - max_size), 2) from order_features) as dd from p",
    m="select (ay * cc - cy * ac) / (aa * cc - ac * ac) as ba, (cy * aa - ay * ac) / (aa * cc - ac * ac) as bc from v"))
def q_lars_tied(spark, sf):
    """M5 on columns that tie: every order appears twice, with its quantity and
    its size in columns a and b and the other way round; the full path ends at
    least squares, with one coefficient for both."""
    o = fx.order_features(spark, sf)
    both = o.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in
                                        (("sum_qty", "max_size"), ("max_size", "sum_qty"))])).alias("ab"), "n_lines", _LABEL)
    _, coef = SEL.select_features(both.select("ab.a", "ab.b", F.col("n_lines").alias("c"), _LABEL), _LABEL, ["a", "b", "c"], "lars")
    return spark.createDataFrame(list(zip("abc", coef)), "feature string, coef double").select("feature", sig_col("coef", 8))


_EN_MOMENTS = ("count(*) as n, avg(sum_qty) as mx, avg(sum_ext) as my, var_pop(sum_qty) as vx, var_pop(sum_ext) as vy, "
               "covar_pop(sum_qty, sum_ext) as cxy")
_SOFT = "sign({m}.cxy) * greatest(abs({m}.cxy) - a.alpha * 0.5, 0) / ({m}.vx + a.alpha * 0.5)"


@register("elastic_net_one", with_cte(
    "select 'sum_qty' as feature, " + sig_sql(_SOFT.format(m="m"), 8) + " as coef, " + _SOFT.format(m="m") + " > 0 as selected "
    "from m, (select alpha from e order by mse, alpha desc limit 1) a",
    order_features=fx.ORDER_FEATURES_SQL,
    d="select *, " + H.fold_sql(_DIG, H.LEVEL_EN, 5) + " as fold from order_features",
    m=f"select {_EN_MOMENTS} from d",
    tr=f"select k, {_EN_MOMENTS} from d, range(5) t(k) where fold <> k group by k",
    te=f"select fold as k, {_EN_MOMENTS} from d group by fold",
    a="select pow(10, log10(2 * abs(cxy) * 1e-3) + i * 3.0 / 99) as alpha from m, range(100) t(i)",
    w="select tr.k, a.alpha, tr.mx, tr.my, " + _SOFT.format(m="tr") + " as w from tr, a",
    e="select alpha, avg(vy + w * w * vx - 2 * w * cxy + pow(te.my - w.my - w * (te.mx - w.mx), 2)) as mse "
      "from w join te on te.k = w.k group by alpha"))
def q_elastic_net_one(spark, sf):
    """M6 with one predictor, where each penalty's fit is a soft threshold: five
    hash folds, 100 penalties, the best one's coefficient."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, ["sum_qty"], "elastic-net")
    df = spark.createDataFrame([("sum_qty", coef[0], bool(chosen))], "feature string, coef double, selected boolean")
    return df.select("feature", sig_col("coef", 8), "selected")


_EN2 = ("sum_qty", "n_lines")
_EN2_MOMENTS = ("count(*) as n, avg(sum_qty) as m1, avg(n_lines) as m2, avg(sum_ext) as my, var_pop(sum_qty) as v1, var_pop(n_lines) as v2, "
                "covar_pop(sum_qty, n_lines) as v12, covar_pop(sum_qty, sum_ext) as c1, covar_pop(n_lines, sum_ext) as c2, var_pop(sum_ext) as vy")


def _en2_best(source: str, key: str) -> str:
    """Of every sign pattern the stationary point, if its signs agree; of those the
    one of least cost (all per row: the penalty is alpha / 2 on both parts)."""
    h = "alpha * 0.5"
    grid = f"(select * from {source}), (select unnest([-1, 0, 1]) as s1), (select unnest([-1, 0, 1]) as s2)"
    det = f"((v1 + {h}) * (v2 + {h}) - v12 * v12)"
    w1 = (f"case when s1 = 0 then 0 when s2 = 0 then (c1 - {h} * s1) / (v1 + {h}) "
          f"else ((c1 - {h} * s1) * (v2 + {h}) - (c2 - {h} * s2) * v12) / {det} end")
    w2 = (f"case when s2 = 0 then 0 when s1 = 0 then (c2 - {h} * s2) / (v2 + {h}) "
          f"else ((c2 - {h} * s2) * (v1 + {h}) - (c1 - {h} * s1) * v12) / {det} end")
    cost = (f"0.5 * (w1 * w1 * v1 + 2 * w1 * w2 * v12 + w2 * w2 * v2) - c1 * w1 - c2 * w2 + {h} * (abs(w1) + abs(w2)) "
            f"+ 0.5 * {h} * (w1 * w1 + w2 * w2)")
    return (f"select {key}, alpha, i, arg_min(struct_pack(w1, w2, m1, m2, my), {cost}) as b from "
            f"(select *, {w1} as w1, {w2} as w2 from {grid}) where sign(w1) = s1 and sign(w2) = s2 group by {key}, alpha, i")


_EN2_CTES = dict(
    order_features=fx.ORDER_FEATURES_SQL,
    d="select *, " + H.fold_sql(_DIG, H.LEVEL_EN, 5) + " as fold from order_features",
    m=f"select {_EN2_MOMENTS} from d",
    a="select i, pow(10, log10(2 * greatest(abs(c1), abs(c2)) * 1e-3) + (99 - i) * 3.0 / 99) as alpha from m, range(100) t(i)",
    tr=f"select k, {_EN2_MOMENTS} from d, range(5) t(k) where fold <> k group by k",
    te=f"select fold as k, {_EN2_MOMENTS} from d group by fold",
    tra="select tr.*, a.alpha, a.i from tr, a",
    w=_en2_best("tra", "k"),
    e="select i, alpha, avg(vy + b.w1 * b.w1 * v1 + b.w2 * b.w2 * v2 + 2 * b.w1 * b.w2 * v12 - 2 * b.w1 * c1 - 2 * b.w2 * c2 "
      "+ pow(te.my - b.my - b.w1 * (te.m1 - b.m1) - b.w2 * (te.m2 - b.m2), 2)) as mse from w join te using (k) group by i, alpha",
    top="select i, alpha from e order by mse, i limit 1",
    fulla="select 0 as k, m.*, top.alpha, top.i from m, top",
    f=_en2_best("fulla", "k"))


@register("elastic_net_two", with_cte(
    "select 'sum_qty' as feature, " + sig_sql("b.w1", 7) + " as coef, b.w1 > 0 as selected from f union all "
    "select 'n_lines', " + sig_sql("b.w2", 7) + ", b.w2 > 0 from f", **_EN2_CTES))
def q_elastic_net_two(spark, sf):
    """M6 with two correlated predictors, where each penalty's fit is the best
    stationary point of nine sign patterns."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, list(_EN2), "elastic-net")
    rows = [(f, c, f in chosen) for f, c in zip(_EN2, coef)]
    return spark.createDataFrame(rows, "feature string, coef double, selected boolean").select("feature", sig_col("coef", 7), "selected")


@register("elastic_net_path", with_cte(
    "select cast(e.i as integer) as step, " + sig_sql("e.alpha", 8) + " as alpha, " + sig_sql("mse", 7) + " as mse, true as certified, "
    "e.i = top.i as best from e, top", **_EN2_CTES))
def q_elastic_net_path(spark, sf):
    """M6: the cross-validated path, each penalty with its certificate (the duality
    gap proves the fits of all folds)."""
    from .operators.solvers import GAP
    out = SEL.elastic_net_path(fx.order_features(spark, sf), _LABEL, list(_EN2))
    return out.select("step", sig_col("alpha", 8), sig_col("mse", 7), (F.col("gap") <= GAP).alias("certified"), "best")


@register("elastic_net_select")
def q_elastic_net_select(spark, sf):
    """M6: cross-validated elastic net keeps the positive coefficients."""
    chosen, coef = SEL.select_features(fx.order_features(spark, sf), _LABEL, _SEL_X, "elastic-net")
    rows = [(f, c, f in chosen) for f, c in zip(_SEL_X, coef)]
    return spark.createDataFrame(rows, "feature string, coef double, selected boolean")


def auto_fit(spark, sf, response="response", features=tuple(fx.FEATURES)):
    """The flagship fit."""
    df = fx.order_features(spark, sf)
    return AR.fit_auto_regression(df, response, list(features), key="id"), df


@register("auto_regression")
def q_auto_regression(spark, sf):
    """The whole automated fit on the order features (k = 9); returns the
    final model's train/test scores with the chosen transform and max_k."""
    fit, df = auto_fit(spark, sf)
    sc = AR.split_scores(fit.model, df)
    return (sc.select("split", "n", "r2", "mean_absolute_error", "root_mean_squared_error")
            .withColumn("transform", F.lit(fit.model.transform))
            .withColumn("max_k", F.lit(fit.model.max_k))
            .withColumn("terms", F.lit(",".join(fit.model.selected_terms))))


_SIGNAL_X = tuple(c for c in fx.FEATURES if c != "sum_ext")


@register("auto_regression_signal")
def q_auto_regression_signal(spark, sf):
    """M17 with a real signal: an order's extended-price total from its other
    eight line-item aggregates (k = 8: LARS budgets {4}); selected terms,
    transform and train/test scores."""
    fit, df = auto_fit(spark, sf, response="sum_ext", features=_SIGNAL_X)
    sc = AR.split_scores(fit.model, df)
    return (sc.select("split", "n", "r2", "mean_absolute_error", "root_mean_squared_error")
            .withColumn("transform", F.lit(fit.model.transform))
            .withColumn("max_k", F.lit(fit.model.max_k))
            .withColumn("terms", F.lit(",".join(fit.model.selected_terms))))


@register("cv_results")
def q_cv_results(spark, sf):
    """Outer candidates with per-fold R^2, mean, sd and rank."""
    fit, _ = auto_fit(spark, sf)
    return AR.cv_results(fit)


_T_SQL = {"None_T": ("sum_ext", "{p}"), "LogP1_T": ("ln(1 + sum_ext)", "exp({p}) - 1")}
# with one predictor the selectors keep it (its slope is positive) and each fit is a line
_ONE_CTES = dict(
    order_features=fx.ORDER_FEATURES_SQL,
    d="select *, " + H.fold_sql(_DIG, H.LEVEL_OUTER, 5) + " as k0, " + H.is_test_sql(_DIG, 0.2) + " as held from order_features",
    fits=" union all ".join(
        f"select k, '{t}' as transform, regr_slope({f}, sum_qty) as b, regr_intercept({f}, sum_qty) as a "
        "from d, (select unnest([0, 1, 2, 3, 4, -1]) as k) where not held and k0 <> k group by k" for t, (f, _) in _T_SQL.items()),
    scored="select transform, k, 1 - sum(power(sum_ext - p, 2)) / (var_pop(sum_ext) * count(*)) as r2 from ("
           "select f.transform, f.k, sum_ext, case when f.transform = 'None_T' then a + b * sum_qty else exp(a + b * sum_qty) - 1 end as p "
           "from d join fits f on d.k0 = f.k where not held) group by transform, k",
    cv="select transform, " + ", ".join(f"max(r2) filter (where k = {i}) as s{i}" for i in range(5))
       + ", avg(r2) as m, stddev_pop(r2) as sd, rank() over (order by avg(r2) desc, transform desc) as r from scored group by transform")


@register("cv_results_one", with_cte(
    "select transform, " + ", ".join(sig_sql(f"s{i}", 8) + f" as split{i}_test_score" for i in range(5)) + ", "
    + sig_sql("m", 8) + " as mean_test_score, " + sig_sql("sd", 7) + " as std_test_score, cast(r as integer) as rank_test_score from cv", **_ONE_CTES))
def q_cv_results_one(spark, sf):
    """M9-M12 with one predictor, where the whole grid has a closed form: both
    transforms, five outer folds, mean, deviation and rank."""
    out = AR.cv_results(auto_fit(spark, sf, _LABEL, ("sum_qty",))[0])
    return out.select("transform", *[sig_col(f"split{i}_test_score", 8) for i in range(5)], sig_col("mean_test_score", 8),
                      sig_col("std_test_score", 7), "rank_test_score")


@register("auto_regression_one", with_cte(
    "select split, count(*) as n, " + sig_sql("1 - sum(power(sum_ext - p, 2)) / (var_pop(sum_ext) * count(*))", 8) + " as r2, any_value(transform) as transform "
    "from (select case when held then 'test' else 'train' end as split, sum_ext, best.transform, "
    "case when best.transform = 'None_T' then a + b * sum_qty else exp(a + b * sum_qty) - 1 end as p "
    "from d, fits f, best where f.k = -1 and f.transform = best.transform) group by split",
    **_ONE_CTES, best="select transform from cv where r = 1"))
def q_auto_regression_one(spark, sf):
    """M17 and S4 with one predictor: the model of the whole fit is saved, read
    back and scored on train and test."""
    from .sources.artifacts import load_model, save_model
    fit, df = auto_fit(spark, sf, _LABEL, ("sum_qty",))
    sc = AR.split_scores(load_model(spark, save_model(spark, fit.model)), df)
    return sc.select("split", "n", sig_col("r2", 8), F.lit(fit.model.transform).alias("transform"))


_REP = 3
_REP_CTES = dict(
    order_features=fx.ORDER_FEATURES_SQL,
    d="select *, " + H.is_test_sql(_DIG, 0.2) + " as held, [" + ", ".join(
        f"{r} * 5 + {H.fold_sql(H.repeat_digest_sql(_DIG, r), H.LEVEL_OUTER, 5)}" for r in range(_REP)) + "] as ks from order_features",
    fits=" union all ".join(
        f"select k, '{t}' as transform, regr_slope({f}, sum_qty) as b, regr_intercept({f}, sum_qty) as a "
        f"from d, (select unnest(range({5 * _REP})) as k) where not held and not list_contains(ks, k) group by k" for t, (f, _) in _T_SQL.items()),
    scored="select transform, f.k, 1 - sum(power(sum_ext - case when f.transform = 'None_T' then a + b * sum_qty else exp(a + b * sum_qty) - 1 end, 2)) "
           "/ (var_pop(sum_ext) * count(*)) as r2 from d join fits f on list_contains(ks, f.k) where not held group by transform, f.k")


@register("cv_results_repeats", with_cte(
    "select transform, " + ", ".join(sig_sql(f"max(r2) filter (where k = {i})", 8) + f" as split{i}_test_score" for i in range(5 * _REP))
    + ", " + sig_sql("avg(r2)", 8) + " as mean_test_score, " + sig_sql("stddev_pop(r2)", 7) + " as std_test_score, "
    "cast(rank() over (order by avg(r2) desc, transform desc) as integer) as rank_test_score from scored group by transform", **_REP_CTES))
def q_cv_results_repeats(spark, sf):
    """Five folds repeated three times give fifteen scores."""
    fit = AR.fit_auto_regression(fx.order_features(spark, sf), _LABEL, ["sum_qty"], settings=AR.ModelSettings(cv_reps=_REP))
    out = AR.cv_results(fit)
    return out.select("transform", *[sig_col(f"split{i}_test_score", 8) for i in range(5 * _REP)], sig_col("mean_test_score", 8),
                      sig_col("std_test_score", 7), "rank_test_score")


# forward and inverse of each target transform for y = sum_ext / 100000; m: least y of the training rows
_ALL_T = {"None_T": ("y", "{z}"), "LogP1_T": ("ln(1 + y)", "exp({z}) - 1"), "LogMinPlus1_T": ("ln(y - m + 1)", "exp({z}) - 1 + m"),
          "LogMinus_T": ("sign(y) * ln(abs(y))", "exp({z})"), "Exp_T": ("exp(y)", "case when {z} > 0 then ln({z}) else 0 end")}
_ALL_T_CTES = dict(
    order_features=fx.ORDER_FEATURES_SQL,
    d="select id, sum_qty as x, sum_ext / 100000 as y, " + H.fold_sql(_DIG, H.LEVEL_OUTER, 5) + " as k0 from order_features where not " + H.is_test_sql(_DIG, 0.2),
    lows="select k, min(y) as m from d, (select unnest([0, 1, 2, 3, 4]) as k) where k0 <> k group by k",
    fits=" union all ".join(f"select k, '{t}' as transform, any_value(m) as m, regr_slope({f}, x) as b, regr_intercept({f}, x) as a "
                            "from d join lows on k0 <> k group by k" for t, (f, _) in _ALL_T.items()),
    scored="select transform, k, 1 - sum(power(y - case " + " ".join(
        f"when transform = '{t}' then {back.format(z='(a + b * x)')}" for t, (_, back) in _ALL_T.items())
    + " end, 2)) / (var_pop(y) * count(*)) as r2 from d join fits on k0 = k group by transform, k")


@register("cv_results_transforms", with_cte(
    "select transform, " + ", ".join(sig_sql(f"max(r2) filter (where k = {i})", 7) + f" as split{i}_test_score" for i in range(5))
    + ", " + sig_sql("avg(r2)", 7) + " as mean_test_score, cast(rank() over (order by avg(r2) desc) as integer) as rank_test_score "
    "from scored group by transform", **_ALL_T_CTES))
def q_cv_results_transforms(spark, sf):
    """M9a-M9e in the outer grid: five target transforms through their protocol,
    each scored on the response's own scale."""
    df = fx.order_features(spark, sf).select("id", "sum_qty", (F.col(_LABEL) / 100000).alias("y"))
    out = AR.cv_results(AR.fit_auto_regression(df, "y", ["sum_qty"], transforms=tuple(_ALL_T)))
    return out.select("transform", *[sig_col(f"split{i}_test_score", 7) for i in range(5)], sig_col("mean_test_score", 7), "rank_test_score")


@register("fit_run_log", with_cte(
    "select 7 as model_id, 'Complete' as status, '6/6' as stage, 6 as step, 6 as steps, true as completed, count(*) as n, 6 as stages "
    "from order_features", **OF))
def q_fit_run_log(spark, sf):
    """The fit logs its stages; the latest status is read back, and the
    model that the run kept predicts every order."""
    from .plans.run import FitRun
    from .sources.artifacts import load_model
    df = fx.order_features(spark, sf)
    run = FitRun(spark, scratch_path(spark, "run"), 7)
    AR.fit_auto_regression(df, _LABEL, ["sum_qty"], run=run)
    log = run.log()
    rows = load_model(spark, f"{run.path}/model").predict(df).where(F.col("prediction").isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    stages = log.agg(F.countDistinct("stage").cast("int").alias("stages"))
    status = R.run_status(log).select(F.col("model_id").cast("int").alias("model_id"), "status", "stage", "step", "steps", "completed")
    return status.join(F.broadcast(rows)).join(F.broadcast(stages))  # one row each


@register("grid_search_outer")
def q_grid_search_outer(spark, sf):
    """Per transform and outer fold, the chosen max_k and its R^2."""
    fit, _ = auto_fit(spark, sf)
    return fit.outer_scores


@register("grid_search_inner")
def q_grid_search_inner(spark, sf):
    """The inner grids of every outer fold and of the final refit (-1)."""
    fit, _ = auto_fit(spark, sf)
    from pyspark.sql import Window
    summary = fit.inner_scores.groupBy("transform", "outer_fold", "max_k").agg(F.avg("r2").alias("mean_r2"),
                                                                               F.stddev_pop("r2").alias("std_r2"))
    w = Window.partitionBy("transform", "outer_fold").orderBy(F.desc("mean_r2"), "max_k")
    return summary.withColumn("rank", F.rank().over(w))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """The fitted model is written to the shared folder as a table, read
    back and applied (predictions for every order)."""
    from .sources.artifacts import load_model, save_model
    fit, df = auto_fit(spark, sf)
    path = save_model(spark, fit.model)
    model = load_model(spark, path)
    return model.predict(df).select("id", sig("prediction", 8).alias("prediction"))


@register("score_table", with_cte(
    "select model_id, " + _SCORE_COLS.replace("sum_qty", "x") + " from ("
    "select 1 as model_id, sum_ext, a1 + b1 * sum_qty as p from sp, m union all "
    "select 2 as model_id, sum_ext, a2 + b2 * n_lines as p from sp, m) group by model_id",
    order_features=fx.ORDER_FEATURES_SQL, sp=_SPLIT_SQL,
    m="select regr_slope(sum_ext, sum_qty) as b1, regr_intercept(sum_ext, sum_qty) as a1, "
      "regr_slope(sum_ext, n_lines) as b2, regr_intercept(sum_ext, n_lines) as a2 from sp where split = 'train'"))
def q_score_table(spark, sf):
    """Predictions of two models written partitioned by model_id, read
    back, scored per model."""
    df = with_split(fx.order_features(spark, sf), "id", 0.2, 42)
    train = df.where(F.col("split") == "train")
    outs = []
    for mid, x in ((1, "sum_qty"), (2, "n_lines")):
        m = SEL.fit_ols(train, _LABEL, [x])
        outs.append(m.predict(df).select(F.lit(mid).alias("model_id"), "id", "split",
                                         F.col(_LABEL).alias("actual"), "prediction",
                                         (F.col(_LABEL) - F.col("prediction")).alias("residual")))
    path = scratch_path(spark, "scores")
    write_dataset(outs[0].unionByName(outs[1]), path, partition_by=["model_id"])
    back = read_dataset(spark, path)
    sc = M.regression_metrics(back, F.col("actual"), F.col("prediction"), by=["model_id"])
    return sc.select("model_id", "n", sig_col("mean_absolute_error"), sig_col("r2"))


@register("score_table_rerun", with_cte(
    "select model_id, " + _SCORE_COLS.replace("sum_qty", "x") + " from ("
    "select 1 as model_id, sum_ext, a1 + b1 * sum_qty as p from sp, m union all "
    "select 2 as model_id, sum_ext, a2 + b2 * n_lines as p from sp, m) group by model_id",
    order_features=fx.ORDER_FEATURES_SQL, sp=_SPLIT_SQL,
    m="select regr_slope(sum_ext, sum_qty) as b1, regr_intercept(sum_ext, sum_qty) as a1, "
      "regr_slope(sum_ext, n_lines) as b2, regr_intercept(sum_ext, n_lines) as a2 from sp where split = 'train'"))
def q_score_table_rerun(spark, sf):
    """Two models' results are written one after the other, the first one's
    twice; each model's partition holds one copy."""
    df = with_split(fx.order_features(spark, sf), "id", 0.2, 42).select("id", "split", _LABEL, "sum_qty", "n_lines").persist()
    path = scratch_path(spark, "results")
    train = df.where(F.col("split") == "train")
    models = {1: SEL.fit_ols(train, _LABEL, ["sum_qty"]), 2: SEL.fit_ols(train, _LABEL, ["n_lines"])}
    for mid in (1, 2, 1):
        write_results(models[mid].predict(df).select(F.lit(mid).alias("model_id"), "id", F.col(_LABEL).alias("actual"), "prediction"), path)
    df.unpersist()
    sc = M.regression_metrics(read_dataset(spark, path), F.col("actual"), F.col("prediction"), by=["model_id"])
    return sc.select("model_id", "n", sig_col("mean_absolute_error"), sig_col("r2"))


# ================================== projections, predicates, registry (2.2, 2.8)


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("parse_attributes", """
select user_id, count(distinct event_type) as n_attrs,
       string_agg(distinct event_type, ',' order by event_type) as attrs
from events group by user_id
""")
def q_parse_attributes(spark, sf):
    """Attribute lists stored as Python-repr text are parsed per row."""
    ev = table(spark, sf, "events")
    text = ev.groupBy("user_id").agg(
        F.concat(F.lit("['"), F.array_join(F.sort_array(F.collect_set("event_type")), "', '"),
                 F.lit("']")).alias("attributes"))
    parsed = text.select("user_id", parse_attribute_column(F.col("attributes")).alias("a"))
    return parsed.select("user_id", F.size("a").cast("bigint").alias("n_attrs"),
                         F.array_join("a", ",").alias("attrs"))


@register("list_children", "select doc_id, lang, source, n_chars from documents")
def q_list_children(spark, sf):
    """Dataset listing without the payload column (never scanned)."""
    return R.list_children(table(spark, sf, "documents"), payload=("text",))


_PT = {"start": ("c_acctbal / 50", "c_acctbal / 25"),
       "end": ("c_nationkey * 4.0 - 40", "c_acctbal / 60"),
       "o": ("c_acctbal / 110", "c_nationkey * 8.0 - 100")}


def _valid_sql(lat, lon):
    return f"(({lat}) > -90 and ({lat}) < 90 and ({lon}) > -180 and ({lon}) < 180)"


@register("valid_points", "select c_custkey, " + _valid_sql(*_PT["start"]) + " as valid from customer")
def q_valid_points(spark, sf):
    """Strict latitude/longitude bounds."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", valid_point(F.col("c_acctbal") / 50, F.col("c_acctbal") / 25).alias("valid"))


def _pt_cols():
    c = F.col
    return {"start_point": (c("c_acctbal") / 50, c("c_acctbal") / 25),
            "end_point": (c("c_nationkey") * 4.0 - 40, c("c_acctbal") / 60),
            "o_point": (c("c_acctbal") / 110, c("c_nationkey") * 8.0 - 100)}


@register("point_errors", "select c_custkey, n_errors, errors from (select c_custkey, "
          "(case when not " + _valid_sql(*_PT["start"]) + " then 1 else 0 end) + "
          "(case when not " + _valid_sql(*_PT["end"]) + " then 1 else 0 end) + "
          "(case when not " + _valid_sql(*_PT["o"]) + " then 1 else 0 end) as n_errors, "
          "concat_ws('; ', "
          "case when not " + _valid_sql(*_PT["start"]) + " then 'Start point coordinates, start_latitude/start_longitude, are invalid' end, "
          "case when not " + _valid_sql(*_PT["end"]) + " then 'End point coordinates, end_latitude/end_longitude, are invalid' end, "
          "case when not " + _valid_sql(*_PT["o"]) + " then 'Orientation point coordinates, o_latitude/o_longitude, are invalid' end"
          ") as errors from customer) where n_errors > 0")
def q_point_errors(spark, sf):
    """One message per invalid point (start, end, orientation)."""
    c = table(spark, sf, "customer")
    e = c.select("c_custkey", point_errors(_pt_cols()).alias("e"))
    return e.select("c_custkey", F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors")) \
        .where(F.col("n_errors") > 0)


@register("missing_inputs", """
select event_id, 'The following required parameters were not found: ' ||
       concat_ws(',', case when event_type = 'error' then 'dataset_id' end,
                      case when value < 10 then 'model_id' end) as message
from events where event_type = 'error' or value < 10
""")
def q_missing_inputs(spark, sf):
    """Per request row, the required parameters it lacks."""
    ev = table(spark, sf, "events")
    keys = F.filter(F.array(F.lit("workflow_id"),
                            F.when(F.col("event_type") != "error", F.lit("dataset_id")),
                            F.when(F.col("value") >= 10, F.lit("model_id"))), lambda k: k.isNotNull())
    out = ev.select("event_id", missing_inputs_column(["workflow_id", "dataset_id", "model_id"], keys)
                    .alias("message"))
    return out.where(F.col("message").isNotNull())


@register("metadata_pivot", with_cte(
    "select base_id, " + ", ".join(f"max(value) filter (where name = '{n}') as {n}" for n in _EVENT_TYPES)
    + " from meta group by base_id", meta=fx.METADATA_SQL))
def q_metadata_pivot(spark, sf):
    """R2: name -> value per base for the requested names (one column each)."""
    return R.metadata_get(fx.metadata(spark, sf), names=_EVENT_TYPES)


_CUT = "2024-01-16"


@register("metadata_upsert", with_cte(
    "select coalesce(u.base_id, c.base_id) as base_id, coalesce(u.name, c.name) as name, "
    "coalesce(u.value, c.value) as value, coalesce(u.seq, c.seq) as seq "
    "from cur c full outer join upd u on c.base_id = u.base_id and c.name = u.name",
    cur=f"select base_id, name, arg_max(value, seq) as value, max(seq) as seq from ({fx.METADATA_LOG_SQL}) "
        f"where ts < timestamp '{_CUT}' group by base_id, name",
    upd=f"select base_id, name, arg_max(value, seq) as value, max(seq) as seq from ({fx.METADATA_LOG_SQL}) "
        f"where ts >= timestamp '{_CUT}' group by base_id, name"))
def q_metadata_upsert(spark, sf):
    """The metadata table as of the cut, upserted with the later writes."""
    log = fx.metadata_log(spark, sf)
    cur = R.metadata_latest(log.where(F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")))
    return R.metadata_upsert(cur, log.where(F.col("ts") >= F.lit(_CUT).cast("timestamp_ntz")))


_DEL_REQ_SQL = ("select base_id, case when t = 'error' then null else t end as name from "
                f"(select base_id, arg_max(name, seq) as t from ({fx.METADATA_LOG_SQL}) group by base_id)")


@register("metadata_delete", with_cte(
    "select m.base_id, m.name, m.value from meta m where not exists (select 1 from req r where "
    "r.base_id = m.base_id and (r.name is null or r.name = m.name))",
    meta=fx.METADATA_SQL, req=_DEL_REQ_SQL))
def q_metadata_delete(spark, sf):
    """Delete by name, or all of a base (null name); requests are each
    base's latest event: its type, or everything after an error."""
    log = fx.metadata_log(spark, sf)
    req = log.groupBy("base_id").agg(F.max_by("name", "seq").alias("t")).select(
        "base_id", F.when(F.col("t") == "error", F.lit(None)).otherwise(F.col("t")).alias("name"))
    return R.metadata_delete(fx.metadata(spark, sf), req).select("base_id", "name", "value")


_CHAIN_CTES = dict(models=fx.MODELS_SQL, workflows=fx.WORKFLOWS_SQL, locations=fx.LOCATIONS_SQL,
                   owners=fx.OWNERS_SQL)


@register("owner_chain", with_cte(
    "select m.model_id, m.workflow_id, w.location_id, l.owner_id from models m "
    "join workflows w on m.workflow_id = w.workflow_id join locations l on w.location_id = l.location_id "
    "join owners o on l.owner_id = o.owner_id", **_CHAIN_CTES))
def q_owner_chain(spark, sf):
    """The owner of every model along model -> workflow -> location."""
    return R.owner_chain(fx.models(spark, sf), fx.workflows(spark, sf), fx.locations(spark, sf),
                         fx.owners(spark, sf))


_GRANT_CUT = "2024-01-16"
_OWNERS_OBJ_SQL = "select 'Location' as object_type, location_id as object_id, owner_id from locations"


def _grant_sql(where):
    return (f"select grantor_id as owner_id, target_user_id, object_type, object_id, "
            f"arg_max(expiration, (ts, request_id)) as expiration, arg_max(access_type, (ts, request_id)) as access_type "
            f"from req r where {where} and exists (select 1 from own o where o.object_type = r.object_type and "
            f"o.object_id = r.object_id and o.owner_id = r.grantor_id) "
            f"group by grantor_id, target_user_id, object_type, object_id")


_ACL_CTES = dict(locations=fx.LOCATIONS_SQL, own=_OWNERS_OBJ_SQL, req=fx.GRANT_REQUESTS_SQL,
                 acl0=_grant_sql(f"ts < timestamp '{_GRANT_CUT}'"),
                 upd=_grant_sql(f"ts >= timestamp '{_GRANT_CUT}'"),
                 acl="select coalesce(u.owner_id, a.owner_id) as owner_id, "
                     "coalesce(u.target_user_id, a.target_user_id) as target_user_id, "
                     "coalesce(u.object_type, a.object_type) as object_type, "
                     "coalesce(u.object_id, a.object_id) as object_id, "
                     "coalesce(u.expiration, a.expiration) as expiration, "
                     "coalesce(u.access_type, a.access_type) as access_type "
                     "from acl0 a full outer join upd u on a.owner_id = u.owner_id and "
                     "a.target_user_id = u.target_user_id and a.object_type = u.object_type and "
                     "a.object_id = u.object_id")


def _acl(spark, sf):
    req = fx.grant_requests(spark, sf)
    own = R.location_owners(fx.locations(spark, sf))
    empty = spark.createDataFrame([], "owner_id bigint, target_user_id bigint, object_type string, "
                                      "object_id bigint, expiration timestamp_ntz, access_type string")
    cut = F.lit(_GRANT_CUT).cast("timestamp_ntz")
    acl0 = R.acl_grant(empty, req.where(F.col("ts") < cut), own)
    return R.acl_grant(acl0, req.where(F.col("ts") >= cut), own), own


@register("acl_grant", with_cte("select * from acl", **_ACL_CTES))
def q_acl_grant(spark, sf):
    """Grants by owners only, upserted per (owner, target, object)."""
    acl, _ = _acl(spark, sf)
    return acl


@register("acl_access", with_cte(
    "select q.request_id, q.user_id, q.object_type, q.object_id, "
    "coalesce(o.owner_id = q.user_id, false) as is_owner, "
    "coalesce(o.owner_id = q.user_id, false) or exists (select 1 from acl a where a.target_user_id = q.user_id "
    "and a.object_type = q.object_type and a.object_id = q.object_id and a.expiration > q.as_of) as allowed "
    "from q left join own o on o.object_type = q.object_type and o.object_id = q.object_id",
    **_ACL_CTES, q="select event_id as request_id, user_id, 'Location' as object_type, "
                   "cast(event_id % 25 as bigint) as object_id, ts as as_of from events"))
def q_acl_access(spark, sf):
    """Owner or unexpired grant, for every access request."""
    acl, own = _acl(spark, sf)
    ev = table(spark, sf, "events")
    req = ev.select(F.col("event_id").alias("request_id"), "user_id", F.lit("Location").alias("object_type"),
                    F.pmod("event_id", F.lit(25)).cast("bigint").alias("object_id"), F.col("ts").alias("as_of"))
    return R.acl_access(req, own, acl)


@register("has_fitted_model", with_cte(
    "select l.location_id, exists (select 1 from workflows w join models m on m.workflow_id = w.workflow_id "
    "where w.location_id = l.location_id and m.fitted) as has_fitted_model from locations l", **_CHAIN_CTES))
def q_has_fitted_model(spark, sf):
    """Does a fitted model sit below each location?"""
    return R.has_fitted_model(fx.locations(spark, sf), fx.workflows(spark, sf), fx.models(spark, sf))


@register("versioned_update", with_cte(
    "select location_id, owner_id, name, null::bigint as replaces from locations l "
    "where not exists (select 1 from hf where hf.location_id = l.location_id and not hf.has_fitted_model) "
    "union all select location_id, owner_id, lower(name) as name, null::bigint from locations l "
    "where exists (select 1 from hf where hf.location_id = l.location_id and not hf.has_fitted_model) "
    "union all select (select max(location_id) from locations) + row_number() over (order by location_id), "
    "owner_id, lower(name), location_id from locations l "
    "where exists (select 1 from hf where hf.location_id = l.location_id and hf.has_fitted_model)",
    **_CHAIN_CTES, hf="select l.location_id, exists (select 1 from workflows w join models m on "
                      "m.workflow_id = w.workflow_id where w.location_id = l.location_id and m.fitted) "
                      "as has_fitted_model from locations l"))
def q_versioned_update(spark, sf):
    """Rename every location; ones with fitted models below keep their
    row and get a new version with a fresh id."""
    locs = fx.locations(spark, sf)
    hf = R.has_fitted_model(locs, fx.workflows(spark, sf), fx.models(spark, sf))
    upd = locs.withColumn("name", F.lower("name"))
    return R.versioned_update(locs, upd, hf, "location_id")


_FAR = 2 ** 53


@register("versioned_update_far", with_cte(
    f"select location_id + {_FAR} as location_id, owner_id, name, null::bigint as replaces from locations "
    f"union all select (select max(location_id) from locations) + {_FAR} + row_number() over (order by l.location_id), "
    f"l.owner_id, n.name, l.location_id + {_FAR} from locations l join n on n.location_id = l.location_id",
    locations=fx.LOCATIONS_SQL, n="select location_id, max(name || suffix) as name from locations, (values ('-a'), ('-b')) t(suffix) group by location_id"))
def q_versioned_update_far(spark, sf):
    """R9 on ids above 2^53 and with two updates of every row, of which the
    later counts."""
    locs = fx.locations(spark, sf).withColumn("location_id", F.col("location_id") + F.lit(_FAR))
    upd = locs.select("location_id", "owner_id", F.col("name").alias("old"), F.explode(F.array(F.lit("-a"), F.lit("-b"))).alias("seq"))
    upd = upd.select("location_id", "owner_id", F.concat("old", "seq").alias("name"), "seq")
    return R.versioned_update(locs, upd, locs.select("location_id", F.lit(True).alias("has_fitted_model")), "location_id", order="seq")


@register("metadata_upsert_null", with_cte(
    "select m.base_id, m.name, case when u.base_id is null then m.value end as value, coalesce(u.seq, m.seq) as seq "
    "from m left join u on u.base_id = m.base_id and u.name = m.name",
    m=fx.METADATA_LOG_SQL.join(["select base_id, name, arg_max(value, seq) as value, max(seq) as seq from (", ") group by base_id, name"]),
    u="select base_id, name, seq + 1000000 as seq from m where base_id % 3 = 0"))
def q_metadata_upsert_null(spark, sf):
    """Writes of null replace what was there."""
    cur = R.metadata_latest(fx.metadata_log(spark, sf))
    upd = cur.where("base_id % 3 = 0").select("base_id", "name", F.lit(None).cast(cur.schema["value"].dataType).alias("value"),
                                              (F.col("seq") + 1000000).alias("seq"))
    return R.metadata_upsert(cur, upd)


@register("cascade_delete", with_cte(
    "select m.model_id, m.workflow_id from models m where not exists (select 1 from workflows w "
    "join locations l on w.location_id = l.location_id join owners o on l.owner_id = o.owner_id "
    "where w.workflow_id = m.workflow_id and o.name = 'AFRICA')", **_CHAIN_CTES))
def q_cascade_delete(spark, sf):
    """Deleting one owner's locations removes their workflows and models."""
    locs = fx.locations(spark, sf)
    gone = locs.join(fx.owners(spark, sf).where(F.col("name") == "AFRICA"), "owner_id", "left_semi")
    _, models = R.cascade_delete(gone, fx.workflows(spark, sf), fx.models(spark, sf))
    return models.select("model_id", "workflow_id")


_OBJECTS = {"Location": ("location", "location_id", "select location_id as id, owner_id from location"),
            "Workflow": ("workflow", "workflow_id", "select w.workflow_id, l.owner_id from workflow w join location l using (location_id)"),
            "Dataset": ("dataset", "dataset_id", "select d.dataset_id, l.owner_id from dataset d join workflow w using (workflow_id) "
                        "join location l using (location_id)"),
            "AnalyticalModel": ("analytical_model", "model_id", "select m.model_id, l.owner_id from analytical_model m join workflow w using (workflow_id) "
                                "join location l using (location_id)")}
_REG = {f'"{k}"' if k == "user" else k: v for k, v in fx.REGISTRY_SQL.items()}
_OBJECT_OWNERS = " union all ".join(f"select '{kind}' as object_type, id as object_id, owner_id from ({q}) t(id, owner_id) "
                                    "where owner_id in (select user_id from \"user\")" for kind, (_, _, q) in _OBJECTS.items())


@register("list_by_parent", with_cte(
    "select d.dataset_id, d.workflow_id, d.name from dataset d join workflow w using (workflow_id) where w.location_id < 5", **_REG))
def q_list_by_parent(spark, sf):
    """Datasets of the workflows of five locations, without their payload."""
    reg = fx.registry(spark, sf)
    return K.REGISTRY.children(reg, "workflow", "dataset", F.col("location_id") < 5).select("dataset_id", "workflow_id", "name")


@register("object_owners", with_cte(_OBJECT_OWNERS, **_REG))
def q_object_owners(spark, sf):
    """Owners of locations, workflows, datasets and models along the keys."""
    return K.object_owners(fx.registry(spark, sf))


_OBJECT_ACL = dict(_REG, own=_OBJECT_OWNERS, req=fx.OBJECT_REQUESTS_SQL,
                   acl="select grantor_id as owner_id, target_user_id, object_type, object_id, "
                       "arg_max(ts + interval 7 day, (ts, request_id)) as expiration, arg_max(access_type, (ts, request_id)) as access_type "
                       "from req r where exists (select 1 from own o where o.object_type = r.object_type and o.object_id = r.object_id "
                       "and o.owner_id = r.grantor_id) group by 1, 2, 3, 4")


def _object_acl(spark, sf):
    req = fx.object_requests(spark, sf).withColumn("expiration", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    own = K.object_owners(fx.registry(spark, sf))
    empty = spark.createDataFrame([], "owner_id bigint, target_user_id bigint, object_type string, "
                                      "object_id bigint, expiration timestamp_ntz, access_type string")
    return R.acl_grant(empty, req, own), own, req


@register("acl_grant_objects", with_cte("select * from acl", **_OBJECT_ACL))
def q_acl_grant_objects(spark, sf):
    """R6 on all four object types."""
    return _object_acl(spark, sf)[0]


@register("acl_access_objects", with_cte(
    "select q.request_id, q.user_id, q.object_type, q.object_id, coalesce(o.owner_id = q.user_id, false) as is_owner, "
    "coalesce(o.owner_id = q.user_id, false) or exists (select 1 from acl a where a.target_user_id = q.user_id "
    "and a.object_type = q.object_type and a.object_id = q.object_id and a.expiration > q.as_of) as allowed "
    "from q left join own o on o.object_type = q.object_type and o.object_id = q.object_id", **_OBJECT_ACL,
    q="select request_id, target_user_id as user_id, object_type, object_id, ts as as_of from req"))
def q_acl_access_objects(spark, sf):
    """R7 on all four object types."""
    acl, own, req = _object_acl(spark, sf)
    q = req.select("request_id", F.col("target_user_id").alias("user_id"), "object_type", "object_id", F.col("ts").alias("as_of"))
    return R.acl_access(q, own, acl)


@register("integrity_objects", with_cte(
    "select 'Location' as object_type, location_id as object_id, exists (select 1 from workflow w join analytical_model m using (workflow_id) "
    "where w.location_id = l.location_id and m.fitted) as has_fitted_model from location l union all "
    "select 'Workflow', workflow_id, exists (select 1 from analytical_model m where m.workflow_id = w.workflow_id and m.fitted) from workflow w union all "
    "select 'Dataset', dataset_id, exists (select 1 from workflow w join analytical_model m using (workflow_id) "
    "where w.workflow_id = d.workflow_id and m.fitted) from dataset d", **_REG))
def q_integrity_objects(spark, sf):
    """R8 for locations, workflows and datasets."""
    return K.integrity(fx.registry(spark, sf), F.col("fitted"))


_HANGS = {"workflow": "workflow_id", "workflow_results": "workflow_id", "preprocessing_config": "workflow_id", "analytical_model": "workflow_id",
          "dataset": "workflow_id", "model_metadata": "base_id", "model_data": "model_id", "model_results": "model_id",
          "dataset_metadata": "base_id", "location_metadata": "base_id", "location": "location_id", "access_control_list": "owner_id"}
_GONE = {"location": "select location_id from location where owner_id = 0", "workflow": "select workflow_id from workflow where location_id in ({location})",
         "analytical_model": "select model_id from analytical_model where workflow_id in ({workflow})",
         "dataset": "select dataset_id from dataset where workflow_id in ({workflow})"}
_GONE["workflow"] = _GONE["workflow"].format(location=_GONE["location"])
_GONE["analytical_model"] = _GONE["analytical_model"].format(workflow=_GONE["workflow"])
_GONE["dataset"] = _GONE["dataset"].format(workflow=_GONE["workflow"])
_HANGS_ON = {"workflow": "location", "location_metadata": "location", "workflow_results": "workflow", "preprocessing_config": "workflow",
             "analytical_model": "workflow", "dataset": "workflow", "model_metadata": "analytical_model", "model_data": "analytical_model",
             "model_results": "analytical_model", "dataset_metadata": "dataset"}


def _left_sql(t: str) -> str:
    if t == "location":
        where = "owner_id <> 0"
    elif t == "access_control_list":
        where = "owner_id <> 0 and target_user_id <> 0"
    else:
        fk = "location_id" if t == "workflow" else _HANGS[t]
        where = f"{fk} not in ({_GONE[_HANGS_ON[t]]})"
    return f"select '{t}' as table_name, count(*) as n, cast(coalesce(sum({_HANGS[t]}), 0) as bigint) as total from {t} where {where}"


@register("cascade_all", with_cte(" union all ".join(_left_sql(t) for t in _HANGS), **_REG))
def q_cascade_all(spark, sf):
    """Deleting a user takes their locations, all that hangs on them along the
    keys, and the grants from and to them; what is left of every table."""
    reg = fx.registry(spark, sf)
    left = K.REGISTRY.cascade(reg, "user", reg["user"].where(F.col("user_id") == 0))
    out = None
    for t, c in _HANGS.items():
        part = left[t].agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@register("run_status", with_cte(
    "select model_id, arg_max(status, (ts, event_id)) as status, arg_max(stage, (ts, event_id)) as stage, "
    "arg_max_null(message, (ts, event_id)) as message, "
    "cast(split_part(arg_max(stage, (ts, event_id)), '/', 1) as integer) as step, "
    "cast(split_part(arg_max(stage, (ts, event_id)), '/', 2) as integer) as steps, "
    "cast(split_part(arg_max(stage, (ts, event_id)), '/', 1) as integer) = "
    "cast(split_part(arg_max(stage, (ts, event_id)), '/', 2) as integer) as completed "
    "from log group by model_id", log=fx.RUN_LOG_SQL))
def q_run_status(spark, sf):
    """Latest status per model, stage parsed, completion flag."""
    return R.run_status(fx.run_log(spark, sf))


_REQ_SQL = ("select event_id as request_id, user_id * 10 as workflow_id, event_id as dataset_id, "
            "event_id * 2 as model_id from events")


@register("missing_ids", with_cte(
    "select * from (select r.*, concat_ws(', ', "
    "case when not exists (select 1 from customer c where c.c_custkey = r.workflow_id) "
    "then 'No workflow found for id: ' || r.workflow_id end, "
    "case when not exists (select 1 from documents d where d.doc_id = r.dataset_id) "
    "then 'No dataset found for id: ' || r.dataset_id end, "
    "case when not exists (select 1 from orders o where o.o_orderkey = r.model_id) "
    "then 'No analytical model found for id: ' || r.model_id end) as message from req r) where message <> ''",
    req=_REQ_SQL))
def q_missing_ids(spark, sf):
    """Every request's missing workflow / dataset / model ids."""
    ev = table(spark, sf, "events")
    req = ev.select(F.col("event_id").alias("request_id"), (F.col("user_id") * 10).alias("workflow_id"),
                    F.col("event_id").alias("dataset_id"), (F.col("event_id") * 2).alias("model_id"))
    return R.missing_ids(req, {"workflow_id": table(spark, sf, "customer").select("c_custkey"),
                               "dataset_id": table(spark, sf, "documents").select("doc_id"),
                               "model_id": table(spark, sf, "orders").select("o_orderkey")})


# ===================================================== full profile (2.4)

_DS_COLS = ["id", "response", *fx.FEATURES]


def _dataset_statistics_sql() -> str:
    from .functions.normal import ad_pvalue_sql, log_cdf_pair_sql
    longv = " union all ".join(f"select '{c}' as variable, cast({c} as double) as value from order_features"
                               for c in _DS_COLS)
    w = "((value - mu) / sd)"
    ln_cdf, ln_sf = log_cdf_pair_sql(w)
    a2 = ("case when max(sd) > 0 and max(n) > 1 then -max(n) - sum(cnt * (2 * r + cnt) * " + ln_cdf
          + " + cnt * (2 * (n - r) - cnt) * " + ln_sf + ") / max(n) else 0 end")
    body = f"""
longv as ({longv}),
st as (select variable, count(*) as n, avg(value) as mu, stddev_samp(value) as sd, max(value) as mx,
              min(value) as mn, count(distinct value) as u, count(*) filter (where value = 0) as z,
              median(value) as med, stddev_pop(value) as sdp, var_pop(value) as vp
       from longv group by variable),
mom as (select l.variable, avg(pow(value - s.mu, 2)) as m2, avg(pow(value - s.mu, 3)) as m3,
               avg(pow(value - s.mu, 4)) as m4 from longv l join st s on l.variable = s.variable
        group by l.variable),
hist as (select variable, value, count(*) as cnt from longv group by variable, value),
rk as (select h.variable, h.value, h.cnt, s.n, s.mu, s.sd,
              coalesce(sum(h.cnt) over (partition by h.variable order by h.value
                       rows between unbounded preceding and 1 preceding), 0) as r
       from hist h join st s on h.variable = s.variable),
ad as (select variable, {a2} as a2 from rk group by variable)
select s.variable, s.n as row_count, s.mx as maximum, s.mn as minimum, {sig_sql('s.mu')} as average,
       s.u as unique_values, s.z as zero_count, {sig_sql('s.med', 12)} as median, s.mx - s.mn as data_range,
       {sig_sql('ad.a2')} as ad_stat, {sig_sql(ad_pvalue_sql('ad.a2'), 6)} as ad_pvalue,
       {sig_sql('s.mu')} as mean, {sig_sql('s.sdp')} as std_dev, {sig_sql('s.vp')} as variance,
       {sig_sql('case when m.m2 > 0 then m.m4 / (m.m2 * m.m2) - 3 else -3 end')} as kurtosis,
       {sig_sql('case when m.m2 > 0 then m.m3 / pow(m.m2, 1.5) else 0 end')} as skewness
from st s join mom m on s.variable = m.variable join ad on s.variable = ad.variable
"""
    return f"with order_features as ({fx.ORDER_FEATURES_SQL}), {body}"


@register("dataset_statistics", _dataset_statistics_sql())
def q_dataset_statistics(spark, sf):
    """T1-T16 for every column of a dataset (id and response included), as
    the dataset view returns them: one row per variable, 16 fields."""
    p = profile(fx.order_features(spark, sf), _DS_COLS, response="response")
    return p.select("variable", "row_count", "maximum", "minimum", sig_col("average"), "unique_values",
                    "zero_count", sig_col("median", 12), "data_range", sig_col("ad_stat"),
                    sig("`ad_pvalue`", 6).alias("ad_pvalue"), sig_col("mean"), sig_col("std_dev"),
                    sig_col("variance"), sig_col("kurtosis"), sig_col("skewness"))


# ======================================================= streaming (2.9)

ROWWISE_DAG = {"nodes": {"1": {"function": "add", "args": {"c1": "x1", "c2": "x3"}},
                         "2": {"function": "log", "args": {"c": "x1+x3"}},
                         "3": {"function": "square", "args": {"c": "x2"}}},
               "edges": [[1, 2]]}


@register("dag_stream", with_cte(
    "select l_orderkey, l_linenumber, " + sig_sql("x1 + x3", 12) + " as \"x1+x3\", "
    + sig_sql("ln(x1 + x3)", 12) + " as \"ln(x1+x3)\", " + sig_sql("x2 * x2", 12) + " as \"(x2)^2\" "
    "from dag_frame", dag_frame=fx.DAG_FRAME_SQL))
def q_dag_stream(spark, sf):
    """Row-wise graph nodes on a Structured Streaming source: the line items
    arrive as files in the shared folder, the graph runs per micro-batch
    into a checkpointed file sink (exactly once), and the sink is read back."""
    from .streaming.rowwise import derive_stream, parquet_stream, run_to_table
    frame = fx.dag_frame(spark, sf)
    src = scratch_path(spark, "stream-src")
    write_dataset(frame, src)
    stream = parquet_stream(spark, src, frame.schema, max_files_per_trigger=4)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    run_to_table(derive_stream(stream, ROWWISE_DAG), out, ck)
    return read_dataset(spark, out).select("l_orderkey", "l_linenumber", sig_col("x1+x3", 12),
                                           sig_col("ln(x1+x3)", 12), sig_col("(x2)^2", 12))
