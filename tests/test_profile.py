import math

import numpy as np
import pytest

from tessera.operators.profile import profile, rank_summary, simple_ols
from tessera.sources.tables import table


def ad_numpy(x):
    """Anderson-Darling A^2 for normality (sample sd), exact normal CDF."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    w = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in w])
    sf = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in w])
    i = np.arange(1, n + 1)
    return -n - np.sum((2 * i - 1) / n * (np.log(cdf) + np.log(sf[::-1])))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(10, 3, 400).round(2)            # ties from rounding
    b = rng.exponential(2.0, 400)
    c = np.full(400, 5.0)                            # constant
    d = np.where(rng.random(400) < 0.3, 0.0, rng.normal(0, 1, 400))  # many zeros
    rows = [(float(a[i]), float(b[i]), float(c[i]), float(d[i])) for i in range(400)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double"), (a, b, c, d)


def test_profile_matches_numpy(frame):
    df, cols = frame
    got = {r["variable"]: r for r in profile(df).collect()}
    for name, x in zip("abcd", cols):
        r = got[name]
        assert r["row_count"] == 400 and r["null_count"] == 0
        assert r["maximum"] == x.max() and r["minimum"] == x.min()
        assert r["average"] == pytest.approx(x.mean(), rel=1e-12, abs=1e-12)
        assert r["unique_values"] == len(np.unique(x))
        assert r["zero_count"] == int((x == 0).sum())
        assert r["median"] == pytest.approx(np.median(x), rel=1e-12)
        assert r["data_range"] == pytest.approx(np.ptp(x))
        assert r["std_dev"] == pytest.approx(x.std(), rel=1e-9, abs=1e-12)
        assert r["variance"] == pytest.approx(x.var(), rel=1e-9, abs=1e-12)
        if x.std() > 0:
            m = x - x.mean()
            assert r["kurtosis"] == pytest.approx((m ** 4).mean() / (m ** 2).mean() ** 2 - 3, rel=1e-8)
            assert r["skewness"] == pytest.approx((m ** 3).mean() / (m ** 2).mean() ** 1.5, rel=1e-8)
            assert r["ad_stat"] == pytest.approx(ad_numpy(x), rel=1e-9)
        else:
            assert r["kurtosis"] == -3.0 and r["skewness"] == 0.0
            assert r["ad_stat"] == 0.0 and r["ad_pvalue"] == 0.0


# Coefficients of the published p-value fit, lowest power first.
AD_LOW = [2.00012, 0.247105, -0.0649821, 0.0347962, -0.011672, 0.00168691]
AD_HIGH = [1.0776, -2.30695, 0.43424, -0.082433, 0.008056, -0.0003146]


def test_ad_pvalue_formula(frame):
    from numpy.polynomial import polynomial as P
    df, _ = frame
    for r in profile(df).collect():
        a = r["ad_stat"]
        if a <= 0:
            continue
        if a < 2:
            cdf = math.exp(-1.2337141 / a) / math.sqrt(a) * P.polyval(a, AD_LOW)
        else:
            cdf = math.exp(-math.exp(P.polyval(a, AD_HIGH)))
        assert r["ad_pvalue"] == pytest.approx(1 - cdf, rel=1e-9, abs=1e-12)


def test_ad_affine_invariance(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 1.5, 300)
    df = spark.createDataFrame([(float(v), float(3.5 - 2.0 * v)) for v in x], "x double, y double")
    r = {row["variable"]: row["ad_stat"] for row in rank_summary(df, ["x", "y"]).collect()}
    assert r["x"] == pytest.approx(r["y"], rel=1e-9)


def test_bucketed_ranks_equal_single_window(spark, sf_tiny):
    li = table(spark, sf_tiny, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = {r["variable"]: r for r in rank_summary(li, cols).collect()}
    many = {r["variable"]: r for r in rank_summary(li, cols, rows_per_bucket=97).collect()}
    for c in cols:
        for f in ("unique_values", "median", "ad_stat", "maximum", "zero_count"):
            assert one[c][f] == pytest.approx(many[c][f], rel=1e-12)


def test_equal_under_repartitioning(spark, sf_tiny):
    li = table(spark, sf_tiny, "lineitem")
    a = {r["variable"]: r["ad_stat"] for r in rank_summary(li, ["l_extendedprice"]).collect()}
    b = {r["variable"]: r["ad_stat"] for r in rank_summary(li.repartition(13), ["l_extendedprice"]).collect()}
    assert a["l_extendedprice"] == pytest.approx(b["l_extendedprice"], rel=1e-12)


def test_nulls_skipped_and_counted(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "v double")
    r = profile(df).first()
    assert r["row_count"] == 4 and r["null_count"] == 2
    assert r["average"] == 2.0 and r["median"] == 2.0


def test_single_row(spark):
    r = profile(spark.createDataFrame([(4.0,)], "v double")).first()
    assert r["ad_stat"] == 0.0 and r["median"] == 4.0 and r["variance"] == 0.0


def test_strict_rejects_text(spark):
    df = spark.createDataFrame([(1.0, "a")], "v double, s string")
    with pytest.raises(TypeError):
        profile(df, strict=True)


def test_simple_ols_matches_polyfit(frame, spark):
    df, (a, b, c, d) = frame
    got = {r["variable"]: r for r in simple_ols(df, "a", ["b", "d"]).collect()}
    for name, x in (("b", b), ("d", d)):
        slope, intercept = np.polyfit(x, a, 1)
        assert got[name]["slope"] == pytest.approx(slope, rel=1e-9)
        assert got[name]["intercept"] == pytest.approx(intercept, rel=1e-9)


def test_response_fallback(spark):
    from tessera.operators.profile import resolve_response
    df = spark.createDataFrame([(1, 2.0, 3.0)], "ID long, Response double, x double")
    assert resolve_response(df, "x") == "x"
    assert resolve_response(df, "missing") == "Response"
    assert resolve_response(df.drop("Response"), None) == "ID"


def test_reference_mode_zeroes_response_ad(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(size=200), rng.exponential(size=200))]
    df = spark.createDataFrame(rows, "Response double, x double")
    ref = {r["variable"]: r["ad_stat"] for r in profile(df, ad_mode="reference").collect()}
    col = {r["variable"]: r["ad_stat"] for r in profile(df).collect()}
    assert ref["Response"] == 0.0 and col["Response"] > 0
    assert ref["x"] == pytest.approx(col["x"])


def test_csv_scan_types(spark, tmp_path):
    from tessera.sources.tables import read_dataset, write_dataset
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "ID long, Response double")
    path = str(tmp_path / "ds")
    write_dataset(df, path, fmt="csv")
    back = read_dataset(spark, path, fmt="csv")
    assert dict(back.dtypes) == {"ID": "bigint", "Response": "double"}


def test_profile_reads_its_input_once(spark, sf_tiny):
    calls = spark.sparkContext.accumulator(0)
    from pyspark.sql import types as T

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    li = table(spark, sf_tiny, "lineitem").select("l_quantity", "l_extendedprice")
    df = profile(li.mapInArrow(counted, T.StructType(li.schema.fields)))
    df.collect()
    assert calls.value == li.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hard_columns_at_any_partitioning(spark):
    rows = [(None, 1.0 if i else 0.0, 0.1, float("-inf") if i % 7 == 0 else float(i), 0.0 if i % 2 else -0.0, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "empty double, most double, same double, logged double, zeros double, ties double")
    one = {r["variable"]: r for r in profile(df).collect()}
    many = {r["variable"]: r for r in profile(df, rows_per_bucket=5).collect()}
    assert set(one) == set(many) == set(df.columns)
    for c in df.columns:
        for a, b in zip(one[c], many[c]):
            assert a == b or a == pytest.approx(b, rel=1e-9, nan_ok=True), c
    assert one["empty"]["row_count"] == one["empty"]["null_count"] == 300 and one["empty"]["average"] is None
    assert (one["same"]["kurtosis"], one["same"]["skewness"], one["same"]["variance"], one["same"]["ad_stat"]) == (-3.0, 0.0, 0.0, 0.0)
    assert one["logged"]["minimum"] == float("-inf") and one["logged"]["ad_stat"] == 0.0
    assert one["zeros"]["unique_values"] == 1 and one["zeros"]["zero_count"] == 300


def test_approx_profile_close_to_exact(spark, sf_tiny):
    from tessera.operators.profile import approx_profile
    li = table(spark, sf_tiny, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    ex = {r["variable"]: r for r in profile(li, cols).collect()}
    ap = {r["variable"]: r for r in approx_profile(li, cols).collect()}
    for c in cols:
        e, a = ex[c], ap[c]
        assert a["row_count"] == e["row_count"] and a["zero_count"] == e["zero_count"]
        assert a["maximum"] == e["maximum"] and a["minimum"] == e["minimum"]
        assert a["mean"] == pytest.approx(e["mean"], rel=1e-9)
        assert a["variance"] == pytest.approx(e["variance"], rel=1e-6)
        assert a["kurtosis"] == pytest.approx(e["kurtosis"], rel=1e-6, abs=1e-9)
        assert abs(a["unique_values"] - e["unique_values"]) <= 0.1 * e["unique_values"] + 1
        assert a["ad_stat"] is None


def test_moments_equal_the_rank_path_without_a_value_exchange(spark, sf_tiny):
    from tessera.operators.profile import moment_summary
    rows = [(None, 0.1, float("-inf") if i % 7 == 0 else float(i), float(i % 3), float(i) ** 2) for i in range(300)]
    df = spark.createDataFrame(rows, "empty double, same double, logged double, ties double, wide double")
    fast = moment_summary(df, df.columns)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_" in plan and "RangePartitioning" not in plan
    ranks = {r["variable"]: r for r in rank_summary(df, df.columns).collect()}
    for r in fast.collect():
        for f in fast.columns:
            a, b = r[f], ranks[r["variable"]][f]
            assert a == b or a == pytest.approx(b, rel=1e-9, nan_ok=True), (r["variable"], f)


@pytest.mark.parametrize("accuracy", [5, 100, 10000])
def test_medians_from_sketches_and_counts(spark, accuracy):
    """Small sketches need many rounds; ties, infinities, even and odd sizes, none."""
    from tessera.operators.profile import exact_medians, median_unique
    rng = np.random.default_rng(accuracy)
    cols = {"normal": rng.normal(size=801), "ties": rng.integers(0, 4, 801), "even": [*rng.exponential(size=800), None],
            "inf": [float("-inf")] * 300 + [float("inf")] * 501, "none": [None] * 801, "one": [None] * 800 + [7.0], "far": 1e15 + rng.integers(0, 3, 801),
            "nan": [float("nan")] * 400 + [*range(401)], "two": [None] * 799 + [0.0, -0.0]}
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    want = {}
    for c, v in cols.items():
        known = [float(x) for x in v if x is not None and not math.isnan(x)]
        want[c] = float(np.median(known)) if known else None
    got = exact_medians(df, list(cols), accuracy)
    assert got == want
    if accuracy == 10000:
        both = {r.variable: (r.unique_values, r.median) for r in median_unique(df, list(cols)).collect()}
        assert both == {c: (len({float(x) + 0.0 for x in v if x is not None and not math.isnan(x)}), want[c]) for c, v in cols.items()}
        assert exact_medians(df.limit(0), ["normal"]) == {"normal": None} and exact_medians(df, []) == {}
