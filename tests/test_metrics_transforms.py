import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.transforms import ExpT, LogMinPlus1, LogP1, LogSigned, NoneT
from tessera.operators import metrics as M
from tessera.operators.features import interactions, standardize
from tessera.operators.split import with_folds, with_split


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(50, 10, 500)
    p = a + rng.normal(0, 4, 500)
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "actual double, predicted double"), a, p


def test_regression_metrics(pairs):
    df, a, p = pairs
    r = M.regression_metrics(df).first()
    e = a - p
    assert r["max_error"] == pytest.approx(np.abs(e).max())
    assert r["mean_absolute_error"] == pytest.approx(np.abs(e).mean())
    assert r["mean_squared_error"] == pytest.approx((e ** 2).mean())
    assert r["root_mean_squared_error"] == pytest.approx(np.sqrt((e ** 2).mean()))
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / ((a - a.mean()) ** 2).sum(), rel=1e-10)


def test_r2_constant_actual(spark):
    exact = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "actual double, predicted double")
    off = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "actual double, predicted double")
    assert M.regression_metrics(exact).first()["r2"] == 1.0
    assert M.regression_metrics(off).first()["r2"] == 0.0


def test_accuracy_and_confusion(spark):
    rows = [(1, 1), (1, 0), (0, 0), (2, 1), (2, 2), (0, 0)]
    df = spark.createDataFrame(rows, "actual int, predicted int")
    assert M.accuracy(df).first()["accuracy"] == pytest.approx(4 / 6)
    wide = M.confusion_matrix(df).collect()
    grid = [[r[str(lab)] for lab in (0, 1, 2)] for r in wide]
    assert grid == [[2, 0, 0], [1, 1, 0], [0, 1, 1]]


@pytest.mark.parametrize("t", [NoneT(), LogP1(), LogMinPlus1()])
def test_inverse_roundtrip(spark, t):
    df = spark.createDataFrame([(-3.5,), (0.0,), (2.0,), (120.0,)], "y double")
    fitted = t.fit(df, "y")
    out = df.select("y", fitted.inverse(fitted.forward(F.col("y"))).alias("back")).collect()
    for r in out:
        assert r["back"] == pytest.approx(r["y"], abs=1e-9)


def test_logp1_shift(spark):
    df = spark.createDataFrame([(-3.0,), (5.0,)], "y double")
    assert LogP1().fit(df, "y").shift == 3.0
    df2 = spark.createDataFrame([(1.0,), (5.0,)], "y double")
    assert LogP1().fit(df2, "y").shift == 0.0


def test_signed_log_and_exp(spark):
    df = spark.createDataFrame([(-math.e,), (0.0,), (math.e ** 2,)], "y double")
    fwd = [r[0] for r in df.select(LogSigned().forward(F.col("y"))).collect()]
    assert fwd[0] == pytest.approx(-1.0) and math.isnan(fwd[1]) and fwd[2] == pytest.approx(2.0)
    inv = [r[0] for r in df.select(ExpT().inverse(F.col("y"))).collect()]
    assert inv[0] == 0.0 and inv[1] == 0.0 and inv[2] == pytest.approx(2.0)


def test_split_and_folds_deterministic(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "id")
    a = with_split(df, "id").groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in a}
    assert 800 < counts["test"] < 1200 and counts["test"] + counts["train"] == 5000
    f1 = with_folds(df, "id").orderBy("id").collect()
    f2 = with_folds(df.repartition(7), "id").orderBy("id").collect()
    assert f1 == f2
    sizes = with_folds(df, "id").groupBy("outer_fold").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and all(800 < r["count"] < 1200 for r in sizes)
    assert {r["split"] for r in with_split(df, "id", one_out=True).select("split").distinct().collect()} == {"train"}


def test_standardize_and_interactions(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 5.0, 5.0)], "id long, a double, c double")
    st = standardize(df, ["a", "c"], keep=["id"]).orderBy("id").collect()
    sd = np.std([1.0, 3.0, 5.0])
    assert st[0]["a"] == pytest.approx(-2.0 / sd) and st[0]["c"] == 0.0
    it = interactions(df, ["a", "c"], keep=["id"]).orderBy("id").first()
    assert it["1"] == 1.0 and it["a*c"] == 5.0 and "a*a" not in it.asDict()
