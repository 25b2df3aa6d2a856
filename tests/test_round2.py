"""Offsets, nulls, wide inputs, settings and registry forms."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import registry as R
from tessera.operators import selection as SEL
from tessera.operators.crossval import fold_r2
from tessera.plans import autoreg as AR
from tessera.sources.tables import table


def test_ols_on_offset_predictors_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 100, 3000)
    y = 2.0 * x + rng.normal(size=3000)
    rows = [(float(a) + 1.7e9, float(b), 5.0) for a, b in zip(x, y)] + [(None, 1.0, 5.0), (3.0, None, 5.0), (float("nan"), 2.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, same double")
    want = np.polyfit(x, y, 1)[0]
    m = SEL.fit_ols(df, "y", ["x", "same"])
    assert m.coef[0] == pytest.approx(want, rel=1e-6) and m.coef[1] == pytest.approx(0, abs=1e-9)
    chosen, coef = SEL.select_features(df, "y", ["x", "same"], "lars", 5)
    assert chosen == ["x"] and coef[0] == pytest.approx(want, rel=1e-6)


def test_sixty_four_predictors(spark, sf_tiny):
    emb = table(spark, sf_tiny, "embeddings")
    names = [f"e{i}" for i in range(64)]
    df = emb.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    pdf = df.toPandas()
    A = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
    want = np.linalg.lstsq(A, pdf["label"].to_numpy(float), rcond=None)[0]
    m = SEL.fit_ols(df, "label", names)
    assert np.allclose([m.intercept, *m.coef], want, rtol=1e-6, atol=1e-8)
    _, coef = SEL.select_features(df, "label", names, "lars")
    assert np.allclose(coef, want[1:], rtol=1e-5, atol=1e-7)


def frame(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = 3 * x[:, 0] + 2 * x[:, 1] + x[:, 0] * x[:, 1] + 0.1 * rng.normal(size=n) + 20
    rows = [(i if i % 50 else None, *map(float, r), float(b)) for i, (r, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{i} double" for i in range(6)) + ", y double")


X = [f"x{i}" for i in range(6)]


def test_fit_without_unused_products_equals_full_fit(spark):
    df = frame(spark)
    full = AR.fit_auto_regression(df, "y", X, products="all")
    lean = AR.fit_auto_regression(df, "y", X)
    assert lean.model.pairs is not None and lean.model.selected_terms == full.model.selected_terms
    a = full.model.predict(df).select("prediction").toPandas()["prediction"]
    b = lean.model.predict(df).select("prediction").toPandas()["prediction"]
    assert np.allclose(a, b, rtol=1e-8)


def test_published_settings_and_graph(spark):
    s = AR.ModelSettings.from_metadata({"cv_folds": "3", "cv_reps": "2"})
    dag = {"nodes": {"1": {"function": "add", "args": {"c1": "x0", "c2": "x1"}}}, "edges": []}
    df = frame(spark, 200)
    fit = AR.fit_auto_regression(df, "y", ["x0", "x0+x1"], settings=s, dag=dag)
    assert fit.model.settings["cv_reps"] == 2
    again = AR.RegressionModel.from_json(fit.model.to_json())
    assert "prediction" in again.predict(df).columns and again.predict(df).where("prediction is null").count() == 0


def test_fold_r2_of_a_constant_predictor(spark):
    df = spark.createDataFrame([(i % 3, 1.0, float(i)) for i in range(30)], "fold int, x double, y double")
    assert all(r.r2 <= 0.0 for r in fold_r2(df, "y", "x", "fold").collect())
    one = spark.createDataFrame([(0, 1.0, 2.0)], "fold int, x double, y double")
    assert fold_r2(one, "y", "x", "fold").first().r2 is None


def test_confusion_grid_has_zeros(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0), (1, 0)], "actual int, predicted int")
    got = {(r.actual, r.predicted): r["count"] for r in M.confusion_grid(df).collect()}
    assert got == {(a, p): {(0, 0): 1, (0, 2): 1, (1, 0): 2}.get((a, p), 0) for a in range(3) for p in range(3)}


def test_versioned_update_keeps_every_row(spark):
    big = 2 ** 53
    t = spark.createDataFrame([(big + i, f"n{i}") for i in range(6)], "k long, name string")
    upd = spark.createDataFrame([(big + i, f"u{i}-{j}", j) for i in range(6) for j in range(3)], "k long, name string, seq long")
    out = R.versioned_update(t, upd, t.select("k", F.lit(True).alias("has_fitted_model")), "k", order="seq", rows_per_bucket=2).collect()
    new = sorted((r.k, r.name, r.replaces) for r in out if r.replaces is not None)
    assert new == [(big + 6 + i, f"u{i}-2", big + i) for i in range(6)] and len(out) == 12


def test_writes_of_null_replace(spark):
    cur = spark.createDataFrame([(1, "message", "old error", 1), (1, "status", "x", 2)], "base_id long, name string, value string, seq long")
    upd = spark.createDataFrame([(1, "message", None, 5)], cur.schema)
    got = {r["name"]: (r.value, r.seq) for r in R.metadata_upsert(cur, upd).collect()}
    assert got == {"message": (None, 5), "status": ("x", 2)}


def test_list_children_of_a_parent(spark):
    locs = spark.createDataFrame([(1, 7), (2, 8)], "location_id long, owner_id long")
    wfs = spark.createDataFrame([(10, 1), (11, 2)], "workflow_id long, location_id long")
    kids = R.list_children(wfs, locs.where("location_id = 2"), fk="location_id", pk="location_id")
    assert [r.workflow_id for r in kids.collect()] == [11]


def test_run_log_writer(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    log = R.run_log_rows(spark, 5, [(t, 1, "Running", "1/6", "loading"), (t, 2, "Complete", "6/6", None)])
    r = R.run_status(log).first()
    assert (r.status, r.stage, r.message, r.completed) == ("Complete", "6/6", None, True)


def test_scratch_tables_can_be_cleared(spark):
    from tessera.session import clear_scratch, scratch_table
    from tessera.session import checkpoint_dir
    t = scratch_table(spark.range(3), "clear")
    other = f"{checkpoint_dir(spark).rstrip('/')}/tessera-tables/another-application/t"
    spark.range(2).write.parquet(other)
    assert t.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception):
        t.count()
    assert spark.read.parquet(other).count() == 2
