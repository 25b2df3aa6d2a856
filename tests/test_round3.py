"""Wide least squares, repeated folds, run log and restart, vectorised operations, sinks."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import registry as R
from tessera.operators import wide as W
from tessera.operators.selection import fit_ols
from tessera.plans import autoreg as AR
from tessera.plans.dag import DagError, apply_dag
from tessera.plans.run import FitRun
from tessera.session import scratch_path
from tessera.sources.tables import write_results


def array_frame(spark, X, y, parts=3):
    return spark.createDataFrame(pd.DataFrame({"y": y, "x": list(X)})).repartition(parts)


def least_norm(X, y):
    """Least squares of least norm on the scaled columns, by numpy on the rows."""
    Xc = X - X.mean(0)
    sd = Xc.std(0)
    sd[sd < 1e-12] = 1
    b = np.linalg.lstsq(Xc / sd, y - y.mean(), rcond=None)[0] / sd
    return y.mean() - X.mean(0) @ b, b


def test_a_thousand_predictors(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(3000, 1000)) * rng.uniform(0.1, 50, 1000) + rng.uniform(-500, 500, 1000)
    X[:, 700] += X[:, 3]
    y = X @ rng.normal(size=1000) + rng.normal(size=3000)
    b0, b = W.wide_ols(array_frame(spark, X, y, 4), "y", "x")
    want0, want = least_norm(X, y)
    assert np.allclose(b, want, rtol=1e-7, atol=1e-9) and b0 == pytest.approx(want0, rel=1e-7)


@pytest.mark.parametrize("block,hold", [(4, 1 << 20), (4, 500), (5, 1 << 20), (256, 1 << 20)])
def test_tiles_with_dependent_and_constant_columns(spark, block, hold):
    """Dependencies inside a block and across blocks, tiles handed on early, slices."""
    rng = np.random.default_rng(block)
    X = rng.normal(size=(2500, 13))
    X[:, 5], X[:, 9], X[:, 11], X[:, 2] = X[:, 1] + 2 * X[:, 3], X[:, 0] - X[:, 7], 3.0, X[:, 1]
    y = X @ rng.normal(size=13) + rng.normal(size=2500)
    b0, b = W.wide_ols(array_frame(spark, X, y), "y", "x", block, hold)
    want0, want = least_norm(X, y)
    assert np.allclose(b, want, atol=1e-8) and b0 == pytest.approx(want0, abs=1e-8)


def test_incomplete_rows_and_empty_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, None, 1.0), (float("nan"), 1.0, 1.0), (3.0, 5.0, 4.0), (0.0, 7.0, float("nan")), (4.0, 6.0, 5.5)],
                               "a double, b double, y double")
    m = fit_ols(df, "y", ["a", "b"])
    want0, want = least_norm(np.array([[1.0, 2], [3, 5], [4, 6]]), np.array([3.0, 4, 5.5]))
    assert np.allclose(m.coef, want) and m.intercept == pytest.approx(want0)
    assert fit_ols(df, "y", []).intercept == pytest.approx(np.mean([3, 1, 1, 4, 5.5]))
    with pytest.raises(ValueError):
        fit_ols(df.where("a > 9"), "y", ["a"])


def regression_frame(spark, n=300, k=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    y = 3 * x[:, 0] + 2 * x[:, 1] + x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) + 20
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)]).assign(y=y, id=np.arange(n))
    return spark.createDataFrame(pdf), pdf


def row_folds(ids, s):
    """Fold and split numbers from the documented digests, row by row."""
    import hashlib
    out = []
    for i in ids:
        d0 = hashlib.md5(f"{i}:{s.random_seed}".encode()).hexdigest()
        ds = [d0, *[hashlib.md5(f"{d0}:{r}".encode()).hexdigest() for r in range(1, s.cv_reps)]]
        word = lambda d, k: int(d[8 * k:8 * k + 8], 16)
        out.append((word(d0, 0) < int(s.test_split * 2 ** 32), [word(d, 1) % s.cv_folds for d in ds],
                    [word(d, 2) % s.cv_folds for d in ds], word(d0, 3) % s.cv_folds))
    return out


def pipeline_r2(pdf, cols, train, held, en, budget, K):
    """The inner pipeline on rows, without Grams of cells: R^2 on the held-out rows."""
    from itertools import combinations
    from tessera.operators import solvers as S
    X, y = pdf[cols].to_numpy(float), pdf["y"].to_numpy(float)

    def moments(rows, design):
        Z, t = design[rows], y[rows]
        return S.Moments(float(len(t)), Z.sum(0), Z.T @ Z, t.sum(), Z.T @ t, t @ t)

    mu, sd = X[train].mean(0), X[train].std(0)
    U = (X - mu) / sd
    kept = np.flatnonzero(S.lars(moments(train, U), budget) > 0)
    D = np.column_stack([np.ones(len(y)), U[:, kept], *[U[:, a] * U[:, b] for a, b in combinations(kept, 2)]])
    folds = [(moments(train & (en != e), D), moments(train & (en == e), D)) for e in range(K)]
    net = S.enet_cv(folds, moments(train, D))[2]
    sel = np.flatnonzero(net > 0)
    A = np.column_stack([np.ones(train.sum()), D[train][:, sel]])
    beta = np.linalg.lstsq(A, y[train], rcond=None)[0]
    p = np.column_stack([np.ones(held.sum()), D[held][:, sel]]) @ beta
    return 1 - ((y[held] - p) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum()


def test_inner_grid_with_repeats_equals_row_level_rebuild(spark):
    """Every inner score of a few groups, rebuilt from rows."""
    df, pdf = regression_frame(spark)
    s = AR.ModelSettings(cv_folds=3, cv_reps=2)
    cols = [f"x{i}" for i in range(6)]
    fit = AR.fit_auto_regression(df, "y", cols, settings=s, transforms=("None_T",), budgets=[1, 2])
    got = {(r.outer_fold, r.max_k, r.inner_fold): r.r2 for r in fit.inner_scores.collect()}
    assert len(got) == 7 * 2 * 6  # outer folds and the refit, budgets, inner folds
    parts = row_folds(pdf["id"], s)
    test = np.array([p[0] for p in parts])
    outer, inner, en = np.array([p[1] for p in parts]), np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
    for (o, b, i), r2 in got.items():
        if o in (AR.ALL, 0, 4):
            part = ~test & (outer[:, o // 3] != o % 3 if o != AR.ALL else True)
            hold = inner[:, i // 3] == i % 3
            assert r2 == pytest.approx(pipeline_r2(pdf, cols, part & ~hold, part & hold, en, b, 3), rel=1e-6, abs=1e-8)
    chosen = {r.outer_fold: r.max_k for r in fit.outer_scores.collect()}
    for o in range(6):
        mean = {b: np.mean([got[o, b, i] for i in range(6)]) for b in (1, 2)}
        assert chosen[o] == max((1, 2), key=lambda b: (mean[b], -b))
    cv = AR.cv_results(fit).first()
    assert [c for c in cv.asDict() if c.startswith("split")] == [f"split{i}_test_score" for i in range(6)]


def test_wide_fit_reads_no_broadcast(spark):
    """120 predictors with two small budgets: only kept columns meet in products."""
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 120))
    y = 4 * X[:, 7] + 2 * X[:, 90] + 0.1 * rng.normal(size=400)
    pdf = pd.DataFrame(X, columns=[f"c{i}" for i in range(120)]).assign(y=y, id=np.arange(400))
    fit = AR.fit_auto_regression(spark.createDataFrame(pdf), "y", [f"c{i}" for i in range(120)], settings=AR.ModelSettings(cv_folds=2),
                                 transforms=("None_T",), budgets=[2, 3])
    assert {"c7", "c90"} <= set(fit.model.lars_selected) and len(fit.model.pairs) < 60
    assert {r.split: r.r2 for r in AR.split_scores(fit.model, spark.createDataFrame(pdf)).collect()}["test"] > 0.99


def test_transform_that_is_not_finite_has_no_score(spark):
    df, _ = regression_frame(spark, 200, 2)
    fit = AR.fit_auto_regression(df.withColumn("y", F.col("y") * 100), "y", ["x0", "x1"], settings=AR.ModelSettings(cv_folds=2),
                                 transforms=("Exp_T", "LogMinPlus1_T", "None_T"))  # exp overflows
    scores = {(r.transform, r.outer_fold): r.r2 for r in fit.outer_scores.collect()}
    assert scores["Exp_T", 0] is None and scores["LogMinPlus1_T", 0] is not None
    assert fit.model.transform != "Exp_T"
    with pytest.raises(ValueError):
        AR.fit_auto_regression(df, "y", ["x0"], transforms=("Sqrt_T",))


def test_killed_fit_resumes_from_its_stages(spark, monkeypatch):
    df, _ = regression_frame(spark, 200, 3)
    s, path = AR.ModelSettings(cv_folds=2), scratch_path(spark, "resume")
    whole = AR.fit_auto_regression(df, "y", ["x0", "x1", "x2"], settings=s)

    class Killed(Exception):
        pass

    def killed(*a, **k):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(AR, "fit_selected", killed)
        with pytest.raises(Exception):
            AR.fit_auto_regression(df, "y", ["x0", "x1", "x2"], settings=s, run=FitRun(spark, path, 3))
    run = FitRun(spark, path, 3)
    failed = R.run_status(run.log()).first()
    assert (failed.status, failed.stage, failed.message, failed.completed) == ("Failed to complete", "-1/6", "Error setting the pipeline.", False)
    with monkeypatch.context() as m:  # finished stages are not run again
        m.setattr(AR, "_facts", killed)
        m.setattr(AR, "lars_selection", killed)
        m.setattr(AR, "array_cell_grams", killed)
        done = [n for n in ("facts", "linear_grams", "kept", "product_grams") if run._done(f"{path}/{n}")]
        assert done == ["facts", "linear_grams", "kept", "product_grams"] and not run._done(f"{path}/grid")
        again = AR.fit_auto_regression(df, "y", ["x0", "x1", "x2"], settings=s, run=run)
    assert again.model.selected_terms == whole.model.selected_terms and np.allclose(again.model.coef, whole.model.coef)
    r = R.run_status(run.log()).first()
    assert (r.model_id, r.status, r.stage, r.message, r.completed) == (3, "Complete", "6/6", None, True)
    assert [x.stage for x in run.log().orderBy("event_id").collect()][:4] == ["1/6", "2/6", "3/6", "4/6"]
    with pytest.raises(ValueError):
        AR.fit_auto_regression(df, "y", ["x0", "x1"], settings=s, run=FitRun(spark, path, 3))


def test_run_spec_is_plain_json(spark):
    run = FitRun(spark, scratch_path(spark, "spec"), 1)
    run.claim({"a": [1, 2], "b": None})
    run.claim({"a": (1, 2), "b": None})
    assert json.loads(json.dumps(run.value("spec", dict))) == {"a": [1, 2], "b": None}


def test_vectorised_operation_null_rules(spark):
    ops = [C.vectorised("ratio_rank", ("c1", "c2"), lambda c1, c2: f"{c1}/{c2}", lambda a, b: a / b),
           C.vectorised("fill", ("c",), lambda c: f"{c}0", lambda a: np.where(np.isnan(a), -1.0, a), nulls="pass"),
           C.vectorised("whole", ("c",), lambda c: f"int {c}", lambda a: a.astype(int), returns="bigint"),
           C.vectorised("short", ("c",), lambda c: f"short {c}", lambda a: a[:1])]
    for op in ops:
        C.register_operation(op)
    try:
        df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None), (8.0, 4.0)], "a double, b double").repartition(2)
        dag = {"nodes": {"1": {"function": "ratio_rank", "args": {"c1": "a", "c2": "b"}}, "2": {"function": "square", "args": {"c": "a/b"}},
                         "3": {"function": "fill", "args": {"c": "a"}}, "4": {"function": "whole", "args": {"c": "b"}}}, "edges": [[1, 2]]}
        got = {(r.a, r.b): (r["a/b"], r["(a/b)^2"], r["a0"], r["int b"]) for r in apply_dag(df, dag).collect()}
        assert got == {(1.0, 2.0): (0.5, 0.25, 1.0, 2), (None, 2.0): (None, None, -1.0, 2), (3.0, None): (None, None, 3.0, None), (8.0, 4.0): (2.0, 4.0, 8.0, 4)}
        assert apply_dag(df.limit(0), dag).count() == 0
        native = apply_dag(df, {"nodes": {"1": {"function": "square", "args": {"c": "a"}}}, "edges": []})
        assert "Python" not in native._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(Exception, match="values for"):
            apply_dag(df, {"nodes": {"1": {"function": "short", "args": {"c": "a"}}}, "edges": []}).collect()
        with pytest.raises(DagError):
            apply_dag(df, {"nodes": {"1": {"function": "fill", "args": {"c1": "a"}}}, "edges": []})
    finally:
        for op in ops:
            del C.OPERATIONS[op.name]


def test_result_sink_replaces_its_partitions_only(spark):
    path = scratch_path(spark, "sink")
    write_results(spark.createDataFrame([(1, 0.5), (2, 0.7), (2, 0.8)], "model_id int, score double"), path)
    write_results(spark.createDataFrame([(2, 0.9)], "model_id int, score double"), path)
    write_results(spark.createDataFrame([], "model_id int, score double"), path)
    assert sorted((r.model_id, r.score) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, 0.9)]
