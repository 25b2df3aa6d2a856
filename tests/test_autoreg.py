import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import autoreg as AR
from tessera.sources import fixtures as fx
from tessera.sources.artifacts import load_model, save_model

FEATS = ["n_lines", "sum_qty", "avg_disc", "avg_tax"]


@pytest.fixture(scope="module")
def fitted(spark, sf_tiny):
    df = fx.order_features(spark, sf_tiny)
    return AR.fit_auto_regression(df, "sum_ext", FEATS, key="id"), df


def md5_words(key, seed=42):
    h = hashlib.md5(f"{key}:{seed}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def brute_force_grams(pdf, feats, label, layout, shifts, mu, sd, mu_y, offsets, s):
    K = s.cv_folds
    G = np.zeros((layout.n_cells, layout.n_cells and 0 or 0)) if False else None
    X = (pdf[feats].to_numpy(float) - mu) / sd
    y = pdf[label].to_numpy(float)
    k = len(feats)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    cols = [np.ones(len(y)), *X.T, *[X[:, i] * X[:, j] for i, j in pairs], y - mu_y]
    for sh, off in zip(shifts, offsets[1:]):
        with np.errstate(invalid="ignore"):
            cols.append(np.log1p(y + sh) - off)
    Z = np.column_stack(cols)
    cells = []
    for key in pdf["id"]:
        w = md5_words(key, s.random_seed)
        if w[0] < int(s.test_split * 2 ** 32):
            cells.append(K ** 3)
        else:
            cells.append((w[1] % K) * K * K + (w[2] % K) * K + (w[3] % K))
    cells = np.array(cells)
    p = Z.shape[1]
    G = np.zeros((layout.n_cells, p, p))
    for c in np.unique(cells):
        Zc = np.nan_to_num(Z[cells == c], nan=0.0)
        G[c] = Zc.T @ Zc
    return G, cells


def test_settings_parse_text_booleans():
    s = AR.ModelSettings.from_metadata({"one_out": "False", "test_split": "0.25", "cv_folds": "4"})
    assert s.one_out is False and s.test_split == 0.25 and s.cv_folds == 4
    assert AR.ModelSettings.from_metadata({"one_out": "True"}).one_out is True


def test_candidates_grid():
    assert AR.candidates(9) == [4, 8]
    assert AR.candidates(4) == [500]
    assert AR.candidates(13) == [4, 8, 12]


def test_cells_and_grams_match_brute_force(spark, fitted):
    fit, df = fitted
    pdf = df.toPandas()
    s = AR.ModelSettings()
    base = AR.assign_cells(df, "id", s).select("id", "_cell").toPandas()
    got = dict(zip(base["id"], base["_cell"]))
    for key in pdf["id"]:
        w = md5_words(key)
        exp = 125 if w[0] < int(0.2 * 2 ** 32) else (w[1] % 5) * 25 + (w[2] % 5) * 5 + (w[3] % 5)
        assert got[key] == exp
    # fold counts cover every row exactly once
    assert len(got) == len(pdf)


def test_final_model_matches_numpy_grid(spark, fitted):
    """Re-run the whole grid from Grams built row by row in numpy."""
    fit, df = fitted
    m = fit.model
    pdf = df.toPandas()
    s = AR.ModelSettings()
    mu, sd = np.array(m.x_mean), np.array(m.x_sd)
    X = pdf[FEATS].to_numpy(float)
    assert np.allclose(mu, X.mean(0), rtol=1e-10)
    assert np.allclose(sd, X.std(0), rtol=1e-8)
    mu_y = pdf["sum_ext"].mean()
    # shifts: response is positive, so only the zero shift exists
    shifts = [0.0]
    offsets = [mu_y, math.log1p(mu_y)]
    layout = AR.Layout(len(FEATS), 5, 2)
    G, cells = brute_force_grams(pdf, FEATS, "sum_ext", layout, shifts, mu, sd, mu_y, offsets, s)
    t_idx = layout.px if m.transform == "None_T" else layout.px + 1
    K = s.cv_folds
    G_en = G[:K ** 3].reshape(K, K, K, *G.shape[1:]).sum(axis=(0, 1))
    sel = AR.lars_selection(G_en.sum(axis=0), len(FEATS), t_idx, [m.max_k])[m.max_k]
    want, terms, _, gap = AR.fit_selected(G_en.sum(axis=0), G_en, layout, t_idx, sel)
    assert gap <= 1e-8 and m.selected_terms == [AR._term_name(x, FEATS) for x in terms]
    at = {pair: 1 + len(FEATS) + i for i, pair in enumerate(layout.products)}
    got = np.zeros(layout.px)
    got[:1 + len(FEATS)] = m.coef[:1 + len(FEATS)]
    for (i, j), c in zip(m.pairs, m.coef[1 + len(FEATS):]):
        got[at[i, j]] = c
    assert np.allclose(want, got, rtol=1e-6, atol=1e-6 * max(1.0, np.abs(m.coef).max()))


def test_outer_scores_none_t_match_direct_r2(spark, fitted):
    fit, df = fitted
    outer = {(r["transform"], r["outer_fold"]): r["r2"] for r in fit.outer_scores.collect()}
    assert set(t for t, _ in outer) == {"None_T", "LogP1_T"}
    assert all(-10 < v <= 1 for v in outer.values())


def test_prediction_plan_is_native_and_roundtrips(spark, fitted):
    fit, df = fitted
    pred = fit.model.predict(df)
    plan = pred._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    path = save_model(spark, fit.model)
    again = load_model(spark, path).predict(df)
    a = {r["id"]: r["prediction"] for r in pred.select("id", "prediction").collect()}
    b = {r["id"]: r["prediction"] for r in again.select("id", "prediction").collect()}
    assert a == b


def test_split_scores_consistent(spark, fitted):
    fit, df = fitted
    sc = {r["split"]: r for r in AR.split_scores(fit.model, df).collect()}
    pdf = fit.model.predict(df).toPandas()
    ok = [md5_words(k)[0] >= int(0.2 * 2 ** 32) for k in pdf["id"]]
    tr = pdf[ok]
    r2 = 1 - ((tr["sum_ext"] - tr["prediction"]) ** 2).sum() / ((tr["sum_ext"] - tr["sum_ext"].mean()) ** 2).sum()
    assert sc["train"]["r2"] == pytest.approx(r2, rel=1e-9)


def test_one_out_and_empty_selection(spark, sf_tiny):
    df = fx.order_features(spark, sf_tiny)
    fit = AR.fit_auto_regression(df, "response", FEATS, key="id",
                                 settings=AR.ModelSettings(one_out=True))
    assert fit.model.transform in AR.TRANSFORMS
    sc = {r["split"] for r in AR.split_scores(fit.model, df).collect()}
    assert sc == {"train", "test"}  # both are all rows


def test_positive_selection_quirk_and_nonzero_option(spark):
    """The reference keeps only positive selector coefficients, so a useful
    negative predictor is dropped; ``keep='nonzero'`` retains it."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x1, x2 = rng.normal(), rng.normal()
        rows.append((i, x1, x2, 3 * x1 - 2 * x2 + rng.normal() - 1.0))
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    fit = AR.fit_auto_regression(df, "y", ["a", "b"], key="id")
    assert fit.model.transform == "None_T"
    assert fit.model.lars_selected == ["a"]
    r2 = {r["split"]: r["r2"] for r in AR.split_scores(fit.model, df).collect()}
    assert 0.5 < r2["train"] < 0.75
    fit2 = AR.fit_auto_regression(df, "y", ["a", "b"], key="id", keep="nonzero")
    assert fit2.model.lars_selected == ["a", "b"]
    r2b = {r["split"]: r["r2"] for r in AR.split_scores(fit2.model, df).collect()}
    assert r2b["train"] > 0.85


def test_edge_frame_collinear_constant_nan(spark):
    """Collinear and constant predictors, null/NaN rows: the fit completes,
    skips incomplete rows and predicts finite values."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        a = float(rng.normal())
        rows.append((i, a, 2.0 * a, 7.0, float(rng.normal()), 1.5 * a + float(rng.normal()) * 0.1))
    rows.append((300, None, 1.0, 7.0, 0.0, 1.0))
    rows.append((301, float("nan"), 1.0, 7.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "id long, a double, a2 double, c double, noise double, y double")
    fit = AR.fit_auto_regression(df, "y", ["a", "a2", "c", "noise"], key="id")
    assert "c" not in fit.model.lars_selected
    pred = fit.model.predict(df.where("id < 300")).select("prediction").toPandas()["prediction"]
    assert np.isfinite(pred).all()
    r2 = {r["split"]: r["r2"] for r in AR.split_scores(fit.model, df.where("id < 300")).collect()}
    assert r2["train"] > 0.9


def test_no_positive_coefficient_gives_intercept_model(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), -3.0 * float(x) + float(rng.normal()) * 0.01)
            for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    fit = AR.fit_auto_regression(df, "y", ["x"], key="id")
    assert fit.model.lars_selected == [] and fit.model.selected_terms == []
    preds = fit.model.predict(df).select("prediction").distinct().count()
    assert preds == 1


def test_gram_ols_equals_spark_ml(spark, sf_tiny):
    """Cross-check: OLS from the one-pass Gram equals pyspark.ml's normal-equation solver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from tessera.operators.selection import fit_ols
    feats = ["n_lines", "sum_qty", "avg_disc", "avg_tax"]
    df = fx.order_features(spark, sf_tiny)
    ours = fit_ols(df, "sum_ext", feats)
    va = VectorAssembler(inputCols=feats, outputCol="features")
    ml = LinearRegression(featuresCol="features", labelCol="sum_ext", solver="normal",
                          regParam=0.0, standardization=False).fit(va.transform(df))
    assert ours.intercept == pytest.approx(ml.intercept, rel=1e-8)
    assert np.allclose(ours.coef, ml.coefficients.toArray(), rtol=1e-8)
