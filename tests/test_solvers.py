import numpy as np
import pytest

from tessera.operators import solvers as S


def moments(X, y):
    n = len(y)
    return S.Moments(float(n), X.sum(0), X.T @ X, float(y.sum()), X.T @ y, float(y @ y))


@pytest.fixture
def data():
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    y = X @ np.array([1.5, -2.0, 0.0, 0.7, 0.0, 3.0]) + rng.normal(size=300) * 2 + 5
    return X, y


def test_ols_matches_lstsq(data):
    X, y = data
    b0, b = S.ols(moments(X, y))
    A = np.column_stack([np.ones(len(y)), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert b0 == pytest.approx(ref[0], rel=1e-8)
    assert np.allclose(b, ref[1:], rtol=1e-8)


def test_r2_from_moments(data):
    X, y = data
    b0, b = S.ols(moments(X, y))
    pred = b0 + X @ b
    r2 = 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert S.r2(moments(X, y), b0, b) == pytest.approx(r2, rel=1e-10)


def textbook_lar(X, y, steps):
    """Efron et al. LAR on standardised columns, no sign-flip handling."""
    Xc = X - X.mean(0)
    norms = np.sqrt((Xc ** 2).sum(0))
    Xn = Xc / norms
    yc = y - y.mean()
    beta = np.zeros(X.shape[1])
    active = []
    for _ in range(steps):
        c = Xn.T @ (yc - Xn @ beta)
        inactive = [j for j in range(len(beta)) if j not in active]
        j = inactive[int(np.argmax(np.abs(c[inactive])))]
        active.append(j)
        C = np.abs(c[j])
        s = np.sign(c[active])
        XA = Xn[:, active] * s
        GA = XA.T @ XA
        w = np.linalg.solve(GA, np.ones(len(active)))
        AA = 1 / np.sqrt(w.sum())
        w = w * AA
        u = XA @ w
        a = Xn.T @ u
        rest = [k for k in range(len(beta)) if k not in active]
        cands = [C / AA]
        for k in rest:
            for g in ((C - c[k]) / (AA - a[k]), (C + c[k]) / (AA + a[k])):
                if g > 1e-12:
                    cands.append(g)
        gamma = min(cands)
        beta[active] += gamma * s * w
    return beta / norms


def test_lars_matches_textbook_steps(data):
    X, y = data
    for steps in (1, 2, 3):
        ours = S.lars(moments(X, y), steps)
        ref = textbook_lar(X, y, steps)
        assert np.allclose(ours, ref, rtol=1e-7, atol=1e-9)


def test_lars_full_path_is_ols(data):
    X, y = data
    ours = S.lars(moments(X, y), 500)
    _, b = S.ols(moments(X, y))
    assert np.allclose(ours, b, rtol=1e-6)


def test_lars_one_step_picks_top_correlation(data):
    X, y = data
    c = np.abs(np.corrcoef(np.column_stack([X, y]).T)[-1, :-1])
    coef = S.lars(moments(X, y), 1)
    assert np.count_nonzero(coef) == 1 and np.argmax(np.abs(coef)) == np.argmax(c)


def test_enet_kkt(data):
    X, y = data
    m = moments(X, y)
    alpha, l1 = 0.5, 0.5
    b0, w = S.enet_fit(m, alpha, l1)
    n = len(y)
    r = y - b0 - X @ w
    Xc = X - X.mean(0)
    grad = Xc.T @ r / n - alpha * (1 - l1) * w
    for j in range(len(w)):
        if w[j] != 0:
            assert grad[j] == pytest.approx(alpha * l1 * np.sign(w[j]), abs=2e-3)
        else:
            assert abs(grad[j]) <= alpha * l1 + 2e-3


def test_enet_top_alpha_is_empty_and_small_alpha_near_ols(data):
    X, y = data
    m = moments(X, y)
    grid = S.alpha_grid(m)
    assert len(grid) == 100 and grid[0] > grid[-1]
    _, w = S.enet_fit(m, grid[0] * 1.0000001)
    assert np.allclose(w, 0)
    _, w_small = S.enet_fit(m, 1e-8)
    _, b = S.ols(m)
    assert np.allclose(w_small, b, rtol=1e-3, atol=1e-3)


def test_enet_cv_returns_grid_alpha(data):
    X, y = data
    folds = np.arange(len(y)) % 5
    parts = [(moments(X[folds != f], y[folds != f]), moments(X[folds == f], y[folds == f])) for f in range(5)]
    alpha, b0, w, path = S.enet_cv(parts, moments(X, y))
    assert alpha in set(S.alpha_grid(moments(X, y)))
    assert path.shape == (100,) and np.argmin(path) == list(S.alpha_grid(moments(X, y))).index(alpha)


def test_moments_transform_consistent(data):
    X, y = data
    T = np.array([[1.0, 0, 0, 0, 0, 0], [0.5, -1.0, 0, 0, 2.0, 0]])
    Z = np.column_stack([np.ones(len(y)), X, y])
    G = Z.T @ Z
    m = S.moments_from_gram(G, list(range(1, 7)), 7, T)
    F_ = X @ T.T
    ref = moments(F_, y)
    assert np.allclose(m.sxx, ref.sxx) and np.allclose(m.sxy, ref.sxy)


def test_lars_with_sign_changes_ends_at_ols():
    """Strongly correlated columns make coefficients cross zero along the
    path; the full path still ends at least squares, and partial budgets
    never keep more columns than steps."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(400, 1))
    X = base + 0.15 * rng.normal(size=(400, 10))
    y = X @ rng.normal(size=10) * 3 + rng.normal(size=400)
    m = moments(X, y)
    _, b = S.ols(m)
    assert np.allclose(S.lars(m, 500), b, rtol=1e-6, atol=1e-8)
    for steps in (1, 3, 5):
        assert np.count_nonzero(S.lars(m, steps)) <= steps


def test_lars_degenerate_duplicate_column():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    X = np.column_stack([x, x[:, 0]])          # exact duplicate column
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    coef = S.lars(moments(X, y), 500)
    # the duplicate is numerically inside the active span: set aside, never enters
    assert np.all(np.isfinite(coef))
    assert coef[2] == 0.0 and coef[0] > 0 and coef[1] < 0


def test_cell_grams_sum_to_total(spark):
    from pyspark.sql import functions as F
    from tessera.operators.moments import cell_grams
    rng = np.random.default_rng(13)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(500, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(5)
    xs, ys = [F.col("a"), F.col("b")], [F.col("y")]
    per = cell_grams(df, xs, ys, F.pmod(F.col("id"), F.lit(7)), 7)
    total = cell_grams(df, xs, ys, F.lit(0), 1)[0]
    assert np.allclose(per.sum(axis=0), total, rtol=1e-12, atol=1e-9)
    X = np.array([[r[1], r[2]] for r in rows]); y = np.array([r[3] for r in rows])
    Z = np.column_stack([np.ones(500), X, X[:, 0] * X[:, 1], y])
    assert np.allclose(total, Z.T @ Z, rtol=1e-12, atol=1e-9)


def tied_designs():
    """Integer data whose columns tie: exchangeable pairs and factorial designs."""
    from itertools import product
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, y = rng.integers(-5, 6, (30, 3)), rng.integers(-9, 10, 30)
        yield np.vstack([a, a[:, [1, 0, 2]]]).astype(float), np.tile(y, 2).astype(float)
    design = np.array(list(product([-1.0, 1.0], repeat=4)) * 2)
    for _ in range(300):
        yield design, rng.integers(-3, 4, len(design)).astype(float)


def test_lars_full_path_equals_least_squares_on_tied_columns():
    for X, y in tied_designs():
        full = np.linalg.lstsq(np.column_stack([np.ones(len(y)), X]), y, rcond=None)[0][1:]
        assert np.allclose(S.lars(moments(X, y), 500), full, atol=1e-9)


def test_lars_does_not_depend_on_the_order_of_tied_columns():
    rng = np.random.default_rng(3)
    for n, (X, y) in enumerate(tied_designs()):
        if n % 10 == 0:
            order = rng.permutation(X.shape[1])
            for steps in (1, 2, 3):
                assert np.allclose(S.lars(moments(X[:, order], y), steps), S.lars(moments(X, y), steps)[order], atol=1e-12)


def test_lars_with_a_repeated_column_still_ends_at_least_squares():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 6))
    X[:, 4] = X[:, 1]
    y = X @ rng.normal(size=6) + rng.normal(size=60)
    Xc, yc = X - X.mean(0), y - y.mean()
    best = ((yc - Xc @ np.linalg.lstsq(Xc, yc, rcond=None)[0]) ** 2).sum()
    assert ((yc - Xc @ S.lars(moments(X, y), 500)) ** 2).sum() == pytest.approx(best, rel=1e-9)


def test_elastic_net_certificates_and_screening(data):
    """Screened fits equal unscreened ones; every gap is proved small; a wrong
    point has a gap at least as large as its excess cost."""
    X, y = data
    m = moments(X, y)
    Q, q_, yy = m.centered()
    out = 0
    for alpha in S.alpha_grid(m)[::7]:
        l1 = l2 = alpha * 0.5 * m.n
        w, gap, screened = S.elastic_net(Q, q_, yy, l1, l2)
        assert gap <= S.GAP * yy
        assert np.allclose(w, S._signed_search(Q, q_, l1, l2, np.zeros(6)), atol=1e-7)
        cost = lambda v: 0.5 * (yy - 2 * q_ @ v + v @ Q @ v) + l1 * np.abs(v).sum() + 0.5 * l2 * v @ v  # noqa: E731, B023
        off = w + 0.1
        assert S.duality_gap(Q, q_, yy, l1, l2, off)[0] >= cost(off) - cost(w) - 1e-9 * yy
        out += screened
    assert out > 0  # large penalties leave columns out from the start


def test_elastic_net_that_does_not_converge_raises(data, monkeypatch):
    X, y = data
    Q, q_, yy = moments(X, y).centered()
    monkeypatch.setattr(S, "_signed_search", lambda Q, q_, l1, l2, w, tol=0: w)
    with pytest.raises(S.NotConverged):
        S.elastic_net(Q, q_, yy, 1.0, 1.0)


def test_lars_path_holds_every_budget(data):
    m = moments(*data)
    path = S.lars_path(m, [0, 1, 3, 6, 500])
    assert not path[0].any() and all(np.allclose(path[b], S.lars(m, b)) for b in (1, 3, 6, 500))
