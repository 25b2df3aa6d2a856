"""Solvers on moment (Gram) matrices: least squares, least-angle regression
and elastic net.  Inputs are p x p sums, never rows, so a fit costs O(p^3)
regardless of table size.  These run inside executor tasks (one fit grid
cell each); nothing here touches Spark.

Conventions
-----------
``Moments``: ``n``, ``sx`` (column sums), ``sxx`` (cross products),
``sy``, ``sxy``, ``syy`` for features x and one target y.  Centering uses the
moments' own means (fit_intercept semantics).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps


@dataclass
class Moments:
    n: float
    sx: np.ndarray
    sxx: np.ndarray
    sy: float
    sxy: np.ndarray
    syy: float

    @property
    def mx(self):
        return self.sx / self.n if self.n else np.zeros_like(self.sx)

    @property
    def my(self):
        return self.sy / self.n if self.n else 0.0

    def centered(self):
        """(Q, q, yy): centered X'X, X'y and y'y."""
        mx, my = self.mx, self.my
        q_ = self.sxy - self.n * mx * my
        Q = self.sxx - self.n * np.outer(mx, mx)
        yy = self.syy - self.n * my * my
        return Q, q_, yy

    def subset(self, idx) -> "Moments":
        idx = np.asarray(idx, dtype=int)
        return Moments(self.n, self.sx[idx], self.sxx[np.ix_(idx, idx)], self.sy,
                       self.sxy[idx], self.syy)


def moments_from_gram(G: np.ndarray, x_idx, y_idx: int, transform: np.ndarray | None = None) -> Moments:
    """Moments of features ``T z[x_idx]`` (or z[x_idx]) and target z[y_idx]
    from the Gram of a basis z whose entry 0 is the constant 1."""
    x_idx = np.asarray(x_idx, dtype=int)
    n = G[0, 0]
    if transform is None:
        sx = G[0, x_idx]
        sxx = G[np.ix_(x_idx, x_idx)]
        sxy = G[x_idx, y_idx]
    else:
        sub = G[np.ix_(x_idx, x_idx)]
        sx = transform @ G[0, x_idx]
        sxx = transform @ sub @ transform.T
        sxy = transform @ G[x_idx, y_idx]
    return Moments(n, np.asarray(sx, float), np.asarray(sxx, float), G[0, y_idx],
                   np.asarray(sxy, float), G[y_idx, y_idx])


# ---------------------------------------------------------------- OLS

def ols(m: Moments) -> tuple[float, np.ndarray]:
    """Least squares with intercept: minimum-norm solution of the centered
    normal equations (= pseudo-inverse solution of the row problem)."""
    if len(m.sx) == 0:
        return m.my, np.zeros(0)
    Q, q_, _ = m.centered()
    beta = np.linalg.lstsq(Q, q_, rcond=None)[0]
    return m.my - m.mx @ beta, beta


def sse(m: Moments, intercept: float, beta: np.ndarray) -> float:
    """Sum of squared residuals of a fixed linear model on the rows of ``m``."""
    b = beta
    val = (m.syy - 2 * intercept * m.sy - 2 * b @ m.sxy + m.n * intercept ** 2
           + 2 * intercept * (b @ m.sx) + b @ m.sxx @ b)
    return max(float(val), 0.0)


def sst(m: Moments) -> float:
    return max(float(m.syy - m.sy * m.sy / m.n), 0.0) if m.n else 0.0


def r2(m: Moments, intercept: float, beta: np.ndarray) -> float:
    e, t = sse(m, intercept, beta), sst(m)
    if t > 0:
        return 1.0 - e / t
    return 1.0 if e == 0 else 0.0


# ---------------------------------------------------------------- LAR

#: A column whose unit-norm residual on the active ones is below this adds nothing.
DEPENDENT = 1e-7
#: Correlations this close to the level (relative) have met it.
TIE = 1e-9


class _ActiveColumns:
    """The columns on the path, and W with W R W' = 1 for their correlations R:
    the inverse of R's Cholesky factor, which a join extends by one row."""

    def __init__(self, R: np.ndarray):
        self.R, self.columns, self.W = R, [], np.zeros((0, 0))

    def join(self, j: int) -> bool:
        """False for a column that depends on the active ones; it stays out."""
        part = self.W @ self.R[self.columns, j]
        rest = self.R[j, j] - part @ part
        if rest < DEPENDENT ** 2:
            return False
        n, size = len(self.columns), np.sqrt(rest)
        grown = np.zeros((n + 1, n + 1))
        grown[:n, :n] = self.W
        grown[n, :n], grown[n, n] = -(part @ self.W) / size, 1.0 / size
        self.W = grown
        self.columns.append(j)
        return True

    def direction(self, signs: np.ndarray) -> np.ndarray:
        """d with R_AA d = signs."""
        return self.W.T @ (self.W @ signs)


def lars(m: Moments, max_steps: int) -> np.ndarray:
    """Coefficients after ``max_steps`` joins of the path."""
    return lars_path(m, [max_steps])[max_steps]


def lars_path(m: Moments, budgets: list[int]) -> dict[int, np.ndarray]:
    """Least-angle regression (Efron, Hastie, Johnstone and Tibshirani 2004)
    with intercept on unit-norm columns; for each budget the coefficients, on the
    original column scale, once so many columns have joined.

    Written with the direction d that solves R_AA d = s (R: correlations, s: the
    signs of the active columns' correlations with the residual).  Moving by t
    along d takes t off every active correlation and t * a_j, a = R_jA d, off
    column j's, so the next to join are the columns whose correlation meets
    the shrinking level C - t first; without one the step ends at least squares
    (t = C).  Columns that meet the level together (TIE) join together, beyond
    ``max_steps`` too, so the path does not depend on the columns' order.
    Constant columns and columns that depend on the active ones stay out."""
    Q, q_, yy = m.centered()
    k = len(q_)
    size = np.sqrt(np.clip(np.diag(Q), 0, None)) if k else np.zeros(0)
    usable = size > 0
    unit = np.where(usable, size, 1.0)
    R, corr = Q / np.outer(unit, unit), q_ / unit
    beta = np.zeros(k)
    out = {b: beta.copy() for b in budgets if b < 1}
    outside = np.flatnonzero(usable)
    active = _ActiveColumns(R)
    level = first = np.abs(corr[outside]).max(initial=0.0)
    noise = 64 * EPS * max(first, np.sqrt(max(yy, 0.0)))
    due = np.zeros(0, int)  # columns that the last step brought to the level
    while level > noise and len(active.columns) < max(budgets):
        meets = np.abs(corr[outside]) >= level - TIE * level - noise
        joining = np.union1d(outside[meets], due)
        outside = np.setdiff1d(outside, joining)
        for j in joining:
            active.join(j)
        on = active.columns
        d = active.direction(np.sign(corr[on]))
        a = R[:, on] @ d
        step, due = level, np.zeros(0, int)
        if len(outside):
            gaps = np.stack([level - corr[outside], level + corr[outside]])
            speeds = np.stack([1 - a[outside], 1 + a[outside]])
            at = np.min(np.divide(np.maximum(gaps, 0), speeds, out=np.full(gaps.shape, np.inf), where=speeds > EPS), axis=0)
            if at.min() < level:
                step, due = at.min(), outside[at <= at.min()]
        beta[on] += step * d
        corr = corr - step * a
        level -= step
        for b in budgets:
            if b not in out and b <= len(on):
                out[b] = beta / unit
    return {b: out.get(b, beta / unit) for b in budgets}


# ---------------------------------------------------------- elastic net

#: Largest duality gap of an elastic-net fit, relative to y'y.
GAP = 1e-8


class NotConverged(ArithmeticError):
    """An elastic-net fit whose duality gap is not proved small."""


@dataclass
class _Point:
    """Coefficients with the products that the gap needs."""
    w: np.ndarray
    Qw: np.ndarray
    qw: float
    wQw: float

    @classmethod
    def at(cls, Q: np.ndarray, q_: np.ndarray, w: np.ndarray) -> "_Point":
        Qw = Q @ w
        return cls(w, Qw, float(q_ @ w), float(w @ Qw))

    def gap(self, q_: np.ndarray, yy: float, l1: float, l2: float) -> tuple[float, np.ndarray, float]:
        """(gap, pull, scale), see :func:`duality_gap`."""
        ridge = l2 * float(self.w @ self.w)
        pull = q_ - self.Qw - l2 * self.w
        size = np.abs(pull)
        rest = max(yy - 2 * self.qw + self.wQw + ridge, 0.0)
        steepest = float(size.max())
        scale = 1.0 if steepest <= l1 else l1 / steepest
        cost = 0.5 * rest + l1 * float(np.abs(self.w).sum())
        return max(cost - scale * (yy - self.qw) + 0.5 * scale * scale * rest, 0.0), size, scale


def duality_gap(Q: np.ndarray, q_: np.ndarray, yy: float, l1: float, l2: float, w: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(gap, |pull|, scale): how far w's cost can be above the least one.  The ridge
    part counts as more rows of a lasso; the residual times ``scale`` is a point of
    its dual, and ``pull`` the columns' products with the residual."""
    return _Point.at(Q, q_, w).gap(q_, yy, l1, l2)


def elastic_net(Q: np.ndarray, q_: np.ndarray, yy: float, l1: float, l2: float, w0: np.ndarray | None = None,
                tol: float = GAP) -> tuple[np.ndarray, float, int]:
    """Minimises 0.5 |y - Xw|^2 + l1 |w|_1 + 0.5 l2 w'w from Q = X'X, q = X'y and
    yy = y'y; returns (w, duality gap, columns left out by screening).

    Columns are screened first (gap-safe sphere, Ndiaye, Fercoq, Gramfort and
    Salmon 2017): the dual solution is within sqrt(2 gap) of the point at hand, so
    a column whose product cannot reach l1 there has coefficient zero.  What is
    left is solved by an active set with signs.  The gap of the result proves it:
    one above ``tol`` yy raises NotConverged."""
    p = len(q_)
    if p == 0:
        return np.zeros(0), 0.0, 0
    start = _Point.at(Q, q_, np.zeros(p) if w0 is None else w0)
    point, gap, out = _elastic_net(Q, q_, yy, l1, l2, start, np.sqrt(np.clip(np.diag(Q), 0, None) + l2), tol)
    return point.w, gap, out


def _elastic_net(Q, q_, yy, l1, l2, start: _Point, size: np.ndarray, tol: float) -> tuple[_Point, float, int]:
    p = len(q_)
    gap, pull, scale = start.gap(q_, yy, l1, l2)
    on = np.flatnonzero(scale * pull + np.sqrt(2 * gap) * size >= l1 * (1 - 1e-12))
    for columns in (on, np.arange(p)):
        w = np.zeros(p)
        if len(columns) == p:
            w = _signed_search(Q, q_, l1, l2, start.w.copy())
        elif len(columns):
            w[columns] = _signed_search(Q[np.ix_(columns, columns)], q_[columns], l1, l2, start.w[columns])
        point = _Point.at(Q, q_, w)
        gap = point.gap(q_, yy, l1, l2)[0]
        if gap <= tol * max(yy, 1e-300):
            return point, gap, p - len(columns)
    raise NotConverged(f"elastic net: duality gap {gap:.3g} of y'y = {yy:.3g} with {p} columns")


def _signed_search(Q: np.ndarray, q_: np.ndarray, l1: float, l2: float, w: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Active set with signs (feature-sign search, Lee, Battle, Raina and Ng 2006):
    with the signs fixed the active coefficients solve a linear system; where that
    would turn a sign, the best point on the way, a coefficient at zero, is taken
    instead.  Ends when the optimality conditions hold for every coefficient."""
    p = len(q_)
    if p == 0:
        return w
    slack = tol * max(1e-300, np.abs(q_).max())

    def cost(x: np.ndarray, on: np.ndarray) -> float:
        return 0.5 * x @ Q[np.ix_(on, on)] @ x - q_[on] @ x + l1 * np.abs(x).sum() + 0.5 * l2 * x @ x

    sign = np.sign(w)
    for _ in range(20 * p + 20):
        pull = q_ - Q @ w - l2 * w
        settled = np.all(np.abs(pull - l1 * sign)[sign != 0] <= slack)
        if settled:
            wants = np.where(sign == 0, np.abs(pull) - l1, -np.inf)
            j = int(np.argmax(wants))
            if wants[j] <= slack:
                break
            sign[j] = np.sign(pull[j])
        on = np.flatnonzero(sign)
        A = Q[np.ix_(on, on)] + l2 * np.eye(len(on))
        b = q_[on] - l1 * sign[on]
        try:
            goal = np.linalg.solve(A, b)
        except np.linalg.LinAlgError:
            goal = np.linalg.lstsq(A, b, rcond=None)[0]
        here = w[on]
        if np.any(np.sign(goal) * sign[on] < 0):
            move = goal - here
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.where(here * goal < 0, -here / move, np.inf)
            stops = [(cost(goal, on), goal)]
            for t in np.unique(at[np.isfinite(at)]):
                x = here + t * move
                x[at == t] = 0.0
                stops.append((cost(x, on), x))
            goal = min(stops, key=lambda s: s[0])[1]
        w[on] = goal
        sign = np.sign(w)
    return w


def alpha_grid(m: Moments, l1_ratio: float = 0.5, eps: float = 1e-3, n_alphas: int = 100) -> np.ndarray:
    _, q_, _ = m.centered()
    amax = (np.abs(q_).max() / (m.n * l1_ratio)) if len(q_) else 0.0
    if amax <= np.finfo(float).resolution:
        return np.full(n_alphas, np.finfo(float).resolution)
    return np.logspace(np.log10(amax * eps), np.log10(amax), num=n_alphas)[::-1]


def enet_fit(m: Moments, alpha: float, l1_ratio: float = 0.5, w0=None) -> tuple[float, np.ndarray]:
    Q, q_, yy = m.centered()
    w, _, _ = elastic_net(Q, q_, yy, alpha * l1_ratio * m.n, alpha * (1 - l1_ratio) * m.n, w0)
    return m.my - m.mx @ w, w


@dataclass
class PathPoint:
    """One penalty of a cross-validated path."""
    alpha: float
    mse: float        # mean over the held-out folds
    gap: float        # largest duality gap of the folds' fits, relative to y'y
    screened: int     # columns left out by screening, all folds together


@dataclass
class EnetCV:
    alpha: float
    intercept: float
    coef: np.ndarray
    gap: float        # of the final fit, relative to y'y
    path: list[PathPoint]


def enet_cv(folds: list[tuple[Moments, Moments]], full: Moments, l1_ratio: float = 0.5,
            eps: float = 1e-3, n_alphas: int = 100) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(alpha, intercept, coef, mean MSE per penalty) of :func:`enet_cv_path`."""
    out = enet_cv_path(folds, full, l1_ratio, eps, n_alphas)
    return out.alpha, out.intercept, out.coef, np.array([x.mse for x in out.path])


def enet_cv_path(folds: list[tuple[Moments, Moments]], full: Moments, l1_ratio: float = 0.5,
                 eps: float = 1e-3, n_alphas: int = 100) -> EnetCV:
    """Elastic net with the penalty chosen by K-fold CV on mean squared error.

    ``folds`` holds (train, held-out) moments per fold; the alpha grid comes
    from the full data (log-spaced, ``eps`` ratio); each fold follows the
    path with warm starts; the alpha with the least mean MSE (first on ties)
    is refit on ``full``.  Every fit carries its duality gap."""
    alphas = alpha_grid(full, l1_ratio, eps, n_alphas)
    mse, gaps, screened = np.zeros((len(folds), n_alphas)), np.zeros((len(folds), n_alphas)), np.zeros(n_alphas, int)
    for f, (tr, te) in enumerate(folds):
        Q, q_, yy = tr.centered()
        point, own = _Point.at(Q, q_, np.zeros(len(q_))), np.clip(np.diag(Q), 0, None)
        for i, alpha in enumerate(alphas):
            l2 = alpha * (1 - l1_ratio) * tr.n
            if len(q_):
                point, gap, out = _elastic_net(Q, q_, yy, alpha * l1_ratio * tr.n, l2, point, np.sqrt(own + l2), GAP)
                gaps[f, i] = gap / yy if yy > 0 else 0.0
                screened[i] += out
            mse[f, i] = sse(te, tr.my - tr.mx @ point.w, point.w) / te.n if te.n else 0.0
    mean = mse.mean(axis=0)
    best = float(alphas[int(np.argmin(mean))])
    Q, q_, yy = full.centered()
    w, gap, _ = elastic_net(Q, q_, yy, best * l1_ratio * full.n, best * (1 - l1_ratio) * full.n)
    path = [PathPoint(float(a), float(m), float(g), int(n)) for a, m, g, n in zip(alphas, mean, gaps.max(axis=0), screened)]
    return EnetCV(best, float(full.my - full.mx @ w), w, gap / yy if yy > 0 else 0.0, path)
