"""Feature selection (M5, M6, U3) and plain least squares (M8) from Grams.

``select_features`` keeps the columns with positive coefficients of a LARS
path (``method='lars'``, ``max_k`` steps) or of a cross-validated elastic net
(``method='elastic-net'``), both fitted from one Gram pass; the elastic net's
folds are key-hash folds so the pass produces one Gram per fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..functions.hashing import LEVEL_EN, fold, key_digest
from . import solvers as S
from .moments import cell_grams
from .split import row_key
from .wide import wide_ols


@dataclass
class LinearModel:
    features: list[str]
    intercept: float
    coef: list[float]

    def prediction(self) -> Column:
        expr = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coef):
            expr = expr + F.lit(float(b)) * q(c).cast("double")
        return expr

    def predict(self, df: DataFrame, col: str = "prediction") -> DataFrame:
        return df.withColumn(col, self.prediction())


@dataclass
class _Scaled:
    """Complete rows with every column centred and scaled, so that sums of
    squares keep their digits whatever the columns' offsets are."""
    rows: DataFrame
    mean: np.ndarray
    sd: np.ndarray
    label_mean: float
    label_sd: float

    def grams(self, cell: Column, n_cells: int) -> np.ndarray:
        """Per cell: sums over [1, x, y], without product terms."""
        k = len(self.mean)
        xs = [(F.col(f"x{i}") - F.lit(float(self.mean[i]))) / F.lit(float(self.sd[i])) for i in range(k)]
        y = (F.col("y") - F.lit(self.label_mean)) / F.lit(self.label_sd)
        return cell_grams(self.rows, xs, [y], cell, n_cells, pairs=[])

    def raw(self, b0: float, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Coefficients on the columns as they are."""
        coef = np.asarray(beta) * self.label_sd / self.sd
        return float(self.label_mean + self.label_sd * b0 - coef @ self.mean), coef


def _scaled(df: DataFrame, label: str, features: list[str], key: Column | None = None) -> _Scaled:
    """One aggregate for means and deviations; rows with a null or NaN in any of
    the columns are left out, as a regression on complete cases does."""
    cols = [q(label).cast("double").alias("y"), *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]]
    names = ["y", *[f"x{i}" for i in range(len(features))]]
    rows = df.select(*cols, *([key.alias("key")] if key is not None else []))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    rows = rows.where(whole)
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in names])
    sd = np.array([stats[f"s_{c}"] or 0.0 for c in names])
    sd[sd <= 1e-13 * np.maximum(1e-300, np.abs(mean))] = 1.0  # constant
    sd[sd == 0] = 1.0
    return _Scaled(rows, mean[1:], sd[1:], float(mean[0]), float(sd[0]))


def _x_y_moments(G: np.ndarray, k: int) -> S.Moments:
    p = G.shape[0]
    return S.moments_from_gram(G, list(range(1, 1 + k)), p - 1)


def fit_ols(df: DataFrame, label: str, features: list[str]) -> LinearModel:
    """M8: OLS with intercept over the complete rows, for any number of
    predictors (see ``wide``): one pass for the scales, one Gram pass."""
    b0, beta = wide_ols(df, label, features)
    return LinearModel(list(features), b0, [float(b) for b in beta])


def _enet(scaled: _Scaled, k: int, folds: int) -> S.EnetCV:
    Gs = scaled.grams(fold(F.col("key"), LEVEL_EN, folds), folds)
    # the penalty acts on the columns as they are: their scales go back in
    back = np.concatenate([[1.0], scaled.sd, [scaled.label_sd]])
    Gs = Gs * np.outer(back, back)
    full = Gs.sum(axis=0)
    pairs = [(_x_y_moments(full - Gs[e], k), _x_y_moments(Gs[e], k)) for e in range(folds)]
    return S.enet_cv_path(pairs, _x_y_moments(full, k))


def elastic_net_path(df: DataFrame, label: str, features: list[str], key: str | None = "id", seed: int = 42,
                     folds: int = 5) -> DataFrame:
    """M6: the cross-validated path, one row per penalty: step, alpha, mse (mean over
    the folds), gap (largest duality gap of the folds' fits over y'y), screened
    (columns left out by safe screening, all folds together), best."""
    net = _enet(_scaled(df, label, features, key_digest(row_key(df, key), seed)), len(features), folds)
    rows = [(i, x.alpha, x.mse, x.gap, x.screened, x.alpha == net.alpha) for i, x in enumerate(net.path)]
    return df.sparkSession.createDataFrame(rows, "step int, alpha double, mse double, gap double, screened long, best boolean")


def select_features(df: DataFrame, label: str, features: list[str], method: str = "lars",
                    max_k: int = 500, key: str | None = "id", seed: int = 42,
                    folds: int = 5) -> tuple[list[str], list[float]]:
    """Returns (selected names, coefficients of all features)."""
    k = len(features)
    if method == "lars":
        scaled = _scaled(df, label, features)
        G = scaled.grams(F.lit(0), 1)[0]
        _, coef = scaled.raw(0.0, S.lars(_x_y_moments(G, k), max_k))
    elif method == "elastic-net":
        scaled = _scaled(df, label, features, key_digest(row_key(df, key), seed))
        coef = _enet(scaled, k, folds).coef
    else:
        raise ValueError(f"unknown selector {method!r}")
    chosen = [f for f, c in zip(features, coef) if c > 0]
    return chosen, [float(c) for c in coef]
