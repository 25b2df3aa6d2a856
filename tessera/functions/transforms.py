"""Reversible target transforms.

Protocol: ``fit(df, col)`` reads the few numbers the transform needs with one
small aggregate and returns a fitted copy; ``forward(Column)`` and
``inverse(Column)`` are native expressions, so a transformed fit and its
predictions stay inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import safe_log


@dataclass(frozen=True)
class TargetTransform:
    name: str = "none"
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, col: str) -> "TargetTransform":
        return self

    def fit_values(self, minimum: float | None) -> "TargetTransform":
        return self

    def forward(self, y: Column) -> Column:
        return y

    def inverse(self, z: Column) -> Column:
        return z


def _min(df: DataFrame, col: str) -> float | None:
    return df.agg(F.min(F.col(col).cast("double"))).first()[0]


@dataclass(frozen=True)
class NoneT(TargetTransform):
    """Identity."""
    name: str = "None_T"


@dataclass(frozen=True)
class LogP1(TargetTransform):
    """shift = -min if min < 0 else 0; log1p(y + shift); inverse
    expm1(z) - shift."""
    name: str = "LogP1_T"

    def fit(self, df, col):
        return self.fit_values(_min(df, col))

    def fit_values(self, minimum):
        shift = -minimum if minimum is not None and minimum < 0 else 0.0
        return LogP1(params={"shift": float(shift)})

    @property
    def shift(self) -> float:
        return self.params.get("shift", 0.0)

    def forward(self, y):
        return F.log1p(y + F.lit(self.shift))

    def inverse(self, z):
        return F.expm1(z) - F.lit(self.shift)


@dataclass(frozen=True)
class LogMinPlus1(TargetTransform):
    """ln(x - min + 1); inverse exp(z) - 1 + min."""
    name: str = "LogMinPlus1_T"

    def fit(self, df, col):
        return self.fit_values(_min(df, col))

    def fit_values(self, minimum):
        return LogMinPlus1(params={"min": float(minimum)})

    def forward(self, y):
        return safe_log(y - F.lit(self.params["min"]) + F.lit(1.0))

    def inverse(self, z):
        return F.exp(z) - F.lit(1.0) + F.lit(self.params["min"])


@dataclass(frozen=True)
class LogSigned(TargetTransform):
    """M9d: sign(y) * ln|y|; the inverse is exp(z) (lossy for y <= 1 and
    negatives, as in the reference)."""
    name: str = "LogMinus_T"

    def forward(self, y):
        return F.signum(y) * safe_log(F.abs(y))

    def inverse(self, z):
        return F.exp(z)


@dataclass(frozen=True)
class ExpT(TargetTransform):
    """M9e: exp(y); inverse ln(z) where z > 0, else 0."""
    name: str = "Exp_T"

    def forward(self, y):
        return F.exp(y)

    def inverse(self, z):
        return F.when(z > 0, F.log(z)).otherwise(F.lit(0.0))


TRANSFORMS = {t.name: t for t in (NoneT(), LogP1(), LogMinPlus1(), LogSigned(), ExpT())}
