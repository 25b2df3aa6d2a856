"""Standard scaling (M4) and pairwise interactions (M7) as projections.

The scaler's means and population sds are scalar subqueries over the same
input; Catalyst merges them into one aggregate (no driver round trip, no
join).  A zero sd scales by 1.  Interactions are ``1, x_i, x_i*x_j (i<j)``:
no squares.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import d, q


def standardize(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    exprs = []
    for c in cols:
        stats = df.select(F.avg(d(c)).alias("m"), F.stddev_pop(d(c)).alias("s"))
        m = stats.select("m").scalar()
        s = stats.select("s").scalar()
        scale = F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
        exprs.append(((d(c) - m) / scale).alias(c))
    return df.select(*[q(k) for k in keep], *exprs)


def interaction_names(cols: list[str], sep: str = "*") -> list[str]:
    return ["1", *cols, *[f"{a}{sep}{b}" for a, b in combinations(cols, 2)]]


def interactions(df: DataFrame, cols: list[str], keep: list[str] | None = None,
                 bias: bool = True, sep: str = "*") -> DataFrame:
    keep = keep or []
    out = [q(k) for k in keep]
    if bias:
        out.append(F.lit(1.0).alias("1"))
    out += [d(c).alias(c) for c in cols]
    out += [(d(a) * d(b)).alias(f"{a}{sep}{b}") for a, b in combinations(cols, 2)]
    return df.select(*out)
