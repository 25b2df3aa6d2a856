"""Named column operations of the preprocessing graph (user-extensible).

Each operation maps its named arguments to ``(output_name, Column)``; the
output name is part of the semantics (later nodes refer to it).  Row-wise
operations are plain native expressions; ``normalize`` needs the column's L2
norm, which the DAG compiler supplies as a scalar subquery.

Numeric rules: inputs are cast to double (no integer overflow under ANSI),
``ln``/``log10`` of 0 give -inf and of negatives NaN (numpy semantics, where
Spark would give NULL), and a zero norm gives NaN instead of raising.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def q(name: str) -> Column:
    """Column by exact name (names such as ``x1+x3`` need quoting)."""
    return F.col("`" + name.replace("`", "``") + "`")


def d(name: str) -> Column:
    return q(name).cast("double")


def safe_log(x: Column, fn=F.log) -> Column:
    return (F.when(x > 0, fn(x))
            .when(x == 0, F.lit(float("-inf")))
            .when(x < 0, F.lit(float("nan")))
            .otherwise(F.when(F.isnan(x), F.lit(float("nan")))))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num / den)


@dataclass(frozen=True)
class Operation:
    name: str
    args: tuple[str, ...]
    out_name: Callable[..., str]
    expr: Callable[..., Column] | None  # None: needs an aggregate (normalize)
    needs_norm: bool = False


def _add(c1, c2):
    return d(c1) + d(c2)


def _subtract(c1, c2):
    return d(c1) - d(c2)


def _square(c):
    x = d(c)
    return x * x


def _ln(c):
    return safe_log(d(c), F.log)


def _log10(c):
    return safe_log(d(c), F.log10)


OPERATIONS: dict[str, Operation] = {
    "add": Operation("add", ("c1", "c2"), lambda c1, c2: f"{c1}+{c2}", _add),
    "subtract": Operation("subtract", ("c1", "c2"), lambda c1, c2: f"{c1}-{c2}", _subtract),
    "normalize": Operation("normalize", ("c",), lambda c: f"{c}n", None, needs_norm=True),
    "square": Operation("square", ("c",), lambda c: f"({c})^2", _square),
    "log": Operation("log", ("c",), lambda c: f"ln({c})", _ln),
    "log10": Operation("log10", ("c",), lambda c: f"log10({c})", _log10),
}


def register_operation(op: Operation) -> None:
    """Add a user operation (native expression or a pandas_udf call)."""
    if op.name in OPERATIONS:
        raise ValueError(f"operation {op.name!r} already registered")
    OPERATIONS[op.name] = op


def vectorised(name: str, args: tuple[str, ...], out_name: Callable[..., str], fn: Callable, returns: str = "double",
               nulls: str = "propagate") -> Operation:
    """A graph node from a function of numpy arrays, one per argument, which
    returns an array of the declared type.  It runs on Arrow batches, and only in
    graphs that use it.

    ``nulls='propagate'``: a null in any argument gives null, and the function sees
    only rows without one.  ``nulls='pass'``: nulls reach it as NaN (arguments are
    doubles), and it gives null by returning NaN in a float type."""
    if nulls not in ("propagate", "pass"):
        raise ValueError(f"null rule {nulls!r}")

    def expr(**columns: str) -> Column:
        out_type = to_arrow_type(DataType.fromDDL(returns))

        @arrow_udf(returns)
        def run(*arrays: pa.Array) -> pa.Array:
            whole = np.ones(len(arrays[0]), bool)
            if nulls == "propagate":
                for a in arrays:
                    whole &= a.is_valid().to_numpy(zero_copy_only=False)
            values = np.asarray(fn(*[a.to_numpy(zero_copy_only=False).astype(float)[whole] for a in arrays]))
            if len(values) != whole.sum():
                raise ValueError(f"{name} gave {len(values)} values for {whole.sum()} rows")
            out = np.zeros(len(whole), values.dtype)
            out[whole] = values
            gone = ~whole
            if nulls == "pass" and np.issubdtype(out.dtype, np.floating):
                gone = np.isnan(out)
            return pa.array(out, mask=gone).cast(out_type)

        return run(*[d(columns[a]) for a in args])

    return Operation(name, args, out_name, expr)


def normalize_expr(c: str, norm: Column) -> Column:
    """``norm`` is NaN (never 0) for an all-zero column, so the division
    cannot raise and references the norm only once."""
    return d(c) / norm


def l2_norm(c: str) -> Column:
    x = d(c)
    s = F.sqrt(F.sum(x * x))
    return F.when(s == 0, F.lit(float("nan"))).otherwise(s)
