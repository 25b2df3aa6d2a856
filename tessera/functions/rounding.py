"""Rounding to significant digits, written once as SQL text so the Spark
query (``F.expr``) and the DuckDB oracle evaluate the very same formula.

Powers of ten are only used with a non-negative exponent (exact doubles), so
both engines produce bit-identical results for identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig_sql(expr: str, digits: int = 9) -> str:
    e = f"(floor(log10(abs({expr}))) - {digits - 1})"
    return (
        f"(case when ({expr}) is null or ({expr}) = 0 or isnan({expr}) or abs({expr}) = 'Infinity'::double then ({expr}) "
        f"when {e} >= 0 then round(({expr}) / power(10, {e}), 0) * power(10, {e}) "
        f"else round(({expr}) * power(10, -{e}), 0) / power(10, -{e}) end)"
    )


def _spark_sql(text: str) -> str:
    # DuckDB's '...'::double literal cast is spelled as a CAST in Spark SQL
    return text.replace("'Infinity'::double", "double('Infinity')")


def sig(expr: str, digits: int = 9) -> Column:
    """Spark Column for :func:`sig_sql` of a SQL expression string."""
    return F.expr(_spark_sql(sig_sql(expr, digits)))


def sig_col(name: str, digits: int = 9) -> Column:
    """Round an existing column (by name) to ``digits`` significant digits."""
    return sig(f"`{name}`", digits).alias(name)
