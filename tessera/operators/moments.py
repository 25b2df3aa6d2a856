"""Cell Gram matrices in one distributed pass.

Basis per row::

    z = [1, x_1..x_k, x_i*x_j (i<j), t_1..t_T]

with x globally standardised (for conditioning) and t the target columns
(response and transformed responses).  Every model of the automated fit --
fold scaling, LARS, interactions of scaled columns, elastic net, OLS -- is a
linear map of this basis, so ``sum z z'`` per (fold) cell is sufficient.

The product terms are optional: plain least squares and the selectors leave
them out, the automated fit gives the pairs it can need.

Execution: ``mapInPandas`` turns each Arrow batch into a numpy block and adds
``Z' Z`` into a per-cell accumulator (BLAS); each task emits one row per
cell with the upper triangle.  The triangles are summed on two levels, by
(cell, salt) and by cell, so no reducer gets more than its share of the map
tasks' rows.  The map side keeps the input's own partitioning.  The driver
receives cells x p(p+1)/2 doubles.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

Pairs = list[tuple[int, int]]


def all_pairs(k: int) -> Pairs:
    return list(combinations(range(k), 2))


def pair_index(k: int, pairs: Pairs | None = None) -> dict[tuple[int, int], int]:
    """Position of x_i*x_j in z."""
    return {pair: 1 + k + n for n, pair in enumerate(all_pairs(k) if pairs is None else pairs)}


def basis_expressions(xs: list[Column], pairs: Pairs | None = None) -> list[Column]:
    """The x-part of z as native expressions (for predictions)."""
    return [F.lit(1.0), *xs, *[xs[i] * xs[j] for i, j in (all_pairs(len(xs)) if pairs is None else pairs)]]


def cell_gram_frame(df: DataFrame, xs: list[Column], targets: list[Column], cell: Column,
                    pairs: Pairs | None = None) -> DataFrame:
    """Lazy DataFrame (cell, tri): the upper triangle of sum z z' per cell.
    ``pairs``: the product terms (default all)."""
    k, t = len(xs), len(targets)
    pairs = all_pairs(k) if pairs is None else pairs
    p = 1 + k + len(pairs) + t
    cols = [cell.cast("int").alias("cell")]
    cols += [x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)]
    cols += [y.cast("double").alias(f"t{i}") for i, y in enumerate(targets)]
    inp = df.select(*cols)
    iu = np.triu_indices(p)
    pi = np.array([a for a, _ in pairs], dtype=int)
    pj = np.array([b for _, b in pairs], dtype=int)

    def partial(batches):
        import pandas as pd
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            xv = pdf[[f"x{i}" for i in range(k)]].to_numpy(dtype=float)
            tv = pdf[[f"t{i}" for i in range(t)]].to_numpy(dtype=float)
            z = np.empty((len(pdf), p))
            z[:, 0] = 1.0
            z[:, 1:1 + k] = xv
            if pairs:
                z[:, 1 + k:1 + k + len(pairs)] = xv[:, pi] * xv[:, pj]
            z[:, 1 + k + len(pairs):] = tv
            cells = pdf["cell"].to_numpy()
            order = np.argsort(cells, kind="stable")
            bounds = np.flatnonzero(np.diff(cells[order])) + 1
            for block in np.split(order, bounds):
                c = int(cells[block[0]])
                zc = z[block]
                g = zc.T @ zc
                if c in acc:
                    acc[c] += g
                else:
                    acc[c] = g
        if acc:
            yield pd.DataFrame({"cell": list(acc.keys()), "tri": [acc[c][iu] for c in acc]})

    def reduce_cells(batches):
        import pandas as pd
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for c, tri in zip(pdf["cell"], pdf["tri"]):
                a = np.asarray(tri, dtype=float)
                if c in acc:
                    acc[c] += a
                else:
                    acc[c] = a.copy()
        if acc:
            yield pd.DataFrame({"cell": list(acc.keys()), "tri": list(acc.values())})

    schema = StructType([StructField("cell", IntegerType()),
                         StructField("tri", ArrayType(DoubleType()))])
    # one row per (task, cell) travels; salted first, so that a cell's rows are
    # summed by several reducers before they meet in one
    fan = max(2, math.isqrt(4 * df.sparkSession.sparkContext.defaultParallelism))
    parts = inp.mapInPandas(partial, schema)
    salted = (parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
              .repartition("cell", "salt").select("cell", "tri").mapInPandas(reduce_cells, schema))
    return salted.repartition("cell").mapInPandas(reduce_cells, schema)


def cell_grams(df: DataFrame, xs: list[Column], targets: list[Column], cell: Column,
               n_cells: int, pairs: Pairs | None = None) -> np.ndarray:
    """Sum of z z' per cell, collected: array (n_cells, p, p)."""
    p = 1 + len(xs) + len(all_pairs(len(xs)) if pairs is None else pairs) + len(targets)
    iu = np.triu_indices(p)
    out = np.zeros((n_cells, p, p))
    for row in cell_gram_frame(df, xs, targets, cell, pairs).collect():
        g = np.zeros((p, p))
        g[iu] = np.asarray(row["tri"], dtype=float)
        g = g + g.T - np.diag(np.diag(g))
        out[row["cell"]] = g
    return out


#: Bytes of Grams that a task holds before it hands them on.
HOLD = 256 << 20


def array_cell_grams(rows: DataFrame, columns: list[int], pairs: Pairs, mean: np.ndarray, sd: np.ndarray,
                     n_targets: int) -> DataFrame:
    """(cell, tri) from rows (cells array<int>, x array<double>, t array<double>): a
    row counts in each of its cells.  The basis is 1, the standardised ``columns``
    of x, the products of ``pairs`` (column numbers) and the targets t.  A task
    holds at most ``HOLD`` bytes of Grams."""
    import pyarrow as pa
    cols = np.array(columns, dtype=int)
    place = {c: n for n, c in enumerate(columns)}
    pi = np.array([place[a] for a, _ in pairs], dtype=int)
    pj = np.array([place[b] for _, b in pairs], dtype=int)
    p = 1 + len(cols) + len(pairs) + n_targets
    iu = np.triu_indices(p)
    at, unit = np.asarray(mean)[cols], np.asarray(sd)[cols]

    def out(acc):
        for c, g in acc.items():  # a Gram a batch
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([g], pa.list_(pa.float64()))], names=["cell", "tri"])

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(n, -1)[:, cols]
            z = np.empty((n, p))
            z[:, 0] = 1.0
            z[:, 1:1 + len(cols)] = (x - at) / unit
            z[:, 1 + len(cols):p - n_targets] = z[:, 1 + pi] * z[:, 1 + pj]
            z[:, p - n_targets:] = np.asarray(batch.column(2).flatten(), float).reshape(n, n_targets)
            counts = np.diff(batch.column(0).offsets.to_numpy())
            cells, row = np.asarray(batch.column(0).flatten()), np.repeat(np.arange(n), counts)
            order = np.argsort(cells, kind="stable")
            for block in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                if not len(block):
                    continue
                c, zc = int(cells[block[0]]), z[row[block]]
                g = (zc.T @ zc)[iu]
                acc[c] = acc[c] + g if c in acc else g
                if len(acc) * len(iu[0]) * 8 > HOLD:
                    yield from out(acc)
                    acc = {}
        yield from out(acc)

    def reduce_cells(batches):
        place, total = None, None
        for batch in batches:
            for c, tri in zip(batch.column(0), batch.column(1)):
                if c.as_py() != place:
                    if place is not None:
                        yield from out({place: total})
                    place, total = c.as_py(), np.array(tri.values, float)
                else:
                    total += np.asarray(tri.values, float)
        if place is not None:
            yield from out({place: total})

    schema = StructType([StructField("cell", IntegerType()), StructField("tri", ArrayType(DoubleType()))])
    fan = max(2, math.isqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    parts = rows.select("cells", "x", "t").mapInArrow(partial, schema)
    salted = (parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition("cell", "salt")
              .sortWithinPartitions("cell", "salt").select("cell", "tri").mapInArrow(reduce_cells, schema))
    return salted.repartition("cell").sortWithinPartitions("cell").mapInArrow(reduce_cells, schema)


def gram_long(df: DataFrame, xs: list[Column], targets: list[Column], names: list[str]) -> DataFrame:
    """One-cell Gram as a lazy long table (i, j, term_i, term_j, value), i <= j."""
    p = 1 + len(xs) + len(all_pairs(len(xs))) + len(targets)
    iu = np.triu_indices(p)
    frame = cell_gram_frame(df, xs, targets, F.lit(0))
    ii = F.array(*[F.lit(int(v)) for v in iu[0]])
    jj = F.array(*[F.lit(int(v)) for v in iu[1]])
    nm = F.array(*[F.lit(n) for n in names])
    e = frame.select(F.posexplode("tri").alias("pos", "value"))
    i = F.element_at(ii, F.col("pos") + 1)
    j = F.element_at(jj, F.col("pos") + 1)
    return e.select(i.alias("i"), j.alias("j"), F.element_at(nm, i + 1).alias("term_i"),
                    F.element_at(nm, j + 1).alias("term_j"), "value")
