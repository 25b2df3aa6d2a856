"""Least squares with any number of predictors: a tiled Gram matrix and a block
Cholesky factorisation, both as Spark tables.

``design``        complete rows as (y, x array<double>)
``scales``        count, means and deviations of every column in one pass
``gram_tiles``    sum of z z' of the scaled columns as (row block, column block,
                  tile): a task holds a slice of rows and at most ``HOLD`` bytes of
                  tiles, which it hands on when they grow beyond that; tiles of the
                  same place are added up in the shuffle
``solve_tiles``   least squares from the tiles, a column of blocks at a time: the
                  diagonal tile is factored on the driver, the tiles below it and
                  the rest of the matrix by joins.  No task and no broadcast holds
                  more than a few tiles, and the driver a diagonal tile and a few
                  vectors.

A predictor that depends on those before it has no pivot; its null vector comes
out of the same factor, and the solution is taken off the null space, which gives
the one of least norm as a pseudo-inverse does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import scratch_table

#: Columns of a tile.
BLOCK = 256
#: Bytes of tiles, and of rows, that a task holds.
HOLD = 128 << 20
#: A pivot below this (columns have length one) has no digits left.
DEPENDENT = 1e-9


def design_array(features: list[str]) -> Column:
    """The columns as one array<double>; no columns: an empty one."""
    return F.array(*[q(c).cast("double") for c in features]).cast("array<double>")


def design(df: DataFrame, label: str, features: list[str] | str) -> DataFrame:
    """Rows without null or NaN as (y double, x array<double>).  ``features``: column
    names, or the name of one array column."""
    if isinstance(features, str):
        x = F.transform(q(features), lambda v: v.cast("double"))
    else:
        x = design_array(features)
    rows = df.select(q(label).cast("double").alias("y"), x.alias("x"))
    return rows.where(F.col("y").isNotNull() & ~F.isnan("y")
                      & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False)))


def _z(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of [x..., y]."""
    y = np.asarray(batch.column(0), float)
    x = np.asarray(batch.column(1).flatten(), float).reshape(len(y), -1)
    return np.column_stack([x, y])


@dataclass
class Scales:
    n: int
    mean: np.ndarray
    sd: np.ndarray  # population; 1 for a constant column


def scales(rows: DataFrame) -> Scales:
    """Count, means and deviations of the columns [x..., y].  Each task centres its
    rows on their own mean; the parts are merged, so nothing cancels."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = _z(batch)
                mean = z.mean(axis=0)
                here = (len(z), mean, ((z - mean) ** 2).sum(axis=0))
                total = here if total is None else _merged(total, here)
        yield from _moment_rows(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, mean, m2 in zip(*(batch.column(i) for i in range(3))):
                here = (n.as_py(), np.asarray(mean.values, float), np.asarray(m2.values, float))
                total = here if total is None else _merged(total, here)
        yield from _moment_rows(total)

    schema = "n long, mean array<double>, m2 array<double>"
    fan = max(2, int(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))
    parts = rows.mapInArrow(part, schema).repartition(fan).mapInArrow(merge, schema).collect()  # a few rows
    total = None
    for r in parts:
        here = (r["n"], np.array(r["mean"]), np.array(r["m2"]))
        total = here if total is None else _merged(total, here)
    if total is None:
        raise ValueError("no complete rows to fit")
    n, mean, m2 = total
    sd = np.sqrt(np.clip(m2 / n, 0, None))
    sd[sd <= 1e-13 * np.maximum(1e-300, np.abs(mean))] = 1.0
    sd[sd == 0] = 1.0
    return Scales(n, mean, sd)


def _merged(a: tuple, b: tuple) -> tuple:
    """Moments of two sets of rows together (Chan, Golub and LeVeque 1979)."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def _moment_rows(total: tuple | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.list_(pa.float64())),
                                          pa.array([total[2]], pa.list_(pa.float64()))], names=["n", "mean", "m2"])


TILE = "i int, j int, tile binary"


def _tile_rows(tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j), t in tiles.items():  # a tile a batch: a task's output stays small
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                                          pa.array([np.ascontiguousarray(t).tobytes()], pa.binary())], names=["i", "j", "tile"])


def gram_tiles(rows: DataFrame, at: Scales, block: int = BLOCK, hold: int = HOLD) -> DataFrame:
    """(i, j, tile), i >= j: the tiles on and below the diagonal of sum z z' over n,
    z the centred and scaled columns [x..., y]; tile is row by row doubles.  Blocks
    are of ``block`` columns, y alone is the last."""
    p = len(at.mean)
    cuts = [*range(0, p - 1, block), p - 1, p]
    spans = list(zip(cuts[:-1], cuts[1:]))
    mean, sd, n = at.mean, at.sd, at.n
    total = sum((b - a) * (d - c) * 8 for i, (a, b) in enumerate(spans) for c, d in spans[:i + 1])
    slice_rows = max(1024, hold // (8 * p))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        waiting, count = [], 0

        def tiles() -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            z = (np.vstack(waiting) - mean) / sd
            for i, (a, b) in enumerate(spans):
                for j, (c, d) in enumerate(spans[:i + 1]):
                    yield (i, j), z[:, a:b].T @ z[:, c:d] / n

        for batch in batches:
            waiting.append(_z(batch))
            count += batch.num_rows
            if count >= slice_rows:
                for place, t in tiles():
                    if total > hold:
                        yield from _tile_rows({place: t})
                    else:
                        held[place] = held[place] + t if place in held else t
                waiting, count = [], 0
        if count:
            for place, t in tiles():
                yield from _tile_rows({place: held.pop(place) + t if place in held else t})
        yield from _tile_rows(held)

    parts = rows.mapInArrow(part, TILE)
    fan = max(2, int(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
    return _summed(_summed(salted, ["i", "j", "salt"]), ["i", "j"])


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of the same keys added up; a task holds one sum at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for i, j, t in zip(*(batch.column(k) for k in range(3))):
                here = (i.as_py(), j.as_py())
                tile = np.frombuffer(t.as_buffer())
                if here != place:
                    if place is not None:
                        yield from _tile_rows({place: total})
                    place, total = here, tile.copy()
                else:
                    total += tile
        if place is not None:
            yield from _tile_rows({place: total})

    return parts.repartition(*keys).sortWithinPartitions(*keys).select("i", "j", "tile").mapInArrow(add, TILE)


def _mapped(tiles: DataFrame, f) -> DataFrame:
    """f(i, j, tile bytes, *other columns) -> tile bytes, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
                i, j = row[0].as_py(), row[1].as_py()
                yield from _tile_rows({(i, j): f(i, j, *[x.as_buffer() if x.is_valid else None for x in row[2:]])})

    return tiles.mapInArrow(run, TILE)


def _factored(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(L, inverse of L, columns without a pivot).  Such a column's part below the
    diagonal is zero and its pivot one."""
    n = len(a)
    L, free = np.zeros((n, n)), []
    for k in range(n):
        rest = a[k:, k] - L[k:, :k] @ L[k, :k]
        if rest[0] <= DEPENDENT:
            free.append(k)
            L[k, k] = 1.0
        else:
            L[k:, k] = rest / np.sqrt(rest[0])
    return L, np.linalg.inv(L), free


def solve_tiles(tiles: DataFrame, p: int, block: int = BLOCK) -> np.ndarray:
    """Least-squares coefficients (least norm) of the last column on the p before
    it, from the Gram tiles of :func:`gram_tiles`."""
    cuts = [*range(0, p, block), p]
    spans = list(zip(cuts[:-1], cuts[1:]))
    width = [b - a for a, b in spans] + [1]
    last = len(spans)
    if last == 1:
        found = {(r["i"], r["j"]): np.frombuffer(r["tile"]) for r in tiles.where("j = 0").collect()}  # two tiles
        return np.linalg.lstsq(found[0, 0].reshape(p, p), found[1, 0], rcond=None)[0]
    work = scratch_table(tiles, "tiles")
    factors, columns, free = [], [], []  # per block column: diagonal factor, table below it
    w = np.zeros(p)
    for k, (a, b) in enumerate(spans):
        diagonal = work.where((F.col("i") == k) & (F.col("j") == k)).first()
        L, inverse, without = _factored(np.frombuffer(diagonal["tile"]).reshape(width[k], width[k]))
        factors.append(L)
        free += [a + x for x in without]
        kept = np.ones(width[k])
        kept[without] = 0.0

        def below(i, j, tile, inverse=inverse, kept=kept, n=width[k]):
            return np.frombuffer(tile).reshape(-1, n) @ inverse.T * kept

        panel = scratch_table(_mapped(work.where((F.col("j") == k) & (F.col("i") > k)), below), "panel")
        columns.append(panel)
        w[a:b] = np.frombuffer(panel.where(F.col("i") == last).first()["tile"])
        if k + 1 < last:

            def less(i, j, tile, left, right, n=width[k]):
                return np.frombuffer(tile).reshape(width[i], width[j]) - np.frombuffer(left).reshape(-1, n) @ np.frombuffer(right).reshape(-1, n).T

            left, right = (panel.select(F.col("i").alias(c), F.col("tile").alias(t)) for c, t in (("i", "left"), ("j", "right")))
            rest = work.where(F.col("j") > k).join(left, "i").join(right, "j").select("i", "j", "tile", "left", "right")
            # the last block is y's, whose own tile nobody reads
            work = scratch_table(_mapped(rest.where(F.col("j") < last), less), "tiles")
    if not free:
        return _back(factors, columns, spans, w[:, None])[:, 0]
    # a free column's row of the factor, solved back, says how it depends on the others
    sides = np.zeros((p, 1 + len(free)))
    sides[:, 0] = w
    for n, x in enumerate(free):
        own = x // block
        sides[spans[own][0]:x, 1 + n] = factors[own][x - spans[own][0], :x - spans[own][0]]
        for k in range(own):
            tile = columns[k].where(F.col("i") == own).first()["tile"]
            sides[spans[k][0]:spans[k][1], 1 + n] = np.frombuffer(tile).reshape(width[own], width[k])[x - spans[own][0]]
    sides[free, :] = 0.0
    out = _back(factors, columns, spans, sides)
    null = -out[:, 1:]
    null[free, np.arange(len(free))] = 1.0
    beta = out[:, 0]
    return beta - null @ np.linalg.lstsq(null, beta, rcond=None)[0]


def _back(factors: list[np.ndarray], columns: list[DataFrame], spans: list[tuple[int, int]], sides: np.ndarray) -> np.ndarray:
    """Solves L' X = sides, the last block first; each block column is read once."""
    out = np.zeros_like(sides)
    last = len(spans)
    for k in range(last - 1, -1, -1):
        a, b = spans[k]
        right = sides[a:b].copy()
        if k + 1 < last:

            def product(i, j, tile, out=out, n=b - a):
                return np.frombuffer(tile).reshape(-1, n).T @ out[spans[i][0]:spans[i][1]]

            parts = _mapped(columns[k].where((F.col("i") > k) & (F.col("i") < last)), product)
            total = _summed(parts.select(F.lit(0).alias("i"), "j", "tile"), ["i", "j"]).first()
            right -= np.frombuffer(total["tile"]).reshape(right.shape)
        out[a:b] = np.linalg.solve(factors[k].T, right)
    return out


def wide_ols(df: DataFrame, label: str, features: list[str] | str, block: int = BLOCK, hold: int = HOLD) -> tuple[float, np.ndarray]:
    """M8 for any number of predictors: (intercept, coefficients) over the complete
    rows.  Of dependent predictors the least-norm solution on the scaled columns."""
    rows = design(df, label, features)
    at = scales(rows)
    p = len(at.mean) - 1
    if not p:
        return float(at.mean[-1]), np.zeros(0)
    beta = solve_tiles(gram_tiles(rows, at, block, hold), p, block) * at.sd[-1] / at.sd[:-1]
    return float(at.mean[-1] - beta @ at.mean[:-1]), beta
