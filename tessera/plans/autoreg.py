"""Automated linear regression (M4-M17) from cell moments.

The estimator being reproduced is a two-level grid search:

* outer: target transform in {identity, log1p-with-shift} (any of ``transforms``),
  repeated K-fold CV scored by R^2 on the original scale, refit on all training rows;
* inner (inside each outer training set, on the transformed target): a grid
  over the LARS step budget ``max_k`` in ``4, 8, ... < k`` when k > 4, repeated
  K-fold CV scored by R^2, refit;
* each pipeline: standard scaling -> keep columns with positive LARS
  coefficients -> 1, x_i, x_i*x_j of the kept columns -> keep columns with
  positive elastic-net (CV over 100 alphas, l1_ratio 0.5) coefficients ->
  OLS with intercept.

Spark plan
----------
1. ``split``/fold columns from md5 of the row key.  With R repeats a row has R
   outer and R inner folds; each pair of repeats is a system of cells (outer,
   inner, elastic-net fold), and a row counts in one cell of each.
2. One pass for counts, means, deviations; one small aggregate for the minima
   by fold (log shifts) and the targets' offsets.
3. One Gram pass without products, one Gram per (system, outer, inner).  Each
   group of the grid (outer fold or refit, inner fold or refit, transform) adds
   up the cells it trains on in the shuffle and runs its LARS path, all budgets
   at once, in a task.
4. One Gram pass over the columns that some path keeps, and the products of
   columns kept together; the same groups then run elastic net and OLS.
5. Scores of other targets than the response need its scale: one data pass
   takes every row's prediction by the model of each of its folds.
6. The final model is a coefficient vector over ``1, x, x_i*x_j`` and a
   target inverse -- prediction is one projection, no UDF.

No Gram is broadcast or collected; a task holds those of one group.  With a
``FitRun`` every stage is logged and its result kept, and a fit that lost its
driver goes on from the last finished stage.

Documented departures: folds come from a key hash, not from a shuffled row
order; an empty selection falls back to the intercept-only model; settings
text such as ``"False"`` is parsed as a boolean; ``cv_folds`` and ``cv_reps`` are
honoured.  A transform that is not finite on every training row has no score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from ..functions.columns import q
from ..functions.hashing import LEVEL_EN, LEVEL_INNER, LEVEL_OUTER, fold, is_test, key_digest, repeat_digest
from ..functions.transforms import TRANSFORMS as TARGETS
from ..functions.transforms import TargetTransform
from ..operators import solvers as S
from ..operators.moments import Pairs, all_pairs, array_cell_grams, basis_expressions, pair_index
from ..operators.split import row_key
from ..operators.wide import design_array, scales
from .run import FitRun, NoRun

TRANSFORMS = ("None_T", "LogP1_T")
#: Bytes of Grams that one group of the grid may take in a task.
MAX_GROUP_BYTES = 1 << 30
REFIT = -1
ALL = -1
VALIDATION = -1


# ------------------------------------------------------------------ settings

def _as_bool(v) -> bool:
    if isinstance(v, str):
        return v.strip().lower() in ("1", "true", "yes", "y", "t")
    return bool(v)


@dataclass(frozen=True)
class ModelSettings:
    """Hyper-parameters; metadata text overlays the defaults."""
    test_split: float = 0.2
    cv_folds: int = 5
    cv_reps: int = 1
    random_seed: int = 42
    one_out: bool = False

    @classmethod
    def from_metadata(cls, meta: dict | None) -> "ModelSettings":
        meta = meta or {}
        base = cls()
        return cls(
            test_split=float(meta.get("test_split", base.test_split)),
            cv_folds=int(meta.get("cv_folds", base.cv_folds)),
            cv_reps=int(meta.get("cv_reps", base.cv_reps)),
            random_seed=int(meta.get("random_seed", base.random_seed)),
            one_out=_as_bool(meta.get("one_out", base.one_out)),
        )


def candidates(k: int) -> list[int]:
    """LARS step budgets; one default (no limit) when k <= 4."""
    if k > 4:
        return list(range(4, k, 4))
    return [500]


# --------------------------------------------------------------- the model

@dataclass
class RegressionModel:
    response: str
    features: list[str]
    key: str | None
    settings: dict
    x_mean: list[float]
    x_sd: list[float]
    transform: str
    params: dict                   # of the fitted target transform
    target_offset: float
    coef: list[float]              # over 1, x~, x~_i*x~_j (x~ standardised)
    lars_selected: list[str] = field(default_factory=list)
    selected_terms: list[str] = field(default_factory=list)
    max_k: int = 0
    pairs: list[list[int]] | None = None   # the products' columns; None: all pairs
    dag: dict | None = None                # derived columns, run before predicting

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "RegressionModel":
        return cls(**json.loads(text))

    def linear_part(self) -> Column:
        xs = [(q(c).cast("double") - F.lit(m)) / F.lit(s)
              for c, m, s in zip(self.features, self.x_mean, self.x_sd)]
        pairs = None if self.pairs is None else [(i, j) for i, j in self.pairs]
        return linear_expression(self.coef, xs, pairs) + F.lit(self.target_offset)

    def prediction(self) -> Column:
        return fitted(self.transform, self.params).inverse(self.linear_part())

    def predict(self, df: DataFrame, col: str = "prediction") -> DataFrame:
        """One projection with the coefficients as literals."""
        if self.dag is not None:
            from .dag import apply_dag
            df = apply_dag(df, self.dag)
        return df.withColumn(col, self.prediction())


def fitted(name: str, params: dict) -> TargetTransform:
    return replace(TARGETS[name], params=params)


def linear_expression(coef, xs: list[Column], pairs: Pairs | None = None) -> Column:
    terms = basis_expressions(xs, pairs)
    expr = None
    for c, t in zip(coef, terms):
        if c == 0.0:
            continue
        piece = F.lit(float(c)) * t
        expr = piece if expr is None else expr + piece
    return expr if expr is not None else F.lit(0.0)


# ---------------------------------------------------------- fit internals

@dataclass(frozen=True)
class Layout:
    """Basis 1, the columns, the products, the targets.  ``columns``: numbers of the
    k columns among the features, None: all of them in order."""
    k: int
    K: int
    n_targets: int
    pairs: tuple[tuple[int, int], ...] | None = None  # product terms by column number, None: all
    columns: tuple[int, ...] | None = None

    @property
    def numbers(self) -> list[int]:
        return list(range(self.k)) if self.columns is None else list(self.columns)

    @property
    def products(self) -> Pairs:
        return list(combinations(self.numbers, 2)) if self.pairs is None else list(self.pairs)

    @property
    def px(self) -> int:
        return 1 + self.k + len(self.products)

    @property
    def n_cells(self) -> int:
        return self.K ** 3 + 1

    @property
    def test_cell(self) -> int:
        return self.K ** 3


def _feature_map(layout: Layout, mu: np.ndarray, sd: np.ndarray, sel: list[int]) -> tuple[np.ndarray, list[str]]:
    """Rows map z_x to [1, u_a, u_a*u_b] for the selected (scaled) columns, whose
    means and deviations are mu and sd."""
    at = {c: 1 + n for n, c in enumerate(layout.numbers)}
    product = {pair: 1 + layout.k + n for n, pair in enumerate(layout.products)}
    scale = dict(zip(sel, zip(mu, sd)))

    def row(*entries) -> np.ndarray:
        r = np.zeros(layout.px)
        for i, v in entries:
            r[i] = v
        return r

    rows, names = [row((0, 1.0))], ["1"]
    for a in sel:
        m, s = scale[a]
        rows.append(row((at[a], 1.0 / s), (0, -m / s)))
        names.append(f"x{a}")
    for a, b in combinations(sel, 2):
        (ma, sa), (mb, sb) = scale[a], scale[b]
        s = sa * sb
        rows.append(row((product[(a, b)], 1.0 / s), (at[a], -mb / s), (at[b], -ma / s), (0, ma * mb / s)))
        names.append(f"x{a}*x{b}")
    return np.array(rows), names


def _chosen(keep: str):
    return (lambda c: c > 0) if keep == "positive" else (lambda c: c != 0)


def lars_selection(G: np.ndarray, k: int, t_idx: int, budgets: list[int], keep: str = "positive") -> dict[int, list[int]]:
    """For each budget the columns that LARS keeps, of the k columns of a Gram."""
    path = S.lars_path(S.moments_from_gram(G, list(range(1, 1 + k)), t_idx), budgets)
    return {b: [int(i) for i in np.flatnonzero(_chosen(keep)(path[b]))] for b in budgets}


def fit_selected(G_fit: np.ndarray, G_en: np.ndarray, layout: Layout, t_idx: int, sel: list[int], keep: str = "positive"):
    """The pipeline behind the LARS selection, from moments: (coef over z_x, term
    names, alpha, the final elastic net's relative duality gap)."""
    at = {c: 1 + n for n, c in enumerate(layout.numbers)}
    mx = S.moments_from_gram(G_fit, [at[a] for a in sel], t_idx)
    mu = mx.mx
    sd = np.sqrt(np.clip(np.diag(mx.sxx) / mx.n - mu * mu, 0, None)) if sel else np.zeros(0)
    sd[sd <= 1e-12 * np.maximum(1.0, np.abs(mu))] = 1.0
    T, names = _feature_map(layout, mu, sd, sel)
    z_idx = list(range(layout.px))
    full = S.moments_from_gram(G_fit, z_idx, t_idx, T)
    folds = [(S.moments_from_gram(G_fit - g, z_idx, t_idx, T), S.moments_from_gram(g, z_idx, t_idx, T)) for g in G_en]
    net = S.enet_cv_path(folds, full)
    sel2 = [int(j) for j in np.flatnonzero(_chosen(keep)(net.coef))]
    coef = np.zeros(layout.px)
    if sel2:
        b0, beta = S.ols(full.subset(sel2))
        coef = beta @ T[sel2]
        coef[0] += b0
    else:
        coef[0] = full.my
    return coef, [names[j] for j in sel2], net.alpha, net.gap


def score_coef(G: np.ndarray, layout: Layout, t_idx: int, coef: np.ndarray) -> float:
    """R^2 on the rows summed in G; NaN for an empty validation set."""
    m = S.moments_from_gram(G, list(range(layout.px)), t_idx)
    if m.n == 0:
        return float("nan")
    return S.r2(m, 0.0, coef)


# ------------------------------------------------------------- folds and groups

def assign_cells(df: DataFrame, key: str | None, s: ModelSettings) -> DataFrame:
    """Adds ``_folds``, the outer fold of each repeat (repeat * K + fold); ``_cells``,
    the row's cell in each system of an outer and an inner repeat (none for test
    rows); ``_cell``, the one of the first system (K^3 for test rows)."""
    dig = key_digest(row_key(df, key), s.random_seed)
    K, R = s.cv_folds, max(1, s.cv_reps)
    digests = [repeat_digest(dig, r) for r in range(R)]
    en = fold(dig, LEVEL_EN, K)
    cells = [(F.lit(r * R + t) * K + fold(a, LEVEL_OUTER, K)) * (K * K) + fold(b, LEVEL_INNER, K) * K + en
             for r, a in enumerate(digests) for t, b in enumerate(digests)]
    test = F.lit(False) if s.one_out else is_test(dig, s.test_split)
    return df.withColumns({
        "_folds": F.array(*[F.lit(r * K) + fold(a, LEVEL_OUTER, K) for r, a in enumerate(digests)]),
        "_cells": F.when(test, F.array().cast("array<int>")).otherwise(F.array(*[c.cast("int") for c in cells])),
        "_cell": F.when(test, F.lit(K ** 3)).otherwise(cells[0]).cast("int")})


def group_parts(K: int, R: int, transforms: int) -> Column:
    """For column ``cell`` the parts it has in the grid's groups, as array<struct<
    grp, part>>: part is the elastic-net fold where the group trains on the cell, and
    VALIDATION where it scores on it."""
    cell = F.col("cell")
    e, i, o = cell % K, F.floor(cell / K) % K, F.floor(cell / (K * K)) % K
    system = F.floor(cell / (K * K * K))
    r, t = F.floor(system / R), system % R
    folds = F.sequence(F.lit(0), F.lit(K - 1))

    def sides(own: Column, repeat: Column, rest: Column) -> Column:
        # every fold of the repeat, held out or not, and the refit, which belongs to the first repeat
        each = F.transform(folds, lambda f: F.struct((repeat * K + f).cast("int").alias("n"), (f == own).alias("held")))
        return F.concat(each, F.when(rest == 0, F.array(F.struct(F.lit(REFIT).alias("n"), F.lit(False).alias("held"))))
                        .otherwise(F.array().cast("array<struct<n:int,held:boolean>>")))

    def part(a: Column, b: Column) -> Column:
        refit = b["n"] == REFIT
        return F.when(a["held"], F.when(refit, F.lit(VALIDATION))).when(b["held"], F.lit(VALIDATION)).otherwise(e.cast("int"))

    inner = sides(i, t, t)
    outer = sides(o, r, r)
    width = R * K + 1
    pairs = F.flatten(F.transform(outer, lambda a: F.transform(inner, lambda b: F.struct(
        ((a["n"] + 1) * width + b["n"] + 1).cast("int").alias("og"), part(a, b).alias("part")))))
    known = F.filter(pairs, lambda x: x["part"].isNotNull())
    return F.flatten(F.transform(known, lambda x: F.transform(F.sequence(F.lit(0), F.lit(transforms - 1)), lambda n: F.struct(
        (x["og"] * transforms + n).cast("int").alias("grp"), x["part"].alias("part")))))


@dataclass(frozen=True)
class Grid:
    """The groups of the grid: numbers from (outer, inner, transform)."""
    K: int
    R: int
    transforms: tuple[str, ...]

    @property
    def size(self) -> int:
        return (self.R * self.K + 1) ** 2 * len(self.transforms)

    def key(self, grp: int) -> tuple[int, int, str]:
        og, n = divmod(grp, len(self.transforms))
        outer, inner = divmod(og, self.R * self.K + 1)
        return outer - 1, inner - 1, self.transforms[n]

    def solve(self, grams: DataFrame, p: int, run, schema: StructType) -> DataFrame:
        """run(grp, {part: Gram}) -> rows, for every group; a group's cells are added
        up as they arrive, so a task holds the parts of one group."""
        n = min(self.size, 4 * grams.sparkSession.sparkContext.defaultParallelism)
        parts = (grams.select("tri", F.inline(group_parts(self.K, self.R, len(self.transforms))))
                 .repartitionById(n, F.col("grp") % n).sortWithinPartitions("grp").select("grp", "part", "tri"))
        iu = np.triu_indices(p)
        names = [f.name for f in schema.fields]

        def whole(tri: np.ndarray) -> np.ndarray:
            g = np.zeros((p, p))
            g[iu] = tri
            return g + g.T - np.diag(np.diag(g))

        def solved(grp: int, held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = run(grp, {e: whole(t) for e, t in held.items()})
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], arrow)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}
            for batch in batches:
                for grp, part, tri in zip(*(batch.column(c) for c in range(3))):
                    if grp.as_py() != now:
                        if now is not None:
                            yield from solved(now, held)
                        now, held = grp.as_py(), {}
                    e, values = part.as_py(), np.asarray(tri.values, float)
                    held[e] = held[e] + values if e in held else values
            if now is not None:
                yield from solved(now, held)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        return parts.mapInArrow(stream, schema)


KEPT = StructType([StructField("grp", IntegerType()), StructField("max_k", IntegerType()),
                   StructField("columns", ArrayType(IntegerType()))])
TASK_SCHEMA = StructType([
    StructField("grp", IntegerType()), StructField("max_k", IntegerType()), StructField("score", DoubleType()),
    StructField("coef", ArrayType(DoubleType())), StructField("columns", ArrayType(IntegerType())),
    StructField("terms", ArrayType(StringType())), StructField("alpha", DoubleType()), StructField("gap", DoubleType()),
])


@dataclass
class FitResult:
    model: RegressionModel
    tasks: DataFrame          # one row per grid entry
    outer_scores: DataFrame   # transform, outer_fold, max_k, r2
    inner_scores: DataFrame   # transform, outer_fold, max_k, inner_fold, r2


def fit_auto_regression(df: DataFrame, response: str, features: list[str], key: str | None = "id",
                        settings: ModelSettings | None = None, keep: str = "positive",
                        products: str = "kept", dag: dict | None = None, transforms: tuple[str, ...] = TRANSFORMS,
                        budgets: list[int] | None = None, run: FitRun | None = None) -> FitResult:
    """``keep='positive'`` (default, as the reference) keeps features with
    positive selector coefficients; ``'nonzero'`` keeps negative ones too.
    ``products='kept'`` builds the products of columns that some LARS path keeps
    together, ``'all'`` those of all features; the results are the same.  ``dag``: a
    graph of derived columns that is run on df before the fit; features may name its
    columns.  ``transforms``: target transforms of the outer grid by name (M9).
    ``budgets``: LARS budgets of the inner grid (default: 4, 8, ... below the number
    of features).  ``run``: a folder for the log and the stages' results."""
    s = settings or ModelSettings()
    run = run or NoRun()
    unknown = [t for t in transforms if t not in TARGETS]
    if unknown or not transforms:
        raise ValueError(f"unknown target transforms: {unknown}")
    if isinstance(run, FitRun):
        run.claim({"response": response, "features": list(features), "key": key, "settings": asdict(s), "keep": keep, "products": products,
                   "dag": dag, "transforms": list(transforms), "budgets": budgets})
    try:
        run.stage(1)
        if dag is not None:
            from .dag import apply_dag
            df = apply_dag(df, dag)
        base = assign_cells(df, key, s).select("_folds", F.col("_cells").alias("cells"), q(response).cast("double").alias("y"),
                                               design_array(features).alias("x"))
        complete = F.col("y").isNotNull() & ~F.isnan("y") & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
        # the narrow frame of four passes: persisted once.  Cells are a key hash, so a
        # recomputation after a lost executor is identical.
        base = base.where(complete).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fit = _fit(df.sparkSession, base, response, features, key, s, keep, products, tuple(transforms),
                       sorted(set(budgets or candidates(len(features)))), run)
            fit.model.dag = dag
            run.stage(5)
            if isinstance(run, FitRun):
                from ..sources.artifacts import save_model
                save_model(df.sparkSession, fit.model, f"{run.path}/model")
            run.stage(6)
            return fit
        finally:
            base.unpersist()
    except Exception as e:
        run.failed(e)
        raise


def _facts(base: DataFrame, s: ModelSettings, transforms: tuple[str, ...]) -> dict:
    """The few numbers that the passes need: scales, the fitted transforms of every
    outer training set, the targets' offsets and whether they are finite."""
    at = scales(base.select("y", "x"))
    train = base.where(F.size("cells") > 0)
    least = {r["f"]: r["m"] for r in train.select("y", F.explode("_folds").alias("f")).groupBy("f").agg(F.min("y").alias("m")).collect()}
    K, R = s.cv_folds, max(1, s.cv_reps)

    def minimum(outer: int) -> float | None:
        repeat = 0 if outer == ALL else outer // K
        mins = [least[f] for f in range(repeat * K, repeat * K + K) if f in least and f != outer]
        return min(mins) if mins else None

    targets, of = [], {}
    for t in transforms:
        for outer in [*range(R * K), ALL]:
            low = minimum(outer)
            params = TARGETS[t].fit_values(0.0 if low is None else low).params
            if (t, params) not in targets:
                targets.append((t, params))
            of[f"{t}:{outer}"] = targets.index((t, params))
    # one aggregate for all targets; what a held-out fold makes of a target does not matter
    y, mean = F.col("y"), F.lit(float(at.mean[-1]))
    checks = [F.count_if(_odd(fitted(*targets[n]).forward(y)) & ~F.array_contains("_folds", int(name.split(":")[1]))).alias(name)
              for name, n in of.items()]
    centres = [F.max(fitted(t, p).forward(mean)).alias(f"at{n}") for n, (t, p) in enumerate(targets)]
    row = train.agg(F.count(F.lit(1)).alias("n"), *checks, *centres).first()
    if not row["n"]:
        raise ValueError("no training rows to fit")
    centre = [row[f"at{n}"] for n in range(len(targets))]
    return {"mean": list(at.mean[:-1]), "sd": list(at.sd[:-1]), "targets": [list(t) for t in targets], "of": of,
            "offsets": [float(c) if c is not None and math.isfinite(c) else 0.0 for c in centre],
            "usable": {name: row[name] == 0 for name in of}}


def _odd(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def _fit(spark: SparkSession, base: DataFrame, response, features, key, s: ModelSettings, keep, products, transforms, budgets, run) -> FitResult:
    K, R, k = s.cv_folds, max(1, s.cv_reps), len(features)
    run.stage(2)
    run.stage(3)
    facts = run.value("facts", lambda: _facts(base, s, transforms))
    mean, sd = np.array(facts["mean"]), np.array(facts["sd"])
    targets, offsets, usable, of = facts["targets"], facts["offsets"], facts["usable"], facts["of"]
    n_t = len(targets)
    forward = [fitted(t, p).forward(F.col("y")) - F.lit(off) for (t, p), off in zip(targets, offsets)]
    forward = [F.when(_odd(f), F.lit(0.0)).otherwise(f) for f in forward]
    rows = base.where(F.size("cells") > 0).select("cells", "x", F.array(*forward).alias("t"))
    grid = Grid(K, R, transforms)

    # -- LARS of every group, on Grams without products and without elastic-net folds
    run.stage(4)
    merged = rows.withColumn("cells", F.transform("cells", lambda c: (F.floor(c / K) * K).cast("int")))
    linear = run.table("linear_grams", lambda: array_cell_grams(merged, list(range(k)), [], mean, sd, n_t))

    def paths(grp: int, parts: dict[int, np.ndarray]) -> list[dict]:
        outer, _, t = grid.key(grp)
        n = of[f"{t}:{outer}"]
        if not usable[f"{t}:{outer}"] or 0 not in parts:
            return []
        kept = lars_selection(parts[0], k, 1 + k + n, budgets, keep)
        return [{"grp": grp, "max_k": b, "columns": c} for b, c in kept.items()]

    found = run.table("kept", lambda: grid.solve(linear, 1 + k + n_t, paths, KEPT)).collect()  # the grid's entries
    selected = {(r["grp"], r["max_k"]): list(r["columns"]) for r in found}
    if products == "all":
        columns, pairs = list(range(k)), all_pairs(k)
    else:
        columns = sorted({c for cols in selected.values() for c in cols})
        pairs = sorted({pair for cols in selected.values() for pair in combinations(cols, 2)})
    layout = Layout(len(columns), K, n_t, tuple(pairs), tuple(columns))
    p = layout.px + n_t
    if (K + 2) * p * p * 8 > MAX_GROUP_BYTES:
        raise ValueError(f"the kept columns have {len(pairs)} products; a group of the grid would take {(K + 2) * p * p * 8 >> 20} MiB "
                         f"(> {MAX_GROUP_BYTES >> 20}): give smaller LARS budgets")

    # -- elastic net and least squares of every entry
    full = run.table("product_grams", lambda: array_cell_grams(rows, columns, pairs, mean, sd, n_t))

    def entries(grp: int, parts: dict[int, np.ndarray]) -> list[dict]:
        outer, inner, t = grid.key(grp)
        n = of[f"{t}:{outer}"]
        out = []
        if any(e != VALIDATION for e in parts):
            zero = np.zeros((p, p))
            G_en = np.array([parts.get(e, zero) for e in range(K)])
            G_fit = G_en.sum(axis=0)
            for b in budgets:
                cols = selected.get((grp, b))
                if cols is None:
                    continue
                coef, terms, alpha, gap = fit_selected(G_fit, G_en, layout, layout.px + n, cols, keep)
                held = parts.get(VALIDATION)
                # the outer score of another target needs the response's scale
                own = inner != REFIT or t == "None_T"
                score = score_coef(held, layout, layout.px + n, coef) if held is not None and own else None
                out.append({"grp": grp, "max_k": b, "score": score, "coef": [float(c) for c in coef], "columns": cols,
                            "terms": terms, "alpha": float(alpha), "gap": float(gap)})
        return out

    results = run.table("grid", lambda: grid.solve(full, p, entries, TASK_SCHEMA))
    done = {(*grid.key(r["grp"]), r["max_k"]): r for r in results.collect()}  # the grid's entries

    # -- inner choice per (transform, outer): best mean inner R^2, first on ties
    outers = [*range(R * K), ALL]
    best_k, inner_rows = {}, []
    for t in transforms:
        for o in outers:
            means = []
            for b in budgets:
                scores = []
                for i in range(R * K):
                    got = done.get((o, i, t, b))
                    scores.append(got["score"] if got is not None else None)
                    inner_rows.append((t, o, b, i, scores[-1]))
                known = [v for v in scores if v is not None and not math.isnan(v)]
                means.append(float(np.mean(known)) if known else -np.inf)
            best_k[t, o] = budgets[int(np.argmax(means))]

    def refit(t: str, o: int):
        return done.get((o, REFIT, t, best_k[t, o]))

    # -- outer scores: the response itself from the Grams, other targets from one data pass
    scored = {("None_T", o): refit("None_T", o)["score"] for o in range(R * K) if refit("None_T", o) is not None}
    others = [t for t in transforms if t != "None_T" and any(refit(t, o) is not None for o in range(R * K))]
    if others:
        scored |= _scores(run, base, others, R * K, layout, mean, sd, refit, of, targets, offsets)
    outer_rows = [(t, o, best_k[t, o], scored.get((t, o))) for t in transforms for o in range(R * K)]

    means = []
    for t in transforms:
        known = [r[3] for r in outer_rows if r[0] == t and r[3] is not None and not math.isnan(r[3])]
        means.append(float(np.mean(known)) if known and refit(t, ALL) is not None else -np.inf)
    best_t = transforms[int(np.argmax(means))]
    res = refit(best_t, ALL)
    if res is None:
        raise ValueError("no target transform is finite on the training rows")
    n = of[f"{best_t}:{ALL}"]
    coef = np.zeros(1 + k + len(pairs))
    coef[0] = res["coef"][0]
    coef[[1 + c for c in columns]] = res["coef"][1:1 + len(columns)]
    coef[1 + k:] = res["coef"][1 + len(columns):]
    model = RegressionModel(
        response=response, features=list(features), key=key, settings=asdict(s),
        x_mean=[float(v) for v in mean], x_sd=[float(v) for v in sd], transform=best_t,
        params=dict(targets[n][1]), target_offset=float(offsets[n]), coef=[float(c) for c in coef],
        pairs=[list(x) for x in pairs], lars_selected=[features[i] for i in res["columns"]],
        selected_terms=[_term_name(t_, features) for t_ in res["terms"]], max_k=best_k[best_t, ALL])

    outer_schema = "transform string, outer_fold int, max_k int, r2 double"
    inner_schema = "transform string, outer_fold int, max_k int, inner_fold int, r2 double"
    return FitResult(model, results, spark.createDataFrame(outer_rows, outer_schema), spark.createDataFrame(inner_rows, inner_schema))


def _scores(run, base: DataFrame, names: list[str], n_folds: int, layout: Layout, mean, sd, refit, of, targets, offsets) -> dict:
    """R^2 on the response's scale of every (transform, outer fold): each row is
    predicted by the models of its own folds, one pass for all."""
    cols = np.array(layout.numbers, dtype=int)
    place = {c: i for i, c in enumerate(layout.numbers)}
    pi = np.array([place[a] for a, _ in layout.products], dtype=int)
    pj = np.array([place[b] for _, b in layout.products], dtype=int)
    models = np.full((len(names), n_folds, layout.px), np.nan)
    for a, t in enumerate(names):
        for o in range(n_folds):
            if refit(t, o) is not None:
                models[a, o] = refit(t, o)["coef"]
                models[a, o, 0] += offsets[of[f"{t}:{o}"]]
    at, unit = mean[cols], sd[cols]

    def linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = (np.asarray(batch.column(1).flatten(), float).reshape(n, -1)[:, cols] - at) / unit
            z = np.column_stack([np.ones(n), x, x[:, pi] * x[:, pj]])
            folds = np.asarray(batch.column(0).flatten()).reshape(n, -1)
            y = np.asarray(batch.column(2), float)
            for r in range(folds.shape[1]):
                f = folds[:, r]
                lin = np.empty((n, len(names)))
                for o in np.unique(f):
                    lin[f == o] = z[f == o] @ models[:, o].T
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(y), pa.array(list(lin), pa.list_(pa.float64()))],
                                                 names=["f", "y", "lin"])

    held = (base.where(F.size("cells") > 0).select("_folds", "x", "y").mapInArrow(linear, "f int, y double, lin array<double>"))
    y, sums = F.col("y"), []
    for a, t in enumerate(names):
        guess = None
        for n in sorted({of[f"{t}:{o}"] for o in range(n_folds)}):
            own = F.col("f").isin([o for o in range(n_folds) if of[f"{t}:{o}"] == n])
            back = fitted(*targets[n]).inverse(F.col("lin")[a])
            guess = F.when(own, back) if guess is None else guess.when(own, back)
        sums.append(F.sum((y - guess) * (y - guess)).alias(f"sse{a}"))
    out = run.table("outer_scores", lambda: held.groupBy("f").agg(*sums, (F.var_pop("y") * F.count(F.lit(1))).alias("sst")))
    scores = {}
    for r in out.collect():  # one row per fold
        for a, t in enumerate(names):
            sse = r[f"sse{a}"]
            if sse is None or math.isnan(sse):
                scores[t, r["f"]] = float("nan")
            else:
                scores[t, r["f"]] = 1 - sse / r["sst"] if r["sst"] > 0 else (1.0 if sse == 0 else 0.0)
    return scores


def _term_name(term: str, features: list[str]) -> str:
    if term == "1":
        return "1"
    parts = term.split("*")
    return "*".join(features[int(p[1:])] for p in parts)


# ------------------------------------------------------- tables of results

def cv_results(fit: FitResult) -> DataFrame:
    """Outer candidates with per-fold R^2, mean, sd and rank."""
    o = fit.outer_scores
    K = int(fit.model.settings["cv_folds"]) * max(1, int(fit.model.settings["cv_reps"]))  # repeat by repeat
    order = [r["transform"] for r in o.select("transform").distinct().collect()]
    order = [t for t in TARGETS if t in order]  # ties in the order of the transforms
    wide = o.groupBy("transform").agg(
        *[F.max(F.when(F.col("outer_fold") == f, F.col("r2"))).alias(f"split{f}_test_score") for f in range(K)],
        F.avg("r2").alias("mean_test_score"), F.stddev_pop("r2").alias("std_test_score"))
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("mean_test_score"), F.asc("_ord"))
    wide = wide.withColumn("_ord", F.array_position(F.array(*[F.lit(t) for t in order]), F.col("transform")))
    return wide.withColumn("rank_test_score", F.rank().over(w)).drop("_ord")


def split_scores(model: RegressionModel, df: DataFrame) -> DataFrame:
    """R^2 by split with the stored split settings (M15 residuals too).
    Under ``one_out`` train and test are both all rows, so both are scored."""
    from ..operators.metrics import regression_metrics
    s = ModelSettings(**model.settings)
    dig = key_digest(row_key(df, model.key), s.random_seed)
    scored = model.predict(df)
    if s.one_out:
        both = regression_metrics(scored, q(model.response), F.col("prediction"))
        return both.select(F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"), "*")
    scored = scored.withColumn("split", F.when(is_test(dig, s.test_split), "test").otherwise("train"))
    return regression_metrics(scored, q(model.response), F.col("prediction"), by=["split"])
