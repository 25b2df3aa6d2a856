"""The registry's foreign keys as data, and the operators that follow them.

``KeyGraph`` holds primary keys and foreign keys of the tables.  Ownership (R5),
integrity (R8), listings (R1) and cascades (R10) are not written table by table:
each walks the graph and compiles to joins on key columns only.  Tables that are
not given are left out where the walk does not need them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RegistryError(ValueError):
    """A table, key or path that the graph does not have."""


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


@dataclass(frozen=True)
class KeyGraph:
    primary: dict[str, str]
    keys: tuple[ForeignKey, ...]

    def __post_init__(self):
        for k in self.keys:
            if k.parent not in self.primary:
                raise RegistryError(f"{k.child}.{k.column} refers to {k.parent}, which has no primary key")
        self.order()

    def of(self, child: str) -> list[ForeignKey]:
        return [k for k in self.keys if k.child == child]

    def order(self) -> list[str]:
        """Tables, parents first."""
        tables = list(dict.fromkeys([*self.primary, *(k.child for k in self.keys)]))
        out: list[str] = []
        while len(out) < len(tables):
            ready = [t for t in tables if t not in out and all(k.parent in out for k in self.of(t))]
            if not ready:
                raise RegistryError("foreign keys form a cycle: " + ", ".join(t for t in tables if t not in out))
            out += ready
        return out

    def path(self, child: str, ancestor: str) -> list[ForeignKey]:
        """The shortest way up from child to ancestor."""
        ways: list[list[ForeignKey]] = [[]]
        while ways:
            for way in ways:
                if (way[-1].parent if way else child) == ancestor:
                    return way
            ways = [[*way, k] for way in ways for k in self.of(way[-1].parent if way else child)]
        raise RegistryError(f"no key leads from {child} to {ancestor}")

    def ancestors(self, tables: dict[str, DataFrame], child: str, ancestor: str) -> DataFrame:
        """(id, ancestor): for every row of child with a full chain, its ancestor's key."""
        way = self.path(child, ancestor)
        pk = self.primary[child]
        if not way:
            return tables[child].select(F.col(pk).alias("id"), F.col(pk).alias("ancestor"))
        out = tables[child].select(F.col(pk).alias("id"), F.col(way[0].column).alias("up"))
        for k, above in zip(way, [*way[1:], None]):
            key = self.primary[k.parent]
            if above is None:
                if k.parent in tables:  # the row has to be there
                    out = out.join(tables[k.parent].select(F.col(key).alias("up")), "up", "left_semi")
                return out.select("id", F.col("up").alias("ancestor"))
            parent = tables[k.parent].select(F.col(key).alias("up"), F.col(above.column).alias("next"))
            out = out.join(parent, "up").select("id", F.col("next").alias("up"))
        raise AssertionError

    def children(self, tables: dict[str, DataFrame], parent: str, child: str, of: Column | None = None,
                 payload: tuple[str, ...] = ("data", "model")) -> DataFrame:
        """Rows of child whose parent exists (and meets ``of``, a condition on
        the parent), payload columns never read."""
        (key,) = [k for k in self.of(child) if k.parent == parent] or [None]
        if key is None:
            raise RegistryError(f"{child} has no key to {parent}")
        rows = tables[parent] if of is None else tables[parent].where(of)
        kept = tables[child].drop(*[c for c in payload if c in tables[child].columns])
        return kept.join(rows.select(F.col(self.primary[parent]).alias(key.column)), key.column, "left_semi")

    def any_below(self, tables: dict[str, DataFrame], parent: str, child: str, condition: Column, name: str) -> DataFrame:
        """(key of parent, name): whether a row of child that meets the condition
        sits below.  Reduced to distinct parents at every step, so a parent with a
        third of all rows counts once."""
        way = self.path(child, parent)
        found = tables[child].where(condition)
        for k, above in zip(way, [*way[1:], None]):
            found = found.select(F.col(k.column).alias("up")).distinct()
            if above is not None:
                found = tables[k.parent].join(found.withColumnRenamed("up", self.primary[k.parent]), self.primary[k.parent], "left_semi")
        pk = self.primary[parent]
        return (tables[parent].select(pk).join(found.select(F.col("up").alias(pk), F.lit(True).alias(name)), pk, "left")
                .select(pk, F.coalesce(name, F.lit(False)).alias(name)))

    def cascade(self, tables: dict[str, DataFrame], root: str, deleted: DataFrame) -> dict[str, DataFrame]:
        """What deleting the rows ``deleted`` of root leaves of every table given
        (root included).  A row goes when a row it refers to goes; a null key refers
        to nothing."""
        pk = self.primary[root]
        gone = {root: deleted.select(pk).distinct()}
        left = dict(tables)
        if root in tables:
            left[root] = tables[root].join(gone[root], pk, "left_anti")
        for t in self.order():
            up = [k for k in self.of(t) if k.parent in gone]
            if t not in tables or not up or t == root:
                continue
            for k in up:
                keys = gone[k.parent].withColumnRenamed(self.primary[k.parent], k.column)
                left[t] = left[t].join(keys, k.column, "left_anti")
            if t in self.primary:
                hit = [tables[t].join(gone[k.parent].withColumnRenamed(self.primary[k.parent], k.column), k.column, "left_semi")
                       .select(self.primary[t]) for k in up]
                gone[t] = reduce(DataFrame.unionByName, hit).distinct() if len(hit) > 1 else hit[0]
        return left


#: The registry (every key cascades).
REGISTRY = KeyGraph(
    primary={"user": "user_id", "location": "location_id", "workflow": "workflow_id", "analytical_model": "model_id", "dataset": "dataset_id"},
    keys=(
        ForeignKey("location", "owner_id", "user"),
        ForeignKey("location_metadata", "base_id", "location"),
        ForeignKey("workflow", "location_id", "location"),
        ForeignKey("workflow_results", "workflow_id", "workflow"),
        ForeignKey("preprocessing_config", "workflow_id", "workflow"),
        ForeignKey("analytical_model", "workflow_id", "workflow"),
        ForeignKey("model_metadata", "base_id", "analytical_model"),
        ForeignKey("model_data", "model_id", "analytical_model"),
        ForeignKey("model_results", "model_id", "analytical_model"),
        ForeignKey("dataset", "workflow_id", "workflow"),
        ForeignKey("dataset_metadata", "base_id", "dataset"),
        ForeignKey("access_control_list", "owner_id", "user"),
        ForeignKey("access_control_list", "target_user_id", "user"),
    ))

#: Object types that can be granted, and their tables.
OBJECT_TYPES = {"Location": "location", "Workflow": "workflow", "Dataset": "dataset", "AnalyticalModel": "analytical_model"}


def object_owners(tables: dict[str, DataFrame]) -> DataFrame:
    """R5 for every object type whose table is given: (object_type, object_id, owner_id)."""
    parts = []
    for kind, t in OBJECT_TYPES.items():
        if t in tables:
            own = REGISTRY.ancestors(tables, t, "user")
            parts.append(own.select(F.lit(kind).alias("object_type"), F.col("id").alias("object_id"), F.col("ancestor").alias("owner_id")))
    return reduce(DataFrame.unionByName, parts)


def integrity(tables: dict[str, DataFrame], fitted: Column) -> DataFrame:
    """(object_type, object_id, has_fitted_model) of locations, workflows and
    datasets: whether a fitted model sits below a location or workflow, or in the
    workflow of a dataset."""
    flag = "has_fitted_model"
    out = []
    for kind in ("Location", "Workflow"):
        t = OBJECT_TYPES[kind]
        has = REGISTRY.any_below(tables, t, "analytical_model", fitted, flag)
        out.append(has.select(F.lit(kind).alias("object_type"), F.col(REGISTRY.primary[t]).alias("object_id"), flag))
    if "dataset" in tables:
        per = REGISTRY.any_below(tables, "workflow", "analytical_model", fitted, flag)
        sets = tables["dataset"].select("dataset_id", "workflow_id").join(per, "workflow_id", "left")
        out.append(sets.select(F.lit("Dataset").alias("object_type"), F.col("dataset_id").alias("object_id"),
                               F.coalesce(flag, F.lit(False)).alias(flag)))
    return reduce(DataFrame.unionByName, out)
