"""Connected components, and comparing the members of groups in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in edges (u, v).

    Contraction: each round maps every vertex to its smallest neighbour (or
    itself), relabels the edges and drops loops and repeats, so each round at
    least halves the vertices that still have edges.  The rounds' maps are then
    joined backwards.  All aggregates combine map-side; a vertex with very many
    edges is one key of a join that adaptive execution splits."""
    cur = scratch.write(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        step = (cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("to")))
        step = scratch.write(step, f"map{len(maps)}")
        maps.append(step)
        a = step.select(F.col("id").alias("u"), F.col("to").alias("a"))
        b = step.select(F.col("id").alias("v"), F.col("to").alias("b"))
        old = cur
        cur = scratch.write(
            cur.join(a, "u").join(b, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"edges{len(maps)}")
        scratch.drop(old)
    scratch.drop(cur)
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[-1].select("id", F.col("to").alias("component"))
    for step in reversed(maps[:-1]):
        nxt = out.select(F.col("id").alias("to"), F.col("component").alias("c"))
        out = step.join(nxt, "to", "left").select("id", F.coalesce("c", "to").alias("component"))
    return out


def bridges(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that hold the classes of one id together.  rows: did, class_id;
    only ids that lie in several classes give edges."""
    spread = rows.groupBy("did").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most").select("did")
    return rows.join(spread, "did").select(F.col("class_id").alias("u"), F.col("did").alias("v")).where("u <> v").distinct()


def components_of(link: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each row of a symmetric boolean matrix."""
    n = len(link)
    root = np.full(n, -1, np.int64)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                near = link[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(near)
                root[front] = i
    return root


def blocked(members: DataFrame, most: int, most_bytes: int, size_col: str) -> DataFrame:
    """Adds n_blocks of the row's group and the row's block: groups are cut by a
    hash of the member's id into blocks of about ``most`` members or
    ``most_bytes`` at most.  members: grp, id, payload columns."""
    sizes = members.groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(float(most))), F.ceil(F.sum(size_col) / F.lit(float(most_bytes))), F.lit(1))
        .cast("int").alias("n_blocks"))
    return members.join(sizes, "grp").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("n_blocks").cast("long")).cast("int"))


def block_pairs(members: DataFrame) -> DataFrame:
    """Units (grp, bi, bj), bi <= bj, with side 0 for rows of block bi and 1 for
    those of bj (bi = bj: side 0 only).  Every two members of a group meet in
    exactly one unit, and a unit holds two blocks at most."""
    return (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
            .withColumn("side", (F.col("block") != F.col("bi")).cast("int")).drop("other", "block", "n_blocks"))


def map_units(units: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls fn once for each (grp, bi, bj); a unit's size is bounded by blocked().
    Of rows repeating an (id, sub) on one side of a unit, one is passed on: sub tells
    apart what shares an id."""
    keys = ["grp", "bi", "bj"]
    order = [*keys, "side", "id", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rows = np.column_stack([t[k].to_numpy() for k in order])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            new[0] = before is None or bool((rows[0] != before).any())
            before = rows[-1]
            t = t.filter(pa.array(new))
            if not t.num_rows:
                continue
            cols = [t[k].to_numpy() for k in keys]
            cut = np.zeros(t.num_rows, bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            bounds = np.concatenate([[0], np.flatnonzero(cut), [t.num_rows]])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                key = tuple(int(c[lo]) for c in cols)
                if last is not None and key != last:
                    yield from fn(pa.concat_tables(held))
                    held = []
                held.append(t.slice(lo, hi - lo))
                last = key
        if held:
            yield from fn(pa.concat_tables(held))

    return units.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)
