"""Embedding near-dedup with a random-projection tree forest.

Equal vectors become one class.  Each tree cuts the space by random directions
at the median of a sample, level by level; vectors close to a cut go down both
sides (spill), so near vectors seldom part.  Classes of one leaf are compared
and those near each other joined; what hangs together over all trees is a
region.  Inside a region every two classes are compared in double precision,
block against block, which verifies the links, counts them whole (a class
counts for as many vectors as it has) and gives the components.

The trees are fitted on a bounded sample (SAMPLE classes, those with the least
hash), every class is indexed.  Below the levels that the sample supports a cut
goes through its last mean.  A leaf or region larger than a block is compared
block against block as well, so there is no cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table
from tessera.llm.graph import block_pairs, blocked, bridges, components_of, connected_components, map_units

THRESHOLD = 0.95
TREES = 10
LEAF = 256
SPILL = 0.1
SAMPLE = 16_384
LEAST_FIT = 24
BLOCK = 2048


class ProjectionTree:
    """Random directions, one per level, and the cut of each node of a level:
    the sample's median there, and how far around it vectors spill."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.way = rng.standard_normal((depth, dim)).astype(np.float32) / math.sqrt(dim)
        self.cut = [np.zeros(1 << d, np.float32) for d in range(depth)]
        self.edge = [np.zeros(1 << d, np.float32) for d in range(depth)]
        groups = {0: sample}
        mean = {0: sample.mean(axis=0) if len(sample) else np.zeros(dim, np.float32)}
        for d in range(depth):
            below, means = {}, {}
            for node in range(1 << d):
                rows = groups.get(node, sample[:0])
                p = rows @ self.way[d]
                if len(rows) >= LEAST_FIT:
                    self.cut[d][node], self.edge[d][node] = np.median(p), spill * p.std()
                    center = rows.mean(axis=0)
                else:
                    center = mean[node]
                    self.cut[d][node], self.edge[d][node] = center @ self.way[d], self.edge[d - 1][node >> 1] if d else 0
                right = p > self.cut[d][node]
                below[2 * node], below[2 * node + 1] = rows[~right], rows[right]
                means[2 * node] = means[2 * node + 1] = center
            groups, mean = below, means

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every vector, more than once where it spills."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d in range(len(self.way)):
            p = (x @ self.way[d])[row]
            off, edge = p - self.cut[d][node], self.edge[d][node]
            left, right = off <= edge, off > -edge
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _matrix(arr: pa.Array, dtype) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    return np.frombuffer(b"".join(arr.to_pylist()), np.float64).reshape(n, -1).astype(dtype) if n else np.zeros((0, 0), dtype)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """id, vec (little-endian doubles, binary) of vectors that can link: not
    null, of some length, without null or non-finite components and not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(np.float64) + 0.0  # -0.0 equals 0.0
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x * x).sum())
                if not np.isfinite(x).all() or not x.any():
                    continue
                if not np.isfinite(norm) or norm == 0 or norm < 1e-150:
                    x = x / np.abs(x).max()  # squares would leave the range of doubles
                ids.append(i), out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])

    return vectors.mapInArrow(run, "id long, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _single(arr: pa.Array) -> np.ndarray:
    """Unit vectors in single precision; the norms are taken in double precision,
    as the squares of very small or large components leave the range of singles."""
    return _unit(_matrix(arr, np.float64)).astype(np.float32)


def _near(threshold: float):
    """In a unit: pairs that connect what is near, from single precision."""

    def fn(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side, x = t["id"].to_numpy(), t["side"].to_numpy(), _single(t["vec"])
        link = x @ x.T >= threshold - 1e-5
        if (side != side[0]).any():
            link &= side[:, None] != side[None]
        root = components_of(link)
        far = np.flatnonzero(root != np.arange(len(root)))
        if len(far):
            yield pa.RecordBatch.from_arrays([ids[root[far]], ids[far]], names=["u", "v"])

    return fn


def _verified(threshold: float):
    """In a unit: (id, sub, n, to): links of each class there, and a connecting pair."""

    def fn(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side, weight, sub = (t[c].to_numpy() for c in ("id", "side", "weight", "sub"))
        x = _unit(_matrix(t["vec"], np.float64))
        link = x @ x.T >= threshold
        if (side != side[0]).any():
            link &= side[:, None] != side[None]
        np.fill_diagonal(link, False)
        n = link @ weight.astype(np.int64)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([ids[some], sub[some], n[some], ids[components_of(link)[some]]], names=["id", "sub", "n", "to"])

    return fn


def embedding_near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                              threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL,
                              sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Link vectors with cosine >= threshold.

    Returns vec_id, n_links, component_id, kept, one row per input row (other
    columns are ignored).  Null, empty or zero vectors, and those with null or
    non-finite components, link with nothing; so do vectors of different
    lengths with each other.  A null id has a null component and is kept.
    Repeated rows link with each other.  Rows that share an id but not the vector
    count their own links, and are one node of the graph.  An empty table gives no
    rows."""
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    usable = scratch.write(
        usable_vectors(rows).select("id", "vec", F.length("vec").alias("len"), F.xxhash64("vec").alias("h1"),
                                    F.xxhash64("vec", F.lit(1)).alias("h2")), "vectors")
    classes = scratch.write(
        usable.groupBy("len", "h1", "h2").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count("*").alias("weight"))
        .withColumn("sub", F.col("h1")), "classes")
    found = None
    for size, n in classes.groupBy("len").count().orderBy("len").collect():
        own = classes.where(F.col("len") == size)
        picked = own.orderBy("h1", "h2").limit(sample).select("vec").toArrow()["vec"]
        fit = _single(picked)
        depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
        forest = spark.sparkContext.broadcast([ProjectionTree(fit, depth, spill, seed) for seed in range(trees)])

        def route(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _single(batch.column(1))
                    for i, tree in enumerate(forest.value):
                        row, node = tree.leaves(x)
                        yield pa.RecordBatch.from_arrays([pa.array((np.int64(i) << 48) + node), *(batch.column(c).take(pa.array(row)) for c in (0, 2))],
                                                         names=["grp", "id", "sub"])

        leaves = own.select("id", "vec", "sub").mapInArrow(route, "grp long, id long, sub long")
        units = block_pairs(blocked(leaves.withColumn("one", F.lit(1)), 4 * block, 1 << 40, "one").drop("one"))
        near = scratch.write(map_units(units.join(own.select("id", "sub", "vec"), ["id", "sub"]).select("grp", "bi", "bj", "side", "id", "sub", "vec"),
                                       _near(threshold), "u long, v long"), f"near{size}")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], "u long, v long")
    region = connected_components(spark, found, scratch)
    members = blocked(region.select(F.col("component").alias("grp"), "id").withColumn("one", F.lit(1)), block, 1 << 40, "one").drop("one")
    links = scratch.write(map_units(
        block_pairs(members).join(classes.select("id", "sub", "vec", "weight"), "id").select("grp", "bi", "bj", "side", "id", "sub", "vec", "weight"),
        _verified(threshold), "id long, sub long, n long, to long"), "links")
    own_class = usable.select(F.col("id").alias("did"), "len", "h1", "h2").join(
        classes.select("len", "h1", "h2", F.col("id").alias("class_id")), ["len", "h1", "h2"]).select("did", "class_id")
    comp = connected_components(spark, links.select(F.col("to").alias("u"), F.col("id").alias("v")).unionByName(bridges(own_class)), scratch)
    held = (classes.drop("vec").join(links.groupBy("id", "sub").agg(F.sum("n").alias("n")), ["id", "sub"], "left")
            .join(comp, "id", "left")
            .select("len", "h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))
    linked = usable.select("id", "len", "h1", "h2").join(held, ["len", "h1", "h2"]).select("id", "n_links", "component_id")
    # rows that cannot link, as often as they occur
    alone = (rows.select("id").groupBy("id").agg(F.count("*").alias("all"))
             .join(usable.groupBy(F.col("id").alias("k")).agg(F.count("*").alias("some")), F.expr("id <=> k"), "left")
             .withColumn("left", F.col("all") - F.coalesce("some", F.lit(0))).where("`left` > 0")
             .select(F.explode(F.sequence(F.lit(1), F.col("left"))), "id")
             .select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark, table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select e.v, r.c from r join e on e.u = r.vec_id),
m as (select vec_id, min(c) as component_id from r group by vec_id),
n as (select u as vec_id, count(*) as n from e group by u)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from m left join n using (vec_id)
"""
