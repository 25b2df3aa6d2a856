"""Centroid clustering over zone maps of a space-filling curve.

Vectors of whole numbers are put in the order of a Hilbert curve through all their
dimensions and cut into blocks; each block keeps its least and greatest value per
dimension (a box) and the sum of its vectors.  In a round, the distance bounds
from a box to the centroids leave the block's candidates: a centroid whose
nearest point of the box is farther than another one's farthest point serves no
vector of the block.  With one candidate the block's sum is taken as a whole;
otherwise its vectors are compared exactly with the candidates.

The blocks are written once to the shared folder; each round reads them, sends
k centroids out and gets k counts and sums back, added up map-side.  Equal vectors
may fill many blocks: ties on the curve are ordered by a hash of the row, so a
frequent vector is dealt over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
BLOCK = 256
#: Bits a dimension has on the curve.
BITS = 3
#: Components are held within this bound, so that squared distances fit 64 bits.
BOUND = 1 << 27
#: Below it double precision adds up squares of 64 dimensions exactly.
EXACT_DOUBLE = 1 << 22


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (n, dims) with values
    below 2**bits, as bytes that sort like it (Skilling 2004)."""
    x = cells.T.astype(np.uint32).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # highest bit first
    return np.packbits(planes.transpose(2, 0, 1).reshape(len(cells), -1).astype(np.uint8), axis=1)


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the whole numbers floor(scale * x) of vectors with exactly
    ``dims`` components, none null, NaN or infinite."""
    x = F.col("embedding")
    usable = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))

    def whole(e: Column) -> Column:
        return F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int")

    return vectors.where(x.isNotNull()).where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def _blocks(scratch: Scratch, whole: DataFrame, dims: int, block: int) -> DataFrame:
    """The written block table: ids, data (int32, row by row), lo, hi, total."""
    ends = whole.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    lo, hi = (0, 0) if ends[0] is None else ends
    width = (hi - lo + 1) / (1 << BITS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((_matrix(batch.column(1), dims) - lo) / width).astype(np.int64)
            key = hilbert_key(cells, BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in key], pa.binary())],
                                             names=["vec_id", "v", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], np.zeros((0, dims), np.int64)

        def out(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            cut = range(0, len(ids), block)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i:i + block] for i in cut], pa.list_(pa.int64())),
                 pa.array([rows[i:i + block].astype("<i4").tobytes() for i in cut], pa.binary()),
                 pa.array([rows[i:i + block].min(0) for i in cut], pa.list_(pa.int64())),
                 pa.array([rows[i:i + block].max(0) for i in cut], pa.list_(pa.int64())),
                 pa.array([rows[i:i + block].sum(0) for i in cut], pa.list_(pa.int64()))],
                names=["ids", "data", "lo", "hi", "total"])

        for batch in batches:
            ids = ids + batch.column(0).to_pylist()
            rows = np.vstack([rows, _matrix(batch.column(1), dims)])
            full = len(ids) // block * block
            if full:
                yield out(ids[:full], rows[:full])
                ids, rows = ids[full:], rows[full:]
        if ids:
            yield out(ids, rows)

    keyed = whole.select(F.col("vec_id").cast("long"), "v").mapInArrow(keys, "vec_id long, v array<int>, key binary")
    ordered = keyed.withColumn("tie", F.xxhash64("vec_id", "v")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return scratch.write(ordered.select("vec_id", "v").mapInArrow(
        pack, "ids array<long>, data binary, lo array<long>, hi array<long>, total array<long>"), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(blocks, k): whether a centroid can be nearest to a point of the block's box."""
    c = centroids[None]
    lo, hi = lo[:, None], hi[:, None]
    near = np.maximum(np.maximum(lo - c, c - hi), 0)
    far = np.maximum(np.abs(c - lo), np.abs(c - hi))
    return (near * near).sum(2) <= (far * far).sum(2).min(1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, k)."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_DOUBLE:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, int | None, np.ndarray | None, np.ndarray | None]]:
    """Per block: its number in the batch and its one candidate, or else the
    vectors and the centroid of each."""
    dims = centroids.shape[1]
    by_name = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    able = candidates(_matrix(by_name["lo"], dims), _matrix(by_name["hi"], dims), centroids)
    for i in range(batch.num_rows):
        on = np.flatnonzero(able[i])
        if len(on) == 1:
            yield i, int(on[0]), None, None
        else:
            x = np.frombuffer(by_name["data"][i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
            yield i, None, x, on[np.argmin(distances(x, centroids[on]), axis=1)]


def _round(blocks: DataFrame, centroids: np.ndarray) -> list:
    """Count and sum of each centroid's vectors: k rows."""
    k, dims = centroids.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            totals = _matrix(batch.column(4), dims)
            for i, one, x, own in _nearest(batch, centroids):
                if one is not None:
                    n[one] += sizes[i]
                    sums[one] += totals[i]
                else:
                    n += np.bincount(own, minlength=k)
                    np.add.at(sums, own, x)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[on], pa.int64()),
                                          pa.array(list(sums[on]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    return (blocks.mapInArrow(gather, "c int, n long, s array<long>").groupBy("c")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).collect())


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
                    scale: int = SCALE, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """k-means (Lloyd) of whole numbers floor(scale * x), exact in every step.

    vectors: vec_id, embedding and any other columns, which are left behind.
    Vectors without exactly ``dims`` components, or with a null, NaN or infinite
    one, are left out.  The centroids start as the k vectors of the least sha256 of
    ``<seed>:<vec_id>`` (null: the text null; equal ids: least components); fewer
    vectors give fewer centroids.  A round assigns every vector to the nearest
    centroid (ties: smaller number) and moves each centroid that has vectors to the
    floor of their mean; after ``rounds`` of them vectors are assigned once more.

    Returns per row vec_id, cluster int, distance long (squared), cluster_inertia,
    inertia long, centroid_sha256.  Repeated and null vec_ids are rows like any
    other; an empty table gives no rows.  Components beyond 2**27 in size are held
    at that bound, sums of distances at the greatest long."""
    scratch = Scratch(spark, "clusters")
    whole = whole_vectors(vectors, dims, scale)
    first = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256).alias("h"), "v")
    centroids = np.array([r["v"] for r in first.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dims)
    blocks = _blocks(scratch, whole, dims, block)
    for _ in range(rounds if len(centroids) else 0):
        for row in _round(blocks, centroids):
            centroids[row["c"]] = [s // row["n"] for s in row["s"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, one, x, own in _nearest(batch, centroids):
                if x is None:
                    x = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
                    own = np.full(len(x), one)
                gap = x - centroids[own]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.cast(pa.int64()), pa.array(own, pa.int32()),
                                                  pa.array((gap * gap).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    found = scratch.write(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in sums)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(r["cluster"], r["s"], names[r["cluster"]]) for r in sums],
                                "cluster int, s decimal(38,0), centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", F.least("s", most).cast("long").alias("cluster_inertia"),
        F.lit(min(total, (1 << 63) - 1)).cast("long").alias("inertia"), "centroid_sha256")


def op12_hilbert_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op12_sql() -> str:
    """The rounds written out; every step on whole numbers."""
    squares = "list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(n: int, centroids: str) -> str:
        return (f"a{n} as materialized (select r, any_value(vec_id) as vec_id, any_value(e) as e, min(struct_pack(d, c)) as b "
                f"from (select v.*, c, {squares} as d from v, {centroids}) group by r)")

    steps = []
    for n in range(ROUNDS):
        steps.append(assigned(n, f"c{n}"))
        steps.append(
            f"s{n} as (select c, i, sum(x) as s, count(*) as n from (select b.c as c, unnest(e) as x, generate_subscripts(e, 1) as i from a{n}) group by c, i)")
        steps.append(
            f"m{n} as (select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{n} group by c)")
        steps.append(f"c{n + 1} as materialized (select c, coalesce(m{n}.m, c{n}.m) as m from c{n} left join m{n} using (c))")
    return f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e
  from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), e) - 1 as c, e as m from v
                    order by sha256('3:' || vec_id), e limit {CLUSTERS}),
{', '.join(steps)},
{assigned(ROUNDS, f'c{ROUNDS}')}
select vec_id, cast(b.c as integer) as cluster, cast(b.d as bigint) as distance,
       cast(sum(b.d) over (partition by b.c) as bigint) as cluster_inertia, cast(sum(b.d) over () as bigint) as inertia,
       sha256(array_to_string(c{ROUNDS}.m, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on c{ROUNDS}.c = b.c
"""


OP12_SQL = _op12_sql()
