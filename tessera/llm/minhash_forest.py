"""MinHash near-dedup with an LSH forest.

1. One pass over the texts gives each document the size and a 128-bit hash of
   its shingle set, and a one-permutation MinHash signature (every bin's least
   shingle; empty bins borrow from other bins by a fixed probe order).
2. Documents with equal sets become one class, held by its smallest doc_id.
3. Forest: the signature's bins are dealt to several trees of a few values each.
   A tree is the classes sorted by its values (a range-partitioned sort).
   Neighbours whose longest common prefix reaches the region's depth are
   candidates; since the order is sorted, all classes that share the prefix
   hang together through their neighbours.  The depth starts at ``depth`` and
   grows in dense regions.
4. Candidates only gather regions: connected by them, classes that might be
   linked share a region.  Inside a region the full shingle sets are compared,
   block against block, and links confirmed exactly.  A region larger than a
   block is first compared with one hub block; only classes that are then
   outside its largest component are compared with all the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, keyed_texts, table
from tessera.llm.graph import block_pairs, blocked, bridges, components_of, connected_components, map_units
from tessera.llm.hashing import chunks, grams, mix, signed, word_hashes

SHINGLE = 5
PERCENT = 85
TREES = 16
VALUES = 8
DEPTH = 4
DENSE = 4096
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
_PROBES = 48


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, buf, starts, ends, first in chunks(texts, lower=True):
        h = word_hashes(buf, starts, ends)
        g = {k: grams(h, k)}
        for a, b in zip(first[:-1], first[1:]):
            n = min(k, b - a)
            if n == 0:
                yield np.zeros(0, np.uint64)
                continue
            if n not in g:
                g[n] = grams(h, n)
            yield np.unique(g[n][a:b - n + 1])


def signatures(sets: list[np.ndarray], trees: int, values: int) -> np.ndarray:
    """uint32 [documents, trees, values]; sets must not be empty."""
    bins = trees * values
    rng = np.random.default_rng(17)
    probes, order = rng.integers(0, bins, (_PROBES, bins)), rng.permutation(bins)
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins))
    low = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        full[i] = at < np.append(at[1:], len(s))
        low[i] = s[np.minimum(at, len(s) - 1)]
    sig, have = low.copy(), full.copy()
    for p in probes:
        take = ~have & full[:, p]
        if have.all():
            break
        sig = np.where(take, low[:, p], sig)
        have |= take
    if not have.all():  # very few shingles: the least of all
        sig = np.where(have, sig, np.array([s[0] for s in sets], np.uint64)[:, None])
    return (mix(sig) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, order].reshape(len(sets), trees, values)


def sketch(docs: DataFrame, k: int = SHINGLE, trees: int = TREES, values: int = VALUES) -> DataFrame:
    """did, rid, tkey, n_shingles, h1, h2, sig (big-endian signature, null for
    a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sets = [], [], [], []
            for s in shingle_sets(batch.column(3), k):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                h2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0)
                sets.append(s)
                if len(sets) == 512:
                    yield out(batch, n, h1, h2, sets)
                    batch, n, h1, h2, sets = batch.slice(512), [], [], [], []
            if sets:
                yield out(batch, n, h1, h2, sets)

    def out(batch: pa.RecordBatch, n: list, h1: list, h2: list, sets: list) -> pa.RecordBatch:
        some = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(sets)
        if some:
            for i, row in zip(some, signatures([sets[i] for i in some], trees, values).astype(">u4")):
                sig[i] = row.tobytes()
        cols = [batch.column(c).slice(0, len(sets)) for c in range(3)]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(n, pa.int64()), signed(np.array(h1, np.uint64)), signed(np.array(h2, np.uint64)),
             pa.array(sig, pa.binary())], names=["did", "rid", "tkey", "n_shingles", "h1", "h2", "sig"])

    return keyed_texts(docs).select("did", "rid", "tkey", "body").mapInArrow(
        run, "did long, rid long, tkey long, n_shingles long, h1 long, h2 long, sig binary")


def prefix_runs(values: np.ndarray, depth: int, dense: int) -> np.ndarray:
    """Sorted signatures [n, values]: for each row, whether it starts a region.
    A region shares a prefix of ``depth`` values; one of more than ``dense``
    rows is cut again a value deeper, and so on."""
    same = values[1:] == values[:-1]
    lcp = np.where(same.all(axis=1), values.shape[1], np.argmin(same, axis=1))
    begin = np.ones(len(values), bool)
    begin[1:] = lcp < depth
    for deeper in range(depth + 1, values.shape[1] + 1):
        starts = np.flatnonzero(begin)
        size = np.diff(np.append(starts, len(values)))
        if not (size > dense).any():
            break
        crowded = np.repeat(size > dense, size)
        begin[1:] |= crowded[1:] & (lcp < deeper)
    return begin


def forest_candidates(spark: SparkSession, classes: DataFrame, scratch: Scratch, trees: int, values: int,
                      depth: int, dense: int) -> DataFrame:
    """Edges (u, v) between classes of one region of a tree.  classes: rid, sig."""
    width = 4 * values
    rows = (classes.select("rid", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
            .select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("label"), "rid"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        root, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy().astype(">u4")
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, values)
            ids = batch.column(2).to_numpy()
            full = np.column_stack([tree, label])
            if last is None:
                yield edge([ids[0]], [ids[0]], part, 0, full[0])
            else:
                full, ids = np.vstack([last[0][None], full]), np.append(last[1], ids)
            begin = prefix_runs(full, depth + 1, dense)
            if last is None:
                root = ids[0]
            at = np.maximum.accumulate(np.where(begin, np.arange(len(ids)), 0))
            roots = np.where(at == 0, root, ids[at])
            link = np.flatnonzero(roots != ids)
            if len(link):
                yield edge(roots[link], ids[link], part, -1, full[0])
            root, last = roots[-1], (full[-1], ids[-1])
        if last is not None:
            yield edge([last[1]], [last[1]], part, 1, last[0])

    def edge(u, v, part: int, end: int, row: np.ndarray) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([end] * n, pa.int32()),
             pa.array([row.tobytes() if end >= 0 else None] * n, pa.binary())], names=["u", "v", "part", "end", "row"])

    found = scratch.write(
        rows.repartitionByRange("tree", "label", "rid").sortWithinPartitions("tree", "label", "rid")
        .mapInArrow(neighbours, "u long, v long, part int, end int, row binary"), "neighbours")
    # neighbours across partitions: two rows for each partition of the sort
    ends = found.where("end >= 0").orderBy("part", "end").collect()
    across = []
    for a, b in zip(ends[1::2], ends[2::2]):
        rows2 = np.frombuffer(bytes(a["row"]) + bytes(b["row"]), ">u4").reshape(2, -1)
        if not prefix_runs(rows2, depth + 1, dense)[1]:
            across.append((a["u"], b["u"]))
    edges = found.where("end < 0").select("u", "v")
    return edges.unionByName(spark.createDataFrame(across, "u long, v long")) if across else edges


def _links(percent: int, k: int):
    """For one unit: (u, v) pairs that connect its classes as their links do."""

    def fn(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        sets = list(shingle_sets(t["body"], k))
        size = np.array([len(s) for s in sets])
        every, col = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(col, minlength=len(every)) > 1  # others can't be in an intersection
        place = np.cumsum(shared) - 1
        keep = shared[col]
        row, col = row[keep], place[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.int64)
        step = max(256, 8_000_000 // len(sets))
        for lo in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((len(sets), min(step, int(shared.sum()) - lo)), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            both += (m @ m.T).astype(np.int64)
        link = 100 * both >= percent * (size[:, None] + size[None] - both)
        if (side != side[0]).any():
            link &= side[:, None] != side[None]
        root = components_of(link)
        far = np.flatnonzero(root != np.arange(len(root)))
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[far]]), pa.array(ids[far])], names=["u", "v"])

    return fn


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE,
                    trees: int = TREES, values: int = VALUES, depth: int = DEPTH, dense: int = DENSE,
                    block: int = BLOCK) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union.

    docs: doc_id, text (other columns are ignored).  Returns doc_id, n_shingles,
    class_id (smallest doc_id of the same set), component_id, kept.  A null or
    wordless text has an empty set and links with nothing.  A null doc_id links
    with nothing, has a null component and is kept.  Rows that share a doc_id are
    one node of the graph, whatever their texts: what is linked with any of them is
    linked through it.  An empty table gives no rows."""
    scratch = Scratch(spark, "minhash")
    seen = scratch.write(sketch(docs, k, trees, values), "sketch")
    usable = seen.where("n_shingles > 0 and did is not null")
    classes = scratch.write(
        usable.groupBy("h1", "h2", "n_shingles")
        .agg(F.min(F.struct("rid", "tkey")).alias("one"), F.first("sig").alias("sig"))
        .select("h1", "h2", "n_shingles", "one.rid", "one.tkey", "sig"), "classes")
    near = connected_components(spark, forest_candidates(spark, classes, scratch, trees, values, depth, dense), scratch)
    members = scratch.write(blocked(
        classes.join(near.withColumnRenamed("id", "rid"), "rid")
        .select(F.col("component").alias("grp"), F.col("rid").alias("id"), "tkey", "n_shingles"),
        block, BLOCK_SHINGLES, "n_shingles"), "members")
    texts = keyed_texts(docs).select(F.col("rid").alias("id"), "tkey", "body")

    def links(units: DataFrame, step: str) -> DataFrame:
        # sorted merge at every size, so that small inputs shuffle as large ones do
        full = units.hint("merge").join(texts, ["id", "tkey"]).select("grp", "bi", "bj", "side", "id", F.col("tkey").alias("sub"), "body")
        return scratch.write(map_units(full, _links(percent, k), "u long, v long"), step)

    # every block with itself and with block 0, the hub
    first = block_pairs(members.where("n_blocks > 1")).where("bi = bj or bi = 0")
    small = block_pairs(members.where("n_blocks = 1"))
    edges = links(small.unionByName(first), "links")
    large = members.where("n_blocks > 1")
    if not large.isEmpty():
        own = connected_components(spark, edges, scratch)
        large = scratch.write(large.join(own, "id", "left").withColumn("component", F.coalesce("component", "id")), "large")
        giant = (large.groupBy("grp", "component").agg(F.count("*").alias("n"))
                 .groupBy("grp").agg(F.max_by("component", "n").alias("giant")))
        # an id of several classes stands in one component though only some of them were linked there
        shared = large.groupBy("grp", "id").agg(F.count("*").alias("same")).where("same > 1")
        rest = (large.join(giant, "grp").join(shared, ["grp", "id"], "left").where("component <> giant or same > 1")
                .drop("n_blocks", "block", "same"))
        rest = scratch.write(blocked(rest, block, BLOCK_SHINGLES, "n_shingles"), "rest")
        n_rest = rest.groupBy("grp").agg(F.max("n_blocks").alias("n_rest"))
        n_all = large.groupBy("grp").agg(F.max("n_blocks").alias("n_all"))
        a = (rest.join(n_all, "grp").withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
             .select("grp", F.col("block").alias("bi"), "bj", F.lit(0).alias("side"), "id", "tkey"))
        b = (large.join(n_rest, "grp").withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)))
             .select("grp", "bi", F.col("block").alias("bj"), F.lit(1).alias("side"), "id", "tkey"))
        edges = edges.unionByName(links(a.unionByName(b), "links2"))
    rows = scratch.write(usable.select("did", "n_shingles", "h1", "h2").join(
        classes.select("h1", "h2", "n_shingles", F.col("rid").alias("class_id")), ["h1", "h2", "n_shingles"])
        .select("did", "n_shingles", "class_id"), "rows")
    joined = connected_components(spark, edges.unionByName(bridges(rows)), scratch).select(F.col("id").alias("class_id"), "component")
    linked = rows.join(joined, "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    alone = seen.where("n_shingles = 0 or did is null").withColumns({"class_id": F.col("did"), "component_id": F.col("did")})
    cols = [F.col("did").alias("doc_id"), "n_shingles", "class_id", "component_id",
            F.coalesce(F.col("did") == F.col("component_id"), F.lit(True)).alias("kept")]
    return linked.select(*cols).unionByName(alone.select(*cols))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') || chr(10) else array_to_string(w[i:i+4], ' ') end as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.v, r.c from r join e on e.u = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from m left join n using (doc_id)
"""
