"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of rising doc_id.  What was seen before is held as
runs: Parquet tables of line hashes, each sorted by hash.  A batch merge-anti-
joins the runs (a line found there belongs to a smaller doc_id), settles its
own lines by the smallest doc_id, and adds its new hashes as a run at level 0.
When a level holds ``fanout`` runs they are merged into one run of the next
level, so a hash is rewritten at most log(batches) times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, row_key, table

SPACES = b" \t\n\x0b\x0c\r"
LEAST = 10
BATCHES = 4
FANOUT = 2


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The line stripped and lower-cased (A-Z), None below ``least`` code points."""
    key = line.strip(SPACES).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return key


class LineRuns:
    """The levelled runs: (h1, h2) of every line key seen so far, each once."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout, self.levels = scratch, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, keys: DataFrame, level: int) -> DataFrame:
        return self.scratch.write(
            keys.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), f"run{level}")

    def known(self, firsts: DataFrame) -> DataFrame:
        """firsts with ``seen``: whether a run holds the key (sort-merge join)."""
        out = firsts
        seen = None
        for run in self.runs():
            seen = run if seen is None else seen.unionByName(run)
        if seen is None:
            return out.withColumn("seen", F.lit(False))
        return (out.join(seen.withColumn("hit", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
                .withColumn("seen", F.col("hit").isNotNull()).drop("hit"))

    def add(self, keys: DataFrame) -> None:
        self.levels[0].append(self._write(keys, 0))
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = level[0]
            for run in level[1:]:
                merged = merged.unionByName(run)
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(merged, i + 1))
            self.scratch.drop(*level)
            self.levels[i] = []


def _line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, rid, tkey: the keys of each document, each once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, rid, tkey = [], [], [], []
            for i, (r, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = {xxhash.xxh3_128_digest(k) for line in batch.column(2)[i].as_buffer().to_pybytes().split(b"\n")
                       if (k := line_key(line, least)) is not None}
                h1.extend(int.from_bytes(d[:8], "little", signed=True) for d in own)
                h2.extend(int.from_bytes(d[8:], "little", signed=True) for d in own)
                rid.extend([r] * len(own))
                tkey.extend([t] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, rid, tkey)],
                                             names=["h1", "h2", "rid", "tkey"])

    return docs.mapInArrow(keys, "h1 long, h2 long, rid long, tkey long")


def line_dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """Drop lines whose key (at least ``least`` code points) a smaller doc_id holds.

    docs: doc_id, text and any other columns.  Returns all of them with ``text``
    deduplicated, plus line_stats struct<n_lines, n_dropped>, which replaces a
    column of that name.  A null text counts
    as empty (one empty line); a null doc_id counts as smaller than all others;
    rows that share a doc_id are one holder, and keep the line together.  An
    empty table gives no rows."""
    scratch = Scratch(spark, "lines")
    keyed = docs.select(*row_key("doc_id", "text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hashes = scratch.write(_line_hashes(
        docs.select(*row_key("doc_id", "text"), F.coalesce("text", F.lit("")).alias("body")), least), "hashes")
    cuts = hashes.agg(F.percentile_approx("rid", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    store, dropped = LineRuns(scratch, fanout), []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = hashes
        if lo is not None:
            part = part.where(F.col("rid") > lo)
        if hi is not None:
            part = part.where(F.col("rid") <= hi)
        firsts = scratch.write(store.known(
            part.groupBy("h1", "h2").agg(F.min("rid").alias("least"), F.max("rid").alias("most"))), "batch")
        # only keys that some row of this batch must lose
        losing = firsts.where("seen or least < most").select("h1", "h2", "least", "seen")
        dropped.append(scratch.write(
            part.join(losing, ["h1", "h2"]).where("seen or rid > least").select("rid", "tkey", "h1"), "dropped"))
        if hi is not None:
            store.add(firsts.where("not seen").select("h1", "h2"))
        scratch.drop(firsts)
    lost = dropped[0]
    for d in dropped[1:]:
        lost = lost.unionByName(d)
    lost = lost.groupBy("rid", "tkey").agg(F.collect_list("h1").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for body, gone in zip(batch.column(1), batch.column(2)):
                lines = (body.as_buffer().to_pybytes() if body.is_valid else b"").split(b"\n")
                stay = lines
                if gone.is_valid:
                    drop = set(gone.as_py())
                    stay = [x for x in lines if (k := line_key(x, least)) is None
                            or int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True) not in drop]
                kept.append(b"\n".join(stay)), n_lines.append(len(lines)), n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["row", "kept", "n_lines", "n_dropped"])

    rest = [c for c in docs.columns if c != "text"]
    slim = keyed.select("rid", "tkey", F.struct(*[F.col("row")[c].alias(c) for c in rest]).alias("row"),
                        F.col("row.text").alias("body"))
    joined = slim.join(lost, ["rid", "tkey"], "left").select("row", "body", "gone")
    schema = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(cut, schema).select(
        *[F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "line_stats"],
        F.struct("n_lines", "n_dropped").alias("line_stats"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as least from k where length(key) >= 10 group by key),
j as (select k.*, coalesce(k.doc_id > f.least, false) as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""
