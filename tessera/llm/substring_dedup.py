"""Substring dedup: seed and extend on winnowed anchors.

Every run of ``length`` words picks one anchor, the k-gram of words with the
smallest hash in it (the rightmost, on ties).  The choice depends on the words
of the run alone, so equal runs pick the same anchor at the same place, and a
repeated run can only be found among occurrences of one anchor.

1. Seed: one row for each anchor occurrence, with the run of windows that picked
   it and a hash of all their words (the widest extension both ways).
2. Occurrences with equal anchor and equal widest extension repeat as a whole.
3. Extend: where one anchor has several extensions, each distinct extension is
   opened into its windows (its extensions word by word), and those found in
   two of them repeat.  Anchor and window hash together have 128 bits.
4. The repeated windows of a document unite to its maximal repeated spans.

Nothing is paired within a group: both comparisons are counts that combine
map-side, joined back.  A text is shuffled twice at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, keyed_texts, table
from tessera.llm.hashing import chunks, grams, mix, signed

LENGTH = 35
ANCHOR = 12


def _last_min(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the last smallest value in each w consecutive values."""
    idx, width = np.arange(len(g)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] <= g[a], b, a)

    while width * 2 <= w:
        idx = better(idx[:-width], idx[width:])
        width *= 2
    n = len(g) - w + 1
    return better(idx[:n], idx[w - width:w - width + n])


def _runs(h: np.ndarray, first: np.ndarray, length: int, k: int):
    """For the words of some documents: the windows' hashes, and for each
    stretch of windows with one anchor its document, first and last window (as
    word index) and anchor."""
    windows, g = grams(h, length), grams(h, k)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return windows, g, none, none, none, none
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = doc[:len(windows)] == doc[length - 1:]
    anchor = _last_min(g, length - k + 1)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1] | (doc[1:len(windows)] != doc[:len(windows) - 1])
    lo = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), len(windows))
    hi = stop[np.searchsorted(stop, lo, "right")] - 1
    return windows, g, doc[lo], lo, hi, anchor[lo]


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int = LENGTH,
                   k: int = ANCHOR) -> DataFrame:
    """rid, tkey, spans array<struct<start, n>>: the windows (first word, how
    many in a row) of each document whose words also start elsewhere."""
    texts = keyed_texts(docs)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.hashing import word_hashes
        for batch in batches:
            rid, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for d0, _, buf, starts, ends, first in chunks(batch.column(2)):
                w, g, doc, lo, hi, at = _runs(word_hashes(buf, starts, ends), first, length, k)
                if len(lo):
                    wide = mix(w[lo] + mix(w[hi] + mix(((hi - lo) * length + at - lo).astype(np.uint64))))
                    yield pa.RecordBatch.from_arrays(
                        [signed(g[at]), signed(wide), rid[d0 + doc], tkey[d0 + doc],
                         (lo - first[doc]).astype(np.int32), (hi - lo + 1).astype(np.int32)],
                        names=["a", "c", "rid", "tkey", "start", "n"])

    occ = scratch.write(texts.select("rid", "tkey", "body").mapInArrow(
        seeds, "a long, c long, rid long, tkey long, start int, n int"), "anchors")
    wide = occ.groupBy("a", "c").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "tkey", "start", "n")).alias("one"))
    wide = scratch.write(
        wide.join(wide.groupBy("a").agg(F.sum("copies").alias("total"), F.count("*").alias("forms"))
                  .where("total > 1").drop("total"), "a"), "extensions")
    whole = (occ.join(wide.where("copies > 1").select("a", "c"), ["a", "c"])
             .select("rid", "tkey", F.struct("start", "n").alias("span")))

    todo = (wide.where("forms > 1").groupBy("one.rid", "one.tkey")
            .agg(F.collect_list(F.struct("a", "one.start", "one.n", (F.col("copies") > 1).alias("known"))).alias("todo")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.hashing import word_hashes
        for batch in batches:
            rid, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            for d0, d1, buf, starts, ends, first in chunks(batch.column(2)):
                w = grams(word_hashes(buf, starts, ends), length)
                part = lists.slice(d0, d1 - d0)
                rows = part.flatten()
                doc = np.repeat(np.arange(d1 - d0), part.value_lengths().to_numpy())
                a, start, n, known = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                each = np.repeat(np.arange(len(n)), n)
                at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [a[each], signed(w[first[doc[each]] + at]), rid[d0 + doc[each]], tkey[d0 + doc[each]],
                     at.astype(np.int32), pa.array(known[each])], names=["a", "w", "rid", "tkey", "start", "known"])

    opened = scratch.write(
        texts.join(todo, ["rid", "tkey"]).select("rid", "tkey", "body", "todo")
        .mapInArrow(extend, "a long, w long, rid long, tkey long, start int, known boolean"), "windows")
    twice = opened.groupBy("a", "w").agg(F.count("*").alias("m")).where("m > 1").select("a", "w")
    parts = (opened.where("not known").join(twice, ["a", "w"])
             .select("rid", "tkey", F.struct("start", F.lit(1).alias("n")).alias("span")))
    return whole.unionByName(parts).groupBy("rid", "tkey").agg(F.collect_list("span").alias("spans"))


def substring_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Remove every word covered by a repeated run of ``length`` words.

    docs: doc_id, text (other columns are ignored).  Returns doc_id, n_words,
    n_removed, kept_text (words joined by a space), removed array<struct<start,
    end>> (maximal word spans).  A null text or one of fewer than ``length``
    words keeps all its words.  Repeated rows, null ids included, are documents
    of their own: each is a copy of the other.  An empty table gives no rows."""
    scratch = Scratch(spark, "substring")
    spans = repeated_spans(spark, docs, scratch, length, k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept, removed = [], [], [], []
            for body, spans in zip(batch.column(1), batch.column(2)):
                words = body.as_buffer().to_pybytes().split()
                at = spans.values
                if at is None or not len(at):
                    total.append(len(words)), gone.append(0), kept.append(b" ".join(words)), removed.append([])
                    continue
                start, n = (at.field(i).to_numpy() for i in (0, 1))
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + n + (length - 1), -1)
                lost = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                total.append(len(words)), gone.append(int(lost.sum()))
                kept.append(b" ".join(compress(words, ~lost)))
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return (keyed_texts(docs).join(spans, ["rid", "tkey"], "left").select("did", "body", "spans")
            .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, "
                             "removed array<struct<start: int, end: int>>"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i+34], ' ')) as h
        from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as n from win) where n > 1),
cov as (select distinct doc_id, i + k as p from rep, range(0, 35) r(k)),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t
         from words anti join cov using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""
