"""Benchmark decontamination by q-gram lemma filtering.

Every stretch of 80 characters of a benchmark item (the whole item, if shorter) is
a segment, wherever it starts.  A text region within k edits of a segment of m
characters shares at least m - q + 1 - k*q of its q-grams with it, on diagonals
(text position less item position) that differ by k at most.  So the shared
q-grams of text and item are counted in overlapping diagonal bands; each stretch
of 2k + 1 diagonals lies whole in one band.  In bands that reach the bound they
are counted for each segment, and segments that reach it are verified by banded
alignment with the text there.

With 6 edits for 80 characters every excerpt of 80 characters with at most 6 edits
is found, and every verbatim excerpt from 74 characters on, at any offset of the
item.  Shorter excerpts of longer items do not count.

The benchmark is small beside the corpus: its index is sent to the tasks, in
slices of a bounded number of characters, each slice one pass over the texts.
Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table
from tessera.llm.hashing import grams

Q = 8
SEGMENT = 80
STRIDE = 1
RATE = 0.08
#: Characters of benchmark text whose index is sent at once.
SLICE_CHARS = 4_000_000
#: Characters of normalised text looked at together.
PART = 400_000
_FILTER = 22


def normalised(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SegmentIndex:
    """q-grams of some benchmark items, each once, and where in an item segments
    start: every ``stride`` characters and at the last place possible."""

    def __init__(self, items: list[tuple[int, str]], q: int, segment: int, stride: int, rate: float):
        some = [(i, t) for i, t in ((i, codes(normalised(text))) for i, text in items) if len(t) >= q]
        self.q, self.stride, self.ids = q, stride, [i for i, _ in some]
        self.whole = np.concatenate([t for _, t in some]) if some else np.zeros(0, np.uint32)
        self.length = np.array([len(t) for _, t in some], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        # of each item's segments: characters, edits (as many as the lemma still
        # leaves two shared q-grams for), q-grams shared at least
        self.size = np.minimum(self.length, segment)
        self.budget = np.maximum(0, np.minimum((rate * self.size).astype(np.int64), (self.size - q - 1) // q))
        self.least = np.maximum(1, self.size - q + 1 - self.budget * q)
        self.band = int(2 * self.budget.max() + 1) if some else 1
        g = [grams(t.astype(np.uint64), q) for _, t in some]
        key = np.concatenate(g) if g else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g])
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else key.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.first, self.owner, self.pos = first, owner[order].astype(np.int32), pos[order].astype(np.int32)
        self.maybe = np.zeros(1 << _FILTER, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER)] = True

    def starts(self, x: int) -> np.ndarray:
        """Where the segments of the x-th item start in it."""
        last = int(self.length[x] - self.size[x])
        return np.append(np.arange(0, last, self.stride), last)

    @property
    def item(self) -> list[int]:
        """Of every segment: the item."""
        return [i for x, i in enumerate(self.ids) for _ in self.starts(x)]

    @property
    def text(self) -> list[np.ndarray]:
        """Of every segment: its characters."""
        return [self.whole[self.begin[x] + s:self.begin[x] + s + self.size[x]] for x in range(len(self.ids)) for s in self.starts(x)]

    @property
    def edits(self) -> list[int]:
        """Of every segment: the edits allowed."""
        return [int(self.budget[x]) for x in range(len(self.ids)) for _ in self.starts(x)]

    def candidates(self, text: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Verbatim segments as (item, place in the text), the first of a band; and
        where a band has none, its segments whose shared q-grams reach the bound,
        as columns item, start in the item, band, edits at least.  A band b holds
        the diagonals from b * band, 2 * band of them."""
        none = np.zeros((0, 4), np.int64)
        g = grams(text, self.q)
        at = np.flatnonzero(self.maybe[g >> np.uint64(64 - _FILTER)])
        if not len(at) or not len(self.keys):
            return [], none
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[k] == g[at]
        at, k = at[hit], k[hit]
        n = self.count[k]
        each = np.repeat(np.arange(len(k)), n)
        place = self.first[k][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        item, pos = self.owner[place].astype(np.int64), self.pos[place].astype(np.int64)
        diag = at[each] - pos
        shift = (len(text) + int(self.length.max())) // self.band + 2
        key = item * (2 * shift) + diag // self.band + shift
        order = np.argsort(key, kind="stable")
        key, pos, diag = key[order], pos[order], diag[order]
        one, count = np.unique(key, return_counts=True)
        # diagonals b and b + 1 make the overlapping band b
        both = np.concatenate([one, one - 1])
        both, where = np.unique(both, return_inverse=True)
        total = np.bincount(where, np.concatenate([count, count]))
        both = both[total >= self.least[both // (2 * shift)]]
        verbatim, rest = [], [none]
        for b, lo, hi in zip(both, np.searchsorted(key, both), np.searchsorted(key, both + 2)):
            x = int(b // (2 * shift))
            span, starts, p, d = int(self.size[x]) - self.q + 1, self.starts(x), pos[lo:hi], diag[lo:hi]
            own = np.unique(p)
            shared = np.searchsorted(own, starts + span) - np.searchsorted(own, starts)
            good = shared >= self.least[x]
            if not good.any():
                continue
            found = self.unchanged(text, x, starts, p, d, span)
            if found is not None:
                verbatim.append((x, found))
                continue
            low = np.maximum(1, -((shared[good] - span) // self.q))
            rest.append(np.column_stack([np.full(len(low), x), starts[good], np.full(len(low), b % (2 * shift) - shift), low]))
        return verbatim, np.concatenate(rest)

    def unchanged(self, text: np.ndarray, x: int, starts: np.ndarray, pos: np.ndarray, diag: np.ndarray, span: int) -> int | None:
        """The first place where a segment of the x-th item stands without edits:
        ``span`` q-grams in a row on one diagonal."""
        order = np.lexsort((pos, diag))
        pos, diag = pos[order], diag[order]
        begin = np.flatnonzero(np.append(True, (diag[1:] != diag[:-1]) | (pos[1:] != pos[:-1] + 1)))
        run = np.diff(np.append(begin, len(pos)))
        found = []
        for i, n in zip(begin[run >= span], run[run >= span]):
            s = int(starts[min(np.searchsorted(starts, pos[i]), len(starts) - 1)])
            at, size = int(diag[i]) + s, int(self.size[x])
            if pos[i] <= s <= pos[i] + n - span and np.array_equal(text[at:at + size], self.whole[self.begin[x] + s:self.begin[x] + s + size]):
                found.append(at)
        return min(found, default=None)

    def align(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment with the text inside its band (free ends in
        the text), and where in the text that alignment ends."""
        best, end = np.full(len(item), 1 << 20), np.zeros(len(item), np.int64)
        width = 2 * self.band
        offs = np.arange(width)
        for lo in range(0, len(item), 2048):
            x, s = item[lo:lo + 2048], start[lo:lo + 2048]
            d0, size = band[lo:lo + 2048] * self.band + s, self.size[x]
            m = int(size.max())
            pattern = self.whole[np.minimum((self.begin[x] + s)[:, None] + np.arange(m), len(self.whole) - 1)]
            row = np.where((d0[:, None] + offs >= 0) & (d0[:, None] + offs <= len(text)), 0, 1 << 20).astype(np.int32)
            for i in range(m):
                j = d0[:, None] + offs + i  # text position under the pattern's character i
                inside = (j >= 0) & (j < len(text))
                same = inside & (text[np.clip(j, 0, len(text) - 1)] == pattern[:, i:i + 1])
                take = row + np.where(inside, ~same, 1 << 20)
                skip = np.append(row[:, 1:], np.full((len(s), 1), 1 << 20, np.int32), axis=1) + 1
                row = np.minimum(np.minimum(take, skip), 1 << 20)
                row = (np.minimum.accumulate(row - offs, axis=1) + offs).astype(np.int32)
                done = np.flatnonzero(size == i + 1)
                if len(done):
                    o = row[done].argmin(axis=1)
                    best[lo + done], end[lo + done] = row[done, o], d0[done] + o + i + 1
        return best, end

    def leaks(self, text: str) -> list[dict]:
        """Segments within their edit budget, the best of each item: fewest edits,
        then first in the text."""
        t = codes(normalised(text))
        found: dict[int, tuple[int, int]] = {}
        over = 2 * (int(self.size.max()) + 2 * self.band) if len(self.size) else 0

        def add(x: int, edits: int, start: int) -> None:
            if x not in found or (edits, start) < found[x]:
                found[x] = (edits, start)

        for at in range(0, max(1, len(t)), PART):
            part = t[at:at + PART + over]
            if len(part) < self.q:
                break
            verbatim, rest = self.candidates(part)
            for x, place in verbatim:
                add(x, 0, at + place)
            # by the fewest edits possible; what can't be an item's best is left out
            for level in np.unique(rest[:, 3]):
                row = rest[rest[:, 3] == level]
                row = row[[level <= (found[x][0] if x in found else self.budget[x]) for x in row[:, 0]]]
                if len(row):
                    edits, end = self.align(part, *row[:, :3].T)
                    for x, e, z in zip(row[:, 0], edits, end):
                        if e <= self.budget[x]:
                            add(int(x), int(e), int(max(0, at + z - self.size[x])))
        # items that share an id: the best of them
        out: dict[int, dict] = {}
        for x, (edits, start) in found.items():
            one = {"item_id": self.ids[x], "edits": edits, "start": start, "length": int(self.size[x])}
            old = out.get(self.ids[x])
            if old is None or (one["edits"] / one["length"], one["start"]) < (old["edits"] / old["length"], old["start"]):
                out[self.ids[x]] = one
        return sorted(out.values(), key=lambda x: x["item_id"])


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT,
               stride: int = STRIDE, rate: float = RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """docs with ``leaks`` (a column of that name is replaced)
    array<struct<item_id, edits, start, length>>: for each
    benchmark item of which a segment occurs in the text, the best occurrence
    (start in the normalised text).  An occurrence has at most rate * length
    edits (insertions, deletions, substitutions).

    docs: text and any other columns, kept as they are; benchmark: item_id, text.
    Null or empty texts have no leaks; items without id or of fewer than q
    characters are not searched.  Items of several segments count as leaked if
    one segment is.  An empty table on either side gives no leaks."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_slices = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars))
    leak = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
                                     T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())]))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("body"),
                      F.array().cast(leak).alias("leaks"))
    schema = T.StructType([out.schema["row"], out.schema["body"], T.StructField("leaks", leak)])
    for i in range(n_slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n_slices)) == i).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(SegmentIndex([(r["item_id"], r["text"]) for r in rows], q, segment, stride, rate))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old = batch.column(2).to_pylist()
                new = [sorted(a + index.value.leaks(b.as_buffer().to_pybytes().decode("utf-8", "replace")),
                              key=lambda x: x["item_id"]) if b.is_valid else a for a, b in zip(old, batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(new, pa.list_(pa.struct(
                        [("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])))],
                    names=["row", "body", "leaks"])

        out = out.mapInArrow(search, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "leaks"], "leaks")


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    out = find_leaks(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
