"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) and length >= max(24, 3 q) that no neighbouring word extends.

At each dyadic scale B = 8, 16, 32, ... a document is cut into blocks of B words.
A run whose period lies in [B, 2 B) (the first scale takes 1 to 15) is long enough
to hold a whole block and the block's next occurrence one period later.  So every
block is correlated with the words that follow it, and the sum of squared
differences of the word numbers

    sum (x_i - y_{i+d})^2 = sum x^2 + sum y^2 - 2 sum x y

is taken at all distances d of the scale at once, modulo a prime, by a number
theoretic transform.  Its zeros are the block's occurrences without mismatch.
Each distance seeds an extension to both sides on the words themselves, which
also settles a sum that is zero only modulo the prime.  A block one of whose
words does not come again within the scale's distances mismatches everywhere and
is not transformed.

The transform is exact: values stay below a prime of 23 bits, a radix of 64 keeps
the sums of a matrix product below 2**53.  Every document is one row's work; one
pass over the table, no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table
from tessera.llm.hashing import chunks, word_hashes

#: 7 * 2**20 + 1 with primitive root 3: transforms of up to 2**20 values.
PRIME, ROOT = 7340033, 3
RADIX = 64
FIRST = 8
#: Blocks of larger scales are searched by their first words.
LARGEST = 1 << 18
#: Values transformed at a time.
WORK = 1 << 19
LEAST, TIMES = 24, 3


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for whole numbers below 2**52; -1 and PRIME may be left."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        step = pow(base, done, PRIME)
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step % PRIME
        done += take
    return out


@lru_cache(maxsize=64)
def _matrix(n: int) -> np.ndarray:
    """The transform of n <= RADIX values."""
    w = _powers(pow(ROOT, (PRIME - 1) // n, PRIME), n)
    return w[np.outer(np.arange(n), np.arange(n)) % n].astype(float)


@lru_cache(maxsize=16)
def _twiddles(n: int, radix: int) -> np.ndarray:
    w = _powers(pow(ROOT, (PRIME - 1) // n, PRIME), n)
    return w[np.outer(np.arange(radix), np.arange(n // radix)) % n].astype(float)


def transform(x: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row (a power of two of values)."""
    rows, n = x.shape
    if n <= RADIX:
        return _reduced(x @ _matrix(n))
    rest = n // RADIX
    inner = _reduced(np.matmul(_matrix(RADIX), x.reshape(rows, RADIX, rest)))
    inner = _reduced(inner * _twiddles(n, RADIX))
    return transform(inner.reshape(rows * RADIX, rest)).reshape(rows, RADIX, rest).swapaxes(1, 2).reshape(rows, n)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row the sum over t of (block[t] - window[t + d])^2 modulo the prime, for
    d = 0 .. b - 1; blocks are (rows, b), windows (rows, 2 b) of whole numbers below the prime."""
    rows, b = blocks.shape
    n = 2 * b
    spread = np.zeros((rows, n))
    spread[:, :b] = blocks
    back = -np.arange(n) % n
    product = _reduced(transform(spread)[:, back] * transform(windows))
    cross = transform(product)[:, back[:b]]  # n times the correlation
    cross = _reduced(_reduced(cross) * float(pow(n, -1, PRIME) * 2 % PRIME))
    squares = np.zeros((rows, n + 1))
    np.cumsum(_reduced(windows * windows), axis=1, out=squares[:, 1:])
    own = _reduced(blocks * blocks).sum(axis=1, keepdims=True)
    out = _reduced(own + squares[:, b:n] - squares[:, :b] + (PRIME - cross))
    out[out == PRIME] = 0
    out[out == -1] = PRIME - 1
    return out


def _next_gap(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distance to the same word's next place in the same document, else a large number."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n + 1, np.int64)
    here, after = order[:-1], order[1:]
    same = (codes[here] == codes[after]) & (after < ends[here])
    gap[here[same]] = (after - here)[same]
    return gap


def block_seeds(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Scale by scale (block size, block starts, distances): the places where a block
    of a document comes again.  first: where each document starts, one more at the end."""
    sizes = np.diff(first)
    values = (codes % PRIME).astype(float)
    whole = sizes // FIRST
    starts = np.repeat(first[:-1], whole) + FIRST * (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole))
    ends = np.repeat(first[1:], whole)
    number = (starts - np.repeat(first[:-1], whole)) // FIRST
    gap = _next_gap(codes, np.repeat(first[1:], sizes))
    widest = gap[starts[:, None] + np.arange(FIRST)].max(axis=1) if len(starts) else np.zeros(0, np.int64)
    scale = FIRST
    while len(starts):
        block = min(scale, LARGEST)
        live = (widest < 2 * scale) & (starts + block + (scale if scale > FIRST else 1) <= ends)
        s_all, q_all = [], []
        for shift in range(0 if scale == FIRST else scale, 2 * scale, block):
            per = max(1, WORK // (2 * block))
            on = np.flatnonzero(live & (starts + shift + block <= ends))
            for i in range(0, len(on), per):
                s, e = starts[on[i:i + per]], ends[on[i:i + per]]
                at = np.minimum(s[:, None] + shift + np.arange(2 * block), len(values) - 1)
                found = squared_differences(values[s[:, None] + np.arange(block)], values[at]) == 0
                r, d = np.nonzero(found)
                q = d + shift
                fits = (q > 0) & (s[r] + q + block <= e[r])
                s_all.append(s[r][fits])
                q_all.append(q[fits])
        if s_all:
            yield block, np.concatenate(s_all), np.concatenate(q_all)
        # two neighbours make a block of the next scale
        pair = np.flatnonzero((number[:-1] % 2 == 0) & (number[1:] == number[:-1] + 1) & (ends[1:] == ends[:-1]))
        starts, ends, number, widest = starts[pair], ends[pair], number[pair] // 2, np.maximum(widest[pair], widest[pair + 1])
        scale *= 2


def _extended(x: np.ndarray, start: int, stop: int, q: int) -> tuple[int, int]:
    """The widest stretch around [start, stop) of x whose items q apart are equal."""
    step, i = 64, stop
    while i < len(x):
        j = min(len(x), i + step)
        differ = np.flatnonzero(x[i:j] != x[i - q:j - q])
        if len(differ):
            i += int(differ[0])
            break
        i, step = j, step * 2
    step, k = 64, start
    while k > 0:
        j = max(0, k - step)
        differ = np.flatnonzero(x[j:k] != x[j + q:k + q])
        if len(differ):
            k = j + int(differ[-1]) + 1
            break
        k, step = j, step * 2
    return k, i


def _smallest_period(x: np.ndarray, start: int, q: int) -> int:
    """The smallest period of a stretch of period q and at least 2 q items."""
    p, rest, f = q, q, 2
    unit = x[start:start + q]
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            rest //= f
            if np.array_equal(unit[p // f:], unit[:len(unit) - p // f]):
                p //= f
        else:
            f += 1
    return p


def find_runs(x: np.ndarray, seeds: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of x, by start and period, from seeds
    (block size, starts, distances) in order of scale.  A seed inside a stretch
    whose period divides the distance adds nothing and is not extended."""
    known: list[tuple[int, int, int]] = []

    def explained(s, q, block, of):
        a, b, p = of
        return (q % p == 0) & (s >= a) & (s + block + q <= b)

    for block, s, q in seeds:
        for stretch in known:
            left = ~explained(s, q, block, stretch)
            s, q = s[left], q[left]
            if not len(s):
                break
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        while len(s):
            a, d = int(s[0]), int(q[0])
            if np.array_equal(x[a:a + block], x[a + d:a + d + block]):
                lo, hi = _extended(x, a, a + block + d, d)
                stretch = lo, hi, _smallest_period(x, lo, d) if hi - lo >= 2 * d else d
                known.append(stretch)
                left = ~explained(s, q, block, stretch)
                left[0] = False
            else:
                left = np.arange(len(s)) > 0
            s, q = s[left], q[left]
    return sorted({(a, b - a, p) for a, b, p in known if b - a >= max(LEAST, TIMES * p)}, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def periodic_runs(spark: SparkSession, docs: DataFrame,
                  rearranged: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of the words (``[^\\x20\\x09-\\x0D]+``) of every whole text.

    docs: doc_id, text and any other columns.  Returns all of them plus ``periodic``
    struct<n_words long, runs array<struct<start, length, period>>, collapsed
    string>: runs by start, then period; collapsed are the words that no run holds
    after its first period, joined by one space.  ``rearranged(doc_id, n)`` may give
    the word numbers to read a document's n words by (None: as they stand).

    A column of docs named ``periodic`` is replaced.  A null text has no words, no
    runs and an empty collapse, as an empty one; null and repeated doc_ids are
    rows like any other; an empty table gives no rows.  Overlapping runs and runs
    of one stretch with several periods are all reported."""
    rest = [c for c in docs.columns if c != "periodic"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = batch.column(2)
            out = []
            for lo, hi, buf, starts, ends, first in chunks(texts):
                codes = np.unique(word_hashes(buf, starts, ends), return_inverse=True)[1]
                orders = {}
                if rearranged is not None:
                    for d in range(lo, hi):
                        a, b = int(first[d - lo]), int(first[d - lo + 1])
                        order = rearranged(ids[d], b - a)
                        if order is not None:
                            orders[d] = order
                            codes[a:b] = codes[a:b][order]
                seeds: dict[int, list] = {}
                for block, s, q in block_seeds(codes, first):
                    doc = np.searchsorted(first, s, "right") - 1
                    order = np.argsort(doc, kind="stable")
                    s, q, doc = s[order], q[order], doc[order]
                    cut = np.flatnonzero(np.diff(doc, prepend=-1))
                    for i, j in zip(cut, [*cut[1:], len(doc)]):
                        seeds.setdefault(int(doc[i]), []).append((block, s[i:j] - first[doc[i]], q[i:j]))
                for d in range(lo, hi):
                    a, b = int(first[d - lo]), int(first[d - lo + 1])
                    runs = find_runs(codes[a:b], seeds[d - lo]) if d - lo in seeds else []
                    words = texts[d].as_buffer().to_pybytes().split() if texts[d].is_valid else []
                    if d in orders:
                        words = [words[i] for i in orders[d].tolist()]
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(b - a, runs)).tolist()]
                    out.append({"n_words": b - a, "runs": [{"start": r[0], "length": r[1], "period": r[2]} for r in runs],
                                "collapsed": b" ".join(words).decode()})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW)], names=["row", "periodic"])

    inp = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("doc_id").cast("long"), "text")
    schema = T.StructType([inp.schema["row"], T.StructField("periodic", _STRUCT)])
    return inp.mapInArrow(search, schema).select(*[F.col("row")[c].alias(c) for c in rest], "periodic")


_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_STRUCT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType())])


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's reading order: one document in ten repeats a stretch of its words to its end."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), repeated_tail)
    runs = F.col("periodic.runs")
    # exact order of length / period: the whole part, then the rest over the period by cross multiplication
    best = F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda m, r: F.when(m.isNull() | (r["length"].cast("decimal(38,0)") * m["period"] > m["length"].cast("decimal(38,0)") * r["period"]), r)
                       .otherwise(m))
    out = out.select("doc_id", "periodic", best.alias("best"))
    text = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                      F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                      F.sha2(text, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
