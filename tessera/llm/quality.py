"""Quality classifier with hierarchical empirical Bayes.

A logistic model on counts of the text gives each document's own evidence.
Sites (``site`` column, e.g. a host) and sections of a site (``section``, e.g. a
path or language) add what their other documents and their labels say: a site's
rate is a posterior around the global rate, a section's one around its site's,
with prior strengths estimated from the variance inside groups against the one
between them (method of moments).  Sparse groups shrink to their parents.  A
document's own evidence is left out of its group's rates.  All rates come from grouped sums; one site may hold any share of
the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.hashing import LOWER, chunks, word_hashes

#: Labelled rows (those with the least hash) that the logistic model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Sections whose rates may be sent to all tasks; more are joined by key.
BROADCAST_GROUPS = 20_000
#: Prior strength at most, and where groups do not differ.
STRONGEST = 1e6
#: Prior strength at least: a group is never taken at its word alone.
WEAKEST = 1.0

FEATURES = ("words", "distinct", "repeated", "word_bytes", "symbols", "digits", "capitals", "bars", "shouted", "marked", "line_words")
#: Byte classes: 1 symbols, 2 digits, 3 capitals, 4 bars, 5 line ends.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 1
_CLASS[48:58] = 2
_CLASS[97:123] = 0
_CLASS[65:91] = 3
_CLASS[[39, 44, 46]] = 0  # ' , . are part of prose
_CLASS[124] = 4
_CLASS[10] = 5


def text_features(texts: pa.Array) -> np.ndarray:
    """[documents, FEATURES]; zeros for a text without words."""
    out = []
    for lo, hi, buf, starts, ends, first in chunks(texts):
        n_docs = hi - lo
        words = np.diff(first)
        h = word_hashes(LOWER[buf], starts, ends)
        doc = np.repeat(np.arange(n_docs), words)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])])
        again = np.zeros(len(h), bool)
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        kind = _CLASS[buf]
        at = np.append(starts, len(buf))[first]
        at[0], at[-1] = 0, len(buf)
        owner = np.repeat(np.arange(n_docs), np.diff(at))
        counts = np.bincount(owner.astype(np.int64) * 6 + kind, minlength=6 * n_docs).reshape(n_docs, 6)
        # words of two bytes or more whose first two bytes are capitals; words that end in a symbol
        second = np.minimum(starts + 1, max(len(buf) - 1, 0))
        shouted = (ends - starts > 1) & (kind[starts] == 3) & (kind[second] == 3) if len(starts) else again
        marked = kind[ends - 1] == 1 if len(ends) else again
        per = lambda flag: np.bincount(doc[flag], minlength=n_docs)
        size = np.bincount(doc, ends - starts, minlength=n_docs)
        w, b = np.maximum(words, 1), np.maximum(size, 1)
        out.append(np.column_stack([
            np.log1p(words), distinct / w, per(again) / w, size / w, counts[:, 1] / b, counts[:, 2] / b, counts[:, 3] / b,
            counts[:, 4] / b, per(shouted) / w, per(marked) / w, np.log1p(words / (counts[:, 5] + 1))]) * (words > 0)[:, None])
    return np.vstack(out) if out else np.zeros((0, len(FEATURES)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset of a penalised logistic model (Newton's method on
    scaled columns); without both labels only the offset differs from zero."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _with_features(docs: DataFrame) -> DataFrame:
    """row (struct of all columns), site, section, features."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(0).field("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["row", "features"])

    return packed.mapInArrow(run, schema)


def prior_strength(count: float, squares: float, groups: tuple[float, float, float]) -> float:
    """Strength of a prior for group means, by the method of moments: the variance of
    values inside groups over the variance between them (one-way analysis of
    variance).  count: values; squares: their squared distances from their group's
    mean; groups: number of groups, n-weighted squared distances of group means from
    their prior's mean, sum of squared group sizes."""
    number, spread, sizes = groups
    if number < 2 or count <= number:
        return STRONGEST
    inside = squares / (count - number)
    between = (spread - (number - 1) * inside) / max(count - sizes / count, 1e-9)
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, inside / between))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang",
                  sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality struct<evidence, site_rate, section_rate, score, kept>; a
    column of docs of that name is replaced.

    docs: doc_id, text, the site and section columns and any others; labels:
    doc_id, quality (0, 1 or null: unlabelled).  A null site or section is a group
    of its own.  A text without words has no evidence but its length: its
    features are zero.  Without labels of both kinds the evidence is the same
    for all and every document is kept.  An empty table gives no rows."""
    scratch = Scratch(spark, "quality")
    key = [F.coalesce(F.col("row")[c].cast("string"), F.lit("\0")).alias(n) for c, n in ((site, "site"), (section, "section"))]
    rows = _with_features(docs)
    narrow = scratch.write(rows.select(F.col("row")["doc_id"].cast("long").alias("did"), *key, "features"), "features")
    known = (narrow.join(labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("did"), "quality"), "did")
             .select("quality", "features", F.xxhash64("did").alias("h"), "did").orderBy("h", "did").limit(sample).toArrow())
    x = np.array(known["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = known["quality"].to_numpy().astype(float) if known.num_rows else np.zeros(0)
    w, offset = fit_logistic(x, y)

    def evidence() -> Column:
        z = F.lit(offset)
        for i, v in enumerate(w):
            z = z + F.lit(float(v)) * F.col("features")[i]
        return 1 / (1 + F.exp(-z))

    # What a group says: its labels, and its documents' evidence by how much that tells:
    # evidence at the labels' own rate tells nothing and counts for nothing.
    base = float(y.mean()) if len(y) and y.min() < y.max() else None

    def weight(p: Column) -> Column:
        if base is None:
            return F.lit(1.0)
        return F.greatest(F.lit(0.0), 1 - p * (1 - p) / F.lit(base * (1 - base)))

    labelled = narrow.join(labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("did"), "quality"), "did")
    values = narrow.select("site", "section", evidence().alias("v")).withColumn("w", weight(F.col("v"))).unionByName(
        labelled.select("site", "section", F.col("quality").cast("double").alias("v"), F.lit(1.0).alias("w")))
    sections = scratch.write(values.groupBy("site", "section").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("q")), "sections")
    sites = sections.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"), F.sum("q").alias("site_q"))
    n, s = sections.agg(F.sum("n"), F.sum("s")).first()
    rate = (s / n) if n else 0.5
    rate = min(1 - 1e-6, max(1e-6, rate))

    def strength(of: DataFrame, size: str, total: str, square: str, prior: Column) -> float:
        mean = F.col(total) / F.col(size)
        got = of.where(F.col(size) > 0).agg(F.sum(size), F.sum(F.greatest(F.col(square) - F.col(total) * mean, F.lit(0.0))), F.count("*"),
                     F.sum(F.col(size) * F.pow(mean - prior, 2)), F.sum(F.col(size).cast("double") * F.col(size))).first()
        return prior_strength(got[0] or 0, got[1] or 0.0, (got[2], got[3] or 0.0, got[4] or 0.0))

    strong = strength(sites, "site_n", "site_s", "site_q", F.lit(rate))
    both = sections.join(sites, "site").withColumn("site_rate", (F.col("site_s") + strong * rate) / (F.col("site_n") + strong))
    strong2 = strength(both, "n", "s", "q", F.col("site_rate"))
    rates = scratch.write(both.select("site", "section", "n", "s", "site_n", "site_s"), "rates")
    if rates.count() <= BROADCAST_GROUPS:
        rates = F.broadcast(rates)
    out = rows.select("row", *key, evidence().alias("p")).join(rates, ["site", "section"])
    # without the document's own evidence
    own, told = weight(F.col("p")), weight(F.col("p")) * F.col("p")
    out = out.withColumn("site_rate", (F.col("site_s") - told + strong * rate) / (F.col("site_n") - own + strong))
    out = out.withColumn("section_rate", (F.col("s") - told + strong2 * F.col("site_rate")) / (F.col("n") - own + strong2))
    out = out.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("section_rate")) - _logit(F.lit(rate))))))
    learned = bool(len(y)) and y.min() < y.max()
    kept = (F.col("score") >= threshold) if learned else F.lit(True)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "quality"],
                      F.struct(F.col("p").alias("evidence"), "site_rate", "section_rate", "score", kept.alias("kept")).alias("quality"))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return score_quality(spark, docs, table(spark, sf_dir, "labels")).select("doc_id", "quality.*")
