"""Toxicity with noisy-channel deobfuscation.

1. A character language model (trigrams over a folded alphabet) is counted over
   all documents by distributed sums.
2. A word that may be disguised (signs or digits among letters, letters repeated
   or spaced out) becomes a lattice: each character stands for itself, for the
   letters it imitates, or for nothing (separators, repeats).  A beam Viterbi
   search under the language model and the channel's costs restores it.
3. Labelled documents (a bounded sample) tell which words and word beginnings of
   restored text mark toxic documents; a feature must beat chance over all
   candidates.  A logistic model on a document's strongest features is fitted on
   them as well, and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, keyed_texts, table
from tessera.llm.quality import fit_logistic

#: Labelled documents of each label (those with the least hash) that are learned from.
TOXIC_SAMPLE, CLEAN_SAMPLE = 6_000, 24_000
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
BEAM = 12
BEST = 4
MEMO = 300_000
#: Characters decoded at once, and of them the last ones that are decoded again.
WINDOW, AGAIN = 64, 32

#: Letters of the model; every other character is one class, and 0 is the space.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß0123456789"
_N = len(ALPHABET) + 1
_CODE = np.full(1 << 16, _N - 1, np.int32)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
for _c in "\t\n\x0b\x0c\r":
    _CODE[ord(_c)] = 0
_INDEX = {c: i for i, c in enumerate(ALPHABET)}

#: Signs and digits, and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "×": "x", "#": "h", "%": "o"}
#: Signs that may hide any letter.
HIDDEN = "*_?#%"
_COST = {"self": 0.0, "leet": 1.0, "hidden": 3.5, "drop": 1.5, "repeat": 0.7, "keep": 6.0}


def text_codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(raw, 0xFFFF)]


def language_model(spark: SparkSession, texts: DataFrame) -> np.ndarray:
    """log P(c | a, b) [N, N, N], from the trigrams of every text (column body).
    Each task sends its own counts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N ** 3, np.int64)
        held, size = [], 0

        def add(parts: list[np.ndarray]) -> None:
            if parts:
                c = np.concatenate(parts).astype(np.int64)
                ends = np.cumsum([len(p) for p in parts])[:-1]
                gram = np.delete((c[:-2] * _N + c[1:-1]) * _N + c[2:], np.concatenate([ends - 2, ends - 1]))  # none across texts
                np.add(total, np.bincount(gram, minlength=len(total)), out=total)

        for batch in batches:
            for body in batch.column(0):
                text = body.as_py()
                for i in range(0, len(text), 1_000_000):
                    c = text_codes(f" {text[max(0, i - 2):i + 1_000_000]} ")
                    held.append(c)
                    size += len(c)
                    if size >= 1_000_000:
                        add(held)
                        held, size = [], 0
        add(held)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = (texts.select("body").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .toArrow())  # at most N ** 3 rows
    tri = np.zeros(_N ** 3)
    tri[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    tri = tri.reshape(_N, _N, _N)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _N)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


_repeat = re.compile(r"(.)\1\1", re.S)
_long_repeat = re.compile(r"(.)\1{3,}", re.S)
#: Signs between the parts of a token: all, and those that imitate no letter.
_signs, _joints = re.compile(r"[\W_]+"), re.compile(r"[^\w$@!|+€£(<#%*?¡×]+|_+")
#: Letters that stand alone between signs.
_lone = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){3,}")
_strip = re.compile(r"^[\W_]+|[\W_]+$")
#: One sign at a word's edge that may stand for its first or last letter.
_edges = re.compile(r"[\"'(\[]*([$@!|+€£(<]?)(\w(?:.*\w)?)([$@+]?)[.,;:!?\"')\]]*", re.S)


def disguised(word: str) -> bool:
    """Whether a lower-case word holds both letters and signs or digits inside,
    or a character three times in a row."""
    if word.isalpha():
        return _repeat.search(word) is not None
    return any(map(str.isalpha, word))


def restore(word: str, lm: np.ndarray, beam: int = BEAM, best: int = BEST) -> list[str]:
    """The likeliest readings of a disguised lower-case word of WINDOW characters
    at most; windows() cuts longer ones."""
    states = {"": 0.0}
    prev = ""
    for c in word[:WINDOW]:
        options = []
        if c in _INDEX and c != " ":
            options.append((c, _COST["self"] if not c.isdigit() else _COST["keep"]))
        options += [(x, _COST["leet"]) for x in LEET.get(c, "")]
        if c in HIDDEN:
            options += [(x, _COST["hidden"]) for x in "abcdefghijklmnopqrstuvwxyz"]
        if not c.isalnum():
            options.append(("", _COST["drop"]))
        elif c == prev:
            options.append(("", _COST["repeat"]))
        if not options:
            options.append(("", _COST["keep"]))
        new: dict[str, float] = {}
        for text, score in states.items():
            a = _INDEX[text[-2]] if len(text) > 1 else 0
            b = _INDEX[text[-1]] if text else 0
            for x, cost in options:
                s = score - cost + (lm[a, b, _INDEX[x]] if x else 0.0)
                t = text + x
                if s > new.get(t, -math.inf):
                    new[t] = s
        # by score for each character read so that dropping is not favoured
        states = dict(sorted(new.items(), key=lambda kv: -(kv[1] + 2.5 * len(kv[0])))[:beam])
        prev = c
    ends = sorted(states.items(), key=lambda kv: -(kv[1] + 2.5 * len(kv[0])))
    return [t for t, _ in ends[:best] if t]


def windows(word: str) -> list[str]:
    """A word in overlapping parts of WINDOW characters at most.  In a longer word
    a character repeated in a row counts three times, which reads the same."""
    if len(word) <= WINDOW:
        return [word]
    word = _long_repeat.sub(r"\1\1\1", word)
    return [word[i:i + WINDOW] for i in range(0, max(1, len(word) - AGAIN), WINDOW - AGAIN)]


def features_of(word: str) -> list[str]:
    """The whole word and its beginnings."""
    return [word + " "] + [word[:k] for k in PREFIXES if len(word) >= k]


class WordReader:
    """What each distinct token says: its features, by way of restoring."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.memo = lm, {}

    def readings(self, raw: str) -> list[str]:
        """The words that a token may stand for."""
        low = raw.lower()
        word = low if low.isalpha() else _strip.sub("", low)
        out = [word] if len(word) > 1 else []
        if len(word) > 1 and disguised(word):
            out += [r for w in windows(word) for r in restore(w, self.lm)]
        if word is not low and (m := _edges.fullmatch(low)) and m[1] + m[3]:
            out += [r for w in windows(m[1] + m[2] + m[3]) for r in restore(w, self.lm)]
        if not word.isalpha():  # the words between signs
            for part in dict.fromkeys([*_joints.split(word), *_signs.split(word)]):
                if len(part) > 1 and part != word:
                    out.append(part)
                    if disguised(part):
                        out += [r for w in windows(part) for r in restore(w, self.lm)]
        return out

    def inner(self, raw: str) -> Iterator[list[str]]:
        """The beginnings of what a token spells from each letter on: of letters
        that stand alone between signs, and of windows of a long token."""
        word = _strip.sub("", raw.lower())
        parts = [w for run in _lone.finditer(word) for w in windows(run[0])] if not word.isalpha() else []
        if len(word) > WINDOW:
            parts += windows(word)
        for part in dict.fromkeys(parts):
            for reading in (restore(part, self.lm, best=2) if disguised(part) else [part]):
                for j in range(len(reading) - 3):
                    yield features_of(reading[j:j + 24])[1:]

    def token(self, raw: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys([f for word in self.readings(raw) for f in features_of(word)] + [f for fs in self.inner(raw) for f in fs]))

    def spaced(self, tokens: list[str]) -> Iterator[tuple[str, ...]]:
        """Readings of letters that stand alone, four or more in a row: the
        beginnings of what they spell from each letter on."""
        run: list[str] = []
        for t in [*tokens, "...."]:
            if len(t) == 1 or len(t) == 2 and not t.isalnum():
                run.append((_strip.sub("", t.lower()) or t)[0])
                continue
            if len(run) >= 4:
                text = "".join(run)
                for i in range(0, len(text), 48):
                    part = text[max(0, i - 16):i + 48]
                    for reading in (restore(part, self.lm, best=2) if disguised(part) else [part]):
                        for j in range(len(reading) - 3):
                            yield tuple(features_of(reading[j:j + 24])[1:])
            run = []


def _single_runs(tokens: list[str]) -> bool:
    n = 0
    for t in tokens:
        n = n + 1 if len(t) == 1 or len(t) == 2 and not t.isalnum() else 0
        if n >= 4:
            return True
    return False


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: str = "true", toxic_sample: int = TOXIC_SAMPLE,
             clean_sample: int = CLEAN_SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document; labels are learned where ``learn`` (SQL on doc_id) holds.

    docs: doc_id, text (other columns are never read); labels: doc_id, toxic (0,
    1 or null: unlabelled).  Returns doc_id, score (0 to 1), predicted (1 if
    score >= threshold), evidence array<string> (the strongest features).  Null
    and empty texts get the score of a text without evidence.  Without labels of
    both kinds all get one score.  Repeated rows are scored alike.  An empty
    table gives no rows."""
    scratch = Scratch(spark, "toxicity")
    texts = keyed_texts(docs).select("did", "body")
    lm = spark.sparkContext.broadcast(language_model(spark, texts))
    known = (labels.where(f"toxic is not null and doc_id is not null and ({learn})")
             .groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.xxhash64("did")))
    chosen = (known.where("toxic = 1").orderBy("h", "did").limit(toxic_sample)
              .unionByName(known.where("toxic = 0").orderBy("h", "did").limit(clean_sample)).select("did", "toxic"))
    train = scratch.write(texts.join(chosen, "did").select("toxic", "body"), "train")
    n_toxic, n_all = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n_all - n_toxic
    base = (n_toxic + 1) / (n_all + 2)

    def reader() -> WordReader:
        return WordReader(lm.value)

    def doc_features(read: WordReader, text: str) -> set[str]:
        tokens = text.split()
        out: set[str] = set()
        for t in set(tokens):
            got = read.memo.get(t)
            if got is None:
                if len(read.memo) >= MEMO // 4:
                    read.memo.clear()
                got = read.memo[t] = read.token(t)
            out.update(got)
        if _single_runs(tokens):
            for got in read.spaced(tokens):
                out.update(got)
        return out

    def counted(wanted=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = reader()
            for batch in batches:
                n: dict[str, int] = {}
                for body in batch.column(0):
                    got = doc_features(read, body.as_py())
                    for f in got if wanted is None else got & wanted.value:
                        n[f] = n.get(f, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["f", "n"])
        return run

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(feature, the token before its first place) of each document."""
        read = reader()
        for batch in batches:
            pairs: dict[tuple[str, str], None] = {}
            for body in batch.column(0):
                seen: set[str] = set()
                before = ""
                for t in body.as_py().split():
                    got = read.memo.get(t)
                    if got is None:
                        if len(read.memo) >= MEMO // 4:
                            read.memo.clear()
                        got = read.memo[t] = tuple(f for f in read.token(t) if f in marked.value)
                    for f in got:
                        if f not in seen:
                            seen.add(f)
                            pairs[f, before] = None
                    before = t
            f, before = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(before, pa.string())], names=["f", "before"])

    weights: dict[str, float] = {}
    if n_toxic and n_clean:
        tox = (train.where("toxic = 1").select("body").mapInArrow(counted(), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
               .where("n >= 3").toArrow())  # bounded by the sample
        tox = dict(zip(tox["f"].to_pylist(), tox["n"].to_pylist()))
        wanted = spark.sparkContext.broadcast(frozenset(tox))
        clean = (train.where("toxic = 0").select("body").mapInArrow(counted(wanted), "f string, n long")
                 .groupBy("f").agg(F.sum("n").alias("n")).toArrow())
        clean = dict(zip(clean["f"].to_pylist(), clean["n"].to_pylist()))
        chance = math.log(max(2, len(tox))) + 0.5

        def gain(t: int, c: int) -> float:
            """How far t toxic of t + c documents are from chance (log-likelihood)."""
            r = t / (t + c)
            return 0.0 if r <= base else t * math.log(r / base) + (c * math.log((1 - r) / (1 - base)) if c else 0.0)

        # copies repeat a word in one context, so contexts are what must beat chance
        marked = spark.sparkContext.broadcast(frozenset(f for f, t in tox.items() if gain(t, clean.get(f, 0)) >= chance))
        places = (train.where("toxic = 1").select("body").mapInArrow(contexts, "f string, before string")
                  .groupBy("f").agg(F.count_distinct("before").alias("n")).toArrow())
        for f, places_of in zip(places["f"].to_pylist(), places["n"].to_pylist()):
            t, c = tox[f], clean.get(f, 0)
            if gain(min(t, places_of), c) >= chance:
                weights[f] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        weights = {f: w for f, w in weights.items() if w > 1}
    lexicon = spark.sparkContext.broadcast((weights, frozenset(f[:4] for f in weights)))

    def evidence(read: WordReader, text: str) -> list[tuple[float, str]]:
        """The strongest feature of each word, strongest words first."""
        tokens = text.split()
        out: dict[str, float] = {}
        memo, (lex, heads) = read.memo, lexicon.value
        for t in set(tokens):
            got = memo.get(t)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                hits = [(lex[f], f) for word in read.readings(t) if (word + " ")[:4] in heads for f in features_of(word) if f in lex]
                hits += [(lex[f], f) for fs in read.inner(t) for f in fs if f in lex]
                got = memo[t] = max(hits) if hits else ()
            if got:
                out[got[1]] = got[0]
        if _single_runs(tokens):
            for fs in read.spaced(tokens):
                hits = [(lex[f], f) for f in fs if f in lex]
                if hits:
                    w, f = max(hits)
                    out[f] = w
        return sorted(((w, f) for f, w in out.items()), reverse=True)[:3]

    def shape(top: list[tuple[float, str]], n_words: int) -> list[float]:
        w = [x for x, _ in top] + [0.0] * 3
        return [w[0], w[1], w[2], math.log1p(n_words) if w[0] else 0.0]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            rows, why = [], []
            for body in batch.column(1):
                text = body.as_py()
                top = evidence(read, text)
                rows.append(shape(top, len(text.split()) if top else 0))
                why.append([f for _, f in top])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), pa.array(why, pa.list_(pa.string()))], names=["did", "x", "why"])

    fit = train.select(F.col("toxic").cast("long"), "body").mapInArrow(judge, "did long, x array<double>, why array<string>").select("did", "x").toArrow()
    x = np.array(fit["x"].to_pylist(), float).reshape(-1, 4)
    w, offset = fit_logistic(x, fit["did"].to_numpy().astype(float) if fit.num_rows else np.zeros(0), penalty=0.1)
    z = F.lit(offset)
    for i, v in enumerate(w):
        z = z + F.lit(float(v)) * F.col("x")[i]
    return (texts.mapInArrow(judge, "did long, x array<double>, why array<string>")
            .select(F.col("did").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"), F.col("why").alias("evidence"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


HELD_OUT = "crc32(encode(cast(doc_id as string), 'utf-8')) % 4 = 2"


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"),
                   learn=f"not ({HELD_OUT})")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")
