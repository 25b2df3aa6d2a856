"""Hierarchical multi-length packing.

A document's tokens are cut into full windows and one rest.  Rests are routed to
context-size tiers (512, 1024, 2048, 4096 tokens) and each tier is packed into
windows of its own size.  Longest pieces go first: a piece takes the open window
that it leaves the least gap in, of its own or a longer tier, so gaps of longer
windows are filled from shorter tiers, and opens a window of its own tier only
where none has room.  A window that ends up full is a sequence of its tier's
length.  The others are put together, again the longest first and where the
least gap is left, into sequences of the longest tier, which are the only ones
with padding.  Sequences of a tier are dealt to step groups so that groups cost
about the same.

Tokens are counted and checked where the text is read; what is shuffled is a
narrow row per piece.  Pieces are dealt to bins of about ``bin_pieces`` by a
hash of their number, and each bin is packed by itself, so copies, long
documents or one source never gather in one task, and the padding lost to the
split is a window or two a bin.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BIN_PIECES = 20_000
STEP = 32
#: Words whose ids a worker remembers; it forgets all of them beyond that.
MEMO = 1_000_000

#: A word that ends in ASCII signs other than the apostrophe.
_ending = re.compile(rb"(.*[a-z])([!-&(-/:-@\[-`{-~]+)", re.S)

#: Words of Latin letters are one piece for the tokenizer's split, and what it
#: does before merging is to lower them and to write their bytes as characters.
_letters = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class WordTokenizer:
    """Ids of whole texts for a tokenizer that drops white space and never
    joins across it: each word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode_batch, tokenizer.model.tokenize
        self.memo: dict[bytes, bytes] = {}

    def _know(self, words: set[bytes]) -> None:
        """Has the memo hold these words.  Signs after a-z are a token run of their
        own, so word and signs are encoded apart, which keeps the words to encode
        few."""
        new = words.difference(self.memo)
        if len(self.memo) + 2 * len(new) > MEMO:
            self.memo.clear()
            new = words
        words = new
        split = {w: m.groups() for w in words if b"<|" not in w and (m := _ending.fullmatch(w))}
        memo, rest = self.memo, []
        for w in {p for w in words for p in split.get(w, (w,))}:
            if w not in memo:
                text = w.decode()
                if _letters.fullmatch(text):
                    form = text.lower().encode().decode("latin-1").translate(_BYTES)
                    memo[w] = array("I", [t.id for t in self.merge(form)]).tobytes()
                else:
                    rest.append(w)
        for i in range(0, len(rest), 8192):
            part = rest[i:i + 8192]
            for w, e in zip(part, self.encode([w.decode() for w in part], add_special_tokens=False)):
                memo[w] = array("I", e.ids).tobytes()
        for w, (a, b) in split.items():
            self.memo[w] = self.memo[a] + self.memo[b]

    def __call__(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """Little-endian 32-bit ids of each text, in parts.  A-Z are lowered first,
        as the tokenizer does, unless the word may hold a special token."""
        for lo, hi in _batches(texts):
            words = [[w if b"<|" in w else w.lower() for w in t.split()] if b"<|" in t else t.lower().split() for t in texts[lo:hi]]
            if len(words) > 1 or len(words[0]) <= MEMO // 4:
                self._know(set().union(*words))
            for ws in words:
                out = []
                for i in range(0, len(ws), MEMO // 4):
                    part = ws[i:i + MEMO // 4]
                    if len(ws) > MEMO // 4:
                        self._know(set(part))
                    out.append(b"".join(map(self.memo.__getitem__, part)))
                yield out


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 256 kB, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > 1 << 18:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_tokenizers: dict[str, WordTokenizer] = {}


def token_ids(path: str, texts: list[bytes]) -> Iterator[bytes]:
    """Ids of each text followed by END_ID, as little-endian 32-bit integers."""
    tok = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
    for parts in tok(texts):
        yield b"".join((*parts, END_ID.to_bytes(4, "little")))


class _Gaps:
    """Open windows by gap; the one with the least gap that has room comes first."""

    def __init__(self, most: int):
        self.by_gap: list[list[int]] = [[] for _ in range(most + 1)]
        self.mask = 0  # bit g: some open window has a gap of g

    def take(self, size: int) -> tuple[int, int] | None:
        """(window, its gap) of the tightest fit, taken out; None without one."""
        fit = self.mask >> size
        if not fit:
            return None
        gap = size + (fit & -fit).bit_length() - 1
        w = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.mask &= ~(1 << gap)
        return w, gap

    def put(self, w: int, gap: int) -> None:
        if gap:
            self.by_gap[gap].append(w)
            self.mask |= 1 << gap


def tier_windows(lengths: np.ndarray, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset) of each length, and (size, tokens) of each window.  Windows
    have the size of the tier of their first, longest length."""
    sizes = np.array(tiers)[np.searchsorted(np.array(tiers), lengths)]
    at, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps, window = _Gaps(tiers[-1]), []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        got = gaps.take(size)
        if got is None:
            got = len(window), int(sizes[i])
            window.append(got[1])
        w, gap = got
        at[i], off[i] = w, window[w] - gap
        gaps.put(w, gap - size)
    window = np.array(window, np.int64)
    return at, off, window, np.bincount(at, weights=lengths, minlength=len(window)).astype(np.int64)


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset for each length (1 to window), and the padded length of
    each sequence: its tier's where it is full, else the window.  The window is a
    tier whether or not it is given as one."""
    lengths = np.asarray(lengths, np.int64)
    tiers = tuple(sorted({t for t in tiers if 0 < t < window} | {window}))
    at, off, size, used = tier_windows(lengths, tiers)
    seq, shift = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
    padded: list[int] = []
    gaps = _Gaps(window)
    alone = (used == size) | (size == window)
    for w in np.flatnonzero(alone):
        seq[w] = len(padded)
        padded.append(int(size[w]))
        gaps.put(int(seq[w]), int(size[w] - used[w]))
    rest = np.flatnonzero(~alone)
    for w in rest[np.argsort(-used[rest], kind="stable")]:
        got = gaps.take(int(used[w]))
        if got is None:
            got = len(padded), window
            padded.append(window)
        s, gap = got
        seq[w], shift[w] = s, window - gap
        gaps.put(s, gap - int(used[w]))
    return seq[at], off + shift[at], np.array(padded, np.int64)


def step_groups(cost: np.ndarray, size: int) -> np.ndarray:
    """Deals sequences to groups of about ``size`` in snake order of their cost."""
    groups = max(1, -(-len(cost) // size))
    rank = np.empty(len(cost), np.int64)
    rank[np.argsort(-cost, kind="stable")] = np.arange(len(cost))
    lap, place = np.divmod(rank, groups)
    return np.where(lap % 2, groups - 1 - place, place)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW,
                   tiers: tuple[int, ...] = TIERS, bin_pieces: int = BIN_PIECES, step: int = STEP,
                   with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens.

    docs: doc_id, text (other columns are ignored).  One row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the length its
    sequence is padded to), step_group, of sequences of one tier (and ids as
    little-endian 32-bit bytes, if asked for).  A null or empty text
    is the end token alone.  Repeated rows are documents of their own; a null id
    stays null.  An empty table gives no rows."""
    scratch = Scratch(spark, "packing")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            for did, ids in zip(batch.column(0).to_pylist(), token_ids(tokenizer, texts)):
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s:4 * (s + window)]
                    out.append((did, s, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.binary())],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    cut = scratch.write(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
        .mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
        .withColumn("piece", F.monotonically_increasing_id()), "pieces")
    bins = max(1, -(-cut.count() // bin_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        lengths = t["length"].to_numpy()
        seq, off, padded = pack_lengths(lengths, window, tiers)
        base = key[0].as_py() << 32
        cost = np.bincount(seq, weights=lengths.astype(float) ** 2)
        group, begun = np.empty(len(padded), np.int64), 0
        for tier in np.unique(padded):
            own = np.flatnonzero(padded == tier)
            group[own] = begun + step_groups(cost[own], step)
            begun = int(group[own].max()) + 1
        cols = {c: t[c] for c in names if c in t.column_names} | {
            "sequence_id": pa.array(base + seq), "offset": pa.array(off), "tier": pa.array(padded[seq]), "step_group": pa.array(base + group[seq])}
        return pa.table({c: cols[c] for c in names})

    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    return (cut.withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(bins)))
            .drop(*[] if with_ids else ["ids"]).groupBy("bin").applyInArrow(pack, schema))


def padding_by_tier(packed: DataFrame) -> DataFrame:
    """(tier, sequences, tokens, padding) of packed pieces."""
    per = packed.groupBy("sequence_id").agg(F.max("tier").alias("tier"), F.sum("length").alias("tokens"))
    return per.groupBy("tier").agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"),
                                   F.sum(F.col("tier") - F.col("tokens")).alias("padding"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())
