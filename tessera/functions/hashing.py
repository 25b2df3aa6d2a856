"""Deterministic, partitioning-independent row buckets.

``randomSplit`` and row order depend on partitioning, so splits and folds are
functions of a row key instead: md5 of ``"<key>:<seed>"`` gives four
independent 32-bit words (hex digits 1-8, 9-16, 17-24, 25-32), one per level
(test split, outer fold, inner fold, elastic-net fold).  DuckDB computes the
same md5, so oracles can reproduce every assignment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL_TEST, LEVEL_OUTER, LEVEL_INNER, LEVEL_EN = 0, 1, 2, 3
WORD = 4294967296  # 2**32


def key_digest(key: Column, seed: int) -> Column:
    """A null key hashes as the fixed text ``null``, so its row has a place too."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))


def repeat_digest(digest: Column, repeat: int) -> Column:
    """Digest of a further repeat of the folds (the first repeat is 0)."""
    return digest if repeat == 0 else F.md5(F.concat(digest, F.lit(f":{repeat}")))


def word(digest: Column, level: int) -> Column:
    """32-bit word ``level`` (0..3) of an md5 hex digest, as bigint."""
    return F.conv(F.substring(digest, 1 + 8 * level, 8), 16, 10).cast("bigint")


def is_test(digest: Column, test_split: float) -> Column:
    return word(digest, LEVEL_TEST) < F.lit(int(test_split * WORD))


def fold(digest: Column, level: int, k: int) -> Column:
    return F.pmod(word(digest, level), F.lit(k)).cast("int")


# SQL text of the same assignments, for DuckDB oracles.

def digest_sql(key: str, seed: int) -> str:
    return f"md5(cast({key} as varchar) || ':{seed}')"


def repeat_digest_sql(digest: str, repeat: int) -> str:
    return digest if repeat == 0 else f"md5({digest} || ':{repeat}')"


def word_sql(digest: str, level: int) -> str:
    return f"cast(('0x' || substr({digest}, {1 + 8 * level}, 8)) as bigint)"


def is_test_sql(digest: str, test_split: float) -> str:
    return f"({word_sql(digest, LEVEL_TEST)} < {int(test_split * WORD)})"


def fold_sql(digest: str, level: int, k: int) -> str:
    return f"cast({word_sql(digest, level)} % {k} as integer)"
