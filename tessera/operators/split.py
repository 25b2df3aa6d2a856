"""Train/test split and cross-validation folds (M1-M3), keyed by a row id.

Assignments are functions of (key, seed), so they do not depend on
partitioning or row order and survive recomputation.  ``one_out`` means
train = test = all rows.  Without a key column, the row's own values are
hashed (``xxhash64``), still deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import (LEVEL_EN, LEVEL_INNER, LEVEL_OUTER, fold, is_test,
                                 key_digest, repeat_digest)


def row_key(df: DataFrame, key: str | None) -> Column:
    if key and key in df.columns:
        return F.col(key)
    return F.xxhash64(*[F.col(c) for c in df.columns])


def with_split(df: DataFrame, key: str | None = "id", test_split: float = 0.2, seed: int = 42,
               one_out: bool = False, col: str = "split") -> DataFrame:
    """Adds ``split`` = 'train' | 'test' (M1; ``one_out``: M2, all 'train')."""
    if one_out:
        return df.withColumn(col, F.lit("train"))
    dig = key_digest(row_key(df, key), seed)
    return df.withColumn(col, F.when(is_test(dig, test_split), "test").otherwise("train"))


def both_splits(df: DataFrame, key: str | None = "id", test_split: float = 0.2, seed: int = 42,
                one_out: bool = False, col: str = "split") -> DataFrame:
    """Train and test as one frame: under ``one_out`` (M2) every row is in both,
    otherwise as :func:`with_split`."""
    if not one_out:
        return with_split(df, key, test_split, seed, False, col)
    return df.withColumn(col, F.explode(F.array(F.lit("train"), F.lit("test"))))


def with_folds(df: DataFrame, key: str | None = "id", seed: int = 42, k: int = 5,
               levels=("outer", "inner", "en")) -> DataFrame:
    """Adds ``outer_fold``, ``inner_fold``, ``en_fold`` in [0, k) (M3)."""
    dig = key_digest(row_key(df, key), seed)
    level_of = {"outer": LEVEL_OUTER, "inner": LEVEL_INNER, "en": LEVEL_EN}
    for name in levels:
        df = df.withColumn(f"{name}_fold", fold(dig, level_of[name], k))
    return df


def with_repeated_folds(df: DataFrame, key: str | None = "id", seed: int = 42, k: int = 5, repeats: int = 1,
                        level: int = LEVEL_OUTER, col: str = "folds") -> DataFrame:
    """Adds an array with the row's fold in [0, k) of every repeat (M3); the first
    repeat has the folds of :func:`with_folds`."""
    dig = key_digest(row_key(df, key), seed)
    return df.withColumn(col, F.array(*[fold(repeat_digest(dig, r), level, k) for r in range(repeats)]))
