"""Training frames and input contracts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q

DEFAULT_RESPONSE = "Response"
DEFAULT_ID = "ID"


def parse_attribute_text(text: str | None) -> list[str] | None:
    """P3 on the driver: a list stored as Python-repr text (single quotes)."""
    if text is None or text == "":
        return None
    value = json.loads(text.replace("'", '"'))
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"attributes must be a list of names, got {text!r}")
    return value


def parse_attribute_column(col: Column) -> Column:
    """P3 on a table column: quote swap, then JSON array of strings."""
    return F.from_json(F.translate(col, "'", '"'), "array<string>")


def training_frame(df: DataFrame, response: str | None = None, attributes=None,
                   id_col: str | None = DEFAULT_ID, require_id: bool = False,
                   label: str = "label") -> DataFrame:
    """(label, *features).

    The id column is never a feature (the reference dropped it for training
    but not for prediction; here the same stored feature list serves both).
    ``attributes`` may be a list or the stored repr text; default: every
    column except response and id.
    """
    response = response or DEFAULT_RESPONSE
    if require_id and id_col not in df.columns:
        raise KeyError(f"id column {id_col!r} not found")
    if response not in df.columns:
        raise KeyError(f"response column {response!r} not found")
    if isinstance(attributes, str):
        attributes = parse_attribute_text(attributes)
    if attributes:
        missing = [a for a in attributes if a not in df.columns]
        if missing:
            raise KeyError(f"attributes not found: {missing}")
        feats = list(attributes)
    else:
        feats = [c for c in df.columns if c not in (response, id_col)]
    return df.select(q(response).cast("double").alias(label), *[q(c) for c in feats])


# Fixed value: the start of the message for missing parameters.
MISSING_PREFIX = "The following required parameters were not found: "


def missing_inputs(required: list[str], actual) -> str:
    """P9 on the driver: '' when complete, else the message listing gaps."""
    missing = [r for r in required if r not in actual]
    return MISSING_PREFIX + ",".join(missing) if missing else ""


def missing_inputs_column(required: list[str], keys: Column) -> Column:
    """P9 per row: message for the required names absent from ``keys``."""
    gaps = F.array_except(F.array(*[F.lit(r) for r in required]), keys)
    return F.when(F.size(gaps) > 0, F.concat(F.lit(MISSING_PREFIX), F.array_join(gaps, ",")))
