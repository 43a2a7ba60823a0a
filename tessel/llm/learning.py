"""Deterministic splits and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, mod 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, id_col: str, columns: list[str], limit: int) -> DataFrame:
    """At most limit labelled ids that may be learned from, picked by hash, with their label columns.

    The limit is what makes the result safe to broadcast.
    """
    usable = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    for c in columns:
        usable = usable.where(F.col(c).isNotNull())
    return usable.select(id_col, *columns).orderBy(F.md5(F.col(id_col).cast("string")), *columns).limit(limit)
