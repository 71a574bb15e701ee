"""Whole input rows as one struct, so that names of further columns can't clash with those an operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "__row"


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows as a struct, and only the given columns beside it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW), *(v.alias(k) for k, v in own.items()))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The packed columns again, in order; those named in ``new`` replaced by it, or added at the end."""
    kept = [new[c].alias(c) if c in new else F.col(ROW)[c].alias(c) for c in columns]
    return df.select(*kept, *(v.alias(c) for c, v in new.items() if c not in columns))
