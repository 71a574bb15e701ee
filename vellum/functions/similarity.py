"""Sequence similarity as Arrow-batched functions: the standard library's matcher, or what it finds (``blocks``).

No SQL function computes it: edit distance differs, and the ratio depends on
the order of its arguments and, from 200 characters on, on the matcher's rule
for frequent characters.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .blocks import matched


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts, 0 to 1; null counts as empty."""
    # the matcher finds equal texts whole, whatever characters are frequent
    return pd.Series([1.0 if (x or "") == (y or "") else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def containment(fragment: pd.Series, text: pd.Series) -> pd.Series:
    """Part of a fragment that lies in matching blocks of a text; 1 for an empty fragment."""

    def one(x: str | None, y: str | None) -> float:
        if not x or x in (y or ""):
            return 1.0
        return matched(x, y or "") / len(x)

    return pd.Series([one(x, y) for x, y in zip(fragment, text, strict=True)])
