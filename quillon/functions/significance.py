"""p-values that Spark has no function for, as Arrow-batched UDFs over aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > x)."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if pd.notna(v) and v >= 0 else None).astype("float64")


@F.pandas_udf(DoubleType())
def sign_test(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial p of the smaller of two counts against one half."""

    def one(x, y):
        n = int(x + y)
        if not n:
            return 1.0
        k = np.arange(int(min(x, y)) + 1)
        lg = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k]) - n * math.log(2)
        return min(1.0, 2 * float(np.exp(lg).sum()))

    return pd.Series([one(x, y) if pd.notna(x) and pd.notna(y) else None for x, y in zip(b, c, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype("float64")


@F.pandas_udf(StringType())
def english_text(value: pd.Series) -> pd.Series:
    """The English text of a list literal of {lang, value} entries; the first 500 characters of anything else."""
    import ast

    def one(v):
        if v is None:
            return None
        try:
            items = ast.literal_eval(v)
            return next((i.get("value") for i in items if i.get("lang") == "en"), v[:500])
        except (ValueError, SyntaxError, AttributeError, TypeError, MemoryError, RecursionError):
            return v[:500]

    return value.map(one)
