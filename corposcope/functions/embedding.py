"""Vectors of texts without a model: signed counts of hashed words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corposcope.functions import text as X


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """``dimensions`` (up to 2048) signed counts of the words of a text; place and sign of a word come from its MD5 digest, so every run and engine agrees."""
    codes = F.transform(X.index_tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 3), 16, 10).cast("int"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def counted(every: pd.Series) -> pd.Series:
        def one(c: np.ndarray) -> np.ndarray:
            c = np.asarray(c, np.int64)
            return np.bincount(c % dimensions, weights=np.where(c // dimensions % 2 == 0, 1.0, -1.0), minlength=dimensions)

        return pd.Series([one(c) for c in every], dtype=object)

    return counted(codes)
