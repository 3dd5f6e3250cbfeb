"""Counts of letters in whole texts, one pass over the bytes of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


@arrow_udf(T.ArrayType(T.DoubleType()))
def letter_shares(text: pa.Array) -> pa.Array:
    """The share of each of a-z in the code points of a text; zeros for an empty text or null."""
    out = np.zeros((len(text), 26))
    for i, t in enumerate(text.cast(pa.large_binary())):
        raw = t.as_buffer()
        if raw:
            n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            # Each code point has one byte that doesn't continue another.
            out[i] = n[97:123] / max(n.sum() - n[128:192].sum(), 1)
    return pa.ListArray.from_arrays(np.arange(0, 26 * len(text) + 1, 26, dtype=np.int32), out.ravel())
