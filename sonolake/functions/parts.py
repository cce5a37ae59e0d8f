"""Texts through plain Python functions, a bounded part of a batch at a time, and only those that need it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text of a batch that are Python strings at a time.
BYTES_AT_ONCE = 1 << 20


def in_parts(texts: pa.Array, rule: Callable[[str], str]) -> pa.Array:
    """rule of each text, nulls stay null. The texts become Python strings in parts of BYTES_AT_ONCE or of one text; the rest is Arrow's."""
    upto, lo, out = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)), 0, []
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES_AT_ONCE, "right")))
        out.append(pa.array([None if s is None else rule(s) for s in texts.slice(lo, hi - lo).to_pylist()], pa.string()))
        lo = hi
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def by_parts(rule: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function of the rule that rule() makes in a task."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return in_parts(texts, rule())

    return run


def only_where(needed: Column, rule: Callable[[Column], Column], text: Column, other: Column | None = None) -> Column:
    """rule(text) where needed, else other (the text). A Python function under when() gets all rows: the others go to it as nulls."""
    return F.when(needed, rule(F.when(needed, text))).otherwise(text if other is None else other)
