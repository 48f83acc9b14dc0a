"""Small column helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Inside higher-order functions Catalyst would otherwise inline a computed
    value at every use (once per array element); a lambda variable is bound
    once per row.
    """
    return F.get(F.transform(F.array(value), body), 0)


def stay(udf):
    """``udf``, evaluated where it is written.

    The optimizer copies a deterministic function into filters and other
    functions' arguments; mixed there with nested lambdas, Spark doesn't
    evaluate it ("Cannot evaluate expression"). One that is called
    non-deterministic isn't copied.
    """
    return udf.asNondeterministic()


def aligned(*lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(rows with all arrays, row of each point, the points' values by list) of list columns; a shorter array counts as ending in NULLs."""
    there = np.logical_and.reduce([np.asarray(x.is_valid()) for x in lists])
    sizes = [np.where(there, pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), 0) for x in lists]
    most = np.maximum.reduce(sizes)
    if not (there.all() and all((s == most).all() for s in sizes)):
        lists = [pa.array([x[:n] + [None] * (n - len(x)) if ok else None for x, ok, n in zip(c.to_pylist(), there, most.tolist())], c.type) for c in lists]
    return there, np.repeat(np.arange(len(there)), most), [x.flatten() for x in lists]


def doubles(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as floats, 0 where NULL, and where they are NULL (a NaN is a value)."""
    return pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), np.asarray(values.is_null())


def of_band(bands: pa.Array, band) -> np.ndarray:
    """Points of one band."""
    return np.asarray(pc.fill_null(pc.equal(bands, pa.scalar(band).cast(bands.type)), False))


def nullable(values: np.ndarray, null: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A column with NULL where ``null``; NaN stays NaN."""
    return pa.array(values, kind or pa.float64(), mask=np.broadcast_to(null, values.shape).copy(), from_pandas=False)
