"""What the operators on vectors share: which rows take part, and their components as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str = "embedding") -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    held = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(held, F.lit(False))


def first_rows(table: DataFrame, n: int, dim: int | None = None) -> list[np.ndarray]:
    """The vectors of the ``n`` least ``vec_id`` whose vectors are sound (null ids last, repeated ids
    by their vectors), of ``dim`` components if given. ``n`` is a parameter, so the driver gets few rows."""
    rows = table.filter(sound() & (F.size("embedding") > 0 if dim is None else F.size("embedding") == dim))
    taken = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(n).collect()
    return [np.array(r["embedding"], np.float64) for r in taken]


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sound vectors of ``dim`` components in ``column``, and their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    found = flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)  # nulls are NaN here
    good = np.isfinite(found).all(axis=1)
    return at[good], found[good]
