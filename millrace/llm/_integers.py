"""Vectors as exact integers: which rows can be used, and their components as 32-bit numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import prepare


def largest(dims: int) -> int:
    """The largest component of which `dims` still have inner products and squared distances that fit a long."""
    return int(2**30 / max(1, dims) ** 0.5)


def _floors(column: pa.Array, factor: float) -> tuple[np.ndarray, list[bytes]]:
    """Which rows of a list column are usable, and those rows' floor(factor * x) as packed 32-bit integers."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    missing = values.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        x = np.floor(np.nan_to_num(values.fill_null(np.nan).to_numpy(zero_copy_only=False) * factor, nan=np.inf))
    row = np.repeat(np.arange(len(column)), lengths)
    limit = np.array([largest(n) for n in np.unique(lengths)])[np.searchsorted(np.unique(lengths), lengths)] if len(lengths) else lengths
    ok = lengths > 0
    ok[row[missing | ~np.isfinite(x) | (np.abs(x) > limit[row])]] = False
    ends = np.cumsum(lengths)
    whole = np.where(ok[row], x, 0).astype(np.int32)
    return ok, [whole[e - n : e].tobytes() for e, n in zip(ends[ok], lengths[ok], strict=True)]


def integer_vectors(vectors: DataFrame, factor: float, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the usable rows, vector being floor(factor * x) of each component x, 32 bits each.

    Left out are rows whose vector is null or empty, or has null, non-finite or too large components (see largest()).
    """
    prepare(vectors.sparkSession)

    def look(batches):
        for batch in batches:
            ok, packed = _floors(batch.column("v"), factor)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])

    slim = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = slim.schema["label"].dataType.simpleString()
    return slim.mapInArrow(look, f"vec_id long, label {kind}, vector binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors of `dims` components as rows of 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
