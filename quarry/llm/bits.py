"""Bit tables of 64-bit numbers: sets of a fixed size that may hold more than was put in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import mix

_U = np.uint64


def bit_of(x: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each number; bits is a power of two."""
    return (mix(x) & _U(bits - 1)).astype(np.int64)


def holds(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    bit = bit_of(x, len(table) * 64)
    return (table[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) == 1


def _rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(bit_of(batch.column(0).to_numpy().view(_U), bits))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((_U(1) << (bit & 63).astype(_U)).view(np.int64))], ["at", "mask"])

    return run


def bit_table(numbers: DataFrame, bits: int) -> np.ndarray:
    """The table of a column of longs; at most bits / 64 rows come to the driver."""
    rows = numbers.mapInArrow(_rows(bits), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, _U)
    if rows.num_rows:
        out[rows["at"].to_numpy()] = rows["mask"].to_numpy().view(_U)
    return out
