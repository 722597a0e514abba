"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and the five ASCII controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_slices(values: pa.Array, one: Callable, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """one(value) for each value of a batch, with the Python objects of some rows at a time only."""
    parts = [pa.array([one(x) for x in values.slice(at, rows).to_pylist()], kind) for at in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def hash_share(df: DataFrame, by: Column, share: float) -> DataFrame:
    """The rows whose hash falls into the given share of the hash space; the same rows in every run."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def sum_matrices(parts: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of float64 arrays packed as binary, one row for each input partition.

    Adds them in about sqrt(partitions) tasks first, so the driver gets few arrays of `size` numbers.
    No rows give zeros.
    """
    groups = max(1, math.isqrt(parts.sparkSession.sparkContext.defaultParallelism * 4))

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in rows.column(column):
            total += np.frombuffer(x.as_py())
        return pa.table({column: pa.array([total.tobytes()], pa.binary())})

    few = parts.select(column, F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.spark_partition_id()), F.lit(groups)).alias("pile")).groupBy("pile").applyInArrow(add, f"{column} binary")
    total = np.zeros(size)
    for row in few.collect():
        total += np.frombuffer(row[0])
    return total
