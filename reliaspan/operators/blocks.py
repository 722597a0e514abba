"""All pairs of rows, block against block, without a shuffle of the vectors.

Rows are packed into bounded blocks that are stored once. Every left block meets the right blocks of one group
in one task, which reads both where they are stored; what leaves the task is one result for each row and group,
so what is written and shuffled grows with the rows while only the work is quadratic.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.session import materialise

#: Groups of right blocks at least, rows of a group at most (about), numbers of a task's matrix at most.
GROUPS, GROUP_ROWS, CELLS = 8, 131_072, 1 << 22


@dataclass
class Block:
    keys: pa.Array
    x: np.ndarray
    #: The other columns, as arrays.
    extra: dict[str, np.ndarray]


def pack_blocks(rows: DataFrame, key: str, blocks: int, block_rows: int, extra: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """A row for each block, in the checkpoint folder: its number, keys, vectors (doubles, row after row) and other columns.

    Rows are dealt over `blocks` partitions by key; a block ends at five quarters of block_rows.
    """
    fields = [T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("x", T.BinaryType())]
    fields += [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in extra]
    most = block_rows + block_rows // 4

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, vectors, *others = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
        if vectors.null_count:
            raise ValueError("a vector is NULL")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        x.reshape(len(keys), -1)  # all of one length
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole(keys), pa.array([x.tobytes()], pa.binary()), *map(whole, others)], [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - n))
                b = b.slice(most - n)
                n += held[-1].num_rows
                if n == most:
                    yield packed(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield packed(number, held)

    dealt = rows.select(key, F.col(vec).cast("array<double>").alias("_vec"), *extra).repartition(blocks, key)
    return materialise(dealt.mapInArrow(run, T.StructType(fields)))


def group_count(rows: int) -> int:
    return max(GROUPS, -(-rows // GROUP_ROWS))


def meet(left: DataFrame, right: DataFrame, groups: int, kernel: Callable[[Block, Iterator[Block]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """The rows of kernel(left block, right blocks of a group) for all left blocks and groups of right ones."""
    names = [left.columns, right.columns]
    sides = [d.select(*[F.col(c).alias(f"{side}{c}") for c in d.columns]) for side, d in zip("lr", (left, right.coalesce(groups)), strict=True)]

    def block(row: tuple[pa.RecordBatch, int], side: int) -> Block:
        b, i = row
        first = side * len(names[0])
        keys = b.column(first + 1)[i].values
        x = np.frombuffer(b.column(first + 2)[i].as_buffer()).reshape(len(keys), -1)
        return Block(keys, x, {c: b.column(first + 3 + n)[i].values.to_numpy(zero_copy_only=False) for n, c in enumerate(names[side][3:])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        for _, pairs in itertools.groupby(rows, lambda r: r[0].column(0)[r[1]].as_py()):
            first = next(pairs)
            yield from kernel(block(first, 0), (block(r, 1) for r in itertools.chain([first], pairs)))

    # partitions meet as they are stored: the size of the tables must not turn this into a broadcast
    return sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def same_keys(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of equal keys, by the left ones."""
    frames = [pd.DataFrame({"k": b.keys.to_numpy(zero_copy_only=False), n: np.arange(len(b.keys))}) for b, n in ((left, "i"), (right, "j"))]
    both = frames[0].merge(frames[1], on="k").sort_values("i")
    return both["i"].to_numpy(), both["j"].to_numpy()


def row_slices(left: Block, right: Block, own: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray]]]:
    """Slices of the left rows, so that a matrix against the right block has at most CELLS numbers, and the equal keys in each."""
    step = max(1, CELLS // max(1, len(right.x)))
    for s in range(0, len(left.x), step):
        a, b = np.searchsorted(own[0], [s, s + step])
        yield slice(s, s + step), (own[0][a:b] - s, own[1][a:b])
