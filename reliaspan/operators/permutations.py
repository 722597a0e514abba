"""Permuted labels as packed columns: a row per subject, whatever the number of permutations.

Subjects are stored in blocks by their anchor positions. A task takes a chunk of permutations, reads the blocks where
they are stored, hashes and sorts each permutation for itself, and returns the labels by position as bits. So neither
the rows of all permutations nor their hashes are shuffled or broadcast: what leaves the tasks is a bit (of each
plane of the class numbers) per subject and permutation. A task holds HELD_BYTES of hashes, or those of eight permutations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.functions.hashing import seeded_hash
from reliaspan.operators.ranking import number_by_hash
from reliaspan.session import materialise

#: Subjects of a block, bytes of a task's hashes, numbers of a matrix at once.
BLOCK_ROWS, HELD_BYTES, CELLS = 4096, 32 << 20, 1 << 22


@dataclass
class Codes:
    """How to read the bits of a `permuted` column."""

    n_perm: int
    #: The labels by class number, NULL first if there is one.
    classes: list
    #: Bit planes of the class numbers, bytes of a plane.
    planes: int
    width: int

    def unpack(self, column: pa.Array, first: int = 0, last: int | None = None) -> np.ndarray:
        """Class numbers, rows x permutations, of the permutations from `first` (0-based) to `last`."""
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), self.planes, self.width)
        last = self.n_perm if last is None else min(last, self.n_perm)
        bits = np.unpackbits(raw[:, :, first // 8 : -(-last // 8)], axis=2, bitorder="little")[:, :, first % 8 : first % 8 + last - first]
        out = bits[:, 0]
        for k in range(1, self.planes):
            out = out.astype(np.int64) | bits[:, k].astype(np.int64) << k
        return out


def chunks_of(frame: DataFrame, n: int, bytes_each: int, held: int = HELD_BYTES) -> int:
    """Columns of a chunk, a multiple of eight: a chunk for each core and no more than `held` bytes, `bytes_each` a column."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return 8 * max(1, min(-(-n // (8 * cores)), held // max(1, 8 * bytes_each)))


def beside_all(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Every chunk, in a task of its own, beside all rows, which it reads where they are stored."""
    return chunks.crossJoin(rows.coalesce(1).hint("shuffle_replicate_nl"))


def _ordered(h: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Places by hash, then key."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    for at in same[np.diff(same, prepend=-2) > 1]:  # the first place of each run of equal hashes
        end = at + 1 + int(np.argmin(np.append(h[order][at + 1 :] == h[order][at], False)))
        run = order[at:end]
        order[at:end] = run[pc.sort_indices(keys.take(pa.array(run)), null_placement="at_start").to_numpy()]
    return order


def permuted_codes(
    subjects: DataFrame, n_perm: int, seed: int, label: str = "label", key: str = "subject_id", within: Sequence[str] = (), extra: Sequence[str] = (),
) -> tuple[DataFrame, Codes]:
    """(within, key, label, extra, permuted) and how to read permuted: the class numbers that `permuted_labels` pairs with a subject.

    Subjects with a NULL in `within` have no group and are left out. The driver sees the labels that there are.
    """
    within = list(within)
    carried = list(dict.fromkeys([key, label, *extra]))
    rows = subjects.select(*dict.fromkeys([*within, *carried])).dropna(subset=within) if within else subjects.select(*carried)
    at = number_by_hash(rows, within, seeded_hash(F.col(key), seed, "anchor"), [key])
    at = at.withColumn("_text", F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    groups = at.groupBy(*within, F.expr(f"(rn - 1) div {BLOCK_ROWS}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("rn", *carried, "_text"))).alias("_rows"))
    blocks = materialise(groups.select(*within, "_block", *[F.col(f"_rows.{c}").alias(c if c not in within else f"_own_{c}") for c in [*carried, "_text"]]))
    classes = [r[0] for r in rows.select(label).distinct().orderBy(F.col(label).asc_nulls_first()).collect()]
    held = at.agg(F.count(F.lit(1))).first()[0]
    step = chunks_of(subjects, n_perm, 8 * held)
    codes = Codes(n_perm, classes, max(1, (max(1, len(classes)) - 1).bit_length()), -(-n_perm // step) * step // 8)
    planes, chunks = codes.planes, -(-n_perm // step)
    names = ["_chunk", *blocks.columns]
    place = {c: names.index(c) for c in names}
    fields = [blocks.schema[c] for c in [*within, "_block"]]
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_bits", T.BinaryType())])
    own_label, own_key = (c if c not in within else f"_own_{c}" for c in (label, key))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, groups, kinds = None, {}, None

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in groups.items():
                numbers = [n for n, *_ in parts]
                keys = pa.concat_arrays([k for _, k, _, _ in parts])
                own = np.concatenate([c for _, _, c, _ in parts])
                hashes = np.concatenate([h for *_, h in parts], axis=1)
                starts = np.concatenate([[0], np.cumsum([len(c) for _, _, c, _ in parts])])
                anchor = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in np.argsort(numbers)])  # places by position
                found = np.zeros((len(anchor), step), own.dtype)
                for i, h in enumerate(hashes):
                    found[:, i] = own[_ordered(h, keys)]
                out = []
                for n in sorted(numbers):
                    part = found[n * BLOCK_ROWS : (n + 1) * BLOCK_ROWS]
                    out += [(n, k * chunks + chunk, np.packbits((part >> k & 1).astype(np.uint8), axis=1, bitorder="little").tobytes()) for k in range(planes)]
                values = [pa.array([g] * len(out), t) for g, t in zip(group, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*values, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True))], [f.name for f in schema.fields])

        for b in batches:
            kinds = [b.schema.field(place[c]).type for c in within]
            for i in range(b.num_rows):
                c = b.column(0)[i].as_py()
                if c != chunk:
                    yield from flush()
                    chunk, groups = c, {}
                texts = [t.encode() for t in b.column(place["_text"])[i].as_py()]
                keys, labels = (b.column(place[x])[i].values for x in (own_key, own_label))
                own = pc.index_in(labels, pa.array(classes, labels.type), skip_nulls=False).to_numpy().astype(np.min_scalar_type(max(1, len(classes) - 1)))
                hashes = np.empty((min(step, n_perm - chunk * step), len(texts)), np.uint32)
                for p in range(len(hashes)):
                    end = b"|%d|perm" % (chunk * step + p + 1)
                    hashes[p] = np.frombuffer(b"".join([md5(t + end).digest() for t in texts]), ">u4")[::4]
                groups.setdefault(tuple(b.column(place[w])[i].as_py() for w in within), []).append((b.column(place["_block"])[i].as_py(), keys, own, hashes))
        yield from flush()

    spark = subjects.sparkSession
    numbered = spark.range(0, chunks, 1, chunks).withColumnRenamed("id", "_chunk")
    parts = beside_all(numbered, blocks).mapInArrow(pair, schema).groupBy(*within, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_bits"))), lambda x: x["_bits"]).alias("_bits"))
    whole = blocks.drop("_text").join(parts.hint("merge"), [*within, "_block"])
    kept = [c for c in carried if c not in within]
    out = T.StructType([*(blocks.schema[w] for w in within), *(rows.schema[c] for c in kept), T.StructField("permuted", T.BinaryType())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                columns = [b.column(b.schema.get_field_index(c))[i].values for c in kept]
                n = len(columns[0])
                bits = b"".join([x.as_py() for x in b.column(b.schema.get_field_index("_bits"))[i].values])
                # parts are stored one after the other, each with the bytes of all rows
                packed = np.ascontiguousarray(np.frombuffer(bits, np.uint8).reshape(planes * chunks, n, step // 8).transpose(1, 0, 2)).tobytes()
                each = planes * chunks * step // 8
                permuted = pa.array([packed[k * each : (k + 1) * each] for k in range(n)], pa.binary())
                same = [pa.array([b.column(b.schema.get_field_index(w))[i].as_py()] * n, b.schema.field(w).type) for w in within]
                yield pa.RecordBatch.from_arrays([*same, *columns, permuted], [f.name for f in out.fields])

    return whole.mapInArrow(rows_of, out), codes


def permuted_sums(packed: DataFrame, codes: Codes, value: str, label: str = "label") -> DataFrame:
    """(perm, label, n, total): count and sum of the known values of each class, perm 0 for the labels as they are.

    All columns of a batch are added up row by row, so that equal labellings have equal sums.
    """
    schema = "split long, n binary, total binary"
    classes, k, wide = codes.classes, len(codes.classes), codes.n_perm + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((k, wide)), np.zeros((k, wide))
        for b in batches:
            known = b.filter(pc.is_valid(b.column(0)))
            step = max(1, CELLS // wide)
            for s in range(0, known.num_rows, step):
                some = known.slice(s, step)
                x = some.column(0).to_numpy(zero_copy_only=False).astype(float)
                own = pc.index_in(some.column(1), pa.array(classes, some.column(1).type), skip_nulls=False).to_numpy()
                which = np.hstack([own[:, None], codes.unpack(some.column(2))])
                for c in range(k):
                    mine = which == c
                    n[c] += mine.sum(0)
                    total[c] += np.where(mine, x[:, None], 0.0).sum(0)
        yield pa.RecordBatch.from_pydict({"split": pa.array([0], pa.int64()), "n": pa.array([n.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k * wide), np.zeros(k * wide)
        for b in batches:
            for i in range(b.num_rows):
                n += np.frombuffer(b.column(1)[i].as_buffer())
                total += np.frombuffer(b.column(2)[i].as_buffer())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.tile(np.arange(wide), k), pa.int32()), pa.array(np.repeat(np.arange(k), wide), pa.int32()), pa.array(n.astype(np.int64)), pa.array(total),
        ], ["perm", "code", "n", "total"])

    sums = packed.select(value, label, "permuted").mapInArrow(part, schema).repartition(1).mapInArrow(add, "perm int, code int, n long, total double")
    return _labelled(sums, packed, classes, label)


def permuted_counts(packed: DataFrame, codes: Codes, beside: str, label: str = "label") -> DataFrame:
    """(perm, label, beside, n): how often each class and value of `beside` meet, perm 0 for the labels as they are."""
    classes, wide = codes.classes, codes.n_perm + 1
    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("code", T.IntegerType()), packed.schema[beside], T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            step = max(1, CELLS // wide)
            for s in range(0, b.num_rows, step):
                some = b.slice(s, step)
                own = pc.index_in(some.column(1), pa.array(classes, some.column(1).type), skip_nulls=False).to_numpy()
                which = np.hstack([own[:, None], codes.unpack(some.column(2))])
                coded = some.column(0).dictionary_encode(null_encoding="encode")
                places = coded.indices.to_numpy()
                for g, v in enumerate(coded.dictionary.to_pylist()):
                    mine = which[places == g]
                    for c in range(len(classes)):
                        held[c, v] = held.get((c, v), 0) + (mine == c).sum(0)
        for (c, v), n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide), pa.int32()), pa.array(np.full(wide, c), pa.int32()), pa.array([v] * wide, kind), pa.array(n.astype(np.int64))], ["perm", "code", beside, "n"])

    found = packed.select(beside, label, "permuted").mapInArrow(count, schema).groupBy("perm", "code", beside).agg(F.sum("n").alias("n")).filter("n > 0")
    return _labelled(found, packed, classes, label)


def _labelled(rows: DataFrame, packed: DataFrame, classes: list, label: str) -> DataFrame:
    names = packed.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], T.StructType([T.StructField("code", T.IntegerType()), T.StructField(label, packed.schema[label].dataType)]))
    return rows.join(F.broadcast(names), "code").drop("code")
