"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints link if they differ in at most LIMIT = 4 bits. They are cut into LIMIT + 1 = 5
segments on a ring, so each segment's budget is 4/5 of a bit. By the pigeonring principle a linked pair
has a start segment from which every chain of l consecutive segments differs in at most
floor(l * 4/5) bits: 0, 1, 2, 3, 4. The join key demands the first two (the start segment equal, the
next within one bit, by listing its one-bit changes on one side), the join condition the longer chains
and then the full Hamming distance.

Work is done on distinct fingerprints; copies ride along with their class and are never paired.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import in_slices
from reliaspan.llm.components import components
from reliaspan.session import materialise

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Segment widths from the lowest bit up, their first bits and masks.
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = tuple(accumulate((0, *WIDTHS[:-1])))
MASKS = tuple(((1 << w) - 1) << o for w, o in zip(WIDTHS, OFFSETS, strict=True))
#: Shingles counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 if it is None or has no word.

    A-Z are lower-cased, words are cut at space and tab to carriage return, shingles are SHINGLE words
    joined by a space, repeats included; fewer words make one shingle. A bit is set if it is set in
    over half of the shingles' XXH64.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - SHINGLE + 1)
    last = starts[min(SHINGLE, len(words)) :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts[at : min(n, at + CHUNK)], last[at:], strict=False)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    value = int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])
    return value


def fingerprint_column(text: Column) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, fingerprint, pa.int64())

    return run(text.cast("binary"))


def _bits(x: int) -> Column:
    """A literal of 64 bits."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, OFFSETS[k]).bitwiseAND((1 << WIDTHS[k]) - 1)


def _key(fp: Column, start: int, change: int = 0) -> Column:
    """The start segment and the next one, some bits of the latter changed, as one long."""
    after = (start + 1) % len(WIDTHS)
    return F.shiftleft(_segment(fp, start), 16).bitwiseOR(_segment(fp, after).bitwiseXOR(F.lit(change).cast("long"))).bitwiseOR(F.lit(start << 32).cast("long"))


def links(prints: DataFrame) -> DataFrame:
    """(u, v): the pairs of distinct values of `prints(fp)` within LIMIT bits; a pair may come more than once."""
    fp = F.col("fp")
    ring = range(len(WIDTHS))
    right = prints.select(fp.alias("v"), F.explode(F.array(*[_key(fp, s) for s in ring])).alias("key"))
    left = prints.select(fp.alias("u"), F.explode(F.array(*[_key(fp, s, c) for s in ring for c in (0, *(1 << b for b in range(WIDTHS[(s + 1) % len(ring)])))])).alias("key"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    start = F.shiftrightunsigned("key", 32)

    def chain(length: int) -> Column:
        masks = [sum(MASKS[(s + i) % len(ring)] for i in range(length)) for s in ring]
        mask = F.when(start == 0, _bits(masks[0]))
        for s in ring[1:]:
            mask = mask.when(start == s, _bits(masks[s]))
        return F.bit_count(apart.bitwiseAND(mask)) <= length * LIMIT // len(ring)

    right = right.withColumnRenamed("key", "right_key")
    near = (F.col("key") == F.col("right_key")) & (F.col("u") < F.col("v")) & chain(3) & chain(4) & (F.bit_count(apart) <= LIMIT)
    return left.join(right, near).select("u", "v")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, class, component_id) for each distinct fingerprint of `prints(doc_id, fp)`.

    class is the smallest linked fingerprint, component_id the smallest doc_id of the class (NULL ids
    count only where no other is there). An empty table gives no rows.
    """
    own = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = materialise(components(links(own.select("fp"))))
    named = own.join(linked, own["fp"] == linked["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class"))
    ids = materialise(named.groupBy("class").agg(F.min("first_id").alias("component_id")))
    return materialise(named.select("fp", "class").join(ids, "class"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; NULL and empty texts share fingerprint 0.

    Repeated rows and exact copies share a class, whatever their number.
    """
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp")))
    found = classes(prints)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id, NULL last.

    Rows that repeat that id give one row too. The columns stay as they are, whatever their names.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    of = {name: f"c{i}" for i, name in reversed(list(enumerate(columns)))}
    rows = plain.withColumn("fp", fingerprint_column(F.col(of[text])))
    found = classes(materialise(rows.select(F.col(of[doc_id]).alias("doc_id"), "fp")))
    first = rows.join(found, "fp").filter(F.col(of[doc_id]).eqNullSafe(F.col("component_id")))
    return first.dropDuplicates(["class"]).select(*plain.columns).toDF(*columns)
