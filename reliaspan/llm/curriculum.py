"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

A source's weight schedule over training time t in [0, 1] is piecewise linear. Its integral gives the
source's cumulative token demand; the words of the source, in a fixed random order of its documents,
are laid end to end against that demand. Inverting the demand gives the time at which each document is
first read, and a range sort by time is the training order.

A mix takes `target` words of a source: a document whose words lie from a to b of the source's S words
gives floor(b * target / S) - floor(a * target / S) words, so whole repeats and a part of one, never
over ceil(target / S) times its size, and the sum is floor(target) exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.session import materialise

#: A source is read at most so many times.
MOST_REPEATS = 3
#: Rows of a bucket and buckets of a group in the running sums.
BUCKET_ROWS, GROUP = 4096, 256


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from `sizes(source, source_size)`, one row for each source.

    The sources by code point, NULL last, have the weights in turn. They share the sum of all sizes;
    a target stops at `most` times the source's size and the excess is shared again by weight. That is
    a water level: with the sources by size over weight, the first of them full, the level is the rest
    of the words over the rest of the weights; the first level that does not fill the next source holds.
    Sources without words get 0. The table of sources is a setting of the mix, small beside the documents.
    """
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    up_to, whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    ranked = (
        sizes.withColumn("turn", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(in_turn, ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("need", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("cap_before", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(up_to) - F.col("weight"))
        .withColumn("level", (F.col("need") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_before", "level"))).over(whole)["level"]
    return ranked.withColumn("at", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def running_sum(rows: DataFrame, key: str, order: Sequence[str], value: str, into: str, shards: int) -> DataFrame:
    """rows with `into`, the sum of `value` over the rows of the same key before this one.

    Rows are ordered by a hash column `order[0]` (long) and the other columns of `order`. The range of
    the hash is cut into `shards` (a power of two), sums run inside shards, inside groups of shards and
    over groups, so no window holds more than a shard's rows, GROUP shards or the groups of one key.
    """
    bits = (shards - 1).bit_length()
    shard = F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("_shard", shard)
    per = rows.groupBy(key, "_shard").agg(F.sum(value).alias("_n")).withColumn("_group", F.expr(f"_shard div {GROUP}"))
    top = per.groupBy(key, "_group").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.select(F.col(key).alias("_k"), F.col("_group").alias("_g"), before.alias("_above"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_group").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_inner", inner)
    per = per.join(top, per[key].eqNullSafe(top["_k"]) & (F.col("_group") == F.col("_g"))).select(F.col(key).alias("_key"), F.col("_shard").alias("_s"), (F.col("_inner") + F.col("_above")).alias("_base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(key, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_own", own)
    return out.join(per, out[key].eqNullSafe(per["_key"]) & (F.col("_shard") == F.col("_s"))).withColumn(into, F.col("_own") + F.col("_base")).drop("_shard", "_key", "_s", "_own", "_base")


def first_read(demand: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a share of a source's demand is reached: the inverse of the schedule's integral.

    `schedule` holds (time, weight) knots from time 0 to 1, linear between, weights not negative and not all 0.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    total, done = sum(areas), 0.0
    at = F.lit(float(schedule[0][0]))
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas, strict=False):
        rest = demand * total - done  # w0 x + (w1 - w0) / (2 (t1 - t0)) x^2 = rest
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + rest * (2 * slope)))
        step = rest * 2 / (root + w0) if w0 or slope else F.lit(0.0)
        at = F.when(rest > 0, t0 + F.least(F.lit(t1 - t0), step)).otherwise(at)
        done += area
    return at


SCHEDULES = (((0, 1), (1, 1)), ((0, 2), (1, 1)), ((0, 1), (1, 2)))


def _scheduled(share: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """first_read by the schedule of a source's `turn`."""
    time = F.when(F.col("turn") % len(schedules) == 0, first_read(share, schedules[0]))
    for k, s in enumerate(schedules[1:], 1):
        time = time.when(F.col("turn") % len(schedules) == k, first_read(share, s))
    return time


def _by_size(rows: DataFrame, parts: int) -> DataFrame:
    """rows(source, size, h, ...) with `rank`, from 0, in the order of size, then h, inside a source.

    A range sort gives every task a run of the sequence; positions come from the rows of earlier runs.
    """
    order = ["source", "size", "h"]
    run = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    run = run.withColumn("_run", F.shiftright("_id", 33))
    per = run.groupBy(F.col("source").alias("_s"), F.col("_run").alias("_r")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = run.join(per, run["source"].eqNullSafe(per["_s"]) & (F.col("_run") == F.col("_r")))
    return placed.withColumn("rank", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_run", "_s", "_r", "_n", "_first", "_before")


def whole_readings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: float = MOST_REPEATS) -> DataFrame:
    """The rows of docs as often as the mix reads them whole, in training order; the columns stay as they are, whatever their names.

    With ratio = target / size of a source, each of its documents is read floor(ratio) times, and the rest of the
    ratio goes systematically along the documents by size, so a source's words miss its target by less than
    its largest document. Readings of a source are shuffled by a hash of document and reading, laid end to end
    against the source's cumulative demand, and each has the time at which that demand is reached; the
    result is range-sorted by it. Equal rows are read equally often. NULL texts have size 0, a NULL source is one source.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    of = {name: f"c{i}" for i, name in reversed(list(enumerate(columns)))}
    plain = plain.withColumn("key", F.xxhash64(F.col(of[doc_id]), F.col(of[text]), F.col(of[source])))
    rows = plain.select(F.col(of[source]).cast("string").alias("source"), "key", word_count(F.col(of[text])).alias("size"), F.xxhash64("key", F.lit("mix")).alias("h"))
    rows = materialise(rows)
    sources = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1))
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    of_source = sources.select(F.col("source").alias("_source"), ratio.alias("ratio"), "turn")
    n = rows.count()
    ranked = _by_size(rows.dropDuplicates(["key"]), max(1, n // BUCKET_ROWS))
    ranked = ranked.join(F.broadcast(of_source) if sources.count() <= 10_000 else of_source, ranked["source"].eqNullSafe(F.col("_source")))
    rest = F.col("ratio") - F.floor("ratio")
    copies = F.floor("ratio") + F.floor(rest * (F.col("rank") + 1)) - F.floor(rest * F.col("rank"))
    read = ranked.withColumn("copies", copies.cast("int")).filter("copies > 0").withColumn("reading", F.explode(F.sequence(F.lit(1), "copies")))
    read = materialise(read.select("source", "key", "size", "turn", F.xxhash64("h", "reading").alias("order"), "reading"))
    shards = 1 << max(0, (int(n * max(1.0, most)) // BUCKET_ROWS).bit_length())
    spread = running_sum(read, "source", ["order", "key", "reading"], "size", "before", shards)
    totals = read.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("total"))
    spread = spread.join(F.broadcast(totals) if sources.count() <= 10_000 else totals, spread["source"].eqNullSafe(F.col("_source")))
    share = F.coalesce(F.try_divide(F.col("before").cast("double"), F.col("total")), F.lit(0.0))
    plan = spread.select(F.col("key").alias("_key"), "order", _scheduled(share, schedules).alias("position"))
    out = plain.join(plan, F.col("key") == F.col("_key"))
    return out.repartitionByRange("position", "order").sortWithinPartitions("position", "order").select(*plain.columns[:-1]).toDF(*columns)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: float = MOST_REPEATS, ordered: bool = True) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position) for each row of docs.

    taken: words that the mix takes, repeats counted. copies: the same in whole documents, drawn from the
    document's hash, for users that cannot split one. position: the training time in [0, 1] of the first
    reading, NULL where nothing is taken; the rows are range-sorted by it if `ordered`. The schedules go
    to the sources in turn, as the weights. NULL texts have size 0, NULL sources are one source, last.
    The order inside a source is that of md5(doc_id), then doc_id, size; repeated rows share the words
    of their key between them. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    rows = materialise(rows.withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")))
    sources = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1))
    shards = 1 << max(0, (rows.count() // BUCKET_ROWS).bit_length())
    # md5 gives 60 bits, from 0 up: widen them to the signed range that running_sum cuts
    placed = running_sum(rows.withColumn("wide", F.shiftleft("h", 4).bitwiseXOR(F.lit(-(1 << 63)))), "source", ["wide", "doc_id", "size"], "size", "before", shards)
    of = sources.select(F.col("source").alias("_source"), "source_size", "target", "turn")
    placed = placed.join(F.broadcast(of) if sources.count() <= 10_000 else of, placed["source"].eqNullSafe(F.col("_source")))
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    edge = lambda words: F.floor(words.cast("double") * F.col("ratio"))
    placed = placed.withColumn("ratio", ratio).withColumn("taken", edge(F.col("before") + F.col("size")) - edge(F.col("before")))
    draw = F.pmod(F.xxhash64("h", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.try_divide(F.col("before").cast("double"), F.col("source_size")), F.lit(0.0))
    time = _scheduled(share, schedules)
    out = placed.select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
        (F.floor("ratio") + (draw < F.col("ratio") - F.floor("ratio")).cast("long")).alias("copies"),
        F.when(F.col("taken") > 0, time).alias("position"),
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id") if ordered else out
