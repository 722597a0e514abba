"""Sample panels derived from the given tables.

``samples`` is the long form (subject_id, channel, t, value); ``frames`` is the time-major form
(subject_id, t, channels array<int>, x array<double>) that the pairwise kernels read.
Subjects are the table's own keys, so a panel grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliaspan.session import spread

N_CHANNELS = 12
N_MONTHS = 83
SHORT_ROWS = 16
BLOCK_ROWS = 4096  # instants of one subject that stay together


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantity per supplier (subject) and part group (channel), dense, time-major.

    The empty grid rows join the facts by union before the only aggregation, whose per-channel
    conditional sums combine on the map side. The reduced rows are then clustered by subject and block
    of time, so the pair kernel folds whole blocks instead of scattered instants.
    """
    li = read_table(spark, sf_dir, "lineitem")
    facts = li.select(
        F.col("l_suppkey").alias("subject_id"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("t"),
        (F.col("l_partkey") % N_CHANNELS).cast("int").alias("channel"),
        F.col("l_quantity").alias("value"),
    )
    grid = (
        li.select(F.col("l_suppkey").alias("subject_id"))
        .distinct()
        .select(
            "subject_id",
            F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("t"),
            F.lit(0).alias("channel"),
            F.lit(0.0).alias("value"),
        )
    )
    sums = [
        F.sum(F.when(F.col("channel") == c, F.col("value")).otherwise(0.0)).alias(f"c{c}")
        for c in range(N_CHANNELS)
    ]
    wide = facts.unionByName(grid).groupBy("subject_id", "t").agg(*sums)
    frames = wide.select(
        "subject_id",
        "t",
        F.array(*[F.lit(c) for c in range(N_CHANNELS)]).alias("channels"),
        F.array(*[F.col(f"c{c}") for c in range(N_CHANNELS)]).alias("x"),
    )
    return spread(frames, "subject_id", F.floor(F.col("t") / BLOCK_ROWS))


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_to_samples(lineitem_frames(spark, sf_dir))


def frames_to_samples(frames: DataFrame) -> DataFrame:
    keys = [c for c in frames.columns if c not in ("channels", "x")]
    return frames.select(
        *keys, F.explode(F.arrays_zip("channels", "x")).alias("e")
    ).select(*keys, F.col("e.channels").alias("channel"), F.col("e.x").alias("value"))


def samples_to_frames(samples: DataFrame, rows_per_chunk: int = BLOCK_ROWS) -> DataFrame:
    """Long -> time-major. A row holds one instant, so its arrays are bounded by the channel count.

    The shuffle key is (subject, block of time), which keeps a subject's rows together for the
    kernels yet spreads a very long recording over many tasks.
    """
    chunk = F.floor(F.col("t") / rows_per_chunk)
    return (
        samples.withColumn("_chunk", chunk)
        .repartition("subject_id", "_chunk")
        .groupBy("subject_id", "_chunk", "t")
        .agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("e"))
        .select("subject_id", "t", F.col("e.channel").alias("channels"), F.col("e.value").alias("x"))
    )


def subject_attributes(subjects: DataFrame) -> DataFrame:
    """Cohort attributes that the panels derive from the subject key."""
    sid = F.col("subject_id")
    return subjects.select(
        "subject_id",
        (sid % 2).cast("int").alias("grp"),
        (sid % 5).cast("int").alias("site"),
        (F.lit(2.0) + F.lit(0.5) * ((sid % 5) % 2)).alias("tr"),
    )


def lineitem_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id")).distinct()
    return subject_attributes(ids)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value per user (subject) and event type (channel name); only observed cells."""
    ev = read_table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    return (
        ev.groupBy(F.col("user_id").alias("subject_id"), F.col("event_type").alias("channel"), day.alias("t"))
        .agg(F.sum("value").alias("value"))
    )


def embedding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature vector per subject in long form: (subject_id, label, pos, value)."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject_id"), "label", F.posexplode("embedding").alias("pos", "value")
    ).withColumn("value", F.col("value").cast("double"))
