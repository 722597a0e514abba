"""Recording stores: discovery, run concatenation, manifests, matrix ingestion and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliaspan.functions.parsing import strip_entities
from reliaspan.operators.cohort import derive_durations
from reliaspan.session import materialise


def load_samples(spark: SparkSession, path: str, n_short: int, eps: float = 1e-8) -> DataFrame:
    """Validated long recordings: constant channels dropped, at least n_short + 10 rows."""
    from reliaspan.operators.clean import drop_constant_channels, recording_lengths

    samples = spark.read.parquet(path)
    usable = recording_lengths(samples).filter(F.col("n_rows") >= n_short + 10).select("subject_id")
    return drop_constant_channels(samples.join(usable, "subject_id", "left_semi"), eps)


def orient(wide: DataFrame) -> DataFrame:
    """(subject_id, row, values array) -> samples with the longer axis as time."""
    shape = wide.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.size("values")).alias("_cols"))
    cells = wide.select("subject_id", "row", F.posexplode("values").alias("col", "value")).join(shape, "subject_id")
    flip = F.col("_rows") < F.col("_cols")
    return cells.select(
        "subject_id", F.when(flip, F.col("row")).otherwise(F.col("col")).cast("int").alias("channel"),
        F.when(flip, F.col("col")).otherwise(F.col("row")).cast("int").alias("t"), "value",
    )


def discover(samples: DataFrame, intervals: DataFrame, min_total_sec: float, max_subjects: int | None = None) -> DataFrame:
    """(subject_id, site, tr, n_rows, total_sec) of recordings that last long enough.

    ``samples`` may be a partitioned table already filtered to a dataset and atlas; only the key and
    time columns are read. ``intervals`` is (subject_id, site, tr).
    """
    rows = samples.groupBy("subject_id").agg((F.max("t") + 1).cast("int").alias("n_rows"))
    out = rows.join(intervals, "subject_id").withColumn("total_sec", F.col("n_rows") * F.col("tr")).filter(F.col("total_sec") >= min_total_sec)
    return out if max_subjects is None else out.orderBy("subject_id").limit(max_subjects)


def pair_runs(files: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """(base, run_path, confound_path): each run with the confounds of the same base entities.

    ``files`` is (path, length, kind) with kind run or confounds; stub runs are skipped.
    """
    name = F.element_at(F.split("path", "/"), -1)
    base = F.regexp_replace(strip_entities(name), r"_(bold|desc-confounds_timeseries|timeseries)\..*$", "")
    keyed = files.withColumn("base", base)
    runs = keyed.filter((F.col("kind") == "run") & (F.col("length") >= min_bytes)).select("base", F.col("path").alias("run_path"))
    conf = keyed.filter(F.col("kind") == "confounds").select("base", F.col("path").alias("confound_path"))
    return runs.join(conf, "base")


def concatenate_runs(samples: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Join a subject's runs end to end in run order; runs with another channel count than the first
    are left out. Offsets come from one row per run."""
    keys = list(keys)
    runs = samples.groupBy(*keys, "run").agg((F.max("t") + 1).alias("n"), F.count_distinct("channel").alias("c"))
    w = Window.partitionBy(*keys).orderBy("run")
    same = runs.withColumn("first_c", F.first("c").over(w)).filter("c = first_c")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = same.select(*keys, "run", before.alias("_off"))
    joined = samples.join(offsets, [*keys, "run"])
    return joined.select(*keys, "channel", (F.col("t") + F.col("_off")).cast("int").alias("t"), "value")


def with_metadata(subjects: DataFrame, phenotype: DataFrame, key: str = "sub_id") -> DataFrame:
    """Left join of attributes with the default row Unknown / -1."""
    out = subjects.join(phenotype, key, "left")
    defaults = {"site": "Unknown", "group": "Unknown", "sex": "Unknown", "age": -1.0}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in out.columns})


def unpack_matrices(rows: DataFrame) -> DataFrame:
    """(subject_id, matrix array<array<double>>) -> edges i < j of the square ones."""
    n = F.size("matrix")
    square = rows.filter(F.forall("matrix", lambda r: F.size(r) == F.size("matrix")) & (n > 1))
    cells = square.select("subject_id", F.posexplode("matrix").alias("i", "row")).select("subject_id", "i", F.posexplode("row").alias("j", "r"))
    return cells.filter("i < j")


def combine_cohorts(parts: dict[str, tuple[DataFrame, DataFrame]], position: str = "pos") -> DataFrame:
    """Union of cohorts, each a (features, metadata) pair joined row by row with a count check."""
    from reliaspan.operators.cohort import positional_join

    out = None
    for name, (features, meta) in parts.items():
        rows = positional_join(features, meta, position).withColumn("cohort", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def concatenate_subjects(samples: DataFrame, subjects: DataFrame) -> DataFrame:
    """All subjects' rows as one series, in subject order. ``subjects`` is (subject_id, n_rows), ids of
    any sortable type; its offsets are running totals over range partitions, written down so that a
    recomputed partition cannot change them, and the cohort is not sorted in one task."""
    from reliaspan.operators.ranking import cumulate

    ordered = materialise(subjects.repartitionByRange("subject_id").withColumn("_vb", F.spark_partition_id()))
    ends = cumulate(ordered, [], "subject_id", F.col("_vb"), {"_end": "n_rows"})
    offsets = ends.select("subject_id", (F.col("_end") - F.col("n_rows")).alias("_off"))
    return samples.join(offsets, "subject_id").select((F.col("t") + F.col("_off")).alias("t"), "channel", "value", "subject_id")


def read_manifest(spark: SparkSession, path: str, n_short: int) -> DataFrame:
    """Subject manifest (JSON array or lines) with the derived durations."""
    rows = spark.read.json(path, multiLine=True)
    renamed = rows.withColumnRenamed("n_trs", "n_rows") if "n_trs" in rows.columns else rows
    return derive_durations(renamed, n_short)


def write_manifest(subjects: DataFrame, path: str) -> None:
    subjects.write.mode("overwrite").json(path)


def write_records(rows: DataFrame, path: str, order: Sequence[str], fmt: str = "csv", digits: int = 6) -> None:
    """Sorted, rounded result table; the sort is a range shuffle, so files stay parallel."""
    cols = [F.round(c.name, digits).alias(c.name) if c.dataType.typeName() in ("double", "float") else F.col(c.name) for c in rows.schema]
    out = rows.orderBy(*order).select(*cols)
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def nested_summary(rows: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """One row of structs: overall block plus one array of blocks per grouping column."""
    block = lambda: [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")]
    out = rows.agg(F.struct(*block()).alias("overall"))
    for g in groups:
        per = rows.groupBy(g).agg(*block()).agg(F.array_sort(F.collect_list(F.struct(g, "n", "mean", "sd"))).alias(f"by_{g}"))
        out = out.withColumn("_k", F.lit(1)).join(per.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out


def write_missing(rows: DataFrame, existing: DataFrame | None, path: str, key: str = "subject_id", force: bool = False) -> None:
    """Append only the subjects the target lacks; ``force`` replaces everything."""
    if force or existing is None:
        rows.write.mode("overwrite").parquet(path)
    else:
        rows.join(existing.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def feature_store(raw: DataFrame, predicted: DataFrame, reference: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject_id, labels..., fc_raw, fc_pred, fc_ref) as float arrays, one row per subject."""
    from reliaspan.operators.connectivity import pack_edges

    out = labels
    for edges, name in ((raw, "fc_raw"), (predicted, "fc_pred"), (reference, "fc_ref")):
        out = out.join(pack_edges(edges, name=name).withColumn(name, F.col(name).cast("array<float>")), "subject_id")
    return out
