"""Recordings held in text files, one instant per line.

``lines`` is (path, line_no, line). Files are split like any text source: a line's number is its
rank inside its file block plus the lines of the earlier blocks, so a huge file is never read whole
by one task.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliaspan.functions.parsing import file_stem
from reliaspan.operators.clean import close_gaps

MAX_BAD_SHARE = 0.2


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    counts = raw.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("path", "_start").orderBy("_id"))
    return (
        raw.withColumn("_local", local).join(before, ["path", "_start"])
        .select("path", (F.col("_before") + F.col("_local") - 1).alias("line_no"), "line")
    )


def _fields(line: Column, pattern: str) -> Column:
    return F.filter(F.split(F.trim(line), pattern), lambda s: s != "")


def _explode(parts: DataFrame) -> DataFrame:
    """(subject_id, line_no, parts) -> samples with closed-up time and numeric values."""
    rows = parts.select("subject_id", F.col("line_no").alias("t"), "parts")
    renumbered = close_gaps(rows)
    return renumbered.select("subject_id", "t", F.posexplode("parts").alias("channel", "text")).select(
        "subject_id", "channel", "t", F.expr("try_cast(text as double)").alias("value")
    )


def _subject(lines: DataFrame) -> DataFrame:
    return lines if "subject_id" in lines.columns else lines.withColumn("subject_id", file_stem("path"))


def _long_enough(samples: DataFrame, min_rows: int, min_channels: int = 2) -> DataFrame:
    size = samples.groupBy("subject_id").agg((F.max("t") + 1).alias("n"), (F.max("channel") + 1).alias("c"))
    keep = size.filter((F.col("n") >= min_rows) & (F.col("c") >= min_channels)).select("subject_id")
    return samples.join(keep, "subject_id", "left_semi")


def _varying(samples: DataFrame, max_bad: float | None = None, eps: float = 1e-8) -> DataFrame:
    """Drop constant channels, and subjects with too large a share of them."""
    spread = samples.groupBy("subject_id", "channel").agg(F.stddev_pop("value").alias("sd"))
    ok = spread.filter(F.col("sd") > eps).select("subject_id", "channel")
    if max_bad is not None:
        share = spread.groupBy("subject_id").agg(F.avg(F.when(F.col("sd") > eps, 0.0).otherwise(1.0)).alias("bad"))
        ok = ok.join(share.filter(F.col("bad") <= max_bad).select("subject_id"), "subject_id", "left_semi")
    return samples.join(ok, ["subject_id", "channel"], "left_semi")


def parse_matrix(lines: DataFrame, min_rows: int = 10) -> DataFrame:
    """Whitespace matrix: comment lines skipped, one-column files and short ones rejected, constant
    channels dropped."""
    kept = _subject(lines).filter(~F.ltrim("line").startswith("#") & (F.trim("line") != ""))
    parts = kept.select("subject_id", "line_no", _fields(F.col("line"), r"\s+").alias("parts"))
    return _varying(_long_enough(_explode(parts), min_rows))


def parse_tabbed_series(lines: DataFrame, min_rows: int = 10) -> DataFrame:
    """Tab-separated with one header line; the first two columns are labels; short lines skipped."""
    parts = _subject(lines).filter(F.col("line_no") > 0).withColumn("f", F.split(F.trim("line"), "\t")).filter(F.size("f") >= 3)
    return _long_enough(_explode(parts.select("subject_id", "line_no", F.slice("f", F.lit(3), F.size("f") - 2).alias("parts"))), min_rows, 1)


def parse_spaced_series(lines: DataFrame, min_rows: int = 20, min_channels: int = 10) -> DataFrame:
    """Space-separated; blank and ``#`` lines dropped; needs rows and channels; rejects subjects with
    more than a fifth of their channels constant."""
    kept = _subject(lines).filter(~F.ltrim("line").startswith("#") & (F.trim("line") != ""))
    parts = kept.select("subject_id", "line_no", _fields(F.col("line"), r"\s+").alias("parts"))
    return _varying(_long_enough(_explode(parts), min_rows, min_channels), MAX_BAD_SHARE)


def format_matrix(frames: DataFrame, sep: str = " ") -> DataFrame:
    """(subject_id, line_no, line): the text form of time-major rows, the inverse of the parsers."""
    text = F.concat_ws(sep, F.transform("x", lambda v: v.cast("string")))
    return frames.select("subject_id", F.col("t").cast("bigint").alias("line_no"), text.alias("line"))


def read_tsv(spark: SparkSession, path: str | list[str], id_column: str | None = None) -> DataFrame:
    """Tab-separated table of trimmed text; rows without an id are dropped."""
    df = spark.read.csv(path, sep="\t", header=True)
    out = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return out if id_column is None else out.filter(F.coalesce(F.col(id_column), F.lit("")) != "")


def flagged(rows: DataFrame, flag: str) -> DataFrame:
    return rows.filter(F.col(flag) == "1")
