"""Subject attribute tables: aliases, codes and eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliaspan.functions.parsing import group_from_dx, group_from_flags, is_healthy, parse_age, sex_from_code

# Column names under which each attribute is known, first match first.
ID_ALIASES = ("ScanDir ID", "Subject", "SUB_ID", "ScanDirID", "SubID")
SITE_ALIASES = ("Site", "site", "SITE_ID")
DIAGNOSIS_ALIASES = ("diagnosis", "group", "Group", "dx", "Diagnosis", "condition", "participant_group")
AGE_ALIASES = ("age", "Age", "AGE")
SEX_ALIASES = ("gender", "sex", "Gender", "Sex")
REST_ALIASES = ("rest", "resting", "task-rest")
ANAT_ALIASES = ("T1w", "t1w", "anat")
UNAVAILABLE = ("0", "no", "No", "n/a")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV, by whether the first line holds a tab."""
    head = spark.read.text(path).head()
    return spark.read.csv(path, header=True, sep="\t" if head and "\t" in head[0] else ",")


def first_alias(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First non-blank value among the alias columns that exist."""
    present = [F.col(f"`{a}`").cast("string") for a in aliases if a in df.columns]
    clean = [F.nullif(F.trim(F.regexp_replace(c, '"', "")), F.lit("")) for c in present]
    return F.coalesce(*clean) if clean else F.lit(None).cast("string")


def first_column(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The values of the first alias column that exists, blank ones as NULL."""
    return first_alias(df, [a for a in aliases if a in df.columns][:1])


def site_phenotypes(rows: DataFrame, order: str) -> DataFrame:
    """Coded site tables -> (sub_id, site, group, dx, age, sex); the last row of an id wins.

    ``rows`` needs ScanDir ID, site, DX, Age and Gender; ``order`` ranks repeated ids. Missing codes
    become Unknown or -1.
    """
    sub = F.trim(F.col("`ScanDir ID`").cast("string"))
    dx = F.trim(F.coalesce(F.col("DX").cast("string"), F.lit("")))
    out = rows.filter(F.coalesce(sub, F.lit("")) != "").select(
        sub.alias("sub_id"), "site", group_from_dx(dx).alias("group"),
        F.when(dx.rlike(r"^\d+$"), dx.try_cast("int")).otherwise(-1).alias("dx"),
        F.coalesce(F.trim(F.col("Age").cast("string")).try_cast("double"), F.lit(-1.0)).alias("age"),
        sex_from_code("Gender").alias("sex"), F.col(order).alias("_o"),
    )
    last = F.row_number().over(Window.partitionBy("sub_id").orderBy(F.desc("_o")))
    return out.withColumn("_rn", last).filter("_rn = 1").drop("_rn", "_o")


def aliased_phenotypes(rows: DataFrame) -> DataFrame:
    """Tables with varying column names -> (sub_id, site, group, age, sex)."""
    one = lambda *names: first_alias(rows, names)
    sub = first_alias(rows, ID_ALIASES)
    return rows.select(
        sub.alias("sub_id"), F.coalesce(first_alias(rows, SITE_ALIASES), F.lit("")).alias("site"),
        group_from_flags(one("DX", "dx"), one("adhd", "ADHD"), one("tdc", "TDC")).alias("group"),
        F.coalesce(one("Age", "age").try_cast("double"), F.lit(-1.0)).alias("age"),
        F.coalesce(one("Sex", "sex", "Gender"), F.lit("")).alias("sex"),
    ).filter(F.col("sub_id").isNotNull() & (F.col("sub_id") != "NA"))


def healthy_adults(participants: DataFrame, dataset: str, min_age: float = 18) -> DataFrame:
    """Participants that count as healthy adults with the needed data.

    Of the columns known for an attribute the first present one counts, so a blank diagnosis beside a
    filled group is no healthy one. Without a diagnosis column everyone counts as healthy; an unknown age passes.
    """
    has_diagnosis = any(a in participants.columns for a in DIAGNOSIS_ALIASES)
    diagnosis, age = first_column(participants, DIAGNOSIS_ALIASES), parse_age(first_column(participants, AGE_ALIASES))
    healthy = is_healthy(diagnosis) if has_diagnosis else F.lit(True)
    available = lambda names: ~F.coalesce(first_column(participants, names).isin(*UNAVAILABLE), F.lit(False))
    rows = participants.select(
        F.lit(dataset).alias("dataset_id"), F.trim("participant_id").alias("participant_id"), age.alias("age"),
        F.coalesce(first_column(participants, SEX_ALIASES), F.lit("")).alias("gender"), available(REST_ALIASES).alias("has_rest"),
        available(ANAT_ALIASES).alias("has_t1w"), F.coalesce(diagnosis, F.lit("assumed_hc")).alias("diagnosis"), healthy.alias("_ok"),
    )
    ok = F.col("_ok") & (F.col("age").isNull() | (F.col("age") >= min_age)) & F.col("has_rest") & F.col("has_t1w")
    return rows.filter((F.col("participant_id") != "") & ok).drop("_ok")


def union_indexes(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
