"""Positions and quantiles over whole tables without a window that spans a whole table or class.

A row's position is its rank inside a bucket plus the number of rows in earlier buckets. Buckets
are order-preserving, so only the small bucket counts meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.functions.hashing import hash_bucket
from reliaspan.session import ensure_checkpoint_dir

BUCKETS = 1024


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "rn") -> DataFrame:
    """1-based position of each row within ``by``; ``bucket`` must rise with the leading order column.

    There are as many bucket counts as groups times buckets, so they are merged with the rows, which the
    window leaves partitioned and sorted for it; a broadcast of them would grow with the groups.
    """
    by = list(by)
    marked = df.withColumn("_bkt", bucket)
    before = _offsets(marked, by)
    local = F.row_number().over(Window.partitionBy(*by, "_bkt").orderBy(*order))
    return (
        marked.withColumn("_local", local).join(before.hint("merge"), [*by, "_bkt"])
        .withColumn(name, F.col("_before") + F.col("_local")).drop("_bkt", "_local", "_before")
    )


def number_by_hash(df: DataFrame, by: Sequence[str], h: Column, tie: Sequence[str], name: str = "rn") -> DataFrame:
    """Position in the order of a seeded hash (a reproducible shuffle of each group)."""
    hashed = df.withColumn("_h", h)
    return number_rows(hashed, by, ["_h", *tie], hash_bucket(F.col("_h"), BUCKETS), name).drop("_h")


def cumulate(df: DataFrame, by: Sequence[str], order: str, bucket: Column, sums: dict[str, str]) -> DataFrame:
    """Running totals along ``order`` within ``by``, current row included: {output: input column}.

    ``order`` must be unique within ``by`` (aggregate equal values first).
    """
    by = list(by)
    marked = df.withColumn("_bkt", bucket)
    per = marked.groupBy(*by, "_bkt").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*by, "_bkt", *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*by, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.withColumns({f"_l_{o}": F.sum(c).over(inside) for o, c in sums.items()}).join(before.hint("merge"), [*by, "_bkt"])
    out = out.withColumns({o: F.col(f"_l_{o}") + F.col(f"_b_{o}") for o in sums})
    return out.drop("_bkt", *[f"_l_{o}" for o in sums], *[f"_b_{o}" for o in sums])


def _offsets(marked: DataFrame, by: list[str]) -> DataFrame:
    counts = marked.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def with_value_bucket(df: DataFrame, value: str, buckets: int = BUCKETS, name: str = "_vb") -> DataFrame:
    """Adds an order-preserving bucket of a numeric column from approximate quantile cut points.

    The cut points (at most ``buckets`` numbers) are the only thing the driver sees.
    """
    probs = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(value, probs, 1 / (4 * buckets))))
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    out = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)
    return out.withColumn(name, F.col(name).cast("int"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q0, q1, ...): exact, linearly interpolated quantiles of groups of any size.

    Rows shrink to counts per distinct value first (combined on the map side, so heavy ties cost
    nothing); bucketed running totals then say which value holds each needed position. The counts are
    checkpointed because the cut points and the totals both read them.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))  # a struct matches NULL groups too
    ensure_checkpoint_dir(df.sparkSession)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(key.alias("_by"), F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .checkpoint()
    )
    ends = cumulate(with_value_bucket(counts, "_v"), ["_by"], "_v", F.col("_vb"), {"_end": "_n"})
    totals = counts.groupBy("_by").agg(F.sum("_n").alias("_total"))
    rows = ends.join(totals, "_by")
    inside = lambda idx: (idx >= F.col("_end") - F.col("_n")) & (idx < F.col("_end"))
    aggs = []
    for k, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        aggs += [
            F.max(F.when(inside(F.floor(pos)), F.col("_v"))).alias(f"_a{k}"), F.max(F.when(inside(F.ceil(pos)), F.col("_v"))).alias(f"_b{k}"),
            F.max(pos - F.floor(pos)).alias(f"_f{k}"),
        ]
    out = rows.groupBy("_by").agg(*aggs)
    lerp = [(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * F.col(f"_f{k}")).alias(f"q{k}") for k in range(len(probs))]
    return out.select(*[F.col(f"_by.{c}").alias(c) for c in by], *lerp)
