"""Cohort tables: funnels, strata, lookups and key normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.functions.parsing import strip_leading_zeros
from reliaspan.functions.reliability import as_col

# Sampling interval in seconds by site name.
SITE_INTERVALS = (
    ("Caltech", 2.0), ("CMU", 2.0), ("KKI", 2.5), ("Leuven", 1.667), ("MaxMun", 3.0), ("NYU", 2.0), ("OHSU", 2.5),
    ("Olin", 1.5), ("Pitt", 1.5), ("SBL", 2.2), ("SDSU", 2.0), ("Stanford", 2.0), ("Trinity", 2.0), ("UCLA", 3.0),
    ("UM", 2.0), ("USM", 2.0), ("Yale", 2.0),
)
DEFAULT_INTERVAL = 2.0


def derive_durations(subjects: DataFrame, n_short) -> DataFrame:
    """Adds total_s, short_s, ref_s and the lengthening factor k from n_rows and tr."""
    n, tr, short = F.col("n_rows"), F.col("tr"), as_col(n_short)
    return subjects.withColumns(
        {"total_s": n * tr, "short_s": short * tr, "ref_s": (n - short) * tr, "k": n / short}
    )


def funnel_rules(mode: str, known_groups: Sequence[str] | None = None) -> list[tuple[str, Column]]:
    """Ordered (stage, pass condition). Modes: liberal, moderate, strict."""
    if mode not in ("liberal", "moderate", "strict"):
        raise ValueError(f"unknown funnel mode {mode!r}")
    rules = []
    if known_groups is not None:
        rules.append(("known_diagnosis", F.col("group").isin(*known_groups)))
    rules.append(("k_at_least_2", F.col("k") >= 2.0))
    if mode != "liberal":
        rules.append(("reference_long_enough", F.col("ref_s") >= (300 if mode == "strict" else 180)))
    if mode == "moderate" and known_groups is None:
        rules.append(("total_at_least_300s", F.col("total_s") >= 300))
    return rules


def first_failure(subjects: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``failed``: index (1-based) of the first stage a subject fails, NULL when it passes all."""
    out = F.lit(None).cast("int")
    for k, (_, ok) in reversed(list(enumerate(rules, start=1))):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)).otherwise(out)
    return subjects.withColumn("failed", out)


def funnel_report(subjects: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(stage, name, n, n_sites, n_excluded, excluded_sites map) per stage, stage 0 being everyone.

    One pass counts (first failure, site); the stages are then summed over that small table.
    """
    names = ["enrolled", *[n for n, _ in rules]]
    cells = first_failure(subjects, rules).groupBy("failed", "site").agg(F.count(F.lit(1)).alias("n"))
    stages = F.explode(F.sequence(F.lit(0), F.lit(len(rules))))
    per = cells.withColumn("stage", stages)
    inside = F.col("failed").isNull() | (F.col("failed") > F.col("stage"))
    out = F.col("failed") == F.col("stage")
    site_rows = per.groupBy("stage", "site").agg(
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("x")
    )
    lost = F.collect_list(F.when(F.col("x") > 0, F.struct("site", "x")))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("stage") + 1)
    return site_rows.groupBy("stage").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).cast("bigint").alias("n_sites"), F.sum("x").alias("n_excluded"),
        F.map_from_entries(F.array_sort(lost)).alias("excluded_sites"),
    ).withColumn("name", name)


def passing(subjects: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    cond = F.lit(True)
    for _, ok in rules:
        cond = cond & ok
    return subjects.filter(cond)


def k_group(k) -> Column:
    """Bins [0,2), [2,3), [3,4), [4,inf)."""
    k = as_col(k)
    return F.when(k < 2, "k<2").when(k < 3, "2<=k<3").when(k < 4, "3<=k<4").when(k >= 4, "k>=4")


def lookup_default(rows: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup with a default for missing keys."""
    return rows.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def missing_keys(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(dim, key, "left_anti")


def lookup_strict(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner lookup that refuses missing keys (checks with one anti-join job)."""
    gone = missing_keys(rows, dim, key).take(1)
    if gone:
        raise KeyError(f"no {key} entry for {gone[0][0]!r}")
    return rows.join(dim, key)


def lookup_normalised(rows: DataFrame, dim: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Match on the raw id, and where that fails on the id without leading zeros.

    ``dim`` is keyed by text. Both lookups are equi-joins.
    """
    raw = dim.select(F.col(key).cast("string").alias("_raw"), *[F.col(v).alias(f"_a_{v}") for v in values])
    bare = dim.select(F.col(key).cast("string").alias("_bare"), *[F.col(v).alias(f"_b_{v}") for v in values])
    out = (
        rows.join(raw, rows[key].cast("string") == F.col("_raw"), "left")
        .join(bare, strip_leading_zeros(rows[key]) == F.col("_bare"), "left")
    )
    picks = [F.when(F.col("_raw").isNotNull(), F.col(f"_a_{v}")).otherwise(F.col(f"_b_{v}")).alias(v) for v in values]
    return out.select(*rows.columns, *picks)


def site_interval(site, table: Sequence[tuple[str, float]] = SITE_INTERVALS, default: float = DEFAULT_INTERVAL) -> Column:
    """Interval of the first table entry whose name occurs in the site text, case-insensitively.

    The table is a handful of fixed entries, so the match is one CASE expression, not a join.
    """
    text = F.lower(as_col(site).cast("string"))
    out = F.lit(default)
    for name, tr in reversed(table):
        out = F.when(text.contains(name.lower()), F.lit(tr)).otherwise(out)
    return out


def first_settings(settings: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Drop repeated settings; the lowest priority number of each key wins."""
    w = Window.partitionBy(*keys).orderBy(priority)
    return settings.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def finite(*cols) -> Column:
    """All columns present, not NaN and not infinite."""
    out = F.lit(True)
    for c in cols:
        c = as_col(c)
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def grid(subjects: DataFrame, **axes: Sequence) -> DataFrame:
    """Every subject with every combination of the given axis values, generated row by row."""
    out = subjects
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


#: Values in one array of a `with_each` table, about.
CHUNK = 1024


def with_each(subjects: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Every subject with every value of the column `name` of a table of distinct values.

    The values travel in arrays of about CHUNK, which subjects meet by an equi-join on chunk and salt; the driver sees
    their number only. A column of that name in `subjects` is replaced.
    """
    chunks = max(1, -(-values.count() // CHUNK))
    salts = max(1, int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = values.groupBy(F.pmod(F.xxhash64(name), F.lit(chunks)).alias("_chunk")).agg(F.collect_list(F.struct(name)).alias("_values"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = subjects.drop(name)
    salted = plain.withColumn("_salt", F.pmod(F.xxhash64(*plain.columns), F.lit(salts)).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    out = salted.join(packed, ["_chunk", "_salt"]).withColumn("_value", F.explode("_values"))
    return out.select(*plain.columns, F.col(f"_value.{name}").alias(name))


def positional_join(left: DataFrame, right: DataFrame, position: str = "pos", check: Sequence[str] = ()) -> DataFrame:
    """Join two tables row by row on their stored position, insisting on equal counts.

    ``check`` names columns present on both sides whose values must agree.
    """
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"row counts differ: {n_left} and {n_right}")
    other = right.select(position, *[F.col(c).alias(f"_chk_{c}") if c in check else F.col(c) for c in right.columns if c != position])
    out = left.join(other, position)
    for c in check:
        if out.filter(~F.col(c).eqNullSafe(F.col(f"_chk_{c}"))).take(1):
            raise ValueError(f"column {c} differs between the two tables")
    return out.drop(*[f"_chk_{c}" for c in check])


def balanced_allocation(pool_sizes: DataFrame, n_total: int, key: str = "dataset") -> DataFrame:
    """(key, pool, n_alloc): proportional share, floored, at least 1, capped at the pool; what is
    left goes to the largest pools in turn. One row per dataset, so the windows stay small."""
    everything = Window.partitionBy()
    total = F.sum("pool").over(everything)
    share = F.least(F.greatest(F.lit(1), F.floor(F.lit(n_total) * F.col("pool") / total)), F.col("pool")).cast("bigint")
    base = pool_sizes.withColumn("total", total).withColumn("base", share)
    left = base.withColumn("rest", F.greatest(F.lit(n_total) - F.sum("base").over(everything), F.lit(0)))
    room = F.col("pool") - F.col("base")
    before = F.coalesce(
        F.sum(room).over(Window.orderBy(F.desc("pool"), key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    extra = F.greatest(F.least(room, F.col("rest") - before), F.lit(0))
    n = F.when(F.col("total") <= n_total, F.col("pool")).otherwise(F.col("base") + extra)
    return left.select(key, "pool", n.cast("bigint").alias("n_alloc"))
