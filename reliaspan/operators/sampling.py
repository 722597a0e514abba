"""Seeded sampling, splitting and fold assignment, all in the order of a key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.functions.hashing import seeded_hash
from reliaspan.operators.cohort import balanced_allocation
from reliaspan.operators.ranking import number_by_hash


def _order(key: str, seed, salt: str) -> Column:
    return seeded_hash(F.col(key), seed, salt)


def train_test_split(subjects: DataFrame, test_ratio: float, seed: int, key: str = "subject_id") -> DataFrame:
    """Adds ``split``; the test side takes max(1, int(n * ratio)) subjects."""
    n = F.count(F.lit(1))
    total = subjects.agg(F.greatest(F.lit(1), F.floor(n * test_ratio)).cast("bigint").alias("n_test"))
    n_test = total.first()["n_test"]
    ranked = number_by_hash(subjects, [], _order(key, seed, "split"), [key])
    return ranked.withColumn("split", F.when(F.col("rn") <= n_test, "test").otherwise("train")).drop("rn")


def sample_subjects(subjects: DataFrame, n: int, seed: int, key: str = "subject_id") -> DataFrame:
    """``n`` subjects without replacement, in key order (Spark takes the top n per task first)."""
    picked = subjects.withColumn("_h", _order(key, seed, "sample")).orderBy("_h", key).limit(n).drop("_h")
    return picked.orderBy(key)


def proportional_sample(records: DataFrame, n_total: int, seed: int, dataset: str = "dataset", key: str = "subject_id") -> DataFrame:
    """Seeded sample whose per-dataset sizes follow ``balanced_allocation``."""
    sizes = records.groupBy(dataset).agg(F.count(F.lit(1)).alias("pool"))
    ranked = number_by_hash(records, [dataset], _order(key, seed, "pool"), [key])
    return ranked.join(balanced_allocation(sizes, n_total, dataset), dataset).filter(F.col("rn") <= F.col("n_alloc")).drop("rn", "pool")


def stratified_folds(subjects: DataFrame, k: int, seed: int, label: str = "label", repeats: int = 1, key: str = "subject_id") -> DataFrame:
    """Adds (repeat, fold): each class is shuffled by hash and dealt round-robin into k folds."""
    rows = subjects.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = number_by_hash(rows, ["repeat", label], seeded_hash(F.col(key), seed, F.col("repeat"), "fold"), [key])
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def site_folds(subjects: DataFrame, site: str = "site") -> DataFrame:
    """Leave-one-site-out: the site is the fold."""
    return subjects.withColumn("fold", F.col(site))


def balanced_downsample(subjects: DataFrame, seed: int, label: str = "label", key: str = "subject_id", by: Sequence[str] = ()) -> DataFrame:
    """Equal class sizes by keeping the first min-class-count subjects of every shuffled class."""
    by = list(by)
    sizes = subjects.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.groupBy(*by).agg(F.min("_n").alias("_keep"))
    ranked = number_by_hash(subjects, [*by, label], _order(key, seed, "balance"), [key])
    joined = ranked.join(smallest, by) if by else ranked.withColumn("_keep", F.lit(smallest.first()["_keep"]))
    return joined.filter(F.col("rn") <= F.col("_keep")).drop("rn", "_keep")


def permuted_labels(
    subjects: DataFrame, n_perm: int, seed: int, label: str = "label", key: str = "subject_id", within: Sequence[str] = ()
) -> DataFrame:
    """(perm, key, label): labels re-paired with subjects, freely or inside each site.

    Subject positions by key hash, ranked once, and by a permutation hash are matched, so a
    permutation is one equi-join on (within, position).
    """
    within = list(within)
    rows = subjects.select(key, label, *within).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    at = number_by_hash(subjects.select(key, *within), within, seeded_hash(F.col(key), seed, "anchor"), [key])
    to = number_by_hash(rows, ["perm", *within], seeded_hash(F.col(key), seed, F.col("perm"), "perm"), [key])
    return at.join(to.select("perm", *within, "rn", label), [*within, "rn"]).select("perm", key, *within, label)
