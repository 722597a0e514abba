"""Agreement between edge vectors: Pearson, Spearman, error norms, rater agreement, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.functions.reliability import clip
from reliaspan.operators.blocks import Block, group_count, meet, pack_blocks, row_slices, same_keys
from reliaspan.operators.cluster import BLOCK_ROWS, block_count
from reliaspan.operators.connectivity import KEYS, moment_corr, pack_edges
from reliaspan.operators.edges import pack_symmetric
from reliaspan.operators.kernels import scalar_kernel
from reliaspan.operators.ranking import exact_quantiles
from reliaspan.session import materialise, spread


#: Similarities that differ by less are equal: those of copies differ by rounding only.
TIE = 1e-12


def average_rank_within(value: str, keys: Sequence[str]) -> Column:
    """Ranks with ties averaged inside one subject's edges (bounded by the channel pairs)."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(wide: DataFrame, a: str, b: str, keys: Sequence[str] = KEYS, name: str = "spearman") -> DataFrame:
    """Spearman correlation of two edge columns per key; pairs with a missing side are dropped."""
    rows = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumn("_ra", average_rank_within(a, keys)).withColumn("_rb", average_rank_within(b, keys))
    return ranked.groupBy(*keys).agg(moment_corr("_ra", "_rb").alias(name), F.count(F.lit(1)).alias("n_edges"))


def error_metrics(wide: DataFrame, true: str, estimate: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """r, mean absolute error and Frobenius norm of the full-matrix difference (both triangles)."""
    diff = F.col(true) - F.col(estimate)
    return wide.groupBy(*keys).agg(
        moment_corr(true, estimate).alias("rho"), F.avg(F.abs(diff)).alias("mae"), F.sqrt(2 * F.sum(diff * diff)).alias("frobenius")
    )


def condition_numbers(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """2-norm condition number of each subject's correlation matrix (unit diagonal)."""
    keys = list(keys)
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("i")).distinct()
    cells = edges.select(*keys, "i", "j", "r").unionByName(ends.select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("r")))
    packed = pack_symmetric(cells, keys, "r")
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("condition_number", T.DoubleType())])
    return spread(packed, *keys).mapInArrow(scalar_kernel(keys, np.linalg.cond, "condition_number"), schema)


def edge_agreement(wide: DataFrame, a: str, b: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two-rater agreement over edges: (MSB - MSW)/(MSB + MSW), clipped to +-1."""
    n, ma, mb = F.count(F.lit(1)), F.avg(a), F.avg(b)
    grand = (ma + mb) / 2
    between = n * ((ma - grand) * (ma - grand) + (mb - grand) * (mb - grand))
    within = F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / 2 / n
    return wide.groupBy(*keys).agg(clip(F.try_divide(between - within, between + within), -1, 1).alias("edge_icc"))


def window_icc(edges: DataFrame, keys: Sequence[str] = KEYS, window: str = "window_id") -> DataFrame:
    """One-way agreement between windows over edges; 0 below two windows or for a bad denominator."""
    keys = list(keys)
    per = edges.groupBy(*keys, window).agg(F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.count("r").alias("e"))
    k = F.col("k")
    agg = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.var_pop("m").alias("vm"), F.sum(F.col("v") * F.col("e")).alias("within"), F.max("e").alias("e")
    )
    msb = k * (F.col("vm") * k) / (k - 1)
    msw = F.col("within") / (k * (F.col("e") - 1))
    den = msb + (k - 1) * msw
    return agg.select(*keys, k.alias("n_windows"), F.when((k < 2) | (den <= 0), 0.0).otherwise(clip((msb - msw) / den, -1, 1)).alias("icc"))


def tertile_correlation(wide: DataFrame, a: str, b: str, reliability: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation inside reliability tertiles (33.3/66.7, lower bound closed); NULL below 3 edges."""
    keys = list(keys)
    cuts = wide.groupBy(*keys).agg(F.percentile(reliability, F.array(F.lit(0.333), F.lit(0.667))).alias("c"))
    x = F.col(reliability)
    tertile = F.when(x < F.col("c")[0], "t1_low").when(x < F.col("c")[1], "t2_mid").otherwise("t3_high")
    rows = wide.join(cuts, keys).withColumn("tertile", tertile)
    return rows.groupBy(*keys, "tertile").agg(
        F.when(F.count(F.lit(1)) > 2, moment_corr(a, b)).alias("r"), F.count(F.lit(1)).alias("n_edges")
    )


def edge_quartiles(wide: DataFrame, reference: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``quartile`` of |reference| per key; the last bin is closed."""
    cuts = wide.groupBy(*keys).agg(F.percentile(F.abs(reference), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_c"))
    x = F.abs(reference)
    q = F.when(x < F.col("_c")[0], 1).when(x < F.col("_c")[1], 2).when(x < F.col("_c")[2], 3).otherwise(4)
    return wide.join(cuts, list(keys)).withColumn("quartile", q).drop("_c")


def window_correlation(edges: DataFrame, keys: Sequence[str] = KEYS, window: str = "window_id") -> DataFrame:
    """Mean correlation over all window pairs, from window-level moments of standardised vectors.

    With z-scored window vectors the sum of all pair correlations is (|sum of vectors|^2 - k)/2, so
    no pair of windows is ever formed.
    """
    keys = list(keys)
    stats = edges.groupBy(*keys, window).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.count("r").alias("e"))
    z = F.try_divide(F.col("r") - F.col("m"), F.col("s") * F.sqrt("e"))
    summed = edges.join(stats, [*keys, window]).groupBy(*keys, "i", "j").agg(F.sum(z).alias("z"), F.count(z).alias("k"))
    k = F.max("k")
    return summed.groupBy(*keys).agg(F.when(k > 1, (F.sum(F.col("z") * F.col("z")) - k) / (k * (k - 1))).alias("mean_window_r"))


def adjacent_window_similarity(edges: DataFrame, keys: Sequence[str] = KEYS, window: str = "window_id") -> DataFrame:
    """(keys, window, r_prev): correlation with the previous window, by a lag along each edge."""
    prev = F.lag("r").over(Window.partitionBy(*keys, "i", "j").orderBy(window))
    rows = edges.withColumn("_p", prev).filter(F.col("_p").isNotNull())
    return rows.groupBy(*keys, window).agg(moment_corr("r", "_p").alias("r_prev"))


def fingerprint_ranks(short: DataFrame, reference: DataFrame, key: str = "subject_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, rank): 1 + how many subjects' references resemble a subject's short vector more than
    its own reference does. Vectors are (key, vec array<double>).

    Both sides are stored in blocks of bounded size; a task multiplies one with those of a group and returns
    only a count per subject, so similarities are never rows and vectors are not shuffled for a pair.
    """
    own = short.join(reference.withColumnRenamed("vec", "ref_vec"), key).select(key, "vec", _unit_dot("vec", "ref_vec").alias("self_sim"))
    usable = materialise(own.filter(F.col("self_sim").isNotNull()))
    stored = pack_blocks(reference, key, block_count(reference, block_rows), block_rows)
    left = pack_blocks(usable, key, block_count(usable, block_rows), block_rows, ["self_sim"])

    def count_greater(s: Block, rights: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        greater = np.zeros(len(s.keys), np.int64)
        own, unit = s.extra["self_sim"][:, None], _rows_unit(s.x)
        for r in rights:
            ok = r.x.std(axis=1) > 1e-14
            other = _rows_unit(np.where(ok[:, None], r.x, np.nan))  # a NaN is not greater
            for at, same in row_slices(s, r, same_keys(s, r)):
                more = unit[at] @ other.T > own[at] + TIE
                more[same] = False
                greater[at] += more.sum(axis=1)
        yield pa.RecordBatch.from_arrays([s.keys, pa.array(greater)], [key, "greater"])

    schema = T.StructType([short.schema[key], T.StructField("greater", T.LongType())])
    counts = meet(left, stored, group_count(reference.count()), count_greater, schema)
    return counts.groupBy(key).agg((F.sum("greater") + 1).alias("rank"))


def _rows_unit(m: np.ndarray) -> np.ndarray:
    m = m - m.mean(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _unit_dot(a: str, b: str) -> Column:
    """Pearson r of two equally long arrays, inside one row."""
    add = lambda x, y: x + y
    total = lambda c: F.aggregate(c, F.lit(0.0), add)
    n = F.size(a)
    ca = F.transform(a, lambda x: x - total(F.col(a)) / n)
    cb = F.transform(b, lambda x: x - total(F.col(b)) / n)
    prod = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    scale = F.sqrt(prod(ca, ca) * prod(cb, cb))
    return F.when(scale > 1e-14, prod(ca, cb) / scale)


def fingerprint_summary(ranks: DataFrame, by: Sequence[str] = (), min_subjects: int = 10) -> DataFrame:
    """Identification rate, mean and exact median rank."""
    by = list(by)
    base = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("identification_rate"), F.avg("rank").alias("mean_rank")
    ).filter(F.col("n") >= min_subjects)
    med = exact_quantiles(ranks.withColumn("rank", F.col("rank").cast("double")), "rank", [0.5], by).withColumnRenamed("q0", "median_rank")
    return base.join(med, by) if by else base.withColumn("_one", F.lit(1)).join(med.withColumn("_one", F.lit(1)), "_one").drop("_one")


def pack_vectors(edges: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return pack_edges(edges.select(*keys, "i", "j", F.col(value).alias("r")), keys, "vec")
