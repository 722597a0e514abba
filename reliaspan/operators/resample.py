"""Block bootstrap of short recordings and the reliability estimator built on it.

A short recording is a bounded prefix (``n_short`` rows), so one row per subject can carry it.
Replicates are numbered rows: the block starts come from a seeded hash, and the corrections,
medians and intervals are column expressions over (keys, seed, b).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.config import EstimatorConfig
from reliaspan.functions.hashing import seeded_hash
from reliaspan.functions.reliability import (
    CORRECTION_METHODS,
    clip,
    correct_attenuation,
    correct_by_name,
    fisher_z,
    fisher_z_inv,
)
from reliaspan.operators.connectivity import (
    KEYS,
    edge_similarity,
    fc_edges,
    moment_corr,
    pack_edges,
    side_by_side,
)
from reliaspan.operators.kernels import ar1_kernel, replicate_edge_kernel, replicate_kernel
from reliaspan.operators.slices import label_segments
from reliaspan.session import spread
from reliaspan.sources.panels import frames_to_samples


def block_lengths(short_frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_rows, ar1, block_len): twice the AR(1) decay length, kept within [5, max(5, n/4)]."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "channel").orderBy("t")
    pairs = frames_to_samples(short_frames).withColumn("prev", F.lag("value").over(w))
    per_channel = pairs.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.var_pop("prev").alias("vp"),
        F.var_pop(F.when(F.col("prev").isNotNull(), F.col("value"))).alias("vn"),
        F.covar_pop("prev", "value").alias("cv"),
    )
    usable = (F.col("vp") > 1e-10) & (F.col("vn") > 1e-10)
    r = F.when(usable, F.try_divide(F.col("cv"), F.sqrt(F.col("vp") * F.col("vn"))))
    ar1 = per_channel.groupBy(*keys).agg(
        F.max("n_rows").cast("int").alias("n_rows"), F.coalesce(F.avg(r), F.lit(0.0)).alias("ar1")
    )
    return ar1.withColumn("block_len", block_length())


def block_length() -> Column:
    n = F.col("n_rows")
    decay = (F.ceil(F.lit(-2.0) / F.log(clip("ar1", 0.01, 0.99))) * 2).cast("int")
    upper = F.greatest(F.lit(5), F.floor(n / 4).cast("int"))
    bounded = F.greatest(F.lit(5), F.least(decay, upper))
    return F.when(n < 5, n).otherwise(bounded).cast("int")


def block_starts(keys: Sequence[str], seed: Column, b: Column, block: Column) -> Column:
    """Start row of one block, uniform in [0, n_rows - block_len]."""
    h = seeded_hash(*[F.col(k) for k in keys], seed, b, block)
    return (h % (F.col("n_rows") - F.col("block_len") + 1)).cast("int")


def block_count() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("n_rows") / F.col("block_len")).cast("int"))


def replicate_starts(keys: Sequence[str], n_bootstraps: int) -> Column:
    """The block starts of all replicates of a row, one replicate after the other."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_bootstraps - 1)),
            lambda b: F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: block_starts(keys, F.col("seed"), b, k)),
        )
    )


def bootstrap_indices(
    lengths: DataFrame, n_bootstraps: int, seeds: Sequence[int] = (0,), keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, seed, b, pos, src_t): which source row stands at each position of each replicate.

    ``lengths`` has (keys, n_rows, block_len). Generators only, no join and no shuffle.
    """
    keys = list(keys)
    blocks = (
        lengths.withColumn("block_len", F.greatest(F.lit(1), F.least("block_len", "n_rows")))
        .withColumn("n_blocks", block_count())
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("start", block_starts(keys, F.col("seed"), F.col("b"), F.col("block")))
    )
    offsets = F.explode(F.sequence(F.lit(0), F.col("block_len") - 1))
    return blocks.withColumn("off", offsets).select(
        *keys, "seed", "b",
        (F.col("block") * F.col("block_len") + F.col("off")).alias("pos"),
        (F.col("start") + F.col("off")).alias("src_t"),
        F.floor(F.col("n_blocks") * F.col("block_len") / 2).cast("int").alias("half_at"),
    )


def pack_recordings(frames: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per key holding a bounded recording row-major. Callers slice to a fixed length first."""
    rows = F.array_sort(F.collect_list(F.struct("t", "x")))
    return (
        frames.groupBy(*keys)
        .agg(rows.alias("rows"), F.max(F.size("x")).alias("p"), *[F.first(c).alias(c) for c in carry])
        .select(*keys, *carry, F.flatten(F.transform("rows", lambda e: e["x"])).alias("rec"), "p")
    )


def replicate_scores(
    short_frames: DataFrame,
    reference: DataFrame,
    n_bootstraps: int,
    seeds: Sequence[int] = (0,),
    keys: Sequence[str] = KEYS,
    kind: str | Sequence[str] = "ledoit_wolf",
    fisher: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(keys, carry, n_rows, seed, b, r_obs, r_split) for every bootstrap replicate.

    ``short_frames`` must already be cut to the short window; ``reference`` is an edge table in
    the space chosen by ``kind``/``fisher`` (or an already packed ``ref`` column), keyed by ``keys``
    or a subset of them. ``carry`` names columns of ``short_frames`` that are constant per key.
    Several kinds may be given at once; the result then has a ``kind`` column.
    Both sides are one row per key; only bounded arrays meet, and replicates never shuffle.
    """
    keys = list(keys)
    ref_keys = [k for k in keys if k in reference.columns]
    packed = reference if "ref" in reference.columns else pack_edges(reference, ref_keys)
    recordings = pack_recordings(short_frames, keys, carry)
    fields = [*recordings.schema.fields, T.StructField("n_rows", T.IntegerType()), T.StructField("ar1", T.DoubleType())]
    measured = recordings.mapInArrow(ar1_kernel, T.StructType(fields)).withColumn("block_len", block_length())
    sides = measured.join(packed.select(*ref_keys, "ref"), ref_keys)
    starts = replicate_starts(keys, n_bootstraps)
    kinds = [kind] if isinstance(kind, str) else list(kind)
    seeded = (
        sides.withColumn("n_blocks", block_count())
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    )
    jobs = spread(seeded, *keys, "seed", "kind").select(
        *keys, *carry, "n_rows", "seed", "kind", "rec", "p", "ref", "block_len", "n_blocks", starts.alias("starts")
    )
    carried = [*keys, *carry, "n_rows", "seed", *([] if isinstance(kind, str) else ["kind"])]
    fields = [jobs.schema[k] for k in carried] + [T.StructField("b", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("r_obs", "r_split")]
    scores = jobs.mapInArrow(replicate_kernel(carried, fisher), T.StructType(fields))
    return scores.select(
        *carried, "b",
        F.nanvl("r_obs", F.lit(None).cast("double")).alias("r_obs"),
        clip(F.nanvl("r_split", F.lit(None).cast("double")), 0.001, 0.999).alias("r_split"),
    )


def replicate_scores_relational(
    short_frames: DataFrame,
    reference: DataFrame,
    n_bootstraps: int,
    seeds: Sequence[int] = (0,),
    keys: Sequence[str] = KEYS,
    fisher: bool = False,
) -> DataFrame:
    """The same replicates through joins and pair moments, with resampling as row weights."""
    keys = list(keys)
    rep = [*keys, "seed", "b"]
    lengths = block_lengths(short_frames, keys)
    weights = (
        bootstrap_indices(lengths, n_bootstraps, seeds, keys)
        .withColumn("half", F.when(F.col("pos") < F.col("half_at"), 1).otherwise(2))
        .groupBy(*rep, "half", F.col("src_t").alias("t"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    rows = label_segments(
        weights.join(short_frames, [*keys, "t"]),
        {"whole": F.lit(True), "first": F.col("half") == 1, "second": F.col("half") == 2},
    )
    edges = fc_edges(rows, [*rep, "seg"], "ledoit_wolf", weight="w")
    wide = side_by_side(edges, rep, "seg", ("whole", "first", "second"))
    whole = fisher_z("whole") if fisher else F.col("whole")
    ref_keys = [k for k in keys if k in reference.columns]
    return (
        wide.join(reference.withColumnRenamed("r", "ref"), [*ref_keys, "i", "j"])
        .groupBy(*rep)
        .agg(
            moment_corr(whole, F.col("ref")).alias("r_obs"),
            clip(moment_corr("first", "second"), 0.001, 0.999).alias("r_split"),
        )
        .join(lengths.select(*keys, "n_rows"), keys)
    )


def split_half(frames: DataFrame, n_rows, keys: Sequence[str] = KEYS, kind: str = "ledoit_wolf") -> DataFrame:
    """(keys, r_split): similarity of the connectivity of the two halves of a whole recording."""
    keys = list(keys)
    middle = F.floor((F.col(n_rows) if isinstance(n_rows, str) else F.lit(n_rows)) / 2)
    halves = label_segments(frames, {"first": F.col("t") < middle, "second": F.col("t") >= middle}, "half")
    wide = side_by_side(fc_edges(halves, [*keys, "half"], kind), keys, "half", ("first", "second"))
    return wide.groupBy(*keys).agg(clip(moment_corr("first", "second", strict=True), 0.001, 0.999).alias("r_split"))


def summarise(
    replicates: DataFrame, z: Column, keys: Sequence[str], with_scores: bool = False, space: str = "z"
) -> DataFrame:
    """Median and 95 % percentile interval of replicate scores, back-transformed from z space.

    The median skips missing replicates; the interval is missing if any replicate is.
    """
    scored = replicates.withColumn("z", z)
    back = fisher_z_inv if space == "z" else (lambda c: c)
    aggs = [
        F.percentile("z", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"),
        (F.count(F.lit(1)) == F.count("z")).alias("complete"),
    ]
    if with_scores:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("b", "z"))), lambda e: e["z"]).alias("z_scores"))
    out = scored.groupBy(*keys).agg(*aggs)
    cols = [
        back(F.col("q")[0]).alias("rho_hat_t"),
        F.when(F.col("complete"), back(F.col("q")[1])).alias("ci_lower"),
        F.when(F.col("complete"), back(F.col("q")[2])).alias("ci_upper"),
    ]
    return out.select(*keys, *cols, *(["z_scores"] if with_scores else []))


def corrected_z(config: EstimatorConfig, k, method: str = "original") -> Column:
    rho = correct_attenuation(
        "r_obs", config.reliability_coeff, "r_split", k, config.empirical_prior, method, config.observation_var
    )
    return fisher_z(rho)


def bootstrap_estimate(
    short_frames: DataFrame,
    reference: DataFrame,
    config: EstimatorConfig,
    seeds: Sequence[int] | None = None,
    k=None,
    method: str = "original",
    keys: Sequence[str] = KEYS,
    kind: str = "ledoit_wolf",
    fisher: bool = False,
    with_scores: bool = False,
) -> DataFrame:
    """Estimated reliability at the target duration per (keys, seed), with its interval."""
    seeds = [config.seed] if seeds is None else list(seeds)
    reps = replicate_scores(short_frames, reference, config.n_bootstraps, seeds, keys, kind, fisher)
    return summarise(reps, corrected_z(config, config.k_factor if k is None else k, method), [*keys, "seed"], with_scores)


def all_methods(replicates: DataFrame, config: EstimatorConfig, k, keys: Sequence[str]) -> DataFrame:
    """Every correction on the same replicates."""
    rows = replicates.withColumn("method", F.explode(F.array(*[F.lit(m) for m in CORRECTION_METHODS])))
    rho = correct_by_name(
        "method", "r_obs", config.reliability_coeff, "r_split", k, config.empirical_prior, config.observation_var
    )
    return summarise(rows, fisher_z(rho), [*keys, "method"])


def seed_summary(estimates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, population SD and range of the estimate over seeds, and mean interval bounds."""
    return estimates.groupBy(*keys).agg(
        F.avg("rho_hat_t").alias("rho_mean"),
        F.stddev_pop("rho_hat_t").alias("rho_std"),
        F.min("rho_hat_t").alias("rho_min"),
        F.max("rho_hat_t").alias("rho_max"),
        F.avg("ci_lower").alias("ci_lower_mean"),
        F.avg("ci_upper").alias("ci_upper_mean"),
    )


def window_estimates(window_rho: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over per-window estimates; percentile interval from four windows on, else +-1 SD."""
    agg = window_rho.withColumn("z", fisher_z("rho_hat_t")).groupBy(*keys).agg(
        F.percentile("z", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"),
        F.stddev_pop("z").alias("sd"),
        F.count("z").alias("n_windows"),
    )
    mid = F.col("q")[0]
    enough = F.col("n_windows") >= 4
    return agg.select(
        *keys,
        F.tanh(mid).alias("rho_hat_t"),
        F.tanh(F.when(enough, F.col("q")[1]).otherwise(mid - F.col("sd"))).alias("ci_lower"),
        F.tanh(F.when(enough, F.col("q")[2]).otherwise(mid + F.col("sd"))).alias("ci_upper"),
        "n_windows",
    )


def replicate_edges(
    short_frames: DataFrame,
    lengths: DataFrame,
    n_bootstraps: int,
    seeds: Sequence[int] = (0,),
    keys: Sequence[str] = KEYS,
    kind: str = "pearson",
    fisher: bool = False,
) -> DataFrame:
    """(keys, seed, b, i, j, r): connectivity of every replicate.

    ``lengths`` has (keys, n_rows, block_len). One row per key carries its bounded recording, so resampled rows do not shuffle.
    """
    keys = list(keys)
    sides = pack_recordings(short_frames, keys, ["channels"]).join(lengths, keys)
    seeded = (
        sides.withColumn("block_len", F.greatest(F.lit(1), F.least("block_len", "n_rows")))
        .withColumn("n_blocks", block_count())
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    )
    jobs = spread(seeded, *keys, "seed").select(*keys, "seed", "channels", "rec", "block_len", "n_blocks", replicate_starts(keys, n_bootstraps).alias("starts"))
    fields = [jobs.schema[k] for k in (*keys, "seed")] + [T.StructField(c, T.IntegerType()) for c in ("b", "i", "j")]
    return jobs.mapInArrow(replicate_edge_kernel([*keys, "seed"], kind, fisher), T.StructType([*fields, T.StructField("r", T.DoubleType())]))


def average_edges(edges: DataFrame, keys: Sequence[str] = KEYS, how: str = "mean") -> DataFrame:
    """Mean or median connectivity over replicates."""
    value = F.avg("r") if how == "mean" else F.percentile("r", F.lit(0.5))
    return edges.groupBy(*keys, "i", "j").agg(value.alias("r"))


def edge_reliability(replicates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 - SD over replicates / largest SD of the subject, per edge; 1 where all replicates are alike but for rounding noise."""
    deviation = F.stddev_pop("r")
    sd = replicates.groupBy(*keys, "i", "j").agg(F.when(deviation < 1e-12, 0.0).otherwise(deviation).alias("sd"))
    top = F.max("sd").over(Window.partitionBy(*keys))
    scale = F.when(top > 0, top).otherwise(1.0)
    return sd.select(*keys, "i", "j", (1 - F.col("sd") / scale).alias("reliability"))


def channel_reliability(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean reliability of the edges at each channel."""
    ends = edges.withColumn("channel", F.explode(F.array("i", "j")))
    return ends.groupBy(*keys, "channel").agg(F.avg("reliability").alias("reliability"))


def reference_similarity(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, name: str = "r_fc") -> DataFrame:
    return edge_similarity(left, right, keys, name)
