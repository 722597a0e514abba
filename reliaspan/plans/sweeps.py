"""Sweeps over durations, offsets, parameters and degradations.

``frames`` carries (subject_id, t, channels, x) plus ``tr`` and ``n_rows``. A sweep labels every row
with the segments it belongs to and runs one connectivity pass over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.config import EstimatorConfig
from reliaspan.functions.hashing import HASH_RANGE, seeded_hash
from reliaspan.functions.reliability import fisher_z
from reliaspan.operators.connectivity import fc_edges, moment_corr, pair_moments, shrunk_edges, side_by_side
from reliaspan.operators.resample import corrected_z, replicate_scores, summarise
from reliaspan.operators.slices import label_segments
from reliaspan.session import materialise


def rows_in(seconds) -> Column:
    return F.floor(F.lit(seconds) / F.col("tr")).cast("int")


def usable_durations(durations: Sequence[float], mode: str) -> dict[float, Column]:
    """Guard per duration: short + 10 rows fit; a split reference keeps max(12 rows, 30 s)."""
    out = {}
    for d in durations:
        ok = rows_in(d) + 10 <= F.col("n_rows")
        if mode == "split":
            ok = ok & (F.col("n_rows") - rows_in(d) >= F.greatest(F.lit(12), rows_in(30)))
        out[d] = ok
    return out


def duration_pairs(frames: DataFrame, durations: Sequence[float], mode: str = "full", fisher: bool = True) -> DataFrame:
    """(subject_id, duration_sec, i, j, short, ref): both sides of every usable duration.

    ``full`` compares with the whole recording (one shared segment), ``split`` with what follows the
    short window.
    """
    if mode not in ("full", "split"):
        raise ValueError(f"unknown reference mode {mode!r}")
    t, segs = F.col("t"), {}
    for k, (d, ok) in enumerate(usable_durations(durations, mode).items()):
        segs[f"short_{k}"] = ok & (t < rows_in(d))
        if mode == "split":
            segs[f"ref_{k}"] = ok & (t >= rows_in(d))
    if mode == "full":
        segs["ref"] = F.lit(True)
    edges = fc_edges(label_segments(frames, segs), ["subject_id", "seg"], "ledoit_wolf", fisher)
    wide = side_by_side(edges, ["subject_id"], "seg", list(segs))
    ref = lambda k: F.col("ref" if mode == "full" else f"ref_{k}")
    rows = F.explode(F.array(*[
        F.struct(F.lit(d).alias("duration_sec"), F.col(f"short_{k}").alias("short"), ref(k).alias("ref")) for k, d in enumerate(durations)
    ]))
    return wide.select("subject_id", "i", "j", rows.alias("e")).select("subject_id", "i", "j", "e.*").filter("short IS NOT NULL")


def duration_sweep(
    frames: DataFrame, durations: Sequence[float], seeds: Sequence[int], config: EstimatorConfig, mode: str = "full",
    method: str = "fisher_z", fisher: bool = True,
) -> DataFrame:
    """One row per subject, duration and seed: raw similarity, estimate with interval, improvement."""
    keys = ["subject_id", "duration_sec"]
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "ref"))), lambda e: e["ref"])
    sides = materialise(duration_pairs(frames, durations, mode, fisher).groupBy(*keys).agg(
        moment_corr("short", "ref", strict=True).alias("r_fc_raw"), packed.alias("ref")
    ))
    usable = usable_durations(durations, mode)
    picks = F.array_compact(F.array(*[F.when(ok & (F.col("t") < rows_in(d)), F.lit(d)) for d, ok in usable.items()]))
    short = frames.withColumn("duration_sec", F.explode(picks))
    reps = replicate_scores(short, sides, config.n_bootstraps, seeds, keys, "ledoit_wolf", fisher, ["tr"])
    target = F.floor(F.lit(config.target_duration_min * 60) / F.col("tr"))
    est = summarise(reps, corrected_z(config, target / F.col("n_rows"), method), [*keys, "seed"])
    return est.join(sides.select(*keys, "r_fc_raw"), keys).withColumn("improvement", F.col("rho_hat_t") - F.col("r_fc_raw"))


def seed_first_summary(sweep: DataFrame) -> DataFrame:
    """Mean over subjects per (duration, seed), then mean and population SD over seeds."""
    rows = sweep.withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))
    names = {"r_fc_raw": "r_fc", "rho_hat_t": "rho_hat_t", "improvement": "improvement", "ci_width": "ci_width"}
    per_seed = rows.groupBy("duration_sec", "seed").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])
    aggs = []
    for c, out in names.items():
        aggs += [F.avg(c).alias(f"{out}_mean"), F.stddev_pop(c).alias(f"{out}_sd")]
    return per_seed.groupBy("duration_sec").agg(
        F.max_by("n", "seed").alias("n_subjects"), F.count(F.lit(1)).alias("n_seeds"), *aggs
    )


def subject_first_summary(rows: DataFrame, by: str, values: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """Mean over seeds per subject, then mean and sample SD over subjects."""
    per = rows.groupBy(by, subject).agg(*[F.avg(v).alias(v) for v in values])
    aggs = [F.count(F.lit(1)).alias("n_subjects")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return per.groupBy(by).agg(*aggs)


def convergence_similarity(frames: DataFrame, tau_shorts: Sequence[float], tau_refs: Sequence[float]) -> DataFrame:
    """(subject_id, tau_short, tau_ref, r_fc): a fixed short window against a growing reference.

    The reference row belongs to the first bin that covers it; pair moments are summed per bin and
    then cumulated over bins, so every reference length comes from one pass over the rows.
    """
    t, refs = F.col("t"), sorted(tau_refs)
    tags = []
    for s in tau_shorts:
        n = rows_in(s)
        ok = n < F.col("n_rows")
        tags.append(F.when(ok & (t < n), F.struct(F.lit(s).alias("tau_short"), F.lit(-1).alias("bin"))))
        bin_ = F.lit(None).cast("int")
        for k, r in reversed(list(enumerate(refs))):
            bin_ = F.when(t < n + rows_in(r), F.lit(k)).otherwise(bin_)
        tags.append(F.when(ok & (t >= n) & bin_.isNotNull(), F.struct(F.lit(s).alias("tau_short"), bin_.alias("bin"))))
    tagged = frames.withColumn("_g", F.explode(F.array_compact(F.array(*tags)))).select("*", "_g.tau_short", "_g.bin").drop("_g")
    keys = ["subject_id", "tau_short", "bin"]
    grown = pair_moments(tagged, keys, norm=True, cumulate=True)
    edges = shrunk_edges(grown, keys).withColumn("r", fisher_z("r"))
    w = Window.partitionBy("subject_id", "tau_short", "i", "j")
    short = F.max(F.when(F.col("bin") < 0, F.col("r"))).over(w)
    paired = edges.withColumn("short", short).filter("bin >= 0")
    r_fc = paired.groupBy(*keys).agg(moment_corr("short", "r", strict=True).alias("r_fc"))
    lengths = frames.groupBy("subject_id").agg(F.first("tr").alias("tr"), F.first("n_rows").alias("n_rows"))
    ref = F.element_at(F.array(*[F.lit(r) for r in refs]), F.col("bin") + 1)
    rows = r_fc.withColumn("tau_ref", ref).join(lengths, "subject_id")
    ref_rows = F.floor(F.col("tau_ref") / F.col("tr"))
    fits = (ref_rows <= F.col("n_rows") - F.floor(F.col("tau_short") / F.col("tr"))) & (ref_rows >= 12)
    return rows.filter(fits).select("subject_id", "tau_short", "tau_ref", (ref_rows * F.col("tr")).alias("ref_actual_sec"), "r_fc")


def convergence_curve(r_fc: DataFrame, min_subjects: int = 20) -> DataFrame:
    """(tau_short, tau_ref, mean, sd, n) where enough subjects reach that reference length."""
    return r_fc.groupBy("tau_short", "tau_ref").agg(
        F.avg("r_fc").alias("mean_r"), F.stddev_samp("r_fc").alias("sd_r"), F.count("r_fc").alias("n")
    ).filter(F.col("n") >= min_subjects)


def convergence_summary(r_fc: DataFrame, estimates: DataFrame, min_subjects: int = 20) -> DataFrame:
    """Per tau_short: peak of the curve, estimate, gap, and the per-subject gap at the longest
    reference with its share of positive subjects."""
    curve = convergence_curve(r_fc, min_subjects).groupBy("tau_short").agg(
        F.max("mean_r").alias("r_peak"), F.max_by("tau_ref", "mean_r").alias("tau_peak"), F.max("tau_ref").alias("tau_max")
    )
    rho = estimates.groupBy("tau_short", "subject_id").agg(F.avg("rho_hat_t").alias("rho"), F.stddev_samp("rho_hat_t").alias("seed_sd"))
    level = rho.groupBy("tau_short").agg(F.avg("rho").alias("rho_mean"), F.stddev_samp("rho").alias("rho_sd"), F.avg("seed_sd").alias("seed_sd"))
    last = r_fc.join(curve.select("tau_short", "tau_max"), "tau_short").filter("tau_ref = tau_max")
    gap = F.col("rho") - F.col("r_fc")
    gaps = last.join(rho, ["tau_short", "subject_id"]).groupBy("tau_short").agg(
        F.avg(gap).alias("gap_subject_mean"), F.avg(F.when(gap > 0, 1.0).when(gap.isNotNull(), 0.0)).alias("share_positive")
    )
    return curve.join(level, "tau_short").join(gaps, "tau_short").withColumn("gap", F.col("rho_mean") - F.col("r_peak"))


def parameter_grid_estimates(replicates: DataFrame, grid: Sequence[dict], k, config: EstimatorConfig, method: str = "fisher_z") -> DataFrame:
    """Estimates for every parameter setting on the same replicates: resample once, correct many.

    Settings may give reliability, prior_mean, prior_var and obs_var; missing ones come from config.
    """
    from reliaspan.functions.reliability import correct_attenuation

    mean, var = config.empirical_prior
    base = {"reliability": config.reliability_coeff, "prior_mean": mean, "prior_var": var, "obs_var": config.observation_var}
    points = [{**base, **g} for g in grid]
    structs = F.array(*[F.struct(*[F.lit(float(p[n])).alias(n) for n in base]) for p in points])
    rows = replicates.withColumn("_p", F.explode(structs)).select(*replicates.columns, "_p.*")
    rho = correct_attenuation("r_obs", F.col("reliability"), "r_split", k, (F.col("prior_mean"), F.col("prior_var")), method, F.col("obs_var"))
    return summarise(rows, fisher_z(rho), ["subject_id", "seed", *base])


def grid_summary(estimates: DataFrame, params: Sequence[str], passing: float = 0.8) -> DataFrame:
    """Mean, coefficient of variation, range and pass rate per setting."""
    r = F.col("rho_hat_t")
    return estimates.groupBy(*params).agg(
        F.avg(r).alias("mean_rho"), F.try_divide(F.stddev_pop(r), F.avg(r)).alias("cv"), (F.max(r) - F.min(r)).alias("rho_range"),
        F.avg(F.when(r >= passing, 1.0).when(r.isNotNull(), 0.0)).alias("pass_rate"),
    )


def add_noise(frames: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Adds seeded Gaussian noise to every value (Box-Muller on two hashes of subject, channel, t)."""
    def unit(c, salt):
        return (seeded_hash(F.col("subject_id"), c, F.col("t"), seed, salt) + 0.5) / HASH_RANGE

    def noisy(v, c):
        z = F.sqrt(-2 * F.log(unit(c, "u"))) * F.cos(2 * F.lit(3.141592653589793) * unit(c, "v"))
        return v + F.lit(float(sigma)) * z

    return frames.withColumn("x", F.zip_with("x", "channels", noisy))


def keep_channels(frames: DataFrame, k: int) -> DataFrame:
    """First k channels of every instant."""
    return frames.withColumn("x", F.slice("x", 1, k)).withColumn("channels", F.slice("channels", 1, k))


def pass_interval(estimates: DataFrame) -> DataFrame:
    """Adds ``passed``: estimate above 0.5 with an interval narrower than 0.5."""
    ok = (F.col("rho_hat_t") > 0.5) & (F.col("ci_upper") - F.col("ci_lower") < 0.5)
    return estimates.withColumn("passed", F.coalesce(ok, F.lit(False)))


def offset_pairs(frames: DataFrame, offsets_sec: Sequence[float], n_short: int) -> DataFrame:
    """(subject_id, offset_sec, i, j, raw, lw, ref): a short window at several offsets against
    everything outside it, raw and shrunk from one moment pass."""
    from reliaspan.operators.connectivity import shrunk_pairs

    t, segs = F.col("t"), {}
    for k, o in enumerate(offsets_sec):
        lo = rows_in(o)
        inside = (t >= lo) & (t < lo + n_short)
        segs[f"in_{k}"], segs[f"out_{k}"] = inside, ~inside
    pairs = shrunk_pairs(pair_moments(label_segments(frames, segs), ["subject_id", "seg"], norm=True), ["subject_id", "seg"]).filter("i < j")
    lw = F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj"))), F.lit(0.0))
    side = F.split("seg", "_")[0]
    keyed = pairs.select(
        "subject_id", "i", "j", side.alias("side"), 
        F.element_at(F.array(*[F.lit(o) for o in offsets_sec]), F.split("seg", "_")[1].cast("int") + 1).alias("offset_sec"), "raw", lw.alias("lw"),
    )
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return keyed.groupBy("subject_id", "offset_sec", "i", "j").agg(
        pick("in", "raw").alias("raw"), pick("in", "lw").alias("lw"), pick("out", "lw").alias("ref")
    )


def offset_subjects(pairs: DataFrame) -> DataFrame:
    per = pairs.groupBy("subject_id", "offset_sec").agg(
        moment_corr("raw", "ref", strict=True).alias("r_raw"), moment_corr("lw", "ref", strict=True).alias("r_lw")
    )
    return per.withColumn("delta_r", F.col("r_lw") - F.col("r_raw"))


def offset_summary(subjects: DataFrame) -> DataFrame:
    d = F.col("delta_r")
    return subjects.groupBy("offset_sec").agg(
        F.avg("r_raw").alias("r_raw_mean"), F.avg("r_lw").alias("r_lw_mean"), F.avg(d).alias("delta_mean"), F.stddev_pop(d).alias("delta_sd"),
        F.count(F.when(d > 0, 1)).alias("n_improved"), (F.avg(F.when(d > 0, 1.0).when(d.isNotNull(), 0.0)) * 100).alias("pct_improved"),
    )


def strong_edge_similarity(frames: DataFrame, lengths: Sequence[int], seeds: Sequence[int], threshold: float, min_edges: int = 50) -> DataFrame:
    """(subject_id, seed, length, r_strong): rank correlation of randomly placed windows with the whole
    recording over its strong edges only.

    Each row is tagged with the windows it falls into, plus the whole recording, so one moment pass
    covers everything; the reference reaches the windows of its own edge (seeds x lengths rows).
    """
    from reliaspan.operators.similarity import spearman

    tags = [F.struct(F.lit(-1).alias("seed"), F.lit(-1).alias("length"))]
    for seed in seeds:
        for length in lengths:
            start = seeded_hash(F.col("subject_id"), seed, length, "window") % (F.col("n_rows") - length + 1)
            inside = (F.col("n_rows") >= length) & (F.col("t") >= start) & (F.col("t") < start + length)
            tags.append(F.when(inside, F.struct(F.lit(seed).alias("seed"), F.lit(length).alias("length"))))
    tagged = frames.withColumn("_g", F.explode(F.array_compact(F.array(*tags)))).select("subject_id", "t", "channels", "x", "_g.seed", "_g.length")
    keys = ["subject_id", "seed", "length"]
    edges = fc_edges(tagged, keys, constant=0.0)
    ref = F.max(F.when(F.col("seed") < 0, F.col("r"))).over(Window.partitionBy("subject_id", "i", "j"))
    strong = edges.withColumn("ref", ref).filter((F.col("seed") >= 0) & (F.abs("ref") > threshold))
    return spearman(strong, "r", "ref", keys, "r_strong").filter(F.col("n_edges") >= min_edges).select(*keys, "r_strong")


def scheme_comparison(frames: DataFrame, schemes: dict[str, int], n_short: int) -> DataFrame:
    """(scheme, n, r_mean, r_sd): short-versus-full similarity under several channel schemes, each
    given by its number of leading channels; the scheme is one more key of the same job."""
    options = F.array(*[F.struct(F.lit(s).alias("scheme"), F.lit(k).alias("k")) for s, k in schemes.items()])
    rows = frames.withColumn("_s", F.explode(options)).select(
        "subject_id", "t", F.col("_s.scheme").alias("scheme"), F.slice("channels", 1, F.col("_s.k")).alias("channels"), F.slice("x", 1, F.col("_s.k")).alias("x")
    )
    keys = ["subject_id", "scheme"]
    marked = label_segments(rows, {"short": F.col("t") < n_short, "full": F.lit(True)})
    wide = side_by_side(fc_edges(marked, [*keys, "seg"], constant=0.0), keys, "seg", ("short", "full"))
    r = wide.groupBy(*keys).agg(moment_corr("short", "full").alias("r"))
    return r.groupBy("scheme").agg(F.count("r").alias("n"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"))
