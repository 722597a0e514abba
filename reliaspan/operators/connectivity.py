"""Channel-by-channel connectivity: one pass of pair moments, everything else is derived from it.

``edges`` is (keys..., i, j, r) with i < j.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.functions.reliability import clip, fisher_z
from reliaspan.operators.kernels import LEAST_VARIANCE, NORM_CHANNEL, SUMS, TERMS, gram_kernel, pair_kernel
from reliaspan.session import spread

KEYS = ("subject_id",)
# A variance below this share of the raw second moment is rounding noise of a constant channel.
CONSTANT_TOL = 1e-12


def pair_moments(
    frames: DataFrame, keys: Sequence[str] = KEYS, norm: bool = False, weight: str | None = None, terms: bool | None = None,
    cumulate: bool = False,
) -> DataFrame:
    """Sums over time for every channel pair i <= j of every key.

    The task-side kernel folds its batch into one packed set of p(p+1)/2 partial sums per key, so the one
    shuffle carries a row per key and run of rows, neither samples x pairs nor a row per pair: a subject that holds
    a large share of all rows still spreads over its map tasks.
    ``norm`` adds a virtual channel (squared row norm) used by the shrinkage estimators, and with it (or with
    ``terms``) the columns that their weight takes from all pairs of the key. With ``cumulate`` the sums run along
    the last key, an int that counts from 0; a negative one stands apart.
    """
    keys = list(keys)
    cols = [*keys, "channels", "x"]
    src = frames.select(*cols, *([F.col(weight).cast("double").alias("w")] if weight else []))
    given = [src.schema[k] for k in keys]
    fields = [*given, T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n", T.DoubleType())]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("sums", "gram")]
    partial = src.sortWithinPartitions(*keys).mapInArrow(gram_kernel(keys, norm, weight is not None), T.StructType(fields))
    terms = norm if terms is None else terms
    fields = [*given, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in (*SUMS, *(f"_{t}" for t in TERMS if terms))]
    together = spread(partial, *(keys[:-1] if cumulate else keys)).sortWithinPartitions(*keys)
    return together.mapInArrow(pair_kernel(keys, terms, cumulate), T.StructType(fields))


def _cov() -> Column:
    return F.col("sij") / F.col("n") - F.col("si") * F.col("sj") / (F.col("n") * F.col("n"))


def _var(s: str, ss: str) -> Column:
    v = F.col(ss) / F.col("n") - F.col(s) * F.col(s) / (F.col("n") * F.col("n"))
    return F.when(v <= F.lit(CONSTANT_TOL) * F.col(ss) / F.col("n"), 0.0).otherwise(v)


def _pearson() -> Column:
    return clip(F.try_divide(_cov(), F.sqrt(_var("si", "sii") * _var("sj", "sjj"))), -1, 1)


def pearson_from_moments(moments: DataFrame, keys: Sequence[str] = KEYS, constant: float | None = None) -> DataFrame:
    """Pearson edges. Pairs with a constant channel get ``constant`` (NULL by default); fewer than
    three rows give 0."""
    r = _pearson() if constant is None else F.coalesce(_pearson(), F.lit(float(constant)))
    value = F.when(F.col("n") < 3, 0.0).otherwise(r)
    return moments.filter((F.col("i") < F.col("j")) & (F.col("j") < NORM_CHANNEL)).select(
        *keys, "i", "j", value.alias("r")
    )


def ledoit_wolf_weight(n, p, tr, d2, uu, mu_u, mcm) -> Column:
    """Shrinkage weight from sums over one key's moments.

    The fourth-order term sum_t |x_t - m|^4 is recovered from the virtual norm channel u = |x|^2:
    C_uu - 4 m'C_u + 4 m'C m + tr(C)^2/n, with C the centred sums of products.
    """
    fourth = uu - 4 * mu_u + 4 * mcm + tr * tr * n
    beta = (fourth / n - d2) / (p * n)
    delta = d2 / p - (tr / p) * (tr / p)
    return F.when((beta <= 0) | (delta <= 0), 0.0).otherwise(F.coalesce(F.try_divide(F.least(beta, delta), delta), F.lit(0.0)))


def oas_weight(n, p, tr, d2) -> Column:
    """Oracle-approximating weight, stated on the sample (n - 1) covariance."""
    unbiased = n / (n - 1)
    tr_u, d2_u = tr * unbiased, d2 * unbiased * unbiased
    num = (1 - 2 / p) * d2_u + tr_u * tr_u
    den = (n + 1 - 2 / p) * (d2_u - tr_u * tr_u / p)
    return F.when(den <= 0, 1.0).otherwise(clip(F.try_divide(num, den), 0, 1))


def shrunk_pairs(moments: DataFrame, keys: Sequence[str] = KEYS, kind: str = "ledoit_wolf") -> DataFrame:
    """Every real channel pair i <= j with its shrunk covariance ``c``, variances ``vi``, ``vj`` and
    the plain correlation ``raw``.

    The sums over all pairs of a key that the weight needs come with the moments.
    """
    terms = TERMS[:3] if kind == "oas" else TERMS
    args = [F.col(f"_{k}") for k in terms]
    weight = oas_weight(F.col("n"), *args) if kind == "oas" else ledoit_wolf_weight(F.col("n"), *args)
    s, mu = F.col("s"), F.col("_tr") / F.col("_p")
    return (
        moments.filter(F.col("j") < NORM_CHANNEL)
        .withColumn("s", weight)
        .select(
            *keys, "i", "j", "n", "s",
            ((1 - s) * _cov() + F.when(F.col("i") == F.col("j"), s * mu).otherwise(0.0)).alias("c"),
            ((1 - s) * _var("si", "sii") + s * mu).alias("vi"),
            ((1 - s) * _var("sj", "sjj") + s * mu).alias("vj"),
            F.when(F.col("n") < 3, 0.0).otherwise(_pearson()).alias("raw"),
        )
    )


def shrunk_edges(moments: DataFrame, keys: Sequence[str] = KEYS, kind: str = "ledoit_wolf") -> DataFrame:
    """Shrunk correlations of the pairs i < j; zero-variance pairs give 0, as do fewer than 3 rows."""
    r = F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj"))), F.lit(0.0))
    return shrunk_pairs(moments, keys, kind).filter("i < j").select(
        *keys, "i", "j", F.when(F.col("n") < 3, 0.0).otherwise(clip(r, -1, 1)).alias("r")
    )


def fc_edges(
    frames: DataFrame,
    keys: Sequence[str] = KEYS,
    kind: str = "pearson",
    fisher: bool = False,
    constant: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Connectivity edges of every key. ``kind``: pearson, ledoit_wolf or oas."""
    if kind == "pearson":
        edges = pearson_from_moments(pair_moments(frames, keys, False, weight), keys, constant)
    elif kind == "ledoit_wolf":
        edges = shrunk_edges(pair_moments(frames, keys, True, weight), keys)
    elif kind == "oas":
        edges = shrunk_edges(pair_moments(frames, keys, False, weight, terms=True), keys, "oas")
    else:
        raise ValueError(f"unknown connectivity kind {kind!r}")
    return edges.withColumn("r", fisher_z("r")) if fisher else edges


def full_matrix(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both triangles plus a unit diagonal."""
    keys = list(keys)
    both = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("r").alias("r")),
                F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("r").alias("r")),
            )
        ).alias("e"),
    ).select(*keys, "e.i", "e.j", "e.r")
    nodes = both.select(*keys, "i").distinct()
    return both.unionByName(nodes.select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("r")))


def covariance_to_correlation(cov: DataFrame, keys: Sequence[str] = KEYS, value: str = "c") -> DataFrame:
    """Full covariance rows (i, j, value) -> correlation rows, via the diagonal joined twice."""
    keys = list(keys)
    diag = cov.filter("i = j").select(*keys, F.col("i").alias("d"), F.col(value).alias("v"))
    left = diag.select(*keys, F.col("d").alias("i"), F.col("v").alias("vi"))
    right = diag.select(*keys, F.col("d").alias("j"), F.col("v").alias("vj"))
    joined = cov.join(left, [*keys, "i"]).join(right, [*keys, "j"])
    r = F.try_divide(F.col(value), F.sqrt(F.col("vi") * F.col("vj")))
    return joined.select(*keys, "i", "j", r.alias("r"))


def pack_edges(edges: DataFrame, keys: Sequence[str] = KEYS, name: str = "ref") -> DataFrame:
    """One array per key in (i, j) order; bounded by the number of channel pairs."""
    packed = F.array_sort(F.collect_list(F.struct("i", "j", "r")))
    return edges.groupBy(*keys).agg(F.transform(packed, lambda e: e["r"]).alias(name))


def side_by_side(edges: DataFrame, keys: Sequence[str], label: str, values: Sequence[str]) -> DataFrame:
    """(keys, label, i, j, r) -> (keys, i, j, one column per label value); one aggregation, no self-join."""
    picks = [F.max(F.when(F.col(label) == v, F.col("r"))).alias(v) for v in values]
    return edges.groupBy(*keys, "i", "j").agg(*picks)


def edge_similarity(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, name: str = "r_fc", extra: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of two edge vectors per key, aligned on (key, i, j).

    A missing value on either side makes the whole similarity missing, as a NaN would.
    """
    on = [k for k in keys if k in right.columns] + ["i", "j"]
    joined = left.withColumnRenamed("r", "a").join(right.withColumnRenamed("r", "b"), on)
    return joined.groupBy(*keys, *extra).agg(moment_corr("a", "b", strict=True).alias(name))


def moment_corr(a, b, strict: bool = False) -> Column:
    """Pearson r as a plain aggregate expression; NULL where either side is constant.

    ``covar_pop``/``var_pop`` are used instead of ``corr``, which raises on a zero variance in ANSI
    mode. With ``strict`` any NULL input gives NULL instead of being skipped.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.isNotNull() & b.isNotNull()
    va, vb = F.var_pop(F.when(both, a)), F.var_pop(F.when(both, b))
    varied = (va > F.lit(LEAST_VARIANCE)) & (vb > F.lit(LEAST_VARIANCE))
    r = F.when(varied, F.covar_pop(a, b) / F.sqrt(va * vb))
    if strict:
        return F.when(F.count(F.lit(1)) == F.count(F.when(both, 1)), r)
    return r
