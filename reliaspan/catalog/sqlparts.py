"""Building blocks for the SQL statements that the results are checked against.

They state each formula in its textbook form (centred sums, self-joins), not in the form the
Spark jobs use.
"""

from __future__ import annotations

PANEL = """
cells AS (
  SELECT l_suppkey AS subject_id, CAST(l_partkey % 12 AS INTEGER) AS channel,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2, 3),
subj AS (SELECT DISTINCT l_suppkey AS subject_id FROM lineitem),
S AS (
  SELECT s.subject_id, CAST(c.c AS INTEGER) AS channel, CAST(g.g AS INTEGER) AS t, coalesce(v, 0) AS value
  FROM subj s CROSS JOIN range(12) c(c) CROSS JOIN range(83) g(g)
  LEFT JOIN cells ON cells.subject_id = s.subject_id AND cells.channel = c.c AND cells.t = g.g),
attrs AS (
  SELECT subject_id, CAST(subject_id % 2 AS INTEGER) AS grp, CAST(subject_id % 5 AS INTEGER) AS site,
         2.0 + 0.5 * ((subject_id % 5) % 2) AS tr FROM subj)"""


def with_panel(*ctes: str) -> str:
    return "WITH " + ",\n".join([PANEL.strip(), *[c.strip() for c in ctes]]) + "\n"


def _on(a: str, b: str, cols) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)


def centred(src: str, out: str, keys=("subject_id",), pos: str = "t") -> str:
    k = ", ".join(keys)
    return f"""
{out} AS (SELECT {k}, channel, {pos}, value - avg(value) OVER (PARTITION BY {k}, channel) AS x,
  count(*) OVER (PARTITION BY {k}, channel) AS n FROM {src})"""


def covariance(src: str, out: str, keys=("subject_id",), pos: str = "t") -> str:
    """Population covariance of every channel pair i <= j; ``src`` is centred."""
    k = ", ".join(f"a.{c}" for c in keys)
    return f"""
{out} AS (SELECT {k}, a.channel AS i, b.channel AS j, max(a.n) AS n, sum(a.x * b.x) / max(a.n) AS c
  FROM {src} a JOIN {src} b ON {_on('a', 'b', [*keys, pos])} AND a.channel <= b.channel GROUP BY ALL)"""


def pearson(src: str, out: str, keys=("subject_id",), pos: str = "t", constant: str = "NULL") -> str:
    k = ", ".join(f"c.{x}" for x in keys)
    return ",".join([
        centred(src, f"{out}_x", keys, pos),
        covariance(f"{out}_x", f"{out}_c", keys, pos),
        f"""
{out} AS (SELECT {k}, c.i, c.j, CASE WHEN c.n < 3 THEN 0
  WHEN a.c < 1e-12 OR b.c < 1e-12 THEN {constant}
  ELSE least(1, greatest(-1, c.c / sqrt(a.c * b.c))) END AS r
  FROM {out}_c c JOIN {out}_c a ON {_on('c', 'a', keys)} AND a.i = c.i AND a.j = c.i
  JOIN {out}_c b ON {_on('c', 'b', keys)} AND b.i = c.j AND b.j = c.j WHERE c.i < c.j)""",
    ])


def ledoit_wolf(src: str, out: str, keys=("subject_id",), pos: str = "t") -> str:
    k = ", ".join(keys)
    ck = ", ".join(f"c.{x}" for x in keys)
    return ",".join([
        centred(src, f"{out}_x", keys, pos),
        covariance(f"{out}_x", f"{out}_c", keys, pos),
        f"""
{out}_b AS (SELECT {k}, sum(u * u) AS b_ FROM (
  SELECT {k}, {pos}, sum(x * x) AS u FROM {out}_x GROUP BY {k}, {pos}) GROUP BY {k}),
{out}_a AS (SELECT {k}, max(n) AS n, sum(CASE WHEN i = j THEN 1 ELSE 0 END) AS p,
  sum(CASE WHEN i = j THEN c ELSE 0 END) AS tr, sum(CASE WHEN i = j THEN c * c ELSE 2 * c * c END) AS d_
  FROM {out}_c GROUP BY {k}),
{out}_bd AS (SELECT a.*, (b_ / n - d_) / (p * n) AS beta, (d_ - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p AS delta
  FROM {out}_a a JOIN {out}_b b ON {_on('a', 'b', keys)}),
{out}_s AS (SELECT *, tr / p AS mu,
  CASE WHEN beta <= 0 OR delta <= 0 THEN 0 ELSE least(beta, delta) / delta END AS s FROM {out}_bd),
{out} AS (SELECT {ck}, c.i, c.j, CASE WHEN c.n < 3 THEN 0 ELSE least(1, greatest(-1, coalesce(
    (1 - s.s) * c.c / nullif(sqrt(((1 - s.s) * a.c + s.s * s.mu) * ((1 - s.s) * b.c + s.s * s.mu)), 0), 0))) END AS r
  FROM {out}_c c JOIN {out}_c a ON {_on('c', 'a', keys)} AND a.i = c.i AND a.j = c.i
  JOIN {out}_c b ON {_on('c', 'b', keys)} AND b.i = c.j AND b.j = c.j
  JOIN {out}_s s ON {_on('c', 's', keys)} WHERE c.i < c.j)""",
    ])


def z_space(src: str, out: str, keys=("subject_id",)) -> str:
    k = ", ".join(keys)
    return f"\n{out} AS (SELECT {k}, i, j, atanh(least(0.9999, greatest(-0.9999, r))) AS r FROM {src})"


def corr_expr(a: str, b: str) -> str:
    """Pearson r of two columns, NULL when either is constant or any value is missing."""
    return (
        f"CASE WHEN count(*) = count({a} + {b}) AND var_pop({a}) > 1e-14 AND var_pop({b}) > 1e-14 "
        f"THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) END"
    )


def similarity(left: str, right: str, out: str, keys=("subject_id",), on=None, name: str = "r_fc") -> str:
    on = list(on or keys)
    k = ", ".join(f"a.{c}" for c in keys)
    return f"""
{out} AS (SELECT {k}, {corr_expr('a.r', 'b.r')} AS {name} FROM {left} a JOIN {right} b
  ON {_on('a', 'b', [*on, 'i', 'j'])} GROUP BY ALL)"""


SHORT = "\nSHORT AS (SELECT * FROM S WHERE t < 16)"
SUFFIX = "\nREST AS (SELECT * FROM S WHERE t >= 16)"


def block_length(src: str, out: str, keys=("subject_id",)) -> str:
    k = ", ".join(keys)
    return f"""
{out}_l AS (SELECT *, lag(value) OVER (PARTITION BY {k}, channel ORDER BY t) AS prev FROM {src}),
{out}_r AS (SELECT {k}, channel, count(*) AS n_rows,
  CASE WHEN stddev_pop(prev) > 1e-5 AND stddev_pop(CASE WHEN prev IS NOT NULL THEN value END) > 1e-5
  THEN covar_pop(prev, value) / (stddev_pop(prev) * stddev_pop(CASE WHEN prev IS NOT NULL THEN value END)) END AS r
  FROM {out}_l GROUP BY {k}, channel),
{out} AS (SELECT {k}, CAST(n_rows AS INTEGER) AS n_rows, ar1, CAST(CASE WHEN n_rows < 5 THEN n_rows ELSE
    greatest(5, least(2 * ceil(-2 / ln(least(0.99, greatest(0.01, ar1)))), greatest(5, floor(n_rows / 4)))) END AS INTEGER) AS block_len
  FROM (SELECT {k}, max(n_rows) AS n_rows, coalesce(avg(r), 0) AS ar1 FROM {out}_r GROUP BY {k}))"""


def resample(lengths: str, out: str, n_boot: int, seeds=(0,), keys=("subject_id",)) -> str:
    k = ", ".join(keys)
    text = " || '|' || ".join([*[f"CAST({c} AS VARCHAR)" for c in keys], "CAST(seed AS VARCHAR)", "CAST(b AS VARCHAR)", "CAST(block AS VARCHAR)"])
    seed_list = ", ".join(str(s) for s in seeds)
    return f"""
{out}_g AS (SELECT l.*, s.seed, b.b, CAST(greatest(1, floor(n_rows / block_len)) AS INTEGER) AS n_blocks
  FROM {lengths} l CROSS JOIN (SELECT unnest([{seed_list}]) AS seed) s CROSS JOIN range({n_boot}) b(b)),
{out}_s AS (SELECT *, CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % (n_rows - block_len + 1) AS start
  FROM (SELECT {out}_g.*, k.k AS block FROM {out}_g JOIN range(1000) k(k) ON k.k < n_blocks)),
{out} AS (SELECT {k}, seed, CAST(b AS INTEGER) AS b, CAST(block * block_len + o.o AS INTEGER) AS pos,
  CAST(start + o.o AS INTEGER) AS src_t, floor(n_blocks * block_len / 2) AS half_at
  FROM {out}_s JOIN range(1000) o(o) ON o.o < block_len)"""


def replicates(short: str, ref: str, out: str, n_boot: int, seeds=(0,), keys=("subject_id",), kind="ledoit_wolf", fisher=False, ref_keys=None) -> str:
    """``out``(keys, seed, b, r_obs, r_split), all from rows of the resampled recording."""
    k = ", ".join(keys)
    rep = [*keys, "seed", "b"]
    rk = ", ".join(rep)
    fc = ledoit_wolf if kind == "ledoit_wolf" else pearson
    z = z_space if fisher else (lambda a, b, c: f"\n{b} AS (SELECT * FROM {a})")
    return ",".join([
        block_length(short, f"{out}_len", keys),
        resample(f"{out}_len", f"{out}_ix", n_boot, seeds, keys),
        f"""
{out}_rows AS (SELECT {', '.join('x.' + c for c in keys)}, seed, b, pos, half_at, channel, value
  FROM {out}_ix x JOIN {short} s ON {_on('x', 's', keys)} AND s.t = x.src_t),
{out}_seg AS (SELECT {rk}, pos, channel, value, 'whole' AS seg FROM {out}_rows
  UNION ALL SELECT {rk}, pos, channel, value, CASE WHEN pos < half_at THEN 'first' ELSE 'second' END FROM {out}_rows)""",
        fc(f"{out}_seg", f"{out}_e", (*rep, "seg"), "pos"),
        f"""
{out}_wh AS (SELECT {rk}, i, j, r FROM {out}_e WHERE seg = 'whole')""",
        z(f"{out}_wh", f"{out}_wz", rep),
        similarity(f"{out}_wz", ref, f"{out}_o", rep, ref_keys or keys, "r_obs"),
        f"""
{out}_h AS (SELECT {', '.join('a.' + c for c in rep)}, {corr_expr('a.r', 'b.r')} AS h
  FROM {out}_e a JOIN {out}_e b ON {_on('a', 'b', [*rep, 'i', 'j'])} AND a.seg = 'first' AND b.seg = 'second' GROUP BY ALL),
{out} AS (SELECT o.*, CASE WHEN h IS NOT NULL THEN least(0.999, greatest(0.001, h)) END AS r_split
  FROM {out}_o o JOIN {out}_h h ON {_on('o', 'h', rep)})""",
    ])


def clip_sql(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least({hi}, greatest({lo}, ({x}))) END)"


def sb_sql(r: str, k: str) -> str:
    c = f"(CASE WHEN ({r}) IS NOT NULL THEN least(0.999, greatest(0.001, {r})) END)"
    return f"(({k}) * {c} / (1 + (({k}) - 1) * {c}))"


def correction_sql(method: str, r_obs: str, r_split: str, k: str, prior=(0.25, 0.05), r_hat: str = "0.98", obs: str = "0.15") -> str:
    """Textbook form: disattenuate by the short reliabilities, re-attenuate by the lengthened ones."""
    if prior is not None:
        w = f"({prior[1]} / ({prior[1]} + {obs}))"
        r_split = f"({w} * {r_split} + (1 - {w}) * {prior[0]})"
    a, b = f"greatest({r_hat}, 0.05)", f"(CASE WHEN ({r_split}) IS NOT NULL THEN greatest({r_split}, 0.05) END)"
    now, later = f"({a} * {b})", f"({sb_sql(a, k)} * {sb_sql(b, k)})"
    if method == "fisher_z":
        return f"tanh(atanh({clip_sql(r_obs, -0.9999, 0.9999)}) - 0.5 * ln({now}) + 0.5 * ln({later}))"
    if method == "partial":
        return clip_sql(f"{r_obs} / pow({now}, 0.25) * pow({later}, 0.25)", -1, 1)
    raw = f"({r_obs} / sqrt({now}) * sqrt({later}))"
    return f"tanh({raw})" if method == "soft_clamp" else clip_sql(raw, -1, 1)


def zclip(x: str) -> str:
    return f"atanh({clip_sql(x, -0.9999, 0.9999)})"


def interval_sql(src: str, out: str, z: str, keys) -> str:
    k = ", ".join(keys)
    return f"""
{out} AS (SELECT {k}, tanh(quantile_cont(z, 0.5)) AS rho_hat_t,
  CASE WHEN count(*) = count(z) THEN tanh(quantile_cont(z, 0.025)) END AS ci_lower,
  CASE WHEN count(*) = count(z) THEN tanh(quantile_cont(z, 0.975)) END AS ci_upper
  FROM (SELECT *, CAST({z} AS DOUBLE) AS z FROM {src}) GROUP BY {k})"""


def hash_sql(*parts: str) -> str:
    """Seeded hash of SQL expressions, as the Spark side computes it."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


EVENT_COHORT = """
COHORT AS (SELECT user_id AS subject_id, CAST(count(*) AS INTEGER) AS n_rows, CAST(user_id % 5 AS INTEGER) AS site,
  2.0 + 0.5 * ((user_id % 5) % 2) AS tr, CASE WHEN user_id % 7 = 0 THEN 'Unknown' WHEN user_id % 2 = 0 THEN 'Control' ELSE 'ADHD' END AS "group"
  FROM events GROUP BY user_id),
DUR AS (SELECT *, n_rows * tr AS total_s, 24 * tr AS short_s, (n_rows - 24) * tr AS ref_s, n_rows / CAST(24 AS DOUBLE) AS k FROM COHORT)"""
