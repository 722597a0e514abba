"""Cleaning, slicing, cohort, lookup and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import EVENT_COHORT, hash_sql, with_panel
from reliaspan.functions.parsing import (
    cohort_from_prefix, file_stem, group_from_dx, group_from_flags, is_healthy, normalise_sex, parse_age, safe_tag, sex_from_code,
    strip_entities, task_label, with_prefix,
)
from reliaspan.operators.clean import (
    densify, drop_censored_rows, drop_constant_channels, length_status, recording_lengths, reject_bad_subjects,
)
from reliaspan.operators.cohort import (
    derive_durations, finite, first_settings, funnel_report, funnel_rules, grid, k_group, lookup_default, lookup_normalised, lookup_strict, missing_keys, positional_join, site_interval, with_each,
)
from reliaspan.operators.ranking import exact_quantiles
from reliaspan.operators.sampling import balanced_downsample, proportional_sample, sample_subjects, site_folds, stratified_folds, train_test_split
from reliaspan.operators.slices import (
    first_channels, half_split, label_segments, offset_complement, offset_window, random_window, sliding, suffix, tumbling,
)
from reliaspan.sources.panels import N_MONTHS, event_samples, lineitem_samples, read_table

COHORT_SQL = "WITH " + EVENT_COHORT.strip() + "\n"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_cohort(spark, sf_dir):
    """One recording per user; its length is the number of events, so lengths vary."""
    sid = F.col("subject_id")
    return (
        read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
        .withColumn("site", (sid % 5).cast("int"))
        .withColumn("tr", F.lit(2.0) + F.lit(0.5) * (F.col("site") % 2))
        .withColumn("group", F.when(sid % 7 == 0, "Unknown").when(sid % 2 == 0, "Control").otherwise("ADHD"))
    )


def by_channel(samples, *extra):
    return samples.groupBy("subject_id", *extra, "channel").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )


def _by_channel_sql(src, *extra):
    e = "".join(f"{x}, " for x in extra)
    return (
        f"SELECT subject_id, {e}channel, CAST(count(*) AS BIGINT) AS n, {q6('sum(value)', 'total')}, min(t) AS t0, max(t) AS t1 "
        f"FROM {src} GROUP BY subject_id, {e}channel"
    )


EVENT_CELLS = """
EC AS (SELECT user_id AS subject_id, event_type AS channel, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, sum(value) AS v
  FROM events GROUP BY 1, 2, 3),
ED AS (SELECT u.subject_id, c.channel, CAST(g.g AS INTEGER) AS t, coalesce(v, 0) AS value
  FROM (SELECT DISTINCT user_id AS subject_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS channel) c
  CROSS JOIN range(30) g(g) LEFT JOIN EC ON EC.subject_id = u.subject_id AND EC.channel = c.channel AND EC.t = g.g)"""


@query("panel_densify", f"WITH {EVENT_CELLS.strip()} SELECT subject_id, channel, t, {q6('value', 'value')} FROM ED")
def panel_densify(spark, sf_dir):
    out = densify(event_samples(spark, sf_dir), 30, EVENT_TYPES)
    return out.select("subject_id", "channel", "t", r6("value"))


@query("panel_samples", with_panel() + f"SELECT subject_id, channel, t, {q6('value', 'value')} FROM S")
def panel_samples(spark, sf_dir):
    return lineitem_samples(spark, sf_dir).select("subject_id", "channel", "t", r6("value"))


@query(
    "zero_variance_filter",
    with_panel("SD AS (SELECT subject_id, channel, stddev_pop(value) AS sd FROM S GROUP BY 1, 2)")
    + _by_channel_sql("(SELECT S.* FROM S JOIN SD USING (subject_id, channel) WHERE sd > 1e-8)"),
)
def zero_variance_filter(spark, sf_dir):
    return by_channel(drop_constant_channels(lineitem_samples(spark, sf_dir)))


@query(
    "bad_channel_share",
    with_panel("SD AS (SELECT subject_id, channel, stddev_pop(value) AS sd FROM S GROUP BY 1, 2)")
    + f"""SELECT subject_id, CAST(count(*) AS BIGINT) AS n_channels, CAST(sum(CASE WHEN sd <= 1e-8 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
      {q6('avg(CASE WHEN sd <= 1e-8 THEN 1.0 ELSE 0 END)', 'bad_share')}, avg(CASE WHEN sd <= 1e-8 THEN 1.0 ELSE 0 END) <= 0.1 AS kept FROM SD GROUP BY subject_id""",
)
def bad_channel_share(spark, sf_dir):
    out = reject_bad_subjects(lineitem_samples(spark, sf_dir))
    return out.select("subject_id", "n_channels", "n_bad", r6("bad_share"), "kept")


@query(
    "length_guard_reasons",
    COHORT_SQL
    + """SELECT subject_id, n_rows, CASE WHEN n_rows < 20 THEN 'fewer_than_20_rows' WHEN n_rows < floor(120 / tr) + 10 THEN 'shorter_than_short_plus_10'
      WHEN n_rows * tr < 150 THEN 'total_too_short' WHEN n_rows - floor(120 / tr) < greatest(12, floor(30 / tr)) THEN 'reference_too_short' END AS reason FROM COHORT""",
)
def length_guard_reasons(spark, sf_dir):
    cohort = event_cohort(spark, sf_dir)
    return length_status(cohort, F.floor(F.lit(120) / F.col("tr")), F.col("tr")).select("subject_id", "n_rows", "reason")


@query(
    "recording_lengths",
    f"WITH {EVENT_CELLS.strip()} SELECT subject_id, CAST(max(t) + 1 AS INTEGER) AS n_rows, CAST(count(DISTINCT channel) AS BIGINT) AS n_channels FROM EC GROUP BY 1",
)
def recording_lengths_query(spark, sf_dir):
    return recording_lengths(event_samples(spark, sf_dir))


@query(
    "prefix_suffix_split",
    with_panel("G AS (SELECT *, 'short' AS seg FROM S WHERE t < 16 UNION ALL SELECT *, 'rest' FROM S WHERE t >= 16 UNION ALL SELECT *, 'block' FROM S WHERE t >= 16 AND t < 40)")
    + _by_channel_sql("G", "seg"),
)
def prefix_suffix_split(spark, sf_dir):
    t = F.col("t")
    rows = label_segments(
        lineitem_samples(spark, sf_dir), {"short": t < 16, "rest": t >= 16, "block": (t >= 16) & (t < 40)}
    )
    return by_channel(rows, "seg")


@query(
    "offset_complement",
    with_panel("G AS (SELECT *, CASE WHEN t >= 20 AND t < 36 THEN 'window' ELSE 'complement' END AS seg FROM S)") + _by_channel_sql("G", "seg"),
)
def offset_complement_query(spark, sf_dir):
    s = lineitem_samples(spark, sf_dir)
    a = offset_window(s, 20, 16).withColumn("seg", F.lit("window"))
    b = offset_complement(s, 20, 16).withColumn("seg", F.lit("complement"))
    return by_channel(a.unionByName(b), "seg")


@query("suffix_block", with_panel() + _by_channel_sql("(SELECT * FROM S WHERE t >= 16 AND t < 56 AND channel < 4)"))
def suffix_block(spark, sf_dir):
    return by_channel(first_channels(suffix(lineitem_samples(spark, sf_dir), 16, 40), 4))


@query("tumbling_windows", with_panel("G AS (SELECT *, CAST(floor(t / 10) AS INTEGER) AS window_id FROM S WHERE t < 80)") + _by_channel_sql("G", "window_id"))
def tumbling_windows(spark, sf_dir):
    return by_channel(tumbling(lineitem_samples(spark, sf_dir), 10, 8), "window_id")


@query(
    "sliding_windows",
    with_panel("G AS (SELECT S.*, CAST(w.w AS INTEGER) AS window_id FROM S JOIN range(100) w(w) ON t >= w.w * 5 AND t < w.w * 5 + 20 AND w.w * 5 + 20 <= 83)")
    + _by_channel_sql("G", "window_id"),
)
def sliding_windows(spark, sf_dir):
    return by_channel(sliding(lineitem_samples(spark, sf_dir), N_MONTHS, 20, 5), "window_id")


@query(
    "random_window",
    with_panel(f"G AS (SELECT *, {hash_sql('subject_id', '7', chr(39) + 'window' + chr(39))} % (83 - 24 + 1) AS st FROM S)")
    + _by_channel_sql("(SELECT * FROM G WHERE t >= st AND t < st + 24)"),
)
def random_window_query(spark, sf_dir):
    return by_channel(random_window(lineitem_samples(spark, sf_dir), N_MONTHS, 24, 7))


@query("half_windows", with_panel("G AS (SELECT *, CASE WHEN t < 41 THEN 1 ELSE 2 END AS half FROM S)") + _by_channel_sql("G", "half"))
def half_windows(spark, sf_dir):
    return by_channel(half_split(lineitem_samples(spark, sf_dir), N_MONTHS), "half")


@query(
    "censored_rows",
    """WITH P AS (SELECT user_id AS subject_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
        sum(CASE WHEN event_type = 'click' THEN value END) AS click, sum(CASE WHEN event_type = 'view' THEN value END) AS "view" FROM events GROUP BY 1, 2),
      K AS (SELECT 'partial' AS mode, * FROM P WHERE click IS NOT NULL OR "view" IS NOT NULL
        UNION ALL SELECT 'complete', * FROM P WHERE click IS NOT NULL AND "view" IS NOT NULL)
      SELECT mode, subject_id, CAST(row_number() OVER (PARTITION BY mode, subject_id ORDER BY t) - 1 AS INTEGER) AS t, """
    + q6("coalesce(click, 0)", "click") + ", " + q6('coalesce("view", 0)', '"view"') + " FROM K",
)
def censored_rows(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    wide = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject_id"), day.alias("t")).agg(
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"),
        F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("view"),
    )
    parts = [
        drop_censored_rows(wide, ["click", "view"], any_missing=m == "complete").withColumn("mode", F.lit(m)) for m in ("partial", "complete")
    ]
    return parts[0].unionByName(parts[1]).select("mode", "subject_id", "t", r6("click"), r6("view"))


def _funnel_sql(mode, known):
    rules = []
    if known:
        rules.append(("known_diagnosis", "\"group\" IN ('Control', 'ADHD')"))
    rules.append(("k_at_least_2", "k >= 2"))
    if mode != "liberal":
        rules.append(("reference_long_enough", f"ref_s >= {300 if mode == 'strict' else 180}"))
    if mode == "moderate" and not known:
        rules.append(("total_at_least_300s", "total_s >= 300"))
    parts, passed = [], "TRUE"
    for stage, (name, cond) in enumerate([("enrolled", "TRUE"), *rules]):
        now = f"({passed}) AND ({cond})"
        parts.append(
            f"""SELECT {stage} AS stage, '{name}' AS name, CAST(count(*) FILTER (WHERE {now}) AS BIGINT) AS n,
            CAST(count(DISTINCT site) FILTER (WHERE {now}) AS BIGINT) AS n_sites, CAST(count(*) FILTER (WHERE ({passed}) AND NOT ({cond})) AS BIGINT) AS n_excluded,
            coalesce((SELECT string_agg(site || ':' || c, ',' ORDER BY site) FROM (SELECT site, count(*) AS c FROM DUR WHERE ({passed}) AND NOT ({cond}) GROUP BY site)), '') AS excluded_sites FROM DUR"""
        )
        passed = now
    return " UNION ALL ".join(parts)


def _funnel(spark, sf_dir, mode, known):
    cohort = derive_durations(event_cohort(spark, sf_dir), 24)
    rep = funnel_report(cohort, funnel_rules(mode, ("Control", "ADHD") if known else None))
    text = F.concat_ws(",", F.transform(F.map_entries("excluded_sites"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))))
    return rep.select("stage", "name", "n", "n_sites", "n_excluded", text.alias("excluded_sites"))


for _mode, _known in (("liberal", False), ("moderate", False), ("strict", False), ("strict", True), ("moderate", True)):
    _name = f"funnel_{_mode}" + ("_known_diagnosis" if _known else "")
    query(_name, COHORT_SQL + _funnel_sql(_mode, _known))(lambda spark, sf_dir, m=_mode, k=_known: _funnel(spark, sf_dir, m, k))


@query(
    "k_groups",
    COHORT_SQL
    + f"""SELECT subject_id, {q6('total_s', 'total_s')}, {q6('short_s', 'short_s')}, {q6('ref_s', 'ref_s')}, {q6('k', 'k')},
      CASE WHEN k < 2 THEN 'k<2' WHEN k < 3 THEN '2<=k<3' WHEN k < 4 THEN '3<=k<4' ELSE 'k>=4' END AS k_group FROM DUR WHERE k >= 2""",
)
def k_groups(spark, sf_dir):
    d = derive_durations(event_cohort(spark, sf_dir), 24).filter("k >= 2")
    return d.select("subject_id", *[r6(c) for c in ("total_s", "short_s", "ref_s", "k")], k_group("k").alias("k_group"))


@query(
    "site_interval_lookup",
    """SELECT s_suppkey AS subject_id, n_name, CASE WHEN contains(lower(n_name), 'nation_1') THEN 1.5 WHEN contains(lower(n_name), 'nation_2') THEN 2.5
      WHEN contains(lower(n_name), 'nation_14') THEN 9.0 ELSE 2.0 END AS tr FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def site_interval_lookup(spark, sf_dir):
    sup = read_table(spark, sf_dir, "supplier")
    nat = read_table(spark, sf_dir, "nation")
    rows = lookup_strict(sup.withColumnRenamed("s_nationkey", "n_nationkey"), nat, "n_nationkey")
    table = (("Nation_1", 1.5), ("Nation_2", 2.5), ("Nation_14", 9.0))
    return rows.select(F.col("s_suppkey").alias("subject_id"), "n_name", site_interval("n_name", table).alias("tr"))


@query(
    "lookup_with_default",
    """SELECT c_custkey AS subject_id, coalesce(CAST(s_acctbal > 0 AS VARCHAR), 'unknown') AS status FROM customer
      LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal < 5000) ON c_custkey = s_suppkey""",
)
def lookup_with_default(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    dim = read_table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select(
        F.col("s_suppkey").alias("key"), (F.col("s_acctbal") > 0).cast("string").alias("status")
    )
    return lookup_default(rows, dim, "key", "status", "unknown").select(F.col("key").alias("subject_id"), "status")


@query("missing_lookup_keys", "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_lookup_keys(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return missing_keys(rows, read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), "key")


@query(
    "id_normalised_join",
    """SELECT l_orderkey AS row_id, l_linenumber AS line, id, s_acctbal AS bal FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_suppkey AS VARCHAR), 7, '0')
      ELSE CAST(l_suppkey AS VARCHAR) END AS id FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey""",
)
def id_normalised_join(spark, sf_dir):
    padded = F.lpad(F.col("l_suppkey").cast("string"), 7, "0")
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") % 2 == 0, padded).otherwise(F.col("l_suppkey").cast("string")).alias("id"),
    )
    dim = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("bal"))
    return lookup_normalised(rows, dim, "id", ["bal"])


@query("positional_join", "SELECT e.vec_id AS pos, e.label, d.lang, CAST(d.n_chars AS BIGINT) AS n_chars FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.doc_id < (SELECT count(*) FROM embeddings)")
def positional_join_query(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang", "n_chars").join(vectors.select("pos"), "pos", "left_semi")
    kept = vectors.join(docs.select("pos"), "pos", "left_semi")
    return positional_join(kept, docs).select("pos", "label", "lang", "n_chars")


@query(
    "settings_first_wins",
    "SELECT o_custkey AS key, o_orderpriority AS level, min(o_orderkey) AS priority FROM orders GROUP BY 1, 2",
)
def settings_first_wins(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("level"), F.col("o_orderkey").alias("priority")
    )
    return first_settings(rows, ["key", "level"], "priority")


@query(
    "parameter_grid",
    COHORT_SQL + "SELECT subject_id, d.d AS duration, s.s AS seed FROM COHORT CROSS JOIN (SELECT unnest([30, 60, 120]) AS d) d CROSS JOIN (SELECT unnest([42, 43]) AS s) s",
)
def parameter_grid(spark, sf_dir):
    return grid(event_cohort(spark, sf_dir).select("subject_id"), duration=[30, 60, 120], seed=[42, 43])


@query(
    "text_scalars",
    """WITH D AS (SELECT doc_id, lang, source, n_chars, CAST(n_chars % 60 AS INTEGER) AS a FROM documents)
      SELECT doc_id, a + 5.0 AS age, CASE WHEN a % 3 = 0 THEN 'M' WHEN a % 3 = 1 THEN 'F' ELSE 'U' END AS sex,
        CASE WHEN a % 5 = 0 THEN 'Control' WHEN a % 5 < 4 THEN 'ADHD' ELSE 'Unknown' END AS dx_group,
        'sub-' || doc_id AS prefixed, 'sub-' || doc_id || '_task-rest' AS entity, 'doc_' || doc_id AS stem, a % 2 = 0 AS healthy,
        CASE WHEN lang LIKE 'e%' THEN 'A' ELSE 'Z' END AS cohort, CASE WHEN lang LIKE 'e%' THEN 1 ELSE 0 END AS task FROM D""",
)
def text_scalars(spark, sf_dir):
    """Each parser applied to text made from the documents' own columns."""
    a = F.col("a")
    text = lambda c: c.cast("string")
    d = read_table(spark, sf_dir, "documents").withColumn("a", (F.col("n_chars") % 60).cast("int"))
    d = d.withColumns({
        "age_text": F.when(a % 2 == 0, F.concat(text(a), F.lit("-"), text(a + 10))).otherwise(F.concat(F.lit(" "), text(a + 5))),
        "sex_text": F.when(a % 3 == 0, "male ").when(a % 3 == 1, " f").otherwise("?"),
        "dx_text": text(a % 5),
        "run": F.concat(F.lit("sub-"), text(F.col("doc_id")), F.lit("_task-rest_space-MNI_res-2")),
        "path": F.concat(F.lit("/data/x/doc_"), text(F.col("doc_id")), F.lit(".txt")),
        "status": F.when(a % 2 == 0, " Healthy Control ").otherwise("patient"),
    })
    cohort = cohort_from_prefix("lang", {"e": "A"}, "Z")
    return d.select(
        "doc_id", parse_age("age_text").alias("age"), normalise_sex("sex_text").alias("sex"), group_from_dx("dx_text").alias("dx_group"),
        with_prefix("doc_id").alias("prefixed"), strip_entities("run").alias("entity"), file_stem("path").alias("stem"),
        is_healthy("status").alias("healthy"), cohort.alias("cohort"), task_label(cohort, ["A"], ["Z"]).alias("task"),
    )


@query(
    "diagnosis_flags",
    """WITH D AS (SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS m, CAST(c_nationkey % 2 AS INTEGER) AS f FROM customer)
      SELECT c_custkey AS subject_id, CASE WHEN m = 0 THEN CASE WHEN f = 0 THEN 'Control' ELSE 'ADHD' END WHEN m = 1 THEN CASE WHEN f = 1 THEN 'ADHD' ELSE 'Control' END
        WHEN m = 2 THEN CASE WHEN f = 1 THEN 'Control' ELSE 'ADHD' END ELSE 'Unknown' END AS grp,
        CASE WHEN f = 1 THEN 'M' ELSE 'F' END AS sex, lower(replace(c_mktsegment, ' ', '_')) AS tag FROM D JOIN customer USING (c_custkey)""",
)
def diagnosis_flags(spark, sf_dir):
    m, f = F.col("c_custkey") % 4, (F.col("c_nationkey") % 2).cast("string")
    rows = read_table(spark, sf_dir, "customer").withColumns(
        {"dx": F.when(m == 0, f), "adhd": F.when(m == 1, f), "tdc": F.when(m == 2, f), "gender": f}
    )
    return rows.select(
        F.col("c_custkey").alias("subject_id"), group_from_flags("dx", "adhd", "tdc").alias("grp"), sex_from_code("gender").alias("sex"),
        safe_tag("c_mktsegment").alias("tag"),
    )


@query(
    "props_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS high FROM events",
)
def props_json(spark, sf_dir):
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))
    ev = read_table(spark, sf_dir, "events").select("event_id", parsed.alias("p"))
    return ev.select("event_id", F.col("p.k").alias("k"), (F.col("p.k") >= 50).alias("high"))


@query(
    "finite_gate",
    "SELECT event_id, " + q6("1 / (value - floor(value))", "w0") + " FROM events WHERE value - floor(value) <> 0",
)
def finite_gate(spark, sf_dir):
    frac = F.col("value") - F.floor("value")
    rows = read_table(spark, sf_dir, "events").select("event_id", F.try_divide(F.lit(1.0), frac).alias("w"))
    return rows.filter(finite("w")).select("event_id", r6("w", "w0"))


def _ranked(key, parts, by):
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {hash_sql(*parts)}, {key})"


@query(
    "train_test_split",
    f"""SELECT vec_id AS subject_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql('vec_id', '42', "'split'")}, vec_id) <= greatest(1, floor(0.2 * (SELECT count(*) FROM embeddings)))
      THEN 'test' ELSE 'train' END AS split FROM embeddings""",
)
def train_test_split_query(spark, sf_dir):
    subjects = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject_id"))
    return train_test_split(subjects, 0.2, 42)


@query(
    "sample_subjects",
    f"SELECT vec_id AS subject_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {hash_sql('vec_id', '42', chr(39) + 'sample' + chr(39))}, vec_id) AS rn FROM embeddings) WHERE rn <= 52",
)
def sample_subjects_query(spark, sf_dir):
    return sample_subjects(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject_id")), 52, 42)


@query(
    "proportional_sample",
    f"""WITH P AS (SELECT c_nationkey AS dataset, count(*) AS pool FROM customer GROUP BY 1), T AS (SELECT sum(pool) AS total FROM P),
      B AS (SELECT dataset, pool, total, least(greatest(1, floor(200 * pool / total)), pool) AS base FROM P, T),
      R AS (SELECT *, greatest(0, 200 - sum(base) OVER ()) AS rest, coalesce(sum(pool - base) OVER (ORDER BY pool DESC, dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM B),
      A AS (SELECT dataset, CASE WHEN total <= 200 THEN pool ELSE base + greatest(0, least(pool - base, rest - before)) END AS n_alloc FROM R),
      C AS (SELECT c_custkey AS subject_id, c_nationkey AS dataset, {_ranked('c_custkey', ['c_custkey', '42', "'pool'"], 'c_nationkey')} AS rn FROM customer)
      SELECT subject_id, dataset, CAST(n_alloc AS BIGINT) AS n_alloc FROM C JOIN A USING (dataset) WHERE rn <= n_alloc""",
)
def proportional_sample_query(spark, sf_dir):
    pool = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("dataset"))
    return proportional_sample(pool, 200, 42).select("subject_id", "dataset", "n_alloc")


@query(
    "stratified_folds",
    f"""SELECT vec_id AS subject_id, label, repeat, CAST(({_ranked('vec_id', ['vec_id', '42', 'repeat', "'fold'"], 'repeat, label')} - 1) % 5 AS INTEGER) AS fold
      FROM embeddings CROSS JOIN (SELECT CAST(r.r AS INTEGER) AS repeat FROM range(2) r(r))""",
)
def stratified_folds_query(spark, sf_dir):
    subjects = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject_id"), "label")
    return stratified_folds(subjects, 5, 42, repeats=2).select("subject_id", "label", "repeat", "fold")


@query("leave_one_site_out", "SELECT c_custkey AS subject_id, c_nationkey AS site, s.n_nationkey AS fold, c_nationkey <> s.n_nationkey AS train FROM customer CROSS JOIN nation s WHERE s.n_nationkey IN (SELECT c_nationkey FROM customer)")
def leave_one_site_out(spark, sf_dir):
    """Every fold's training side is everyone outside the site."""
    rows = site_folds(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("site")))
    return with_each(rows, rows.select("fold").distinct(), "fold").withColumn("train", F.col("site") != F.col("fold"))


@query(
    "balanced_downsample",
    f"""WITH R AS (SELECT vec_id AS subject_id, label, {_ranked('vec_id', ['vec_id', '42', "'balance'"], 'label')} AS rn FROM embeddings)
      SELECT subject_id, label FROM R WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))""",
)
def balanced_downsample_query(spark, sf_dir):
    subjects = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject_id"), "label")
    return balanced_downsample(subjects, 42)


@query(
    "exact_group_quantiles",
    f"""SELECT l_returnflag AS grp, {q6('quantile_cont(l_extendedprice, 0.3333)', 'q0')}, {q6('quantile_cont(l_extendedprice, 0.5)', 'q1')},
      {q6('quantile_cont(l_extendedprice, 0.6667)', 'q2')} FROM lineitem GROUP BY 1""",
)
def exact_group_quantiles(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    q = exact_quantiles(rows, "l_extendedprice", [0.3333, 0.5, 0.6667], ["grp"])
    return q.select("grp", r6("q0"), r6("q1"), r6("q2"))
