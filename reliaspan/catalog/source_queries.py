"""Source, preparation and packaging queries. Text inputs are written from the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliaspan.catalog.fixtures import segment_edges, with_attributes
from reliaspan.catalog.registry import q6, query, r6
from reliaspan.catalog.sqlparts import PANEL, SHORT, ledoit_wolf, pearson, with_panel
from reliaspan.operators.prep import (
    align_confounds, detrend_zscore, fit_scaler, label_average, pad_and_mask, regress_confounds, scale_back, scale_to_unit, select_confounds, task_regressors,
)
from reliaspan.sources.panels import (
    N_MONTHS, SHORT_ROWS, event_samples, lineitem_frames, lineitem_samples, lineitem_subjects, read_table,
)
from reliaspan.sources.phenotype import aliased_phenotypes, healthy_adults, site_phenotypes, union_indexes
from reliaspan.sources.recordings import (
    combine_cohorts, concatenate_runs, concatenate_subjects, discover, feature_store, nested_summary, orient, pair_runs, unpack_matrices, with_metadata,
)
from reliaspan.sources.text import format_matrix, parse_matrix, parse_spaced_series, parse_tabbed_series

SAMPLE_SQL = f"SELECT subject_id, channel, t, {q6('value', 'value')} FROM "


def _samples(df):
    return df.select("subject_id", F.col("channel").cast("int").alias("channel"), F.col("t").cast("int").alias("t"), r6("value"))


@query("text_matrix", with_panel() + SAMPLE_SQL + "S")
def text_matrix(spark, sf_dir):
    return _samples(parse_matrix(format_matrix(lineitem_frames(spark, sf_dir))))


@query("text_spaced_series", with_panel() + SAMPLE_SQL + "S")
def text_spaced_series(spark, sf_dir):
    """Every instant is preceded by a comment line, which must not leave a gap in time."""
    lines = format_matrix(lineitem_frames(spark, sf_dir))
    both = F.explode(F.array(F.struct((F.col("line_no") * 2).alias("n"), F.lit("# note").alias("l")), F.struct((F.col("line_no") * 2 + 1).alias("n"), F.col("line").alias("l"))))
    noisy = lines.select("subject_id", both.alias("e")).select("subject_id", F.col("e.n").alias("line_no"), F.col("e.l").alias("line"))
    return _samples(parse_spaced_series(noisy))


@query("text_tabbed_series", with_panel() + SAMPLE_SQL + "S")
def text_tabbed_series(spark, sf_dir):
    lines = format_matrix(lineitem_frames(spark, sf_dir), "\t")
    labelled = lines.select("subject_id", (F.col("line_no") + 1).alias("line_no"), F.concat(F.lit("file\tbrick\t"), "line").alias("line"))
    header = lines.select("subject_id").distinct().select("subject_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("File\tSub-brick\tMean").alias("line"))
    return _samples(parse_tabbed_series(labelled.unionByName(header)))


@query("orient_wide", with_panel() + SAMPLE_SQL + "S")
def orient_wide(spark, sf_dir):
    """Channel-major rows (12 rows of 83 values) come back as time series."""
    s = lineitem_samples(spark, sf_dir)
    wide = s.groupBy("subject_id", F.col("channel").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda e: e["value"]).alias("values"))
    return _samples(orient(wide))


@query(
    "discover_recordings",
    """SELECT user_id AS subject_id, CAST(user_id % 5 AS INTEGER) AS site, 2.0 + 0.5 * ((user_id % 5) % 2) AS tr, CAST(max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) + 1 AS INTEGER) AS n_rows,
      (max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) + 1) * (2.0 + 0.5 * ((user_id % 5) % 2)) AS total_sec FROM events GROUP BY 1, 2, 3
      HAVING (max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) + 1) * (2.0 + 0.5 * ((user_id % 5) % 2)) >= 60""",
)
def discover_recordings(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    attrs = with_attributes(s.select("subject_id").distinct()).select("subject_id", "site", "tr")
    return discover(s, attrs, 60).select("subject_id", "site", "tr", "n_rows", "total_sec")


@query(
    "concatenate_runs",
    f"WITH {PANEL.strip()} " + SAMPLE_SQL + "(SELECT subject_id, channel, t, value FROM S)",
)
def concatenate_runs_query(spark, sf_dir):
    """The recording is cut into three runs that each start at zero, and put together again."""
    s = lineitem_samples(spark, sf_dir)
    run = F.when(F.col("t") < 20, 1).when(F.col("t") < 50, 2).otherwise(3)
    start = F.when(F.col("t") < 20, 0).when(F.col("t") < 50, 20).otherwise(50)
    runs = s.select("subject_id", "channel", run.alias("run"), (F.col("t") - start).alias("t"), "value")
    return _samples(concatenate_runs(runs))


@query(
    "concatenate_subjects",
    with_panel("OFS AS (SELECT subject_id, (row_number() OVER (ORDER BY subject_id) - 1) * 83 AS off FROM subj)")
    + f"SELECT CAST(t + off AS BIGINT) AS t, channel, {q6('value', 'value')} FROM S JOIN OFS USING (subject_id)",
)
def concatenate_subjects_query(spark, sf_dir):
    s = lineitem_samples(spark, sf_dir)
    sizes = s.groupBy("subject_id").agg((F.max("t") + 1).cast("bigint").alias("n_rows"))
    return concatenate_subjects(s, sizes).select(F.col("t").cast("bigint").alias("t"), "channel", r6("value"))


@query(
    "pair_runs",
    "SELECT 'sub-' || doc_id || '_task-rest' AS base, '/d/sub-' || doc_id || '_task-rest_space-MNI_desc-preproc_bold.nii.gz' AS run_path, '/d/sub-' || doc_id || '_task-rest_desc-confounds_timeseries.tsv' AS confound_path FROM documents WHERE n_chars >= 500",
)
def pair_runs_query(spark, sf_dir):
    """Run and confound listings named after the documents; short documents stand for stub files."""
    d = read_table(spark, sf_dir, "documents").select("n_chars", F.concat(F.lit("/d/sub-"), F.col("doc_id").cast("string"), F.lit("_task-rest")).alias("p"))
    kinds = F.explode(F.array(
        F.struct(F.concat("p", F.lit("_space-MNI_desc-preproc_bold.nii.gz")).alias("path"), F.col("n_chars").alias("length"), F.lit("run").alias("kind")),
        F.struct(F.concat("p", F.lit("_desc-confounds_timeseries.tsv")).alias("path"), F.lit(1).cast("bigint").alias("length"), F.lit("confounds").alias("kind")),
    ))
    return pair_runs(d.select(kinds.alias("e")).select("e.*"), 500)


@query(
    "site_phenotypes",
    """SELECT CAST(c_custkey AS VARCHAR) AS sub_id, c_mktsegment AS site, CASE WHEN c_nationkey % 5 = 0 THEN 'Control' WHEN c_nationkey % 5 < 4 THEN 'ADHD' ELSE 'Unknown' END AS "group",
      CAST(c_nationkey % 5 AS INTEGER) AS dx, CASE WHEN c_custkey % 4 = 0 THEN -1.0 ELSE 7.0 + c_custkey % 30 END AS age, CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'Unknown' END AS sex FROM customer""",
)
def site_phenotypes_query(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = c.select(
        key.cast("string").alias("ScanDir ID"), F.col("c_mktsegment").alias("site"), (F.col("c_nationkey") % 5).cast("string").alias("DX"),
        F.when(key % 4 == 0, "unknown").otherwise((key % 30 + 7).cast("string")).alias("Age"), (key % 3).cast("string").alias("Gender"), F.lit(1).alias("o"),
    )
    older = rows.withColumn("DX", F.lit("9")).withColumn("o", F.lit(0))
    return site_phenotypes(rows.unionByName(older), "o")


@query(
    "aliased_phenotypes",
    """SELECT CAST(c_custkey AS VARCHAR) AS sub_id, c_mktsegment AS site, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'Control' ELSE 'ADHD' END
      WHEN c_nationkey % 2 = 1 THEN 'ADHD' ELSE 'Control' END AS "group", 1.0 * (c_custkey % 50) AS age, 'M' AS sex FROM customer""",
)
def aliased_phenotypes_query(spark, sf_dir):
    key = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit('"'), key.cast("string"), F.lit('"')).alias("SUB_ID"), F.col("c_mktsegment").alias("Site"),
        F.when(key % 2 == 0, (F.col("c_nationkey") % 3).cast("string")).alias("DX"), (F.col("c_nationkey") % 2).cast("string").alias("adhd"),
        (key % 50).cast("string").alias("Age"), F.lit("M").alias("Sex"),
    )
    return aliased_phenotypes(rows)


@query(
    "healthy_adult_index",
    """SELECT 'a' AS dataset_id, CAST(c_custkey AS VARCHAR) AS participant_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 10.0 + c_custkey % 30 END AS age, 'F' AS gender FROM customer
      WHERE c_nationkey % 2 = 0 AND (c_custkey % 4 = 0 OR 10 + c_custkey % 30 >= 18) AND c_custkey % 5 <> 0
      UNION ALL SELECT 'b', CAST(s_suppkey AS VARCHAR), 30.0, '' FROM supplier""",
)
def healthy_adult_index(spark, sf_dir):
    key = F.col("c_custkey")
    a = read_table(spark, sf_dir, "customer").select(
        key.cast("string").alias("participant_id"), F.when(F.col("c_nationkey") % 2 == 0, "Control ").otherwise("patient").alias("diagnosis"),
        F.when(key % 4 == 0, "n/a").otherwise((key % 30 + 10).cast("string")).alias("age"), F.lit("F").alias("sex"), F.when(key % 5 == 0, "0").otherwise("1").alias("rest"),
    )
    b = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("participant_id"), F.lit("25-35").alias("Age"))
    out = union_indexes([healthy_adults(a, "a"), healthy_adults(b, "b")])
    return out.select("dataset_id", "participant_id", "age", "gender")


@query(
    "metadata_defaults",
    """SELECT CAST(c_custkey AS VARCHAR) AS sub_id, coalesce(s_name, 'Unknown') AS site, coalesce(s_acctbal, -1.0) AS age FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def metadata_defaults(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sub_id"))
    dim = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sub_id"), F.col("s_name").alias("site"), F.col("s_acctbal").alias("age"))
    return with_metadata(rows, dim)


@query(
    "unpack_matrices",
    "SELECT vec_id AS subject_id, CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j, CAST(embedding[CAST(i.i * 8 + j.j + 1 AS INTEGER)] AS DOUBLE) AS r FROM embeddings CROSS JOIN range(8) i(i) JOIN range(8) j(j) ON i.i < j.j",
)
def unpack_matrices_query(spark, sf_dir):
    """The 64 features read as an 8 x 8 matrix."""
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8)).alias("matrix")
    )
    return unpack_matrices(e)


@query(
    "combine_cohorts",
    "SELECT vec_id AS pos, label, CAST(vec_id % 3 AS INTEGER) AS site, 'even' AS cohort FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT vec_id, label, CAST(vec_id % 3 AS INTEGER), 'odd' FROM embeddings WHERE label % 2 = 1",
)
def combine_cohorts_query(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label")
    meta = e.select("pos", (F.col("pos") % 3).cast("int").alias("site"), (F.col("label") % 2).alias("p"))
    side = lambda p: (e.filter(F.col("label") % 2 == p), meta.filter(F.col("p") == p).drop("p"))
    return combine_cohorts({"even": side(0), "odd": side(1)}).select("pos", "label", "site", "cohort")


@query(
    "nested_summary",
    """SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 9) AS mean, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_flags, CAST(count(DISTINCT l_linestatus) AS BIGINT) AS n_status FROM lineitem""",
)
def nested_summary_query(spark, sf_dir):
    s = nested_summary(read_table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag", "l_linestatus"])
    return s.select(
        F.col("overall.n").alias("n"), r6(F.col("overall.mean"), "mean", 9), F.size("by_l_returnflag").cast("bigint").alias("n_flags"), F.size("by_l_linestatus").cast("bigint").alias("n_status")
    )


@query(
    "feature_store",
    with_panel(SHORT, pearson("SHORT", "FA", constant="0"), ledoit_wolf("S", "FB"))
    + f"""SELECT subject_id, grp, CAST(66 AS INTEGER) AS n_edges, {q6('a', 'raw_total', 4)}, {q6('b', 'ref_total', 4)} FROM attrs JOIN (SELECT subject_id, sum(r) AS a FROM FA GROUP BY 1) USING (subject_id)
      JOIN (SELECT subject_id, sum(r) AS b FROM FB GROUP BY 1) USING (subject_id)""",
)
def feature_store_query(spark, sf_dir):
    raw = segment_edges(spark, sf_dir, "pearson", ("short",), constant=0.0).drop("seg")
    ref = segment_edges(spark, sf_dir, "ledoit_wolf", ("full",)).drop("seg")
    labels = with_attributes(lineitem_subjects(spark, sf_dir).select("subject_id")).select("subject_id", "grp")
    store = feature_store(raw, raw, ref, labels)
    total = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, b: a + b)
    return store.select("subject_id", "grp", F.size("fc_raw").alias("n_edges"), r6(total("fc_raw"), "raw_total", 4), r6(total("fc_ref"), "ref_total", 4))


DETREND = """
DT AS (SELECT subject_id, channel, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM S GROUP BY 1, 2),
RS AS (SELECT S.*, value - a - b * t AS e FROM S JOIN DT USING (subject_id, channel)),
SDV AS (SELECT subject_id, channel, stddev_samp(e) AS sd FROM RS GROUP BY 1, 2)"""


@query("detrend_zscore", with_panel(DETREND) + f"SELECT subject_id, channel, t, {q6('e / sd', 'value')} FROM RS JOIN SDV USING (subject_id, channel)")
def detrend_zscore_query(spark, sf_dir):
    return _samples(detrend_zscore(lineitem_samples(spark, sf_dir)))


@query(
    "label_average",
    """WITH V AS (SELECT l_suppkey AS subject_id, CAST(month(l_shipdate) AS INTEGER) AS t, l_partkey AS voxel, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)
      SELECT subject_id, p_brand AS channel, t, """ + q6("avg(value)", "value") + " FROM V JOIN part ON voxel = p_partkey GROUP BY 1, 2, 3",
)
def label_average_query(spark, sf_dir):
    vox = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id"), F.month("l_shipdate").alias("t"), F.col("l_partkey").alias("voxel")).agg(F.avg("l_quantity").alias("value"))
    atlas = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), F.col("p_brand").alias("label"))
    return label_average(vox, atlas).select("subject_id", "channel", "t", r6("value"))


@query(
    "confound_regression",
    with_panel(
        """
CF AS (SELECT subject_id, t, max(CASE WHEN channel = 0 THEN value END) AS z FROM S GROUP BY 1, 2),
RG AS (SELECT s.subject_id, s.channel, regr_slope(value, z) AS b, regr_intercept(value, z) AS a FROM S s JOIN CF USING (subject_id, t) WHERE channel > 0 GROUP BY 1, 2)"""
    )
    + f"SELECT s.subject_id, s.channel, s.t, {q6('value - a - b * z', 'value')} FROM S s JOIN CF ON CF.subject_id = s.subject_id AND CF.t = s.t JOIN RG ON RG.subject_id = s.subject_id AND RG.channel = s.channel",
)
def confound_regression(spark, sf_dir):
    """Channel 0 plays the confound; a motion-like derivative column that does not exist is ignored."""
    s = lineitem_samples(spark, sf_dir)
    conf = s.filter("channel = 0").select("subject_id", "t", F.col("value").alias("motion"))
    chosen = select_confounds(conf, ["motion", "missing"])
    return _samples(regress_confounds(s.filter("channel > 0"), chosen, ["motion"]))


@query(
    "confound_alignment",
    "WITH C AS (SELECT user_id AS subject_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS t, event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT subject_id, CAST(t - greatest(n - 20, 0) AS INTEGER) AS t, event_id FROM C WHERE t >= greatest(n - 20, 0)",
)
def confound_alignment(spark, sf_dir):
    from reliaspan.operators.clean import close_gaps

    ev = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("t"), "event_id")
    conf = close_gaps(ev)
    lengths = conf.select("subject_id").distinct().withColumn("n_rows", F.lit(20))
    return align_confounds(conf, lengths).select("subject_id", F.col("t").cast("int").alias("t"), "event_id")


@query("task_regressors")
def task_regressors_query(spark, sf_dir):
    grid = lineitem_frames(spark, sf_dir).select("subject_id", "t")
    return task_regressors(grid, N_MONTHS, 2.0, 9).select("subject_id", "condition", "t", r6("value"))


@query(
    "minmax_mask",
    with_panel(
        """
MM AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM S GROUP BY 1),
PD AS (SELECT subject_id, channel, CAST(g.g AS INTEGER) AS t, max(CASE WHEN S.t = g.g AND S.t < 16 THEN value ELSE 0 END) AS value FROM S JOIN range(24) g(g) ON TRUE GROUP BY 1, 2, 3)"""
    )
    + f"SELECT subject_id, channel, t, {q6('(value - lo) / (hi - lo) * 2 - 1', 'value')}, t < 16 AS observed FROM PD JOIN MM USING (channel)",
)
def minmax_mask(spark, sf_dir):
    s = lineitem_samples(spark, sf_dir)
    padded = pad_and_mask(s.filter(F.col("t") < SHORT_ROWS), 24, SHORT_ROWS)
    out = scale_to_unit(padded, fit_scaler(s))
    return out.select("subject_id", "channel", "t", r6("value"), "observed")


@query("minmax_round_trip", with_panel() + SAMPLE_SQL + "S")
def minmax_round_trip(spark, sf_dir):
    s = lineitem_samples(spark, sf_dir)
    scaler = fit_scaler(s)
    return _samples(scale_back(scale_to_unit(s, scaler), scaler))
