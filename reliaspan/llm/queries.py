"""The registered queries of this package: thin applications of each operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliaspan.llm import curriculum, decision_list, embedding_join, filter_audit, html_blocks, language_id, lexical_scan, piece_bpe, quality_kernel, secret_scan, simhash, toxicity, warc
from reliaspan.llm.common import crc_bucket, table
from reliaspan.session import ensure_checkpoint_dir

#: The vocabulary file; a parameter of the operator.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.train(docs.filter(crc_bucket("doc_id", 4) != 2))
    return language_id.identify(docs, models, [F.col("doc_id"), F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")])


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"), [F.col("page_id"), F.col("url")])


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), PIECES, [F.col("doc_id")])


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_kernel.measured(table(spark, sf_dir, "documents"))
    learned = stats.filter(crc_bucket("doc_id", 3) != 1)
    model = quality_kernel.fit(quality_kernel.labelled_statistics(learned, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    return quality_kernel.score(stats.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op7_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs), [F.col("doc_id")])


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    judged = decision_list.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *[F.col("quality_stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op10_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(crc_bucket("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, [F.col("doc_id"), F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")])


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_pigeonring, op3_html_blocks, op4_piece_bpe, op5_curriculum_mix, op6_quality_kernel, op7_secret_grammar, op8_warc_segments, op9_decision_list, op10_epsilon_grid, op11_filter_orders, op12_lexical_scan, op13_toxicity_trees)}

ORACLES = {
    "op5_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents
        ), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS turn FROM s),
        w AS (SELECT *, ((turn - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
        v AS (
            SELECT *, (SELECT sum(source_size) FROM w)::DOUBLE AS need, (SELECT sum(weight) FROM w) AS weights,
                   sum(cap) OVER f - cap AS cap_before, sum(weight) OVER f - weight AS weight_before
            FROM w WINDOW f AS (ORDER BY cap / weight, turn ROWS UNBOUNDED PRECEDING)
        ), l AS (SELECT *, (need - cap_before) / (weights - weight_before) AS level FROM v),
        a AS (SELECT arg_min(level, cap_before) AS fit FROM l WHERE level * weight <= cap),
        t AS (SELECT source, source_size, least(cap, coalesce((SELECT fit FROM a) * weight, cap)) AS target FROM l),
        c AS (
            SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d
        )
        SELECT doc_id, size, source_size, target,
               (floor((before + size)::DOUBLE * coalesce(target / nullif(source_size, 0)::DOUBLE, 0)) - floor(before::DOUBLE * coalesce(target / nullif(source_size, 0)::DOUBLE, 0)))::BIGINT AS taken
        FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
    """,
    "op8_warc_segments": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM h)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               list_reduce(list_transform(range(0, 40, 5), lambda k: list_reduce(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, k::INT + 1, 5))::INT) >> s) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op10_epsilon_grid": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
        c AS (SELECT u, min(w) AS low FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
    """,
    "op11_filter_orders": r"""
        WITH RECURSIVE f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
        m AS (
            SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                   + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM w
        ),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        c AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
        ),
        o(filter_order, applied) AS (
            SELECT '', 0 UNION ALL SELECT filter_order || letter, applied | bit FROM o JOIN f ON applied & bit = 0
        ),
        s AS (SELECT filter_order, step FROM (SELECT filter_order FROM o WHERE applied = 31), range(1, 6) AS r(step)),
        p AS (
            SELECT filter_order, step::INT AS step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(substr(filter_order, 1, step - 1), g.letter))::INT AS earlier
            FROM s JOIN f ON letter = substr(filter_order, step, 1)
        ),
        r AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM c CROSS JOIN p GROUP BY part, filter_order, step, bit
        )
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
    """,
    "op12_lexical_scan": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ),
        t AS (SELECT row_id, unnest(terms) AS term FROM d),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        f AS (SELECT row_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY row_id, term),
        g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, n_docs),
        m AS (SELECT row_id, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, g WHERE len(terms) > 0),
        s AS (
            SELECT i.item_id, m.row_id, m.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score
            FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY i.item_id, m.row_id, m.doc_id
        ),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
