"""A training-data pipeline: five operators over `documents`, each on what the one before it kept.

Quality rules drop documents, SimHash near-dedup keeps one document of each group, secret scans redact
what they find, the mix repeats or drops documents by the target weights of their sources, in training
order, and the last stage encodes what is left and decodes the ids.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reliaspan.llm import curriculum, decision_list, piece_bpe, secret_scan, simhash  # noqa: E402
from reliaspan.llm.common import table  # noqa: E402
from reliaspan.llm.queries import PIECES  # noqa: E402
from reliaspan.session import ensure_checkpoint_dir  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or the learned decision list."""
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    columns = [f"c{i}" for i in range(len(docs.columns))]  # whatever the names are, judge's own do not meet them
    rows = docs.toDF(*columns)
    return decision_list.judge(rows, rules, columns[docs.columns.index("text")]).filter("kept").select(*columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of linked fingerprints."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and corrects n_chars."""
    clean = docs.withColumn("text", secret_scan.redact(F.col("text"), secret_scan.learn(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix reads them whole, at the target weights of their sources, in training order."""
    return curriculum.whole_readings(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the text that they decode to."""
    coded = piece_bpe.encode(docs, PIECES, [F.col("doc_id"), F.col("source")], decoded="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: The learned and Python-backed stages have no SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
