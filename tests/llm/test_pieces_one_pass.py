"""Encoding and decoding in one step."""

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from reliaspan.llm import piece_bpe

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_decoded_text_come_from_one_worker(spark, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BATCH_IDS", 50)  # batches are cut inside
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, "", " ", "two  words\n\n", "日本 😀 ▁", "a" * 300, *(f"line {i} of some text" for i in range(60))]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    rows = piece_bpe.encode(docs, PIECES, [F.col("doc_id")], decoded="plain").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["plain"] == sp.decode(ids)
    last = corpus_pipeline.encode_pieces(spark, docs, "")
    assert last.columns == ["doc_id", "source", "ids", "decoded", "n_tokens"]
    assert last._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
