"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that are much more frequent among distinct labelled
toxic texts than among clean ones, each with a strength. A document then has densities of lexicon words,
their nearness to second-person words, and rates of capitals, punctuation and obfuscated spelling. Trees
of Spark ML are boosted over these, and an isotonic regression on rows that no tree has seen turns their
margin into a probability.

Features of the rows that are learned from use a lexicon of other rows (two halves), so that a word
seen in one text only does not look like evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import hash_share
from reliaspan.session import materialise

#: Distinct labelled texts of each label that a model is learned from, and lexicon entries kept.
SAMPLE_TEXTS, LEXICON = 20_000, 20_000
#: Entries are whole words and beginnings of these lengths; they need so many toxic texts and that ratio.
STEMS, LEAST_TEXTS, LEAST_RATIO = (3, 4, 5, 6), 3, 4.0
#: A word's strength is (log ratio) x sqrt(toxic texts); words at least this strong count as strong.
STRONG = 6.0
TREES, DEPTH, STEP, SEED = 24, 3, 0.3, 17
#: Words between a lexicon word and a second-person word that still are near.
NEAR = 5
#: Second-person words of some languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans("013457@$€!|", "oieastasei" + "l")
FEATURES = (
    "log_words", "lexicon_density", "strong_density", "strong_log", "top_strength", "second_strength", "strength_density", "strong_kinds_log",
    "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation", "symbols", "obfuscated", "obfuscated_lexicon", "repeated_letters",
)
#: Characters of a token that are looked at, and tokens remembered in a worker.
TOKEN, REMEMBERED = 64, 400_000


_STRETCHED = re.compile(r"(.)\1\1")


def plain(token: str) -> tuple[str, bool]:
    """The word that a token spells, lowered, and whether its spelling was obfuscated.

    Marks at the ends are no part of a word. Inside it, look-alikes become letters, other marks go and
    letters three or more times in a row count once.
    """
    word = token[:TOKEN].lower()
    if not word.isalpha():
        inner = word.strip("0123456789.,;:!?\"'()[]{}<>#$%&*|/\\_-+=~^`«»„“”’…")
        if not inner.isalpha():
            head = word.strip(".,;:?\"'()[]{}<>#%&*/\\_-+=~^`«»„“”’…")
            spelled = "".join(c for c in head.translate(LOOKALIKES) if c.isalpha())
            letters = sum(c.isalpha() for c in head)
            return spelled, 5 * letters >= 2 * len(head) and 2 <= letters <= 20 and "'" not in head and "-" not in head
        word = inner
    if _STRETCHED.search(word):
        return "".join(c for k, c in enumerate(word) if k < 2 or not c == word[k - 1] == word[k - 2]), True
    return word, False


def entries(word: str) -> list[str]:
    """The lexicon entries that a word can meet: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


_MISS = object()


class Lexicon:
    """Strengths of words, by the strongest entry of each; remembers tokens in a worker.

    A token without any part in a count (no lexicon word, plain spelling, not in capitals, no second
    person) is remembered as None. Once REMEMBERED tokens are held, new ones are worked out each time.
    """

    def __init__(self, strength: dict[str, float]):
        self.strength = strength
        self._beginnings = frozenset(e[:3] for e in strength)
        self._seen: dict[str, tuple | None] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": {}}

    def _learn(self, token: str) -> tuple | None:
        """(word, strength, obfuscated, in capitals, second person, stretched), None if nothing holds."""
        word, odd = plain(token)
        s = 0.0
        if len(word) > 2 and word[:3] in self._beginnings:
            get = self.strength.get
            s = max([get(e, 0.0) for e in entries(word)])
        found = (word, s, odd, len(token) > 2 and token.isupper(), word in SECOND_PERSON, odd and token.isalpha())
        if not any(found[1:]):
            found = None
        if len(self._seen) < REMEMBERED and len(token) <= TOKEN:
            self._seen[token] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """FEATURES of a text; None and texts without words have zeros."""
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        hits = strong = odd = odd_hits = capital = you = stretched = 0
        total = 0.0
        kinds: dict[str, float] = {}
        get = self._seen.get
        known: dict[str, tuple] = {}
        for token, k in Counter(tokens).items():
            found = get(token, _MISS)
            if found is _MISS:
                found = self._learn(token)
            if found is None:
                continue
            known[token] = found
            word, s, o, c, y, x = found
            odd += k * o
            capital += k * c
            you += k * y
            stretched += k * x
            if s > 0:
                hits += k
                total += k * s
                odd_hits += k * o
                if s >= STRONG:
                    strong += k
                    kinds[word] = s
        near = 0
        if strong and you:
            last, waiting = -NEAR - 1, []
            for at, token in enumerate(tokens):
                found = known.get(token)
                if found is None:
                    continue
                if found[4]:
                    near += sum(at - w <= NEAR for w in waiting)
                    last, waiting = at, []
                elif found[1] >= STRONG:
                    if at - last <= NEAR:
                        near += 1
                    else:
                        waiting = [w for w in waiting if at - w < NEAR] + [at]
        tops = sorted(kinds.values(), reverse=True)[:2] + [0.0, 0.0]
        c = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
        size = len(text)
        return [
            math.log1p(n), hits / n, strong / n, math.log1p(strong), tops[0], tops[1], total / n, math.log1p(len(kinds)),
            near / n, you / n, float(c[65:91].sum()) / size, capital / n, float(c[33]) / size, float(c[63]) / size, float(c[[39, 40, 41, 44, 46, 58, 59]].sum()) / size,
            float(c[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum()) / size, odd / n, odd_hits / n, stretched / n,
        ]


def features_column(text: Column, half: Column, lexicons: list[Lexicon], spark) -> Column:
    """FEATURES of a text by the lexicon of number `half`."""
    shared = spark.sparkContext.broadcast(lexicons)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array, halves: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), 256):
            rows = zip(texts.slice(at, 256).to_pylist(), halves.slice(at, 256).to_pylist(), strict=True)
            parts.append(pa.array([shared.value[h].features(t) for t, h in rows], pa.list_(pa.float64())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run(text, half)


def learn_lexicon(texts: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Strengths of the `most` strongest entries from `texts(text, toxic 0/1)`, each text counted once for an entry.

    Partitions add up their own entries first; the driver gets the kept entries only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(tally[0].keys() | tally[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([t[x] for x in names], pa.int64()) for t in tally]], ["entry", "clean", "toxic"])
            tally[0].clear(), tally[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = {plain(t)[0] for t in set((text.as_py() or "").split())}
                tally[toxic].update({e for w in words if len(w) > 2 for e in entries(w)})
                if len(tally[0]) + len(tally[1]) > 400_000:
                    yield flush()
        yield flush()

    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}
    found = texts.select("text", F.col("toxic").cast("int")).mapInArrow(count, "entry string, clean long, toxic long")
    found = found.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = (F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    rows = found.filter((F.col("toxic") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).select("entry", (F.log(ratio) * F.sqrt("toxic")).alias("strength"))
    return {r["entry"]: r["strength"] for r in rows.orderBy(F.desc("strength"), "entry").limit(most).collect()}


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    #: Trees and calibration; None where the labels are of one kind or absent, then `share` is the score.
    stages: PipelineModel | None
    share: float


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, key, weight): distinct labelled texts, up to about `most` of each label, by the text's hash.

    Several labels of one text count as their rounded mean. weight is the number of texts that a row stands for.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).na.drop().groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("size")).filter("size > 0").join(marks, "doc_id")
    texts = materialise(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    taken = [hash_share(texts.filter(F.col("toxic") == k), F.col("key"), most / n).withColumn("weight", F.lit(max(1.0, n / most))) for k, n in sizes.items()]
    if not taken:
        return docs.select("text", F.lit(0).alias("toxic"), F.lit(0).cast("long").alias("key"), F.lit(1.0).alias("weight")).limit(0)
    rows = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
    # a doc_id may come again with another text
    one = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(rows, ["doc_id", "key"]).dropDuplicates(["key"])
    parts = max(4, docs.sparkSession.sparkContext.defaultParallelism)
    return materialise(one.select("text", "toxic", "key", "weight").repartition(parts, "key").sortWithinPartitions("key"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_TEXTS) -> ToxicityModel:
    """A model from the rows of `docs(doc_id, text)` that `labels(doc_id, toxic)` marks, NULLs left out."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, most)
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(6))  # the half by parity; 4 and 5 calibrate
    sample = sample.withColumn("fold", fold.cast("int"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    whole = Lexicon(learn_lexicon(sample))
    share = sizes.get(1, 0.0) / max(1.0, sum(sizes.values())) if sizes else 0.5
    if len(sizes) < 2:
        return ToxicityModel(whole, None, share)
    others = [Lexicon(learn_lexicon(sample.filter(F.col("fold") % 2 != h))) for h in (0, 1)]
    rows = sample.select(array_to_vector(features_column(F.col("text"), F.col("fold") % 2, others, spark)).alias("features"), F.col("toxic").cast("double").alias("label"), "weight", "fold")
    rows = materialise(rows)
    grown, apart = rows.filter("fold < 4"), rows.filter("fold >= 4")
    kinds = [{r["label"] for r in x.select("label").distinct().collect()} for x in (grown, apart)]
    if len(kinds[0]) < 2:
        grown = rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=3, maxBins=64, seed=SEED, weightCol="weight").fit(grown)
    apart = apart if len(kinds[1]) == 2 else rows
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score")
    return ToxicityModel(whole, PipelineModel([trees, isotonic.fit(_margin(trees.transform(apart)))]), share)


def _margin(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", vector_to_array("rawPrediction")[1])


def score(docs: DataFrame, model: ToxicityModel, keep: list[Column], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The `keep` columns of docs with score (0 to 1) and predicted (1 from `threshold`).

    NULL texts and texts without words have the features of an empty text, all zero.
    """
    names = [f"k{i}" for i in range(len(keep))]
    found = features_column(F.col(text).cast("string"), F.lit(0), [model.lexicon], docs.sparkSession)
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], found.alias("found"))
    if model.stages is None:
        rows = rows.withColumn("score", F.lit(float(model.share)))
    else:
        trees, isotonic = model.stages.stages
        rows = isotonic.transform(_margin(trees.transform(rows.withColumn("features", array_to_vector("found")))))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    labels = docs.select(*keep).columns
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, labels, strict=True)], value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
