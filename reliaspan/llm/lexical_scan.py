"""Ranked lexical search by scanning the documents with one automaton of all query terms.

Nothing is indexed on the document side. The distinct terms of all items, each between two boundary
marks, go into an Aho-Corasick automaton that is broadcast; its outputs are term numbers, and a table
maps those to the items that hold the term. The texts are normalised the same way (letters A-Z lowered, every
separator one boundary mark), so a match is a whole term and at most one term ends at any place.

One scan adds up what the weights need (documents, terms, documents of each term), one more scores the
documents and hands over the best of each partition for each item only. Items are worked off in groups
whose terms and postings are bounded, so the broadcast is, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliaspan.llm.common import sum_matrices
from reliaspan.session import materialise

#: Bytes of terms and number of postings (item, term) of a group of items; a single larger item is a group of its own.
GROUP_BYTES, GROUP_POSTINGS = 8 << 20, 1 << 20
#: Documents scored side by side, and cells (document, item) of that.
DOCS, CELLS = 256, 1 << 22
MARK = b" "
#: Separators become the boundary mark, A-Z are lowered, everything else stays.
TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else MARK[0] for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text with repeats; None has none."""
    return (text or b"").translate(TABLE).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term) without repeats; rows of equal item_id are one item, items without terms have no row."""

    @F.arrow_udf("array<binary>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms(x))) for x in texts.to_pylist()], pa.list_(pa.binary()))

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(split(F.col(text).cast("binary"))).alias("term"))
    return rows.distinct()


def item_groups(posted: DataFrame, most_bytes: int = GROUP_BYTES, most_postings: int = GROUP_POSTINGS) -> list[DataFrame]:
    """The postings in groups of whole items, each within the bounds, or of one item."""
    sizes = posted.groupBy("item_id").agg(F.sum(F.length("term")).alias("bytes"), F.count("*").alias("n"))
    groups, n = [(posted, sizes)], 0
    done = []
    while groups:
        rows, of = groups.pop()
        b, p, items = of.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
        if not items:
            continue
        if items == 1 or (b <= most_bytes and p <= most_postings):
            done.append(rows)
            continue
        n += 1  # parts by another hash each time
        k = min(items, 1 + max(b // most_bytes, p // most_postings))
        part = F.pmod(F.xxhash64("item_id", F.lit(n)), F.lit(max(2, k)))
        groups += [(rows.filter(part == i), of.filter(part == i)) for i in range(max(2, k))]
    return done


class Scanner:
    """Distinct terms as an automaton, with the items of each; built once in each Python worker."""

    def __init__(self, words: Sequence[bytes], starts: np.ndarray, items: np.ndarray, n_items: int):
        self.words, self.starts, self.items, self.n_items = words, starts, items, n_items
        self._automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            # one character for each byte, in the patterns and in the texts
            self._automaton = ahocorasick.Automaton()
            for k, w in enumerate(self.words):
                self._automaton.add_word((MARK + w + MARK).decode("latin-1"), k)
            self._automaton.make_automaton()
        return self._automaton

    def count(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms a text has, and the numbers of those in the automaton with their occurrences."""
        if not text:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = MARK + text.translate(TABLE) + MARK
        b = np.frombuffer(plain, np.uint8) != MARK[0]
        n = int(np.count_nonzero(b[1:] & ~b[:-1]))
        if not n:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits = np.fromiter((k for _, k in self.automaton.iter(plain.decode("latin-1"))), np.int64)
        return (n, *np.unique(hits, return_counts=True))


def _scanner(posted: DataFrame) -> tuple[Scanner, list[int | None]]:
    """The automaton of a group of items, and the items in the order of their numbers."""
    rows = posted.collect()  # bounded by item_groups
    words = sorted({bytes(r["term"]) for r in rows})
    ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i))
    number, place = {w: k for k, w in enumerate(words)}, {i: k for k, i in enumerate(ids)}
    pairs = np.array(sorted((number[bytes(r["term"])], place[r["item_id"]]) for r in rows), np.int64).reshape(-1, 2)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    return Scanner(words, starts, pairs[:, 1].copy(), len(ids)), ids


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for the number of documents that hold a term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


class _Best:
    """The best rows (item, score, doc) so far, `top` for each item; equal scores by ascending doc_id, NULL last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.bar = np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items."""
        d, i = np.nonzero(scores >= self.bar)
        if not len(d):
            return
        item, score = np.concatenate([self.item, i]), np.concatenate([self.score, scores[d, i]])
        doc, no = np.concatenate([self.doc, docs[d]]), np.concatenate([self.null, null[d]])
        order = np.lexsort((doc, no, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.top]
        self.item, self.score, self.doc, self.null = item[rank < self.top], score[keep], doc[keep], no[keep]
        last = rank[rank < self.top] == self.top - 1
        self.bar[self.item[last]] = self.score[last]  # a tie may still win by its doc_id


def search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = GROUP_BYTES, most_postings: int = GROUP_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest scores above 0 of each item, equal ones by ascending doc_id.

    The score is the integer form of BM25 that `weights` and `_scores` compute. Rows of equal item_id are
    one item; each row of docs is a document, also where ids repeat; a NULL doc_id comes last among equal
    scores. NULL and empty texts have no terms. No documents or no terms give no rows.
    """
    posted = materialise(item_terms(items, item_id, item_text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = [_search(rows, group, top) for group in item_groups(posted, most_bytes, most_postings)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, posted: DataFrame, top: int) -> DataFrame:
    spark = rows.sparkSession
    scanner, ids = _scanner(posted)
    shared = spark.sparkContext.broadcast(scanner)
    v = len(scanner.words)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total, held = shared.value, np.zeros(2), np.zeros(v)
        for b in batches:
            for x in b.column(0):
                n, which, _ = scan.count(x.as_py())
                total += (n > 0, n)
                held[which] += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([total, held]).tobytes()], pa.binary())})

    sums = sum_matrices(rows.select("text").mapInArrow(tally, "part binary"), "part", v + 2)
    n_docs, n_terms = int(sums[0]), int(sums[1])
    if not n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = spark.sparkContext.broadcast(weights(n_docs, sums[2:]))
    side = max(1, min(DOCS, CELLS // scanner.n_items))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, w, best = shared.value, weight.value, _Best(scanner_items, top)
        for b in batches:
            for at in range(0, b.num_rows, side):
                part = b.slice(at, side)
                counted = [scan.count(x.as_py()) for x in part.column(1)]
                doc = part.column(0)
                best.add(_scores(scan, w, counted, n_docs, n_terms), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score)], ["place", "doc_id", "score"]
        )

    scanner_items = scanner.n_items
    few = rows.mapInArrow(score, "place long, doc_id long, score long").withColumn("pile", F.pmod(F.spark_partition_id(), F.lit(32)))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (["place", "pile"], ["place"]):  # the best of some partitions, then of those
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "place long, item_id long")
    return few.join(names, "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _scores(scan: Scanner, weight: np.ndarray, counted: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int) -> np.ndarray:
    """Documents x items: for each term of an item w * (10^9 tf div (1000 tf + 8 m)), added up in 64-bit integers."""
    sizes = np.array([len(k) for _, k, _ in counted])
    m = np.array([10 + 90 * n * n_docs // n_terms for n, _, _ in counted], np.int64)
    out = np.zeros((len(counted), scan.n_items), np.int64)
    if not sizes.sum():
        return out
    doc = np.repeat(np.arange(len(counted)), sizes)
    term, tf = np.concatenate([k for _, k, _ in counted]), np.concatenate([c for _, _, c in counted])
    value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    first, size = scan.starts[term], scan.starts[term + 1] - scan.starts[term]
    ends = np.cumsum(size)
    posting = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
    np.add.at(out.reshape(-1), np.repeat(doc, size) * scan.n_items + scan.items[posting], np.repeat(value, size))
    return out
