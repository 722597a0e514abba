"""Language identification by cross-parsing entropy over suffix automata.

For each language the suffix automaton of some labelled text is built. A text is parsed greedily into
the longest phrases that occur in that text; a language that fits needs few, long phrases. The number
of phrases times log2 of the model's length, divided by the text's length, estimates the cross
entropy, and the language with the smallest estimate wins.

Texts are normalised first: lower case, each run of other characters than letters becomes one
separator, with one at either end. Phrases end at every `WINDOW`-th normalised character; this keeps
the work of all parses in step, and a whole text of any length is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.session import materialise

#: Normalised characters after which a phrase ends anyway.
WINDOW = 1024
#: Distinct labelled texts drawn for a language, characters of a text that are drawn at most, and the model's length in characters.
SAMPLE_ROWS, SAMPLE_TEXT, MODEL_CHARS = 400, 20_000, 24_000
#: Characters parsed side by side.
CHUNK = 1 << 22


class SuffixAutomaton:
    """All substrings of a sequence of symbols; state 0 is the start."""

    def __init__(self, symbols):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][c]
        if self.length[q] != self.length[p] + 1:
            copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = copy
                p = self.link[p]
            q = copy
        self.link[new] = q
        return new


def parse_table(automaton: SuffixAutomaton, width: int) -> np.ndarray:
    """One step of the greedy parse for every state and symbol: 2 * width * next state + phrase begun.

    A symbol that cannot extend the phrase begins the next one. The last state is that before the first
    phrase and after a symbol which the model lacks and which is a phrase of its own.
    """
    n = len(automaton.next)
    step = np.full((n + 1, width), -1, np.int64)
    for s, edges in enumerate(automaton.next):
        step[s, list(edges)] = list(edges.values())
    fresh = np.where(step[0] < 0, n, step[0])
    begun = step < 0
    return (np.where(begun, fresh, step) * (2 * width) + begun).astype(np.int32).ravel()


@dataclass
class Models:
    langs: list[str]
    #: Symbol of each code point: 0 separator, then the letters seen in the models, last any other letter.
    symbol: np.ndarray
    width: int
    tables: list[np.ndarray]
    bits: np.ndarray


def _symbols(texts: list[str]) -> np.ndarray:
    """Symbol by code point, from the letters of the models' texts."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    known = {c: i + 1 for i, c in enumerate(letters)}
    other = len(letters) + 1
    out = np.zeros(0x110000, np.uint8 if other < 255 else np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = known.get(c.lower()[0], other)
    return out


def _normalise(symbol: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts one after another, each ending in one separator, and each text's length (0: no letter)."""
    flat = symbol[np.frombuffer((" " + "".join(t + " " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])  # the place of each text's closing separator
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    kept = np.cumsum(keep)
    flat = flat[keep]
    return flat[1:], np.diff(kept[ends], prepend=kept[0])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Models:
    """Models from labelled rows; rows with a NULL text or language are not used.

    The first SAMPLE_ROWS distinct texts of a language by their hash come to the driver, of each
    SAMPLE_TEXT characters from its first letter on. Each model reads MODEL_CHARS normalised characters
    of them. Every language with a text that is not empty has a model.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    distinct = materialise(rows.groupBy("lang", "h").agg(F.count("*").alias("n")))
    sizes = distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in sizes}
    drawn: dict[str, list[str]] = {}
    if counts:
        # twice the share that is needed, of which the first ones are taken: no language falls short by chance
        share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, 2 * SAMPLE_ROWS / r["texts"]) * (1 << 40)))])
        place = F.pmod("h", F.lit(1 << 40))
        first: dict[str, list[int]] = {}
        for r in sorted(distinct.filter(place < share[F.col("lang")]).select("lang", "h").collect(), key=lambda r: (r["h"] % (1 << 40), r["h"])):
            first.setdefault(r["lang"], []).append(r["h"])
        chosen = labelled.sparkSession.createDataFrame([(k, h) for k, hashes in first.items() for h in hashes[:SAMPLE_ROWS]], "lang string, h long")
        picked = rows.join(F.broadcast(chosen), ["lang", "h"])
        piece = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, SAMPLE_TEXT)
        for r in sorted(picked.groupBy("lang", "h").agg(F.min(piece).alias("text")).collect(), key=lambda r: (r["lang"], r["h"])):
            drawn.setdefault(r["lang"], []).append(r["text"])
    if counts.keys() != drawn.keys():
        raise RuntimeError(f"no model for {sorted(counts.keys() - drawn.keys())}")
    symbol = _symbols([t for ts in drawn.values() for t in ts])
    width = int(symbol.max()) + 2  # one more symbol, which no text has, between the model's texts
    langs, tables, bits = [], [], []
    for name, texts in sorted(drawn.items(), key=lambda x: (-counts[x[0]], x[0])):
        flat, lengths = _normalise(symbol, texts)
        parts, size = [], 0
        for piece in np.split(flat, np.cumsum(lengths)[:-1]):
            if size and size + len(piece) > MODEL_CHARS:
                continue
            parts += [0, *piece.tolist(), width - 1]
            size += len(piece)
        langs.append(name)
        tables.append(parse_table(SuffixAutomaton(parts), width))
        bits.append(np.log2(max(2, size)))
    return Models(langs, symbol, width, tables, np.array(bits))


def phrase_counts(models: Models, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    pieces = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * WINDOW
    size = np.minimum(WINDOW, lengths[owner] - nth * WINDOW)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    out = np.zeros((len(lengths), len(models.langs)), np.int64)
    at = np.empty((len(models.langs), len(owner)), np.int32)
    begun = np.zeros_like(at)
    for k, tab in enumerate(models.tables):
        at[k] = len(tab) - models.width
    for step in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -step, "left"))  # the windows that are longer than step come first
        c = flat[start[:n] + step].astype(np.int32)
        for k, tab in enumerate(models.tables):
            v = tab.take(at[k, :n] + c)
            begun[k, :n] += v & 1
            at[k, :n] = v >> 1
    for k in range(len(models.langs)):
        out[:, k] = np.bincount(owner, begun[k], len(lengths))
    return out


def _predict(models: Models, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    at = 0
    while at < len(texts) and models.langs:
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= CHUNK):
            size += len(texts[upto] or "")
            upto += 1
        flat, lengths = _normalise(models.symbol, [t or "" for t in texts[at:upto]])
        counts = phrase_counts(models, flat, lengths)
        entropy = counts * models.bits / np.maximum(lengths, 1)[:, None]
        best = np.argmin(entropy, 1)
        low = np.sort(entropy, 1)
        for i in np.flatnonzero(lengths):
            lang[at + i] = models.langs[best[i]]
            score[at + i] = float(low[i, 1] / (low[i, 0] + low[i, 1])) if len(models.langs) > 1 else 1.0
        at = upto
    return lang, score


def identify(docs: DataFrame, models: Models, keep: list[Column], text: str = "text") -> DataFrame:
    """The `keep` columns with lang_pred and score, a row for each row of docs.

    A NULL text, one without letters, or no model at all gives `und` and score 0. Ties go to the
    language with more labelled rows, then by name. The score is the runner-up's share of the two smallest entropies: 0.5 at a tie, near 1 for a
    clear win, 1 with a single model.
    """
    models_b = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = _predict(models_b.value, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
