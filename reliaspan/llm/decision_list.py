"""Quality rules: base statistics and a learned decision list.

Sequential covering finds rules for bad documents one by one: a rule grows threshold by threshold to
the conjunction with the best gain on two thirds of the labelled statistics, is pruned on the rest,
and is kept while it is right often enough there; the rows that it covers leave. Every step counts all
labelled rows by narrow bins of their values, in DataFrame operations only. The rules become one ordered Spark conditional
expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import WORD_GAP, let
from reliaspan.session import materialise

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\f\r"
WINDOW = 5
#: Bins of values to each doubling (cuts lie between bins), conditions of a rule, rules, least precision.
BINS, MOST_CONDITIONS, MOST_RULES, PRECISION = 256, 3, 8, 0.9
LEAST_COVER = 10


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _split_words(text: Column) -> Column:
    """The words in order; none for NULL and empty texts."""
    inner = F.btrim(text, F.lit(GAPS))
    return F.when(inner != "", F.split(inner, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that come twice or more, from the words' hashes.

    Texts without a repeated window, nearly all, need one pass. For the others the windows are sorted by
    hash and place: equal neighbours are repeats, and the places of all of these, sorted again, cover
    min(WINDOW, distance to the next place) words each.
    """
    n = F.size(hashes)

    def of(windows: Column) -> Column:
        keyed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            m = F.size(s)
            hit = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])))
            places = F.array_sort(F.transform(hit, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(keyed, covered))

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(n > WINDOW, let(windows, of)).otherwise(F.lit(0))


#: Statistics that rules may use, as expressions of the base ones.
STATISTICS = ("n_words", "word_chars_mean", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "bang_share", "line_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `quality_stats`; a column of that name is replaced.

    Base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A NULL text has no words and zeros
    everywhere. Then STATISTICS, which are shares and means and 0 where they would divide by zero.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = _split_words(t)

    def base(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(_without(t, GAPS)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
            let(hashes, lambda h: F.struct(_repeat_words(h).cast("long").alias("repeat"), F.size(F.array_distinct(h)).cast("long").alias("distinct"))).alias("hashed"),
            (F.length(t) - F.length(_without(t, "0123456789"))).cast("long").alias("digits"),
            (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("bangs"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("upper"),
        )

    s = let(words, base)

    def flat(x: Column) -> Column:
        share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
        n, chars = x["n_words"], x["word_chars"]
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["lines"]["dup"].alias("n_dup_lines"), x["hashed"]["repeat"].alias("n_repeat_words"),
            share(chars, n).alias("word_chars_mean"), share(x["n_symbols"], chars).alias("symbol_share"), share(x["lines"]["dup"], x["lines"]["all"]).alias("dup_line_share"),
            share(x["hashed"]["repeat"], n).alias("repeat_share"), share(x["upper"], chars).alias("upper_share"), share(x["digits"], chars).alias("digit_share"),
            share(x["hashed"]["distinct"], n).alias("distinct_share"), share(x["bangs"], n).alias("bang_share"), share(n, x["lines"]["all"]).alias("line_words"),
        )

    return docs.withColumn("quality_stats", let(s, flat))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # statistic > cut, else statistic <= cut
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.statistic] > self.cut) == self.above

    def column(self, stats: Column) -> Column:
        x = stats[self.statistic].cast("double")
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)


def _bins(v: np.ndarray) -> np.ndarray:
    """Ordered numbers of the bins of values, BINS to each doubling, as bin_of."""
    size = np.floor(np.log(np.maximum(np.abs(v), 1e-300)) / math.log(2) * BINS) + (1 << 20)
    return (np.sign(v) * size).astype(np.int64)


def bin_of(v: Column) -> Column:
    return (F.signum(v) * (F.floor(F.log(F.greatest(F.abs(v), F.lit(1e-300))) / math.log(2) * BINS) + (1 << 20))).cast("long")


def _inside(x: np.ndarray, names: Sequence[str], conditions: Sequence[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        out &= (x[:, names.index(c.statistic)] > c.cut) == c.above
    return out


def _open(x: np.ndarray, names: Sequence[str], rules: Sequence[Sequence[Condition]]) -> np.ndarray:
    """The rows that no rule covers."""
    out = np.ones(len(x), bool)
    for rule in rules:
        out &= ~_inside(x, names, rule)
    return out


def _tally(x: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """[statistic, bin, bad, n, low, high]: bad rows, rows, least and largest value of each bin that has rows."""
    parts = []
    for s in range(x.shape[1] if len(x) else 0):
        order = np.argsort(x[:, s], kind="stable")
        v = np.ascontiguousarray(x[order, s])
        bins = _bins(v)
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        ends = np.r_[starts[1:], len(v)]
        parts.append((np.full(len(starts), s), bins[starts], np.add.reduceat(bad[order].astype(np.int64), starts), ends - starts, v[starts], v[ends - 1]))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)] * 2


def _best(tally: Sequence[np.ndarray], names: Sequence[str]) -> Condition | None:
    """The condition with the best gain over the cuts between neighbouring bins; None if none gains."""
    best, take = 0.0, None
    for s, name in enumerate(names):
        mine = np.flatnonzero(tally[0] == s)
        mine = mine[np.argsort(tally[1][mine])]
        bad, n, low, high = (c[mine] for c in tally[2:])
        p0, all0 = int(bad.sum()), int(n.sum())
        if not 0 < p0 < all0:
            return None
        if len(mine) < 2:
            continue
        p, size = (np.cumsum(c)[:-1].astype(float) for c in (bad, n))
        p, size = np.stack([p, p0 - p], 1), np.stack([size, all0 - size], 1)
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / size) - math.log2(p0 / all0)), -math.inf)
        i, above = divmod(int(np.argmax(gain)), 2)
        if gain[i, above] > best + 1e-9:
            middle = (high[i] + low[i + 1]) / 2
            best, take = gain[i, above], Condition(name, bool(above), float(middle if middle < low[i + 1] else high[i]))
    return take


def cover(tally: Callable, check: Callable, names: Sequence[str]) -> list[tuple[Condition, ...]]:
    """Rules, most reliable evidence first; none if no rule is precise enough.

    tally(rules, conditions) counts the growing rows that no rule covers and that meet the conditions, as _tally does;
    check(rules, rule) gives for each beginning of a rule the bad and all pruning rows, and the bad and all rows, inside.
    A rule must cover LEAST_COVER bad rows and be right on PRECISION of all rows and of the pruning rows that it covers.
    """
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS and (take := _best(tally(rules, rule), names)):
            rule.append(take)
        if not rule:
            break
        counts = check(rules, rule)

        def worth(n: int) -> float:
            hits, size = counts[n - 1][:2]
            return (2 * hits - size) / size if size else -1.0

        while len(rule) > 1 and worth(len(rule) - 1) >= worth(len(rule)):
            rule.pop()
        right, tested, hits, covered = counts[len(rule) - 1]
        if hits < LEAST_COVER or hits < PRECISION * covered or tested and right < PRECISION * tested:
            break
        rules.append(tuple(rule))
    return rules


def _checked(x: np.ndarray, names: Sequence[str], rule: Sequence[Condition], bad: np.ndarray, prune: np.ndarray) -> list[list[int]]:
    inside = [_inside(x, names, rule[: n + 1]) for n in range(len(rule))]
    return [[int(m.sum()) for m in (i & prune & bad, i & prune, i & bad, i)] for i in inside]


def learn(rows: Sequence[dict], statistics_used: Sequence[str] = STATISTICS) -> list[tuple[Condition, ...]]:
    """Rules for rows at hand with `bad` true; every third row prunes, the others grow."""
    names = list(statistics_used)
    x = np.array([[r[s] for s in names] for r in rows], float).reshape(len(rows), len(names))
    bad, prune = np.array([bool(r["bad"]) for r in rows], bool), np.arange(len(rows)) % 3 == 0

    def tally(rules: Sequence, conditions: Sequence) -> list[np.ndarray]:
        at = ~prune & _open(x, names, rules) & _inside(x, names, conditions)
        return _tally(x[at], bad[at])

    def check(rules: Sequence, rule: Sequence) -> list[list[int]]:
        at = _open(x, names, rules)
        return _checked(x[at], names, rule, bad[at], prune[at])

    return cover(tally, check, names)


def learn_table(rows: DataFrame, names: Sequence[str] = STATISTICS) -> list[tuple[Condition, ...]]:
    """Rules from all of rows(bad, prune, statistics...); counts of bins and of rules reach the driver, never rows."""
    names = list(names)
    stats = F.struct(*names)

    def meets(conditions: Sequence[Condition]) -> Column:
        return reduce(Column.__and__, [c.column(stats) for c in conditions], F.lit(True))

    def left(rules: Sequence) -> DataFrame:
        return rows.filter(verdict(rules, stats))

    def tally(rules: Sequence, conditions: Sequence) -> list[np.ndarray]:
        inside = left(rules).filter(~F.col("prune") & meets(conditions))
        each = inside.select("bad", F.posexplode(F.array(*[F.col(s).cast("double") for s in names])).alias("s", "v"))
        counted = each.groupBy("s", bin_of(F.col("v")).alias("bin")).agg(F.sum(F.col("bad").cast("long")), F.count(F.lit(1)), F.min("v"), F.max("v"))
        return [np.array(c) for c in zip(*counted.collect(), strict=True)] or _tally(np.zeros((0, len(names))), np.zeros(0))

    def check(rules: Sequence, rule: Sequence) -> list[list[int]]:
        beginnings = [meets(rule[: n + 1]) for n in range(len(rule))]
        wanted = [F.count_if(m) for i in beginnings for m in (i & F.col("prune") & F.col("bad"), i & F.col("prune"), i & F.col("bad"), i)]
        counts = list(left(rules).agg(*[w.alias(f"n{k}") for k, w in enumerate(wanted)]).first())
        return [counts[at : at + 4] for at in range(0, len(counts), 4)]

    return cover(tally, check, names)


def verdict(rules: Sequence[Sequence[Condition]], stats: Column) -> Column:
    """True (keep) unless a rule holds, tried in order."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].column(stats)
        for c in rule[1:]:
            holds = holds & c.column(stats)
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> list[tuple[Condition, ...]]:
    """Rules from all labelled documents, quality 0 being bad; a third of them, by the hash of their id, prunes.

    The numbers of the labelled documents are stored once and counted where they are. Several labels of an id
    count as their mean, rounded. NULL ids, labels and texts are not used; without both kinds of rows there are no rules.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("double").alias("quality")).na.drop().groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    # one plan at every size: texts are shuffled once, unsorted, and labels are never sent to all tasks
    known = statistics(texts.join(marked.hint("shuffle_hash"), "doc_id"))
    # which rows fail the base rules is asked after they are stored: a filter here would move below the join, to all documents
    prune = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    rows = materialise(known.select("bad", prune, *[F.col("quality_stats")[s].cast("double").alias(s) for s in STATISTICS], base_failed(F.col("quality_stats")).alias("failed")))
    return learn_table(rows.filter("not failed"))


def judge(docs: DataFrame, rules: Sequence[Sequence[Condition]], text: str = "text") -> DataFrame:
    """docs with quality_stats, base_failed and kept (these three names are replaced); every row has a verdict."""
    out = statistics(docs, text).withColumn("base_failed", base_failed(F.col("quality_stats")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules, F.col("quality_stats")))
