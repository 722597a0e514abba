"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

The fixed patterns give the base spans. Credentials that they find in a bounded sample of the rows are
the labelled examples of each kind: a prefix tree of their characters is built, statistically
compatible states are merged (Hoeffding's bound on the outcomes at both states and below), which
leaves a small probabilistic automaton of the format. A background automaton is inferred the same way
from ordinary tokens, without those that a format explains better: unlabelled credentials are among
them. Every token of credential characters is scored by the likelihood of each format against the
background; clear winners become spans of kind `like_<kind>` unless they touch a base span.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliaspan.llm.common import in_slices
from reliaspan.session import materialise

#: Fixed patterns, with the least length of the part that decides.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex")
#: Tokens that are scored: of credential characters, without dots at the ends, at least LEAST_ASSIGN of them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{%d,}[A-Za-z0-9+/_=-]" % (LEAST_ASSIGN - 2))
#: Plain words and numbers between signs; they are never taken for unlabelled credentials when the background is learned.
PLAIN = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=.-]+|$))+")

#: Rows drawn to find examples, examples of a kind or shape, characters of an example that count, confidence of the merge test.
SAMPLE_ROWS, EXAMPLES, LENGTH, ALPHA = 20_000, 300, 64, 0.05
#: Least log-likelihood ratio a character for a span; rounds of dropping explained tokens from the background.
MARGIN, ROUNDS = 0.7, 5
END = ""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def credential(text: str, start: int, end: int, kind: str) -> str:
    """The part of a base span that is the credential."""
    return ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


def symbol(c: str) -> str:
    """The class of a character; formats are about classes, not about single letters."""
    if c in "0123456789":
        return "9"
    if c in "abcdef":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if c in "ABCDEF":
        return "A"
    if "G" <= c <= "Z":
        return "G"
    return c if c in "+/_.=-" else "?"


ALPHABET = ("9", "a", "g", "A", "G", "+", "/", "_", ".", "=", "-", "?")
#: Each ASCII character to its class.
CLASSES = {i: symbol(chr(i)) for i in range(128)}
#: Class strings whose kind is remembered.
MEMO = 1 << 16


@dataclass
class Automaton:
    """A probabilistic automaton: counts of each state's outcomes, END for stopping, and where they lead."""

    count: list[dict[str, int]] = field(default_factory=lambda: [{}])
    to: list[dict[str, int]] = field(default_factory=lambda: [{}])
    #: Log shares of the outcomes of each state, made at first use.
    logs: list[dict[str, float]] = field(default_factory=list, repr=False, compare=False)

    def log_likelihood(self, word: str) -> float:
        """Natural log of the probability of a word's classes and its end; unseen outcomes have a small share."""
        if not self.logs:
            for counts in [*self.count, {}]:
                n = sum(counts.values()) + 0.1 * (len(ALPHABET) + 1)
                self.logs.append({c: math.log((counts.get(c, 0) + 0.1) / n) for c in (*ALPHABET, END)})
        total, state = 0.0, 0
        for c in [*map(symbol, word), END]:
            total += self.logs[state][c]  # the last state is that of words which have left the automaton
            state = self.to[state].get(c, -1) if state >= 0 else -1
        return total


def prefix_tree(words: list[str]) -> Automaton:
    a = Automaton()
    for w in words:
        s = 0
        for c in map(symbol, w[:LENGTH]):
            a.count[s][c] = a.count[s].get(c, 0) + 1
            if c not in a.to[s]:
                a.to[s][c] = len(a.count)
                a.count.append({})
                a.to.append({})
            s = a.to[s][c]
        a.count[s][END] = a.count[s].get(END, 0) + 1
    return a


def _alike(f1: int, n1: int, f2: int, n2: int) -> bool:
    if not n1 or not n2:
        return True
    return abs(f1 / n1 - f2 / n2) < math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(words: list[str]) -> Automaton:
    """Merges compatible states of the prefix tree, from the start outwards, and drops the unreachable ones."""
    a = prefix_tree(words)
    total = [sum(c.values()) for c in a.count]

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for c in a.count[p].keys() | a.count[q].keys():
                if not _alike(a.count[p].get(c, 0), total[p], a.count[q].get(c, 0), total[q]):
                    return False
            todo += [(a.to[p][c], a.to[q][c]) for c in a.to[p].keys() & a.to[q].keys() if a.to[p][c] != a.to[q][c]]
        return True

    def fold(p: int, q: int) -> None:
        """Adds the tree below q to the states from p on."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for c, n in a.count[q].items():
                a.count[p][c] = a.count[p].get(c, 0) + n
            total[p] += total[q]
            for c, child in a.to[q].items():
                if c in a.to[p]:
                    todo.append((a.to[p][c], child))
                else:
                    a.to[p][c] = child

    kept = [0]
    while True:
        edge = next(((s, c, t) for s in kept for c, t in sorted(a.to[s].items()) if t not in kept), None)
        if edge is None:
            break
        s, c, t = edge
        same = next((k for k in kept if compatible(k, t)), None)
        if same is None:
            kept.append(t)
        else:
            a.to[s][c] = same
            fold(same, t)
    place = {s: i for i, s in enumerate(kept)}
    return Automaton([a.count[s] for s in kept], [{c: place[t] for c, t in a.to[s].items()} for s in kept])


@dataclass
class Formats:
    kinds: dict[str, Automaton]
    background: Automaton
    #: What plain words and numbers of a shape consist of, for those that the background has not met.
    words: dict[str, Automaton]
    margin: float
    #: Log of the ordinary tokens for each credential of the sample, which any span has to outweigh.
    odds: float = 0.0
    memo: dict[str, str | None] = field(default_factory=dict, repr=False, compare=False)
    #: Tokens that are known to be of no format.
    ordinary: set[str] = field(default_factory=set, repr=False, compare=False)

    def any_in(self, text: str) -> bool:
        """Whether a token of the text is of a format, base spans or not."""
        fresh = set(CANDIDATE.findall(text)) - self.ordinary
        if any(self.kind(t) for t in fresh):
            return True
        if len(self.ordinary) >= MEMO:
            self.ordinary.clear()
        self.ordinary.update(t for t in fresh if len(t) <= LENGTH)
        return False

    def kind(self, token: str) -> str | None:
        """The format that explains a token best, if clearly better than the background."""
        word = token.translate(CLASSES)  # only the classes count
        if word in self.memo:
            return self.memo[word]
        best, kind = explained(word, self.kinds, self.background, self.words)
        found = kind if best > max(self.margin * (len(word) + 1), self.odds) else None
        if len(word) <= LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found


def explained(token: str, kinds: dict[str, Automaton], background: Automaton, words: dict[str, Automaton]) -> tuple[float, str]:
    """The largest log-likelihood ratio of a format against the background, and its kind."""
    best = max(((a.log_likelihood(token), k) for k, a in kinds.items()), default=(-math.inf, ""))
    plain = background.log_likelihood(token)
    if PLAIN.fullmatch(token) and (of := words.get(shape(token))):
        plain = max(plain, of.log_likelihood(token))
    return best[0] - plain, best[1]


def shape(token: str) -> str:
    """Which sorts of characters a token has: digits, lower case, upper case, signs."""
    return "".join(n for n, p in SORTS if p.search(token))


SORTS = [(n, re.compile(p)) for n, p in (("9", "[0-9]"), ("a", "[a-z]"), ("A", "[A-Z]"), ("+", "[+/_=.-]"))]


def _candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    spans = sorted((s, e) for s, e, _ in taken)
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if not (at < len(spans) and spans[at][0] < m.end()):
            yield m


def pooled(tokens: list[str]) -> dict[str, Automaton]:
    """An automaton of one state for the plain words and numbers of each shape."""
    counts: dict[str, dict[str, int]] = {}
    for t in filter(PLAIN.fullmatch, tokens):
        of = counts.setdefault(shape(t), {})
        for c in [*map(symbol, t), END]:
            of[c] = of.get(c, 0) + 1
    return {k: Automaton([c], [dict.fromkeys(ALPHABET, 0)]) for k, c in counts.items()}


def infer_background(plain: list[str], kinds: dict[str, Automaton], words: dict[str, Automaton]) -> Automaton:
    """The automaton of ordinary tokens, without those mixed ones that a format explains better.

    A token is compared with the background of the other half of the tokens, so that it cannot speak for
    itself; what is dropped makes the next background purer. Plain words and numbers always stay.
    """
    halves, kept = [plain[::2], plain[1::2]], [plain[::2], plain[1::2]]
    for _ in range(ROUNDS):
        others = [_automaton(kept[1]), _automaton(kept[0])]
        now = [[t for t in half if PLAIN.fullmatch(t) or explained(t, kinds, other, words)[0] <= 0] for half, other in zip(halves, others, strict=True)]
        if now == kept:
            break
        kept = now
    return _automaton(kept[0] + kept[1])


def _automaton(words: list[str]) -> Automaton:
    """infer(words); without words all classes are alike."""
    return infer(words) if words else Automaton([dict.fromkeys((*ALPHABET, END), 1)], [dict.fromkeys(ALPHABET, 0)])


def learn(docs: DataFrame, text: str = "text") -> Formats | None:
    """Formats from the base spans of at most about SAMPLE_ROWS rows, drawn by the hash of the text.

    At most EXAMPLES distinct credentials of a kind, and as many tokens of a shape that no base span
    touches, come to the driver. None where there is no example.
    """
    rows = docs.select(F.col(text).alias("text")).filter("text is not null")
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, dict[str, int]] = {}
            seen, met = {"plain": 0, "labelled": 0}, set()
            for x in b.column(0):
                t = x.as_py()
                spans = base_spans(t)
                seen["labelled"] += len(spans)
                for s, e, k in spans:
                    v = credential(t, s, e, k)[:LENGTH]
                    found.setdefault(k, {})[v] = _hash(v)
                tokens = {m[0][:LENGTH] for m in _candidates(t, spans)} if spans else {v[:LENGTH] for v in CANDIDATE.findall(t)}
                seen["plain"] += len(tokens)
                for v in tokens - met:
                    found.setdefault("plain " + shape(v), {})[v] = _hash(v)
                met = tokens if len(met) >= MEMO else met
                met |= tokens
                for k, values in found.items():
                    if len(values) > 8 * EXAMPLES:
                        found[k] = dict(heapq.nsmallest(EXAMPLES, values.items(), key=_by_hash))
            rows = [("seen", k, n) for k, n in seen.items()] + [(k, v, h) for k, values in found.items() for v, h in heapq.nsmallest(EXAMPLES, values.items(), key=_by_hash)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "h"])

    values = materialise(drawn.mapInArrow(run, "kind string, value string, h long"))
    seen = {r["value"]: r["n"] for r in values.filter("kind = 'seen'").groupBy("value").agg(F.sum("h").alias("n")).collect()}
    distinct = materialise(values.filter("kind <> 'seen'").distinct())
    examples = {}
    for kind in sorted(r["kind"] for r in distinct.select("kind").distinct().collect()):
        examples[kind] = [r["value"] for r in distinct.filter(F.col("kind") == kind).orderBy("h", "value").limit(EXAMPLES).collect()]
    plain = [v for k, values in examples.items() if k not in KINDS for v in values]
    kinds = {k: infer(examples[k]) for k in KINDS if k in examples}
    if not kinds:
        return None
    words = pooled(plain)
    return Formats(kinds, infer_background(plain, kinds, words), words, MARGIN, max(0.0, math.log((seen["plain"] + 1) / (seen["labelled"] + 1))))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest(), "big")


def _by_hash(item: tuple[str, int]) -> tuple[int, str]:
    return item[1], item[0]


def spans_of(text: str | None, formats: Formats | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start, the base kinds first; none for None and empty texts."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    if formats and formats.any_in(text):
        for m in _candidates(text, base):
            k = formats.kind(m[0])
            if k:
                more.append((m.start(), m.end(), f"like_{k}"))
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[2])) if more else base


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, formats: Formats | None, keep: list[Column], text: str = "text") -> DataFrame:
    """The `keep` columns with n_assign, n_access, n_hex, base_sha256 and spans, a row for each row of docs.

    Places are code points, ends exclusive. NULL and empty texts have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(x.as_py(), shared.value) for x in b.column(b.num_columns - 1)]
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *counts, digests, pa.array([_joined(spans) for _, spans in found], pa.string())],
                [*b.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, formats: Formats | None, mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by a mark."""
    out, at = [], 0
    end = -1
    for s, e, _ in spans_of(text, formats)[1]:
        if s < end:
            end = max(end, e)
            at = max(at, e)
            continue
        out += [text[at:s], mark]
        at = end = e
    return "".join([*out, text[at:]])


def redact(text: Column, formats: Formats | None, mark: str = "[secret]") -> Column:
    """A text column without its secrets; NULL stays NULL."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda x: None if x is None else redact_text(x, formats, mark), pa.string())

    return run(text)
