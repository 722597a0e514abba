"""Exact encoding and decoding with SentencePiece models of the merge type (BPE), by backtracking.

A sequence of pieces is what the merges produce exactly if every two adjacent pieces, put together and
merged again, come out as the same two pieces. So the encoder walks over a text taking the longest
piece (all pieces at all places come from one Aho-Corasick pass), accepts it if it is compatible with
the piece before, else tries shorter ones, else steps back; a bitfield keeps the positions from which
it came back, so no position fails twice.

Spaces: no piece has a space mark after another character, and runs of marks merge after everything
else. So a text is cut before each word's last mark, words are encoded apart (and kept in a bounded
store, as words repeat), and the marks before them are merged last, from the left. A line feed that
is in no longer piece is a cut as well.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and pairs kept at most by a worker, and the longest word that is kept.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 200_000, 160_000, 64
#: Hash places that tell whether a word came before; a power of two. Words that come once are not kept.
SEEN_PLACES = 1 << 20
#: Ids after which a batch of results is handed over.
BATCH_IDS = 1 << 20


class PieceModel:
    """The pieces of a model file and the encoder over them."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.byte = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.byte_of = {i: int(p[3:5], 16) for p, i in self.byte.items()}
        self.unknown = sp.unk_id()
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.id):
            raise ValueError("the model has pieces across words")
        # A piece that its own merges do not produce never comes out of an encoding.
        self.usable = {p for p in self.id if len(p) == 1 or set(p) != {MARK} and self.merge(p) == [p]}
        split = {p: self._split(p) for p in self.usable if len(p) > 1}
        self.left_edge = {p: self._edge(p, split, 0) for p in self.usable}
        self.right_edge = {p: self._edge(p, split, 1) for p in self.usable}
        self.automaton = ahocorasick.Automaton()
        for p in self.usable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: The next shorter piece with which a piece starts; the lengths of pieces by their first two characters, from the longest.
        self.shorter = {p: q for p in self.usable if (q := next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.usable), p[0] if len(p) > 1 else ""))}
        self.lengths: dict[str, tuple[int, ...]] = {}
        for p in sorted(self.usable, key=len, reverse=True):
            if len(p) > 1 and len(p) not in self.lengths.get(p[:2], ()):
                self.lengths[p[:2]] = (*self.lengths.get(p[:2], ()), len(p))
        #: The ids of words that decode to themselves, as text: the present generation and the one before.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.seen = bytearray(SEEN_PLACES)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: The ids as text.
        self.written = {p: str(i) for p, i in self.id.items()}
        self.runs: dict[int, tuple[int, ...]] = {}
        self.longest_run = max(len(p) for p in self.id if set(p) == {MARK})
        if self.merge(MARK * self.longest_run * 2) != [MARK * self.longest_run] * 2:
            raise ValueError("the model's pieces of space marks do not merge from the left")
        #: Whether a line feed joins no other character, so that texts can be cut there too.
        self.breaks = not any("\n" in p for p in self.id if len(p) > 1)
        self.line_end = self._entry("\n", 0)

    def merge(self, text: str) -> list[str]:
        """The plain merges: again and again the best-scored pair of neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, piece: str) -> tuple[str, str]:
        """The two parts that a piece's last merge joins."""
        parts = list(piece)
        while len(parts) > 2:
            at = max((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score), key=lambda i: (self.score[parts[i] + parts[i + 1]], -i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edge(self, piece: str, split: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float]] | None:
        """What stands at one end of a piece while it grows, each with the score of the merge that takes it up.

        None if a step's score is not below the one before: then merging is not in the order of the scores.
        """
        out = [(piece, float("-inf"))]
        while piece in split:
            part = split[piece][side]
            if any(self.score[x] <= self.score[piece] for x in split[piece] if len(x) > 1):
                return None
            out.append((part, self.score[piece]))
            piece = part
        return out[::-1]

    def _meet(self, left: str, right: str) -> bool:
        """Whether re-merging two neighbours joins nothing across their border.

        Both grow at the border as their own merges take them up, the better score first and the left
        one of equals; they stay apart unless what stands at the border makes a piece of a better score.
        """
        a, b = self.right_edge.get(left, ((left, float("-inf")),)), self.left_edge.get(right, ((right, float("-inf")),))
        if a is None or b is None:
            return self.merge(left + right) == [left, right]
        i = j = 0
        while True:
            (x, up_a), (y, up_b) = a[i], b[j]
            cross = self.score.get(x + y)
            if cross is not None and cross > up_a and cross >= up_b:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if up_a >= up_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        after = self.pairs.get(left)
        known = after.get(right) if after else None
        if known is None:
            if self.n_pairs >= KEPT_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            known = self.pairs.setdefault(left, {})[right] = self._meet(left, right)
            self.n_pairs += 1
        return known

    def _longest(self, word: str, at: int) -> str:
        """The longest piece at a place that the Aho-Corasick pass did not visit; a character of no piece stands for itself."""
        for n in self.lengths.get(word[at : at + 2], ()):
            p = word[at : at + n]
            if len(p) == n and p in self.usable:
                return p
        return word[at]

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word; a character that no piece has stands for itself."""
        size = len(word)
        if word in self.usable:
            return [word]
        longest = {end - len(p) + 1: p for end, p in self.automaton.iter_long(word)}
        failed = 0  # bit by place: nothing that starts there fits
        out: list[str] = []
        at, p = 0, ""
        while at < size:
            p = p or longest.get(at) or self._longest(word, at)
            before = out[-1] if out else ""
            while p and (failed >> (at + len(p)) & 1 or before and not self.compatible(before, p)):
                p = self.shorter.get(p, "")
            if p:
                out.append(p)
                at += len(p)
                p = ""
                continue
            failed |= 1 << at
            while not p:  # back over the pieces that have no shorter one
                back = out.pop()
                at -= len(back)
                p = self.shorter.get(back, "")
                if not p:
                    failed |= 1 << at
        return out

    def run(self, marks: int) -> tuple[int, ...]:
        """The ids of a run of space marks: merged from the left, as these pieces have equal scores."""
        known = self.runs.get(marks)
        if known is None:
            # nothing joins the longest run that is a piece, so it repeats
            whole, rest = divmod(marks, self.longest_run)
            out = [self.id[MARK * self.longest_run]] * whole + [self.id[p] for p in self.merge(MARK * rest)]
            known = tuple(out)
            if len(self.runs) < 4096:
                self.runs[marks] = known
        return known

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            out.extend([i] if i is not None else [self.byte[f"<0x{b:02X}>"] for b in p.encode()])
        return out

    def _entry(self, word: str, marks: int) -> tuple[str, str]:
        """Of a word after so many space marks: the ids joined by commas, and the text they decode to."""
        pieces = self.pieces(MARK + word if marks and word else word)
        if pieces and pieces[0] == MARK:  # no merge took its mark up
            pieces = pieces[1:]
        elif marks and word:
            marks -= 1
        if not marks and word:
            found = list(map(self.written.get, pieces))
            if None not in found:  # no bytes: the pieces are the text
                return ",".join(found), "".join(pieces).replace(MARK, " ")
        ids = [*(self.run(marks) if marks else ()), *self.ids(pieces)]
        return ",".join(map(str, ids)), self._surface(ids)

    def _known(self, key: str) -> str | None:
        """The ids of a word after one mark, or after a line feed where that is its first character.

        From the words kept, or encoded and kept if it decodes to itself; None if it does not.
        """
        ids = self.older.get(key)
        if ids is None:
            word, marks = (key[1:], 0) if key[0] == "\n" else (key, 1)
            ids, surface = self._entry(word, marks)
            if surface != " " * marks + word:
                return None
        if len(key) <= KEPT_LENGTH:
            place = hash(key) % SEEN_PLACES
            if self.seen[place]:
                if len(self.words) >= KEPT_WORDS // 2:
                    self.older, self.words, self.seen = self.words, {}, bytearray(SEEN_PLACES)
                self.words[key] = ids
            self.seen[place] = 1
        return ids

    def _one(self, key: str) -> tuple[str, str]:
        ids = self.words.get(key) or self._known(key)
        word, marks = (key[1:], 0) if key[0] == "\n" else (key, 1)
        return (ids, " " * marks + word) if ids is not None else self._entry(word, marks)

    def encode_parts(self, text: str) -> tuple[list[str], list[str]]:
        """The ids, joined by commas, of consecutive stretches of a text, and the texts they decode to."""
        ids: list[str] = []
        decoded: list[str] = []
        if not text:
            return ids, decoded
        for k, line in enumerate(text.replace(MARK, " ").split("\n") if self.breaks else [text.replace(MARK, " ")]):
            if k:
                ids.append(self.line_end[0])
                decoded.append(self.line_end[1])
                first, gap, rest = line.partition(" ")
                if first:
                    i, t = self._one("\n" + first)
                    ids.append(i)
                    decoded.append(t)
                if not gap:
                    continue
                line = rest
            words = line.split(" ")
            found = list(map(self.words.get, words))
            if None not in found:
                ids += found
                decoded.append(" " + line)
                continue
            marks = 0
            for w, i in zip(words, found, strict=True):
                marks += 1
                if not w:
                    continue
                t = " " + w
                if marks > 1:
                    i, t = self._entry(w, marks)
                elif i is None:
                    i, t = self._one(w)
                ids.append(i)
                decoded.append(t)
                marks = 0
            if marks:
                i, t = self._entry("", marks)
                ids.append(i)
                decoded.append(t)
        return ids, decoded

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.encode_parts(text)[0] for i in ids.split(",")]

    def _surface(self, ids) -> str:
        """Decoded text with space marks as spaces; bytes that are no UTF-8 become U+FFFD one by one."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(self.piece[i].replace(MARK, " ") if i in self.piece else " ⁇ " if i == self.unknown else "")
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark that encoding puts in front goes."""
        while ids and ids[0] not in self.piece and ids[0] not in self.byte_of and ids[0] != self.unknown:
            ids = ids[1:]
        text = self._surface(ids)
        return text[1:] if ids and ids[0] in self.piece and text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        ids, decoded = self.encode_parts(text or "")
        joined = ",".join(ids)
        return joined.count(",") + bool(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256("".join(decoded)[1:].encode()).hexdigest()


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@cache
def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(path)


def _open(path: str) -> PieceModel:
    """A model at a path that every executor has, or a file sent with SparkContext.addFile."""
    return model(path if path.startswith("/") else SparkFiles.get(path))


def encode(docs: DataFrame, path: str, keep: list[Column], text: str = "text", decoded: str | None = None) -> DataFrame:
    """The `keep` columns with `ids` (array of int) for each row; NULL and empty texts give an empty array.

    With `decoded` a column of that name holds the text that the ids decode to, made by the same worker: a second
    step would hold a second model beside each of the first.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _open(path)
        for b in batches:
            start, ends, ids, texts = 0, [0], array("i"), []
            for k, x in enumerate(b.column(b.num_columns - 1), 1):
                found = m.encode(x.as_py() or "")
                ids.extend(found)
                ends.append(len(ids))
                if decoded:
                    texts.append(m.decode(found))
                if len(ids) >= BATCH_IDS or k == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                    more = [pa.array(texts, pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, k - start) for c in b.columns[:-1]), lists, *more], [*b.schema.names[:-1], "ids", *([decoded] if decoded else [])])
                    start, ends, ids, texts = k, [0], array("i"), []

    return rows.mapInArrow(run, f"{schema}, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, path: str, keep: list[Column], ids: str = "ids") -> DataFrame:
    """The `keep` columns with the decoded `text`; NULL ids give an empty text."""
    rows = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _open(path)
        for b in batches:
            texts = [m.decode(x.as_py() or []) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, path: str, keep: list[Column], text: str = "text") -> DataFrame:
    """The `keep` columns with n_tokens, ids_sha256 and decoded_sha256, encoding and decoding in one pass."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _open(path)
        for b in batches:
            found = [m.digest(x.as_py()) for x in b.column(b.num_columns - 1)]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
