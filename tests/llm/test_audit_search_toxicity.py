"""Filter audit, lexical search and toxicity against brute-force versions, held-out labels and edge rows."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from reliaspan.llm import common, filter_audit, lexical_scan, toxicity

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LONG = " ".join(f"word{i % 70_000}" for i in range(150_000))
#: doc_id, text, source
ROWS = [
    (1, "short text", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, LONG, "a"), (6, "short text", "b"), (6, "short text", "b"), (1, "short text", "c"),
    (None, "short text", "a"), (None, None, None), (7, "A|B $ " * 60, "a"), (8, "SHOUTING " * 60, "b"), (9, " ".join(f"w{i}é" for i in range(60)), "c"),
    (10, " ".join(f"w{i}é" for i in range(60)), None), (11, " ".join(f"Ж{i}" for i in range(60)), "ä"), (12, "#", ""), (13, "\x0b\x0c\x1c\x85 a", "b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (8, 1, None), (10, 1, 1), (99, 1, 1)]
DOCS = "doc_id long, text string, source string"
CLASHING = DOCS + ", part string, mask int, n long, digest string, item_id long, rank int, score double, found string, features string, key long, toxic int, label int, fold int"
CLASH = ("p", 1, 2, "d", 3, 4, 0.5, "f", "g", 5, 1, 0, 2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def brute_mask(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = re.findall(WORD, text)
    same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    fails = (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search("[#$%&*|]", text)), doc_id is not None and any(x < doc_id for x in same),
    )
    return "".join(c for c, f in zip("ABCDE", fails, strict=True) if f)


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    failed = [(r[2] or "", brute_mask(rows, i), r[0] in good, r[0] in toxic) for i, r in enumerate(rows)]
    for part in {f[0] for f in failed}:
        mine = [f[1:] for f in failed if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f[0] for f in mine) - len(gone), sum(f[0] == x for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_a_plain_walk(docs, labels):
    rows = filter_audit.audit(filter_audit.cells(docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(rows) == len(got) == 600 * len({r[2] or "" for r in ROWS})
    assert got == brute_audit(ROWS, LABELS)


def test_filter_audit_of_other_letters_and_empty_tables(spark, docs, labels):
    counted = spark.createDataFrame([("x", 0, 5, 2, 0), ("x", 3, 4, 1, 1), ("x", 1, 2, 0, 0), ("y", 2, 7, 7, 7)], "part string, mask int, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.audit(counted, "PQ").collect()}
    assert got == {
        ("x", "PQ", 1): (5, 6, 0, 8), ("x", "PQ", 2): (5, 0, 4, 4), ("x", "QP", 1): (7, 4, 0, 4), ("x", "QP", 2): (5, 2, 4, 8),
        ("y", "PQ", 1): (7, 0, 0, 0), ("y", "PQ", 2): (0, 7, 0, 14), ("y", "QP", 1): (0, 7, 0, 14), ("y", "QP", 2): (0, 0, 0, 0),
    }
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), labels)).count() == 0
    none = filter_audit.audit(filter_audit.cells(docs, labels.limit(0)))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


ITEMS = [
    (1, "Short TEXT w3é"), (2, "word7 word7 word8; w1é"), (2, "SHOUTING"), (3, None), (4, "..."), (None, "short a"), (5, "absent"), (6, "text-short\x1fЖ3"), (7, "b a shouting w59é ж3"),
]


def brute_search(rows, items, top=10):
    terms = [re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    kinds = [set(t) for t in terms]
    out = set()
    for i, words in wanted.items():
        found = []
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in k for k in kinds) + 1))) for w in words}
        for (doc_id, _, _), t, k in zip(rows, terms, kinds, strict=True):
            m = 10 + 90 * len(t) * n_docs // n_terms
            score = sum(weight[w] * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in words & k)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out |= {(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)}
    return out


@pytest.mark.parametrize("postings", [1 << 20, 3])
def test_lexical_search_equals_brute_force(spark, docs, postings):
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, rank int, term int")
    many = docs.unionAll(docs.filter("doc_id in (6, 9)")).repartition(5)
    rows = ROWS + [r for r in ROWS if r[0] in (6, 9)]
    got = lexical_scan.search(many, items, top=3, most_postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_search(rows, ITEMS, 3)


def test_lexical_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_scan.search(docs, items.limit(0)).count() == 0
    assert lexical_scan.search(docs.limit(0), items).count() == 0
    assert lexical_scan.search(docs.filter("text is null"), items).count() == 0


def test_groups_of_items_are_bounded_and_whole(spark):
    posted = spark.createDataFrame([(i, f"t{i}_{k}".encode()) for i in range(40) for k in range(1 + i % 7)] + [(99, f"big{k}".encode()) for k in range(50)], "item_id long, term binary")
    groups = [g.collect() for g in lexical_scan.item_groups(posted, 1 << 20, 20)]
    assert all(len(g) <= 20 or {r["item_id"] for r in g} == {99} for g in groups)
    ids = [i for g in groups for i in {r["item_id"] for r in g}]
    assert len(ids) == len(set(ids)) == 41 and sum(map(len, groups)) == posted.count()


@pytest.mark.parametrize(("token", "word", "odd"), [("Idiot!", "idiot", False), ("1d10t,", "idiot", True), ("i.d.i.o.t", "idiot", True), ("looooser", "looser", True), ("don't", "dont", False), ("2024", "", False), ("---", "", False)])
def test_spellings(token, word, odd):
    got = toxicity.plain(token)
    assert got[1] is odd
    if word:
        assert got[0] == word


def test_features_of_a_text():
    lexicon = toxicity.Lexicon({"idiot": 9.0, "stup*": 7.0})
    f = dict(zip(toxicity.FEATURES, lexicon.features("You IDIOT and one two three four five six seven stupid!! 1d10t"), strict=True))
    assert f["strong_density"] == pytest.approx(3 / 12) and f["second_person"] == pytest.approx(1 / 12)
    assert f["near_second_person"] == pytest.approx(1 / 12) and f["obfuscated_lexicon"] == pytest.approx(1 / 12)
    assert f["top_strength"] == 9.0 and f["second_strength"] == 7.0 and f["capital_words"] == pytest.approx(1 / 12)
    assert lexicon.features(None) == lexicon.features(" \n") == [0.0] * len(toxicity.FEATURES)


@pytest.fixture(scope="module")
def corpus(spark):
    return [common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.fit(corpus[0].filter(common.crc_bucket("doc_id", 3) != 1), corpus[1])


def test_toxicity_of_held_out_rows(spark, corpus, model):
    docs, labels = corpus
    held = docs.filter(common.crc_bucket("doc_id", 3) == 1).join(labels, "doc_id").filter("quality = 1")
    rows = toxicity.score(held, model, [F.col("toxic")]).collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    left = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(caught) >= 0.9 * len(caught) > 0 and sum(left) <= 0.02 * len(left)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_of_edge_rows(docs, model):
    rows = toxicity.score(docs, model, [F.col("doc_id"), F.col("part"), F.col("score").alias("mine")]).collect()
    assert len(rows) == len(ROWS) and all(r["part"] == "p" and r["mine"] == 0.5 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1 and toxicity.score(docs.limit(0), model, [F.col("doc_id")]).count() == 0


def test_toxicity_without_labels_of_both_kinds(docs, labels):
    for marks, share in ((labels.limit(0), 0.5), (labels.filter("toxic = 0"), 0.0), (labels.filter("doc_id = 5"), 1.0)):
        rows = toxicity.score(docs, toxicity.fit(docs, marks), [F.col("doc_id")]).collect()
        assert {r["score"] for r in rows} == {share}


def test_toxicity_learns_from_a_few_rows(spark):
    texts = [(i, f"some plain words {i} about topic{i % 9} and more" if i % 3 else f"you idiot {i} are such a moron topic{i % 9}") for i in range(90)]
    few = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    runs = [{r["doc_id"]: r["score"] for r in toxicity.score(few, toxicity.fit(few.repartition(k), marks), [F.col("doc_id")]).collect()} for k in (1, 3)]
    assert runs[0] == runs[1]
    assert all((runs[0][i] >= 0.7) == (i % 3 == 0) for i in range(90))
