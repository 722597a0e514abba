"""Pages, pieces, mixing, archives, rules, vectors and the pipeline against brute-force versions and edge rows."""

import html
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from reliaspan.llm import common, curriculum, decision_list, embedding_join, html_blocks, piece_bpe, simhash, warc

LONG = "lorem ipsum dolor sit amet " * 20_000
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word", "b"), (5, "word", "b"), (None, "a text without an id", None), (7, LONG, "b"), (8, "repeated row of five words", "a"), (8, "repeated row of five words", "a")]
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5, "x", True) for i, t, s in rows], "doc_id long, text string, source string, size long, taken long, position double, h string, kept boolean")


# pages


def test_blocks_of_an_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Menu</a></nav><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Short.<ul><li>item</ul><div class="comments"><p>nice</div></article>
    <aside>side</aside><form>f</form><footer>&copy; x</footer></body></html>"""
    assert html_blocks.main_text(page) == "Head & line\n\nOne two three four\n\nShort.\n\nitem"


def test_blocks_without_an_article_are_classified_by_rules():
    para = "The cat is on the mat and it was there for all of the day, as it has been with us in the house. " * 4
    page = f"<body><div><a href=1>Home page</a> <a href=2>About us</a></div><h2>A heading</h2><p>{para}</p><p>Short one.</p><p>{para}</p><div>Xyzzy plugh qwert asdf zxcv uiop hjkl vbnm tyui ghjk wert sdfg cvbn yuio bnmk poiu lkjh mnbv</div></body>"
    got = html_blocks.main_text(page).split("\n\n")
    assert got == [" ".join(para.split()), "Short one.", " ".join(para.split())] or got[0] == "A heading"
    assert "Home page" not in got and not any("Xyzzy" in g for g in got)


def test_blocks_inside_an_article_are_classified_and_classes_match_whole():
    para = "The cat is on the mat and it was there for all of the day, as it has been with us in the house."
    links = "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(3))
    page = f"<article><h1>Head</h1><p>{para}</p><ul>{links}</ul><p>More:</p><ul>{links}</ul><h2><a href=#x>Part</a></h2><p>{para}</p><p>End.</p></article>"
    assert html_blocks.main_text(page) == f"Head\n\n{para}\n\nPart\n\n{para}\n\nEnd."
    for start in ('<body class="has-sidebar"><article>', '<body class="comments"><main>', '<article class="no-sidebar">', '<div class="comments-open" data-id="ad"><article id="ad">'):
        assert html_blocks.main_text(f"<html>{start}<p>{para}</p>") == para
    page = f'<article><p class="ad">Buy now<p>{para}</p><ul><li class="social share">Share it<ul><li>x</li></ul>this</li><li>item</ul><table><tr><td id="ad-banner">Ad<td>cell</table><div class="cookie-notice">c</div></article>'
    assert html_blocks.main_text(page) == f"{para}\n\nitem\n\ncell"


PROSE = "The house of the old man is on the hill and it has been there for as long as we can remember, with a view over all of the town."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>t</title><meta charset=x><body><p>{PROSE}</p><p>{PROSE}</p></body>", [PROSE, PROSE]),  # head is not closed
        (f"<head><link rel=x><article><p>{PROSE}</article>", [PROSE]),
        (f"<body><form id=page><nav>Menu</nav><article><p>{PROSE}</p><button>Go</button></article></form>", [PROSE]),  # a form around the page
        (f"<body><form id=page><p>{PROSE}</p><p>{PROSE}</p><select><option>x</select></form>", [PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><form><p>{PROSE}</p><input></form><p>{PROSE}</p></article>", [PROSE, PROSE]),  # a form inside it
        (f"<body><p>{PROSE}</p><p>{PROSE}</p><form>Write to us<input></form>", [PROSE, PROSE]),
        (f"<article><a name=top><p>{PROSE}</p><p>{PROSE}</p></article>", [PROSE, PROSE]),  # an anchor is no link
        (f"<article><p><a href=x>Never closed</p><p>{PROSE}</p><p>{PROSE}</p></article>", ["Never closed", PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><p><a href=x>A link alone</a></p><p>{PROSE}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>", [PROSE, "A link alone", PROSE]),
        (f"<article><p>left <script>x = '<p>'</script>right. {PROSE}</p></article>", [f"left right. {PROSE}"]),
    ],
)
def test_omitted_tags_forms_and_anchors(page, want):
    assert html_blocks.main_text(page).split("\n\n") == want


@pytest.mark.parametrize(
    "prose",
    [
        "Дом старика стоит на холме с незапамятных времён, и оттуда виден весь город до самой реки. " * 3,
        "老人的房子在山上已经很久了从那里可以看到整个城市直到河边。" * 4,
        "La casa del vecchio sta sulla collina da tempo immemorabile e di lassù si vede tutta la città fino al fiume. " * 3,
    ],
)
def test_pages_without_a_stop_word_list_are_judged_by_length_and_links(prose):
    prose = prose.strip()
    page = f"<body><ul><li><a href=1>{prose[:40]}</a><li><a href=2>{prose[:30]}</a></ul><div><p>{prose}</p><p>{prose}</p></div><p><a href=3>{prose[:20]}</a></p>"
    assert html_blocks.main_text(page) == f"{prose}\n\n{prose}"


def test_odd_pages(spark):
    for page in (None, "", "<", "<p", "plain < text", "<article>", "</div></article>", "<!-- open", "<script>never closed", "&#0;&bogus;", "<p>" * 3000):
        assert isinstance(html_blocks.main_text(page), str)
    pages = spark.createDataFrame([(1, None, "u", "x"), (1, None, "u", "x"), (2, "", None, "x"), (3, f"<article>{LONG}</article>", "u", "x")], "page_id long, html string, url string, text string")
    rows = html_blocks.extract(pages, [F.col("page_id"), F.col("url")]).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [0, 0, 0, len(LONG) - 1]
    assert html_blocks.extract(pages.limit(0), [F.col("page_id")]).count() == 0


def test_given_pages_give_their_articles(spark):
    for r in html_blocks.extract(common.table(spark, "/root/testdata/sf0.001", "pages"), [F.col("html")]).collect():
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r["text"] == "\n\n".join(w for w in want if w)


# pieces


def test_pieces_equal_the_library(spark, edge_docs):
    own, sp = piece_bpe.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    units = ["a", "aa", " ", "  ", "▁", "é", "日本", "😀", "\n", "\t", "0123", "<0x41>", "\x00", "the", "ing", "er", "ß", ".", "..."] + [own.piece[i].replace("▁", " ") for i in rng.sample(sorted(own.piece), 400)]
    texts = ["", " ", "\n", "\n\n a", " a  b "] + ["".join(rng.choice(units) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, " " * 100 + "x"]
    for t in texts:
        ids = sp.encode(t, num_threads=1)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids), t
    for _ in range(300):  # ids that no encoding gives
        ids = [rng.choice([rng.randrange(0, 259), rng.randrange(32000)]) for _ in range(8)]
        assert own.decode(ids) == sp.decode(ids), ids
    encoded = piece_bpe.encode(edge_docs, PIECES, [F.col("doc_id"), F.col("text").alias("given")])
    for r in piece_bpe.decode(encoded, PIECES, [F.col("given"), F.col("ids")]).collect():
        assert r["ids"] == sp.encode(r["given"] or "") and r["text"] == sp.decode(r["ids"])
    digests = {r["doc_id"]: r for r in piece_bpe.digests(edge_docs, PIECES, [F.col("doc_id")]).collect()}
    assert digests[1]["n_tokens"] == 0 and digests[1][1:] == digests[2][1:] and digests[7]["n_tokens"] == len(sp.encode(LONG))
    assert piece_bpe.digests(edge_docs.limit(0), PIECES, [F.col("doc_id")]).count() == 0


# mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            full.add(s)
            out[s] = float(most * sizes[s])
            left -= out[s]


def test_targets_share_the_excess(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {rng.choice(["a", "B", "é", "z", "10", "9", "c", "d"]) if k else None: rng.choice([0, 5, 100, 10_000, rng.randrange(1, 900)]) for k in range(7)}
        got = {r["source"]: r["target"] for r in curriculum.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(slow_targets(sizes))


def test_mix_meets_the_targets(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 16)  # many shards
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = curriculum.mix(docs).collect()
    assert len(rows) == docs.count()
    words = {r["doc_id"]: len([w for w in r["text"].replace("\x1c", "x").split() if w]) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = slow_targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    at = [r["position"] for r in rows if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sorted(curriculum.mix(docs).collect(), key=str) == sorted(rows, key=str)
    copies = Counter()
    for r in rows:
        copies[r["source"]] += r["copies"] * r["size"]
    assert sum(copies.values()) == pytest.approx(sum(want.values()), rel=0.15)
    edge = curriculum.mix(edge_docs).collect()
    assert len(edge) == 9 and sum(r["taken"] for r in edge) == pytest.approx(sum(r["size"] for r in edge), abs=3)
    assert curriculum.mix(docs.limit(0)).count() == 0


def test_first_read_inverts_the_schedule(spark):
    knots = ((0, 2), (0.5, 0), (1, 4))
    shares = [k / 20 for k in range(21)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(curriculum.first_read(F.col("s"), knots)).collect()]
    weight = lambda t: 2 - 4 * t if t < 0.5 else 8 * (t - 0.5)
    grid = np.linspace(0, 1, 20_001)
    area = np.concatenate([[0], np.cumsum([(weight(a) + weight(b)) / 2 * (b - a) for a, b in zip(grid, grid[1:], strict=False)])])
    assert got == pytest.approx(np.interp(shares, area / area[-1], grid).tolist(), abs=0.02)


# archives


@pytest.fixture
def pages(spark):
    big = "".join(chr(0x4E00 + i % 500) for i in range(60_000))
    rows = [(1, "http://a/", "x"), (2, "http://b/é y", "same"), (3, None, "same"), (4, "http://c/", None), (5, "u", ""), (6, "u", big), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\n0\r\n"), (8, "u", "WARC/1.1\r\n\r\n0\r\n"), (None, "u", "no id")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_come_back_whole(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"))
    texts = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    rows = found.collect()
    assert len(rows) == 10 and all(r["problem"] is None for r in rows)
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in rows if r["record_type"] == "response")
    got = {r["page_id"]: r for r in warc.resolve(found).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: 6, 8: None, None: None}
    assert all(r["payload_bytes"] == len(texts[i]) and r["payload_digest"] == warc.digest(texts[i]) for i, r in got.items())
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_repeated_rows_with_segments_come_back_each(spark, tmp_path):
    big = ["".join(chr(0x4E00 + (i * k) % 500) for i in range(40_000)) for k in (3, 7, 11)]
    rows = [(1, "u", big[0]), (1, "u", big[0]), (2, "u", big[0]), (2, "u", big[0]), (None, "u", big[1]), (None, "u", big[1]), (3, "u", big[2]), (4, "u", big[2]), (4, "v", big[2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 1 << 30):
        folder = tmp_path / f"w{least}"
        warc.write(pages, str(folder), least=least)
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["problem"]) for r in warc.resolve(warc.read(spark, str(folder))).collect()), key=str)
        to = {2: 1, 4: 3} if not least else {}
        assert got == sorted(((i, len(t.encode()), warc.digest(t.encode()), to.get(i), None) for i, _, t in rows), key=str)
        heads = [h for f in folder.glob("part*") for h, _ in warc.parse(warc.inflate(f.read_bytes()))]
        names = {h["warc-record-id"] for h in heads}
        assert len(names) == len(heads) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= names
        assert sum("warc-refers-to" in h for h in heads) == (0 if least else 2)


def test_broken_archives_are_told(spark, tmp_path):
    parts = list(warc.records(1, "u", b"z" * 100_000, None))
    assert len(parts) == 4
    cases = {"segments missing or repeated": parts[:2] + parts[3:], "wrong total length": [*parts[:3], parts[3].replace(b"Total-Length: 1", b"Total-Length: 2")]}
    cases["wrong digest"] = [next(warc.records(1, "u", b"abc", None)).replace(b"abc", b"abd")]
    cases["chunk cut off"] = [next(warc.records(1, "u", b"abc", None)).replace(b"3\r\nabc", b"4\r\nabc")]
    for problem, records in cases.items():
        folder = tmp_path / problem.replace(" ", "-")
        folder.mkdir()
        random.Random(1).shuffle(records)
        (folder / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
        (row,) = warc.read(spark, str(folder)).collect()
        assert row["problem"] == problem and row["payload"] is None
    with pytest.raises(ValueError):
        list(warc.parse(parts[0][:-5]))
    assert warc.unchunked(warc.chunked(b"q" * 40_000)) == b"q" * 40_000


# rules


def slow_base(text):
    gap = " \t\n\x0b\f\r"
    words = "".join(" " if c in gap else c for c in text or "").split(" ")
    words = [w for w in words if w]
    lines = [x for x in (text or "").split("\n") if x.strip(gap)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_statistics_equal_brute_force(spark, edge_docs):
    rng = random.Random(8)
    texts = [None, "", " ", "\n\n", "a\n a\na", LONG] + ["".join(rng.choice(["a ", "b ", "c", "\n", "# ", "\t", "é|", "x y z w v "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in decision_list.statistics(docs).collect():
        assert tuple(r["quality_stats"][n] for n in names) == slow_base(texts[r["doc_id"]]), texts[r["doc_id"]]
    judged = decision_list.judge(edge_docs, [])
    assert judged.count() == 9 and {r["kept"] for r in judged.filter("doc_id < 7 or doc_id is null").collect()} == {False}
    assert decision_list.judge(edge_docs.limit(0), []).count() == 0


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(1)
    zero = dict.fromkeys(decision_list.STATISTICS, 0.0)
    rows = []
    for _ in range(900):
        a, b = rng.random(), rng.random()
        rows.append({**zero, "symbol_share": a, "upper_share": b, "bad": a > 0.7 and b < 0.5 or b > 0.9})
    rules = decision_list.learn(rows)
    judged = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(x == r["bad"] for x, r in zip(judged, rows, strict=True)) > 0.97 * len(rows)
    frame = spark.createDataFrame([(i, [float(r[s]) for s in decision_list.STATISTICS]) for i, r in enumerate(rows)], "i long, v array<double>")
    stats = F.struct(*[F.get("v", k).alias(s) for k, s in enumerate(decision_list.STATISTICS)])
    got = {r[0]: r[1] for r in frame.select("i", decision_list.verdict(rules, stats)).collect()}
    assert all(got[i] == (not x) for i, x in enumerate(judged))
    assert decision_list.learn([]) == [] and decision_list.learn([{**zero, "bad": True}] * 5) == []
    assert decision_list.learn([{**zero, "bad": k % 2 == 0} for k in range(200)]) == []


def test_rules_count_every_label(spark):
    good = "the quick brown fox jumps over one lazy dog while others sleep"
    rows = spark.range(60_000).selectExpr("id AS doc_id", f"concat('{good}', IF(id % 6000 = 7, '!!!!', '')) AS text", "IF(id % 6000 = 7, 0, 1) AS quality")
    rules = decision_list.fit(rows, rows)
    assert [(c.statistic, c.above) for rule in rules for c in rule] in ([("bang_share", True)], [("word_chars_mean", True)])
    table = rows.selectExpr("doc_id % 6000 = 7 AS bad", "doc_id % 3 = 0 AS prune", *[f"CAST({'hash(doc_id)' if s == 'n_words' else 'doc_id % 6000 = 7'} AS double) AS {s}" for s in decision_list.STATISTICS])
    at_hand = [r.asDict() for r in table.orderBy("n_words").collect()]
    assert len(decision_list.learn_table(table)) == len(decision_list.learn(at_hand)) == 1


def test_rules_from_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rules = decision_list.fit(docs, labels)
    rows = decision_list.judge(docs, rules).join(labels, "doc_id").filter("not base_failed").collect()
    assert rules and sum(r["kept"] == (r["quality"] == 1) for r in rows) > 0.95 * len(rows)
    assert decision_list.fit(docs, labels.limit(0)) == []


# vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        center = rng.normal(size=16)
        rows += [(center + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.25])).astype(np.float32).tolist() for _ in range(25)]
    rows += [rows[0]] * 6 + [[2 * x for x in rows[1]], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    data = [(i * 7 % 1000, v, "x", 5) for i, v in enumerate(rows)]
    got = {r["vec_id"]: r for r in embedding_join.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, copies string, node int"), block=16).collect()}
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ids, vectors = [d[0] for d in data], [np.asarray(v, np.float32).astype(float) if ok(v) else None for _, v, *_ in data]
    linked = [[j for j in range(len(data)) if i != j and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.95] for i in range(len(data))]
    for i, first in enumerate(ids):
        seen, todo = {i}, [i]
        while todo:
            new = set(linked[todo.pop()]) - seen
            seen |= new
            todo += new
        low = min(ids[j] for j in seen)
        r = got[first]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(linked[i]), low, low == first)
    assert sum(map(len, linked)) > 500
    empty = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in embedding_join.near_duplicates(empty).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    assert embedding_join.near_duplicates(empty.limit(0)).count() == 0


# pipeline


def test_whole_readings_meet_each_target_in_training_order(spark, edge_docs):
    rng = random.Random(4)
    rows = [(i, "w " * (1500 if i % 97 == 0 else rng.randrange(1, 60)), "abcde"[min(4, i % 7)] if i % 11 else None, i, "x") for i in range(900)]
    rows += [(5000, "twice the same row", "a", 0, "y")] * 2 + [(None, "no id", "b", 0, "z"), (6000, None, "b", 0, "z"), (6001, "", None, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, position string")
    out = curriculum.whole_readings(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and got == [tuple(r) for r in curriculum.whole_readings(docs.repartition(5)).collect()]
    size, words, largest = Counter(), Counter(), Counter()
    for _, text, source, *_ in rows:
        n = len((text or "").split())
        size[source] += n
        largest[source] = max(largest[source], n)
    for _, text, source, *_ in got:
        words[source] += len((text or "").split())
    wanted = {r["source"]: r["target"] for r in curriculum.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert all(abs(words[s] - wanted[s]) <= largest[s] for s in size)
    assert max(Counter(r[0] for r in got if r[0] != 5000).values()) <= 3
    assert curriculum.whole_readings(docs.limit(0)).count() == 0
    assert len(curriculum.whole_readings(edge_docs).columns) == len(edge_docs.columns)
    early = Counter(r[2] for r in got[: len(got) // 4])  # the second source's schedule starts high, the third's low
    assert early["b"] / words["b"] > early["c"] / words["c"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").selectExpr("*", "1 AS copies", "'a' AS kept", "'b' AS quality_stats", "2 AS copy", "3 AS key", "4 AS position", "5 AS base_failed")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.redact_secrets, corpus_pipeline.mix_sources):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.limit(20).collect()} == {(1, "a", "b", 2, 3, 4, 5)}


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    rules = decision_list.fit(docs, common.table(spark, sf, "labels"))
    keep = set()
    for r in decision_list.statistics(docs).collect():
        n, *_, repeat = slow_base(r["text"])
        if n >= 10 and 100 * repeat <= 20 * n and not any(all(c.holds(r["quality_stats"]) for c in rule) for rule in rules):
            keep.add(r["doc_id"])
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert first.columns == columns and set(kept) == keep
    second = corpus_pipeline.near_dedup(spark, first, sf)
    ids = sorted(kept)
    prints = [simhash.fingerprint(kept[i].encode()) % (1 << 64) for i in ids]  # held to a slow version in its own test
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = {ids[g] for g in group}
    left = {r["doc_id"] for r in second.collect()}
    assert second.columns == columns and left == want and second.count() == len(left)
    third = corpus_pipeline.redact_secrets(spark, second, sf)
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    assert third.columns == columns and set(texts) == left
    assert not any("token = \"" in t for t in texts.values()) and sum(t == kept[i] for i, t in texts.items()) > 0.9 * len(left)
    fourth = corpus_pipeline.mix_sources(spark, third, sf)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    assert fourth.columns == columns and set(copies) <= left and max(copies.values()) <= 3
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    last = corpus_pipeline.encode_pieces(spark, fourth, sf).collect()
    assert Counter(r["doc_id"] for r in last) == copies and all(r["ids"] == sp.encode(texts[r["doc_id"]]) and r["decoded"] == sp.decode(r["ids"]) for r in last)
