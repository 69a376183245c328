"""Vectors, pages, the registered queries and the pipeline."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import entries, htmltext, topk

SF = "/root/testdata/sf0.001"


def brute_top(rows):
    valid = []
    for k, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((k, [math.floor(256 * x) for x in v]))
    out = []
    for q, a in valid:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), k) for k, b in valid if k != q)
            out += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:5])]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(8)]) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 500)]  # many equal vectors
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = [(x["vec_id"], x["embedding"]) for x in frame.collect()]
    for block in (topk.BLOCK, 40):
        monkeypatch.setattr(topk, "BLOCK", block)
        assert sorted(map(tuple, topk.top_k(frame).collect())) == brute_top(exact)
    few = frame.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.top_k(few).collect())) == brute_top([x for x in exact if x[0] < 3])
    assert topk.top_k(frame.limit(0)).count() == 0


def test_top_k_of_repeated_ids_other_widths_and_large_numbers(spark):
    r = random.Random(5)
    rows = [(k % 150, [r.gauss(0, 3) for _ in range(4)], "x", k) for k in range(300)]
    rows += [(k, [1.0] * 5, "wide", k) for k in range(1000, 1010)] + [(2000, [], "none", 1), (None, [1.0] * 4, "no id", 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    valid = [(x["vec_id"], [math.floor(256 * y) for y in x["embedding"]]) for x in frame.collect() if x["vec_id"] is not None and len(x["embedding"]) == 4]
    want = []
    for q in (0, 50, 100):
        a = min(v for k, v in valid if k == q)
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), k) for k, b in valid if k != q)
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:5])]
    assert sorted(map(tuple, topk.top_k(frame).collect())) == want
    big = [(k, [float(r.randint(-3 * 10**5, 3 * 10**5)) for _ in range(3)]) for k in range(120)]
    large = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(large).collect())) == brute_top(big)


def test_a_block_meets_the_queries_of_several_groups_at_once():
    r = np.random.default_rng(3)
    v = r.integers(-30, 30, (3000, 6)).astype(np.int16)
    v[500:900] = v[0]  # many equal vectors
    ids = r.permutation(3000)
    ids[600:640] = ids[500]  # of one id
    kept = topk.few_of_equal(ids, v)
    assert len(kept) < 3000 - 400 + 3 * topk.K
    asked = r.choice(3000, 700, replace=False)
    asked[:3] = 500, 0, 700
    own, floor, group = ids[asked], np.full(700, topk.NONE), np.arange(700) % 3
    for scale in (1, 1 << 12, 1 << 23):  # products in single and double precision, and as integers
        x, y = v[asked].astype(np.int64) * scale, v.astype(np.int64) * scale
        best = topk.search(x, own, floor, y[kept], ids[kept], group)
        scores = x @ y.T
        for k in range(700):
            others = np.flatnonzero(ids != own[k])
            want = others[np.lexsort((ids[others], -scores[k, others]))][: topk.K]
            assert best.score[k].tolist() == scores[k, want].tolist() and best.id[k].tolist() == ids[want].tolist()
    assert [topk.whole_type(*x) for x in ((-32768, 32767), (-32769, 0), (0, 1 << 31))] == ["smallint", "int", "bigint"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on the site and that is why you see this.</div>
<aside><p>Something in the side bar that is long enough to be read as if it were the text of it.</p></aside>
<article><h1>The  title &amp; more</h1><p>This is the first paragraph of the text,<br>and it has a <b>second</b> line in it.<p>It is short.</p>
<div class="ad">Buy the thing that is on offer in the shop for all of you.</div><p>The last one of them is here, and it is the end of the text.</p></article>
<form><p>Sign up for the letter of the week and be the first to know.</p></form><section id="comments"><p>I am the reader and this is what I think of the text.</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<p>unclosed <a href='x", "x"), (5, "u", "plain text only", "x"), (6, "u", "<" * 5000, "x"), (1, "u", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {x["page_id"]: x for x in htmltext.page_report(frame).collect()}
    want = ["The title & more", "This is the first paragraph of the text, and it has a second line in it.", "It is short.", "The last one of them is here, and it is the end of the text."]
    assert found[1]["text"].split("\n") == want
    assert found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == found[3]["text"] == "" and found[5]["text"] == "plain text only"
    assert htmltext.page_report(frame).count() == len(rows)
    assert htmltext.page_report(frame.limit(0)).count() == 0


TEXT = "This is the one text of the page, and it is long enough to be read as the main part of it."


@pytest.mark.parametrize(
    "page",
    [
        f"<head><title>T</title><meta charset=utf-8><script>var x = '<body>';</script><body><p>{TEXT}</p></body>",
        f"<head><title>T</title><p>{TEXT}</p>",
        f"<body><div><select><option>1<p>{TEXT}</p></div></body>",
        f"<body><button>x<p>{TEXT}</p><button>y</button></body>",
        f"<body><svg><g><text>x</text></g><p>{TEXT}</p></body>",
        f"<body><object data=x><p>{TEXT}</p></body>",
        *[f"<body><div class='{x}'><p>{TEXT}</p></div></body>" for x in ("content no-sidebar", "with-sidebar", "side-by-side")],
        *[f"<body><div class='layout {x}'><{t}><p>{TEXT}</p></{t}></div></body>" for x in ("sidebar", "nav-side") for t in ("article", "main")],
        f"<p>{TEXT}</p><div id='comments'><article class='comment'><p>{TEXT}</p></article></div>",
    ],
)
def test_valid_pages_keep_their_text(page):
    assert htmltext.main_text(page) == TEXT


def test_text_behind_a_loose_angle_bracket_stays():
    assert htmltext.main_text("<p>a is < b and much more") == "a is < b and much more"
    assert htmltext.main_text("<p>kept <a href='x") == "kept"


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_registered_queries_run(spark, name):
    table = {"op4_top_k": None, "op7_main_text": "pages"}.get(name, "documents")
    found = entries.QUERIES[name](spark, SF)
    assert found.count() == (spark.read.parquet(f"{SF}/{table}.parquet").count() if table else 50)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(p.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(names)] == names and docs.count() <= before
        if k >= 3:
            assert docs.count() == before
    assert docs.where("not round_trip").count() == 0
    twice = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (None, "q w e r t", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = p.near_dedup(spark, twice, SF)
    assert sorted((x["doc_id"] or -1) for x in kept.collect()) == [-1, 1, 2]
    for _, stage in p.STAGES:
        assert stage(spark, twice.limit(0), SF).count() == 0
    assert p.tokens(spark, p.personal_data(spark, twice, SF), SF).where(F.col("round_trip")).count() == 5


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    more = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, long, "en", "s", len(long)), (None, "x y z", None, None, None), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)], plain.schema)
    names = "score predicted n_words spans items base slots vals _mark fp id key _key _near_id _near_kept _masked _document_0 _document_1 piece_score decoded Score2".split()
    docs = plain.union(more).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for k, (_, stage) in enumerate(p.STAGES):
        rows = {tuple(x[n] for n in names) for x in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns[: len(docs.columns)] == docs.columns
        found = after.collect()
        assert {tuple(x[n] for n in names) for x in found} <= rows and found
        assert all(x["score"] in (None, f"score{x['doc_id']}") for x in found)
        if k >= 3:
            assert len(found) == docs.count()
    clash = docs.select("*", F.lit("own").alias("ids"), F.lit("own").alias("N_pieces"), F.lit("own").alias("round_trip"))
    assert p.tokens(spark, clash, SF).columns == [*docs.columns, "ids", "n_pieces", "round_trip"]


def test_density_decides_outside_of_articles():
    nonsense = " ".join(f"qx{k}" for k in range(60))
    middling = "The plan of which many people never heard came about after long talks between several towns."
    assert htmltext.main_text(f"<div><p>{TEXT}</p><p>{nonsense}</p><p>{TEXT}</p></div>") == f"{TEXT}\n{TEXT}"
    assert htmltext.main_text(f"<main><p>{TEXT}</p><p>{nonsense}</p></main>") == f"{TEXT}\n{nonsense}"
    links = "<p><a href=x>One of many links that stand on the page for all of you to read now</a></p>"
    assert htmltext.main_text(f"<div><p>{TEXT}</p></div><div>{links}<p>{middling}</p>{links}</div>") == TEXT
    assert htmltext.main_text(f"<div><p>{TEXT}</p><p>{middling}</p><p>Short one.</p><p>{TEXT}</p></div>") == f"{TEXT}\n{middling}\nShort one.\n{TEXT}"
    assert htmltext.main_text(f"<p>{nonsense}</p><p>{nonsense}</p>") == f"{nonsense}\n{nonsense}"  # a language without a list


@pytest.mark.parametrize("name", ["social-policy", "noticeable", "seaside", "share-of-voice", "research", "alertness", "commentary"])
def test_names_are_whole_words(name):
    assert htmltext.main_text(f"<div class='{name}'><p>{TEXT}</p></div>") == TEXT


@pytest.mark.parametrize("name", ["site-footer", "cookie-notice", "sideBar x", "main_menu", "ad-300x250", "comment-list", "relatedPosts", "share"])
def test_regions_by_name_are_left_out(name):
    assert htmltext.main_text(f"<div class='{name}'><p>{TEXT}</p></div><p>{TEXT} So it is.</p>") == f"{TEXT} So it is."


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '>' " * 150_000, '<a "' * 300_000, "<!-- " * 200_000, "<p><select>" * 100_000, "<![CDATA[" * 100_000])
def test_long_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    htmltext.main_text(page)
    assert time.perf_counter() - start < 5


def test_made_pages_give_back_their_article(spark):
    r = random.Random(11)
    stop = "the of and to in is that it for on was with as be".split()
    sentence = lambda n: " ".join(r.choice(stop) if r.random() < 0.4 else f"word{r.randint(0, 999)}" for _ in range(n))
    noise = [
        lambda: f"<nav class=menu><ul>{''.join(f'<li><a href=#>{sentence(2)}</a></li>' for _ in range(5))}</ul></nav>",
        lambda: f"<div class='ad-slot'><p>{sentence(20)}</p></div>",
        lambda: f"<aside><p>{sentence(30)}</p></aside>",
        lambda: f"<form><label>{sentence(3)}</label><p>{sentence(15)}</p></form>",
        lambda: f"<div id=comments><p>{sentence(25)}</p></div>",
        lambda: f"<script>var x = '{sentence(5)} </p>';</script><style>p {{ }}</style><!-- {sentence(9)} -->",
        lambda: f"<p><a href=#>{sentence(14)}</a></p>",
    ]
    rows, want = [], {}
    for k in range(60):
        parts = [sentence(r.choice((4, 18, 40))) for _ in range(r.randint(3, 12))]
        parts[0], parts[-1] = sentence(30), sentence(30)
        body = "".join(f"<p>{x}</p>" + (r.choice(noise[:6])() if r.random() < 0.3 else "") for x in parts)
        tag = r.choice(("article", "main", "div"))
        rows.append((k, "u", "".join(x() for x in r.sample(noise, 3)) + f"<{tag}>{body}</{tag}>" + "".join(x() for x in r.sample(noise, 2)), "own"))
        want[k] = "\n".join(parts)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    assert {x["page_id"]: x["text"] for x in htmltext.page_report(frame).collect()} == want


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<form id='aspnetForm'><nav>Home and more</nav><article>", "</article></form>"), ("<div class='main-content sidebar-left'><article>", "</article></div>"), ("<form><div class='sidebar'><div class='wrapper sidebar'>", "</div></div></form>"),
        ("<form>" * 3, "</form>" * 3), ("<div class='modal'><form><div class='popup'>", "</div></form></div>"),
    ],
)
def test_containers_of_a_page_are_no_regions(before, after):
    """What holds most of a page is not left out as a form or by its name; regions within it are."""
    text = f"<p>{TEXT}</p>"
    away = "<nav>Home, News and all of the rest that is in a menu of the site.</nav><div class='newsletter'><p>Sign up for the letter of the week and be the first to know.</p></div>"
    assert htmltext.main_text(before + text * 3 + away + after) == "\n".join([TEXT] * 3)
    assert htmltext.main_text(f"<article>{text}</article><form>" + "<p>Sign up for the letter of the week and be the first of all to know.</p>" * 5 + "</form>") == TEXT


def test_density_leaves_blocks_of_an_article_open():
    """A block of few stop words inside an article takes the label of its neighbours; links still make it bad."""
    odd = "zork blip quux flob gnat wump trill brack snood plim vext crum drell"
    links = "".join(f"<a href='x'>{w} more</a> " for w in odd.split())
    page = f"<article><p>{TEXT}</p><p>{odd}</p><p>{TEXT}</p><p>{links}</p></article>"
    assert htmltext.main_text(page).split("\n") == [TEXT, odd, TEXT]

