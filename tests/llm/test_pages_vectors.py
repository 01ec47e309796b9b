"""Page extraction and vector search."""

import math
import re

import pytest

from spindle.llm import extraction, topk

from . import brute

@pytest.mark.parametrize("wrapper", ["class='page has-sidebar'", "class=with-menu", "id=no-ads", "class=cookie-consent-given", "class='site header'"])
def test_wrappers_named_like_asides_keep_their_article(wrapper):
    aside = f"<div class=sidebar><article><p>{PARA}</p></article></div>"
    for page in (f"<div {wrapper}><article><h1>T</h1><p>{PARA}More.</p></article>{aside}</div>", f"<main><h1>T</h1><div {wrapper}><article><p>{PARA}More.</p></article></div></main>"):
        assert extraction.main_text(page) == f"T {PARA}More."
    for tag in ("div class=comments", "aside", "div role=complementary", "div hidden"):
        assert extraction.main_text(f"<{tag}><article><p>{PARA}</p></article></{tag.split()[0]}>") == ""


def test_short_linked_blocks_stay_in_the_article():
    assert extraction.main_text(f"<article><p>{PARA}</p><ul><li><a href=x>A linked item</a></ul><p>Source: <a href=y>the place</a></p><p>{PARA}</p></article><p><a href=z>out</a></p>") == f"{PARA}A linked item Source: the place {PARA.strip()}"


def test_pages_of_other_languages():
    para = "Szybki brązowy lis przeskoczył nad leniwym psem, który spał spokojnie obok starego młyna. "
    assert extraction.main_text(f"<div><p>{para}</p><p>Krótko.</p><p>{para}</p></div><nav>Menu</nav><div><a href=x>{para}</a></div>") == f"{para}Krótko. {para.strip()}"
    assert extraction.main_text(f"<div><p>{PARA * 4}</p></div><div><p>{para}</p></div>") == (PARA * 4).strip()


PARA = "The quick fox is in the house and it was not the one that they had seen by the river, for which all of them are to be sorry. "


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        (f"<article><h1>Title</h1><p>{PARA}</p><p>Short.</p></article><footer>x</footer>", f"Title {PARA}Short."),
        (f"<body><nav><ul><li><a href=x>Menu</a></ul></nav><main><p>{PARA}<p>Two &amp; <b>th</b>ree<br>four &eacute;&#233;</main>", f"{PARA}Two & three four éé"),
        (f"<header>Site</header><article><header><h1>Head</h1><p>By me</p></header><p>{PARA}</p><aside>More</aside><div class='ad-box'>Buy</div><form>Name<input></form></article>", f"Head {PARA}"),
        (f"<article><p>{PARA}</p><section id=comments><p>{PARA}</p></section></article><article class=comment><p>{PARA}</p></article>", PARA),
        (f"<div class=cookie-notice>{PARA}</div><div><p>{PARA}</p><p>Yes.</p></div><div><a href=/>one</a> | <a href=/>two</a></div>", f"{PARA}Yes."),
        (f"<article><p>{PARA}<script>var t='</p>';</script><!-- <p>no</p> --><style>p{{}}</style></p><p hidden>h</p><p>end &am", f"{PARA}end &am"),
        (f"<article><p>{PARA}</p><p>a | b | c</p><p>cut <a hre", f"{PARA}a | b | c cut"),
        ("<html><body class='has-sidebar'><article class='post no-sidebar'><p>Only this.</p></article></body></html>", "Only this."),
    ],
)
def test_pages(page, text):
    assert extraction.main_text(page) == text.strip()


def test_table_of_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inside = re.sub(r"<[^>]*>?", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", inside)
        assert found[r.page_id].text == " ".join(html.unescape(inside).split()) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_rows_of_pages(spark):
    df = spark.createDataFrame([(1, None, None, 2), (1, "u", "<article>x</article>", 3), (None, "v", "", 4)], "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in extraction.extract(df).collect()), key=str) == sorted([(1, None, "", 0), (1, "u", "x", 1), (None, "v", "", 0)], key=str)
    assert extraction.extract(df.limit(0)).count() == 0


def test_nearest_labels():
    g, b, o = extraction.GOOD, extraction.BAD, extraction.OPEN
    yes = [True] * 7
    assert extraction.second_pass([g, o, o, b, o, o, g], yes, [0] * 7) == [True, True, False, False, False, True, True]
    assert extraction.second_pass([o, o], [True, True], [0, 0]) == [True, True] and extraction.second_pass([o], [False], [0]) == [False]
    assert extraction.second_pass([g, o, b], [False] * 3, [1, 1, 2]) == [True, True, False]


def vectors(n, d=6, seed=1):
    import random

    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + (i % 13 == 0)) for _ in range(d)]) for i in range(n)]
    rows[100] = (100, rows[101][1])
    rows += [(n, None), (n + 1, [1.0, None] + [0.0] * (d - 2)), (200_000, [math.nan] * d), (300_000, [math.inf] + [0.0] * (d - 1)), (None, [9.0] * d), (7, rows[7][1]), (400_000, [0.0] * d), (400_001, list(rows[3][1]))]
    return rows


@pytest.mark.parametrize("block,seeds", [(4096, 1024), (3, 16), (4096, 5)])
def test_top_k(spark, block, seeds):
    rows = vectors(700)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted(map(tuple, topk.search(df, query_block=block, seeds=seeds).collect()))
    assert found == sorted(brute.top_k(rows))


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, score int, rank int"
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (1, [0.5, 0.0], 1, 1), (2, [0.5, 0.0], 1, 1)], schema)
    assert [tuple(r) for r in topk.search(few).collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, 1024 * 512)]
    assert topk.search(few.limit(0)).count() == 0 and topk.search(few.where("vec_id > 0")).count() == 0


def test_a_lead_in_the_header_of_the_article_stays():
    lead = "This is the lead of the article, which tells in one paragraph what is to come in the rest of it."
    body = "The rest of it is as long as the lead and has as many of the words that every text in the language has."
    page = f"<body><header><p>{lead}</p><nav>Home</nav></header><article><header><h1>Title</h1><p>{lead}</p><p>By Ann Onym</p><time>3 May</time></header><p>{body}</p></article></body>"
    assert extraction.main_text(page) == f"Title {lead} {body}"


@pytest.mark.parametrize("text", ["Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób.", "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему, так говорится в начале.", "幸福的家庭都是相似的，不幸的家庭各有各的不幸。" * 5])
def test_pages_without_an_article_in_other_languages(text):
    page = f"<body><nav><a href=/>Start</a> <a href=/b>B</a></nav><div><p>{text}</p><p>{text}</p></div><footer>2020</footer></body>"
    assert extraction.main_text(page) == f"{text} {text}"
