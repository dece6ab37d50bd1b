"""HTML extraction: parsing, cuts against brute force, whole pages against what they were made of."""

import itertools
import random
import re
from html import unescape

from folioforge.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/x">The</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy now.</div><article><h1>Head &amp; shoulders</h1><p><b>First  para
graph.<br><p>Second <a href="x>y">one</a>&nbsp;&#8212; with dash.</p><p>3.</p></article><footer>&copy; example.com</footer></body></html>"""


def test_a_page():
    assert html.main_text(PAGE) == "Head & shoulders\nFirst para graph.\nSecond one — with dash.\n3."


def test_parts_that_go():
    body = "<article><p>Real text stands here, in a sentence.</p><p>And here is more of it.</p></article>"
    for extra in ('<header><p>Site name and a claim.</p></header>', '<aside>More stories for you.</aside>', '<div id="sidebar"><p>Side text. It is long.</p></div>', '<div class="cookie-notice">We use cookies.</div>', '<form><p>Your mail address please.</p><button>Go</button></form>', '<section class="comments"><p>I liked this article a lot. Thanks.</p></section>', '<div role="navigation">Home</div>', '<div style="display: none">hidden words</div>', "<noscript>Turn on scripts.</noscript>", "<textarea>x</textarea>", '<div class="advertisement"><p>Very good product, buy it today.</p></div>'):
        for page in (extra + body, body + extra):
            assert html.main_text(f"<body>{page}</body>") == "Real text stands here, in a sentence.\nAnd here is more of it.", extra
    inside = body.replace("</article>", '<div class="ad">Buy it. Now.</div><p>Last words of it.</p></article>')
    assert html.main_text(inside).endswith("more of it.\nLast words of it.")


def test_odd_markup():
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<script>x") == "" and html.main_text("<!-- open <p>x</p>") == ""
    assert html.main_text("just a plain text, 1 < 2 & 3 > 2.") == "just a plain text, 1 < 2 & 3 > 2."
    assert html.main_text("<article><p>Un</article></div></p>closed.") .startswith("Un")
    deep = "<div>" * 20_000 + "<article><p>Deep down it is dark.</p></article>" + "</div>" * 20_000
    assert html.main_text(deep) == "Deep down it is dark."
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(long).count("\n") == 19_999
    html.main_text('<a b="' * 3000)
    html.main_text("<" * 20_000)


def test_quoted_values_of_any_length():
    want = "Real text stands here, in a sentence.\nAnd here is more of it."
    for size in (100, 5000, 200_000):
        value = "v" * size + "<div class='ad'><p>Inner words of a value. They stay out.</p><ul>"
        for quoted in (f'"{value}"', "'" + value.replace("'", '"') + "'"):
            page = f"<body><article><p data-x={quoted}>Real text stands here, in a sentence.</p><iframe srcdoc={quoted}></iframe><p>And here is more of it.</p></article></body>"
            assert html.main_text(page) == want, (size, quoted[0])
    assert html.main_text('<article><p title="' + "never closed " * 1000 + ">Some text stands here, in a sentence.</p></article>").endswith("Some text stands here, in a sentence.")


def test_cuts_match_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 9)
        content, boilerplate = ([rng.random() * 2 for _ in range(n)] for _ in "ab")
        edges = [(i, j, rng.random() * rng.choice([0.1, 1, 3])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(label):
            return sum(c if x else b for x, c, b in zip(label, content, boilerplate)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html.minimum_cut(content, boilerplate, edges)) - best) < 1e-9


def _expected(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x) if "<br" in x else re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


def test_whole_table_against_its_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == _expected(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_edges(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, 5, "x"), (2, "u", PAGE, 5, "x"), (2, "u", PAGE, 5, "x"), (None, "u", "", 5, "x")]
    got = sorted((str(r.page_id), r.n_chars > 0) for r in html.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", False), ("2", True), ("2", True), ("None", False)]


def test_names_that_mislead_drop_no_paragraph():
    for name in ("notice-board", "social-history", "related-work", "share-prices", "tags-list", "header-files", "promotion-criteria"):
        page = f"<body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>Head</h1><p>Real text stands here, in a sentence.</p><div class='{name}'><p>The board met on Monday and decided, after a long talk, to go on.</p></div><p>And more of it.</p></article><div class='cookie-notice'>We use cookies.</div><footer>c</footer></body>"
        assert html.main_text(page) == "Head\nReal text stands here, in a sentence.\nThe board met on Monday and decided, after a long talk, to go on.\nAnd more of it.", name


def _labels(page):
    found = html.blocks(page)
    content, boilerplate = html.costs(found, html.weights())
    return found, [b > c for c, b in zip(content, boilerplate)], html.minimum_cut(content, boilerplate, html.ties(found))


def test_the_cut_flips_what_neighbours_contradict():
    flips, right, alone, rng = 0, 0, 0, random.Random(123)
    for _ in range(150):
        found = html.blocks(html.training_page(rng))
        truth = [b.text.startswith("+") for b in found]
        for b in found:
            b.text, b.link = b.text[2:] or ".", max(0, min(b.link - 2, len(b.text)))
        content, boilerplate = html.costs(found, html.weights())
        own, keep = [b > c for c, b in zip(content, boilerplate)], html.minimum_cut(content, boilerplate, html.ties(found))
        flips += sum(a != b for a, b in zip(own, keep))
        alone += sum(a == b for a, b in zip(own, truth))
        right += sum(a == b for a, b in zip(keep, truth))
    assert flips >= 5 and right > alone
    long = "<p>A paragraph that goes on for quite a while, so that there is no doubt of what it is to the reader.</p>"
    page = "<div>" + long * 3 + "<div class='widget'><p>See the table for the numbers of the last year.</p></div>" + long * 3 + "</div>"
    found, own, keep = _labels(page)
    assert keep == [True] * 7


def test_names_of_any_length_give_hints():
    body = "<article><p>Real text stands here, in a sentence.</p><p>And here is more of it.</p></article>"
    for size in (0, 210, 5000, 100_000):
        name = "nav menu" + "".join(f" u{i}-px{i}" for i in range(size // 9))
        page = f'<body><div class="{name}"><p>Short notice of ours. Read it.</p></div>{body}</body>'
        assert html.main_text(page) == "Real text stands here, in a sentence.\nAnd here is more of it.", size
        page = f'<body><nav>Home</nav><article><div class="{name.replace("nav menu", "grid cols")}"><p>Real text stands here, in a sentence.</p></div></article></body>'
        assert html.main_text(page) == "Real text stands here, in a sentence.", size


def test_paragraphs_close_under_any_nesting():
    for depth in (1, 7, 8, 20, 500):
        page = "<article><p>" + "<b>" * depth + "First of the texts, in a sentence.<p>Second of the texts, in a sentence.</article>"
        found = html.blocks(page)
        assert [(b.text[:6], b.depth) for b in found] == [("First ", 2), ("Second", 2)], depth
    far = "<article>" + "<div>" * 40 + "<p>One side of it, in a sentence.</p>" + "</div>" * 40 + "<div>" * 40 + "<p>The other side of it, in a sentence.</p>" + "</div>" * 40 + "</article>"
    assert len(html.ties(html.blocks(far))) == 1


def test_formulas_and_hidden_parts_of_an_article_stay():
    page = "<body><nav>Home</nav><article><p>We know that <math><mi>x</mi> <mo>&lt;</mo> <mn>3</mn></math> holds for all values.</p>{}<p>And here is more of it.</p></article></body>"
    lines = "We know that x < 3 holds for all values.\n{}And here is more of it."
    for part in ('<div style="display:none"><p>Answers are kept folded here, as usual.</p></div>', "<p hidden>Answers are kept folded here, as usual.</p>", "<noscript><p>Answers are kept folded here, as usual.</p></noscript>", "<template><p>Answers are kept folded here, as usual.</p></template>", '<p aria-hidden="true">Answers are kept folded here, as usual.</p>'):
        assert html.main_text(page.format(part)) == lines.format("Answers are kept folded here, as usual.\n"), part
    drawn = '<p>As the figure shows <svg viewBox="0 0 1 1"><title>t</title><path d="M0 0"/><text>axis</text></svg> it grows.</p>'
    assert html.main_text(page.format(drawn)) == lines.format("As the figure shows axis it grows.\n")
