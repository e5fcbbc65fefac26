import pandas as pd
import pytest

from listloom.llm import html, quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.op1_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    found = found[found.held_out]
    good, bad = found.score[found.quality == 1].to_numpy(), found.score[found.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert ((found.predicted == 1) == (found.quality == 1)).mean() > 0.96


def test_quality_of_odd_rows(spark, odd, empty, write_tables):
    rows = quality.op1_quality(spark, write_tables(odd)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.op1_quality(spark, write_tables(empty)).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op1_quality(spark, write_tables(odd, labels=none)).collect()} == {0.5}


def plain_contexts(texts, common):
    """Words and context vectors with a regular expression and dictionaries."""
    import re
    from collections import Counter, defaultdict

    import numpy as np

    from listloom.llm import kernels as K

    def word(w):
        b = np.frombuffer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode(), np.uint8)
        up, low = sum("A" <= c <= "Z" for c in w), sum("a" <= c <= "z" for c in w)
        n = len(w.encode())
        shape = 3 if re.fullmatch("[0-9]+", w) else 4 if not re.search("[A-Za-z\x80-\U0010ffff]", w) else 2 if up and not low and n > 1 else int(up > 0)
        h = K.mix(K.span_hashes(b, np.array([0]), np.array([len(b)])) ^ np.uint64(shape))[0]
        return int(h), shape * quality.LENGTHS + min(n, quality.LENGTHS) - 1

    docs = [[word(w) for w in re.findall("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z\x80-\U0010ffff0-9 \t-\r]+", t or "")] for t in texts]
    counts = Counter(h for d in docs for h, _ in d)
    vocabulary = sorted(h for h, n in counts.items() if n * common >= sum(counts.values()))
    row = {h: k for k, h in enumerate(vocabulary)}
    place, sign = quality.index_vectors(np.array(vocabulary, np.uint64))
    sums = defaultdict(lambda: np.zeros(quality.DIM))
    for d in docs:
        rows = [row.get(h, len(vocabulary) + s) for h, s in d]
        for a, b in [*zip(rows, rows[1:], strict=False), *zip(rows[1:], rows, strict=False)]:
            for c in range(2):
                sums[a][place[c][b]] += sign[c][b]
    out = np.zeros((len(vocabulary) + quality.SHARED, quality.DIM))
    for a, x in sums.items():
        out[a] = x / np.linalg.norm(x) if x.any() else x
    return vocabulary, out


def test_contexts_equal_a_plain_count(spark, odd, documents, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "HELD", 300)
    texts = [r["text"] for r in odd.collect()] + documents.text.tolist()[:60]
    found = quality.contexts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 400)
    vocabulary, matrix = plain_contexts(texts, 400)
    assert found.vocabulary.words.tolist() == vocabulary and 10 < len(vocabulary) <= 400
    assert np.allclose(found.matrix, matrix, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that is long enough to count as text</p></div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>er &lt;p&gt; text<br>line<p>Second&nbsp;par <a class="ad" href="x">buy</a><div class="ad">Ad</div><form><input>Name</form>
<p>Third.</p><section id="comments"><p>I like it</p></section></article><footer>Foot</footer><script>var t="</p>";</script></body></html>"""


def test_parts_that_are_not_the_article_go():
    assert html.main_text(PAGE) == "Title & more First bolder <p> text line Second par Third."
    body = "word " * 60
    assert html.main_text(f"<body><nav>menu</nav><div><p>{body}</p><p>short</p></div><footer>f</footer></body>") == f"{body}short"
    assert html.main_text("plain text") == "plain text" and html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""


def test_pages_equal_their_articles(spark, sf_dir):
    import re
    from html import unescape

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id")
    for r in html.op4_html_text(spark, sf_dir).collect():
        inner = re.search("<article>(.*)</article>", pages.html[r["page_id"]], re.S)[1]
        want = re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br|div|ul|li)[^>]*>", " ", inner))
        assert r["text"] == " ".join(unescape(want).split()) and r["n_chars"] == len(r["text"])


def article_of(page):
    import re
    from html import unescape

    inner = re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br|div|ul|li)[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1]))
    return " ".join(unescape(inner).split())


def test_windows_find_articles_without_their_names():
    import re

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    bare = [re.sub(' class="[^"]*"', "", p.replace("<article", "<div").replace("</article", "</div")) for p in pages]
    same = sum(html.main_text(b) == article_of(p) for b, p in zip(bare, pages, strict=True))
    assert same >= 0.95 * len(pages)
    # With a surge at every line with text, the advert before each article comes in.
    off = sum(html.main_text(b, surge=0) == article_of(p) for b, p in zip(bare, pages, strict=True))
    assert off <= 0.05 * len(pages)


def test_parts_of_articles_stay():
    body = "word " * 60
    for page, want in (
        ("<article><header><h1>Title</h1></header><p>Body</p></article>", "Title Body"),
        ('<article><p class="share-price">Up 3</p><p>Body</p><div class="share-bar">Share</div><div class="cookie-notice">C</div></article>', "Up 3 Body"),
        (f"<div><div>By A. Author</div><h1>T</h1><p>{body}</p><ul><li>one</li><li><a href=x>two</a></li></ul><p>end</p></div><div>foot</div>", f"By A. Author T {body}one two end"),
        (f"<div><div><p>{body}</p></div><div><p>b</p></div><div><p>{body}</p></div></div><div>© us</div>", f"{body}b {body.strip()}"),
        (f"<body><h1>T</h1><p>{body}</p><div>ad</div><p>x</p><div>foot</div></body>", f"T {body}x"),
        (f"<header><h1>Site</h1></header><main><article><p>{body}</p></article><article><h2>Second</h2></article></main>", body.strip()),
        ("<article><p><a href=x>all linked</a></p></article>", "all linked"),
    ):
        assert html.main_text(page).split() == want.split()


def test_long_and_deep_pages():
    assert html.main_text("<div>" * 50_000 + "<p>deep text</p>" + "</div>" * 50_000) == "deep text"
    assert len(html.main_text("<article>" + "<p>one two" * 100_000)) == 100_000 * 8 - 1


def test_null_pages_and_empty_table(spark, empty, write_tables):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, "<p>a &amp; b")], "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.op4_html_text(spark, write_tables(empty, pages=pages)).collect())
    assert rows == [(1, "", 0), (2, "", 0), (2, "a & b", 5)]
    assert html.op4_html_text(spark, write_tables(empty, pages=pages.limit(0))).collect() == []


LONG = "<p>" + "A paragraph of the article with more than enough words to weigh something. " * 4 + "</p>"
TWO = " ".join(["A paragraph of the article with more than enough words to weigh something."] * 8)
MENU = "<div class=menu><a href=/>Home</a> <a href=/b>News</a></div>"


@pytest.mark.parametrize("open_, close", [
    ("<form id=aspnetForm method=post>", "</form>"), ('<div class="wrapper header-fixed">', "</div>"), ('<div class="content sidebar-right">', "</div>"),
    ('<form><div class="page-wrapper sidebar-left"><section class="header-fixed">', "</section></div></form>"), ('<div role="banner main">', "</div>"),
])
def test_no_page_is_lost_to_a_word(open_, close):
    """A form or a class around the whole page says nothing; inside it the same words still tell a menu from the text."""
    assert html.main_text(f"<body>{open_}{MENU}{LONG}{LONG}<div class=sidebar><p>Also on this site today</p></div>{close}</body>") == TWO


def test_short_parts_of_a_series_are_kept():
    body = f"<div id=a>{LONG}{LONG}</div><div id=b>{LONG}{LONG}</div><div id=c><p>Short end.</p></div>"
    assert html.main_text(f"<body>{body}</body>") == f"{TWO} {TWO} Short end."
    assert html.main_text(f"<body>{body}<div id=d><a href=/>More</a></div><div id=e class=x><p>Other</p></div></body>") == f"{TWO} {TWO} Short end."


def test_comments_are_left_out_however_many():
    comments = "<div class=comments>" + LONG * 9 + "</div>"
    assert html.main_text(f"<body><div class=post>{LONG}{LONG}</div>{comments}</body>") == TWO
    assert html.main_text(f"<body><form><div class=post>{LONG}{LONG}</div>{comments}</form></body>") == TWO
