"""Wrapper induction: matching against all matchings, wrappers in any split, templates, markup and odd rows."""

import functools
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from cutover.llm import wrapper_induction as wi
from cutover.llm.queries import QUERIES

DDL = "page_id long, url string, html string"


def tree(label, *children):
    node = wi.Node(label)
    node.children = list(children)
    return node


def brute(a, b):
    """The most nodes that a matching can pair, over all choices of children in order."""
    if a.label != b.label:
        return 0

    @functools.cache
    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute(a.children[i], b.children[j]) + best(i + 1, j + 1) if a.children[i].label == b.children[j].label else 0)

    return 1 + best(0, 0)


def random_tree(rng, depth=3):
    return tree(rng.choice("ab") if depth < 3 else "r", *(random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)))


def test_matching_pairs_the_most_nodes():
    rng = random.Random(1)
    for _ in range(200):
        a, b = random_tree(rng), random_tree(rng)
        assert wi._paired(a, b, {})[0] == brute(a, b)
        joined = wi.merge(a, b)
        assert joined.size() == a.size() + b.size() - brute(a, b)
        assert joined.n == 2 and len(wi.placed(a, wi.numbered(joined))) >= brute(a, joined)


def text_of(page, constant=None):
    return "\n".join(wi.main_blocks(wi.Page(page), constant))


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>one &amp; two &lt;b&gt; &eacute;&#x41;&nbsp;x</p></article>", "one & two <b> éA x"),
    ("<article><p>a\n\t  b<br>c <b>d</b>e</p>f<div>g</div></article>", "a b c de\nf\ng"),
    ("<body><nav><a href=/>Home</a></nav><div id=main-content><h1>T</h1><p>Body text</p></div><footer>f</footer></body>", "T\nBody text"),
    ("<article><header><h1>T</h1></header><p>x<aside>s</aside><footer>f</footer><form><p>q</p></form></article>", "T\nx"),
    ("<article><p>x</p><div class='share-buttons'>tweet</div><section id=comments><article class=comment>me too</article></section></article>", "x"),
    ("<article class='post with-sidebar'><p>x</p></article><div class=sideBar>s</div>", "x"),
    ("<script>var t='</p><article>no</article>';</script><style>p{}</style><article><p>yes<script>no</script> it<!-- no --> is</p></article>", "yes it is"),
    ("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\nb\nc\nd\ne\nf\ng"),
    ("plain text, no tags < 3", "plain text, no tags < 3"),
    ("<title>head only</title>after", "after"),
    ("<head><title>x</title><p>open head</p>", "open head"),
    ("<article>cut <a href='x", "cut"),
    ("<div class=cookie-notice>We use cookies</div><div role=alert>!</div><p hidden>h</p><p style='display: none'>h</p><p>seen</p>", "seen"),
    ("<main><p>intro</p><article><h1>A</h1><p>x</p></article><article><h2>teaser</h2></article></main>", "A\nx"),
    ("<ul class=x><li><a href=1>one</a><li><a href=2>two</a></ul><p>Text with a <a href=3>link</a> inside.</p>", "Text with a link inside."),
    ("</p></div><article></span>x</b></article></body></html>late", "x"),
    ("<article><textarea>no</textarea><button>no</button><figure><figcaption>cap</figcaption></figure></article>", "cap"),
    ("<ARTICLE><P CLASS=a>Upper</P></ARTICLE>", "Upper"),
])
def test_markup(page, text):
    assert text_of(page) == text


def soup(k, rng):
    """A page without any telling element or name: four constant parts around a varying text."""
    words = lambda n: " ".join(rng.choice(["red", "green", "blue", "old", "new"]) + str(rng.randint(0, 99)) for _ in range(n))
    paragraphs = [words(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
    title = words(4)
    page = (f"<html><body><div><div>The Daily Example</div><div>Terms apply to all readers</div></div><table><tr><td><div><h1>{title}</h1>"
            + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div>Written by our staff</div></td></tr></table><div>All rights kept &copy; Example</div></body></html>")
    return page, "\n".join([title, *paragraphs])


def pages_of(spark, rows, parts=1):
    return spark.createDataFrame(rows, DDL).repartition(parts)


def extracted(df):
    return {r.page_id: r.text for r in wi.with_main_text(df, wi.induced(df)).collect()}


@pytest.mark.parametrize("parts", [1, 40])
def test_constant_nodes_are_template(spark, many_segments, parts):
    rng = random.Random(2)
    made = [soup(k, rng) for k in range(120)]
    rows = [(k, f"https://site.example/{k}", page) for k, (page, _) in enumerate(made)]
    # copies of one page must not make its own text a template
    rows += [(1000 + k, f"https://site.example/copy{k}", made[0][0]) for k in range(500)]
    # a host with few pages is read without template
    rows += [(5000 + k, f"https://few.example/{k}", made[k][0]) for k in range(wi.LEAST_PAGES - 1)]
    got = extracted(pages_of(spark, rows, parts))
    assert all(got[k] == text for k, (_, text) in enumerate(made)) and all(got[1000 + k] == made[0][1] for k in range(500))
    assert all("The Daily Example" in got[5000 + k] for k in range(wi.LEAST_PAGES - 1))


def test_partial_wrappers_meet(spark, monkeypatch, many_segments):
    monkeypatch.setattr(wi, "FAN_IN", 2)
    monkeypatch.setattr(wi, "HOSTS", 2)
    rng = random.Random(3)
    rows = [(k, f"http://h{k % 5}.example/{k}", soup(k, rng)[0]) for k in range(100)]
    wrappers = wi.induced(pages_of(spark, rows, 9)).collect()
    assert sorted(r.host for r in wrappers) == [f"h{k}.example" for k in range(5)]
    assert all(wi.unpacked(wi.json.loads(r.wrapper), False).n == 20 and len(r.constants) == 4 for r in wrappers)


def letters(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(4))


def test_rare_nodes_of_large_wrappers_count(spark):
    # every page has elements of its own, so the host's wrapper has to give up nodes, those of a layout on 6 pages of 400 among them
    rows, want = [], {}
    for k in range(400):
        own = [f"{letters(k)} says {letters(60 * k + i)}" for i in range(60)]
        odd = f"<div class=odd><div>Strapline of few pages</div><div>odd {letters(k)}</div></div>" if k % 70 == 5 else ""
        rows.append((k, f"https://large.example/{k}", "<html><body><div>The Daily Example</div>" + odd + f"<div id={letters(k)}x>" + "".join(
            f"<section id={letters(60 * k + i)}>{text}</section>" for i, text in enumerate(own)) + "</div></body></html>"))
        want[k] = "\n".join([f"odd {letters(k)}"] * bool(odd) + own)
    rows += [(1000 + k, u, page) for k, u, page in rows[:10]]
    df = pages_of(spark, rows, 3)
    wrappers = wi.induced(df)
    whole = wi.unpacked(wi.json.loads(wrappers.filter("page is null").first().wrapper), False)
    assert whole.partial and whole.size() <= wi.NODES
    got = {r.page_id: r.text for r in wi.with_main_text(df, wrappers).collect()}
    assert len(got) == 410 and {k: got[k] for k in want} == want and all(got[1000 + k] == want[k] for k in range(10))


def test_nodes_without_a_place_have_names(spark):
    rng = random.Random(5)
    for _ in range(100):
        page, wrapper = random_tree(rng, 4), wi.numbered(random_tree(rng, 4))
        page.label = wrapper.label = "r"
        names, places = wi.all_placed(page, wrapper), wi.placed(page, wrapper)
        assert len(names) == len(set(names.values())) == page.size() and places.items() <= names.items()


def test_repeated_passages_of_articles_stay(spark):
    # copies of an article with one changed word: almost everything repeats, and nothing may go
    rows = [(k, f"https://one.example/{k}", f"<nav>n{k}</nav><article><h1>Same</h1><p>first part of it</p><p>second part {k}</p></article>") for k in range(50)]
    got = extracted(pages_of(spark, rows, 4))
    assert got == {k: f"Same\nfirst part of it\nsecond part {k}" for k in range(50)}


def test_odd_rows(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000 + "<p>after</p>"
    rows = [(1, None, None), (2, "https://a.example/", ""), (3, None, "<p>no host</p>"), (4, "not a url", "<p>x</p>"), (5, "http://A.example:80/x", "<p>y</p>"),
            (5, "http://A.example:80/x", "<p>y</p>"), (None, "ftp://u:p@b.example?q", "   "), (6, "http://a.example/l", long), (7, "http://a.example/d", deep), (8, "http://a.example/s", "<script>only")]
    df = spark.createDataFrame(rows, DDL)
    out = wi.with_main_text(df, wi.induced(df)).collect()
    got = {(r.page_id, r.text) for r in out}
    assert len(out) == 10 and all(r.n_chars == len(r.text) for r in out)
    assert got == {(1, ""), (2, ""), (3, "no host"), (4, "x"), (5, "y"), (None, ""), (6, "\n".join(["word word"] * 50_000)), (7, "deep\nafter"), (8, "")}
    assert wi.with_main_text(df.limit(0), wi.induced(df.limit(0))).collect() == []


def test_clashing_columns(spark):
    rng = random.Random(4)
    df = pages_of(spark, [(k, f"https://site.example/{k}", soup(k, rng)[0]) for k in range(12)])
    more = {c: F.lit("x") for c in ("TEXT", "n_chars", "_host", "_wrapper", "_constants", "_html", "host", "wrapper", "constants", "_w")}
    clash = df.withColumns(more)
    out = wi.with_main_text(clash, wi.induced(clash))
    assert {r.page_id: r.text for r in out.select("page_id", "text").collect()} == extracted(df) and "host" in out.columns


def test_hosts(spark):
    urls = ["https://A.b.C/x", "http://u@h.example:8080", "//h/x", "h.example/x", None, "ftp://h.example#x", "https:///x"]
    out = spark.createDataFrame([(u,) for u in urls], "u string").select(wi.host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in out] == ["a.b.c", "h.example", None, None, None, "h.example", None]


def independent(page):
    """The article of the given tables' pages, cut out by plain patterns."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:h1|p)>", inner))
    return "\n".join(p for p in parts if p)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op12_html_extraction"](spark, folder)
    assert out.dtypes[:4] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(pages)
    assert all((r.url, r.text, r.n_chars) == (pages[r.page_id].url, t := independent(pages[r.page_id].html), len(t)) for r in rows)
