"""Pages of acts against a plain reading of the same mark-up."""

from __future__ import annotations

import random
import re
from html import unescape

from pyspark.sql import functions as F

from lexspark.sources import acts, pages


def page(details="", title="<h2>T</h2>", body="", table="detailsTable"):
    return f'<html><body><div id="sticky">{title}</div><div id="article-details-scroll"><table class="{table}"><tbody>{details}</tbody></table></div><div id="html-content-frame"><div class="sl-content"><div class="doc"><div class="article-column">{body}</div></div></div></div></body></html>'


ELI = '<tr><td>ELI: <a href="/e">/eli/sluzbeni/1990/1/2</a></td></tr>'


def row(*args, **more):
    return pages.row_of(page(*args, **more))


def test_fields_come_from_the_first_cell_alone():
    assert row("<tr><td>Datum tiskanog izdanja: 1.1.1990.</td><td>drugo</td></tr>" + ELI)["datum"] == "1.1.1990."
    assert row("<tr><th>Donositelj: x</th><td>Donositelj: Sabor</td></tr>" + ELI)["donositelj"] == "Sabor"
    assert row("<tr><td>drugo</td><td>Donositelj: Sabor</td></tr>" + ELI)["donositelj"] is None
    assert row("<tr><td>Donositelj:</td></tr>" + ELI)["donositelj"] == ""
    assert row("<tr><td>Dio&nbsp;NN:&#32;Slu&#x17E;beni</td></tr>" + ELI)["dio"] == "Službeni"


def test_links_and_plain_values():
    first = '<tr><td><a href="/first">first</a></td></tr>'
    got = row(first + '<tr><td>Izdanje: <a href="/i?a&amp;b"> NN <b> 1/1990 </b></a></td></tr>' + ELI)
    assert (got["izdanje"], got["izdanjeUrl"], got["eli"], got["eliUrl"]) == ("NN1/1990", "/i?a&b", "/eli/sluzbeni/1990/1/2", "/e")
    got = row("<tr><td>Izdanje:&nbsp;NN&nbsp;1/1990</td></tr>" + ELI)
    assert (got["izdanje"], got["izdanjeUrl"]) == ("NN 1/1990", None)
    assert row("<tr><td>Izdanje: &nbsp; </td></tr>" + ELI)["izdanje"] is None
    assert row("<tr><td>Izdanje: <a>x</a></td></tr>" + ELI) == {"refused": "link without address"}


def test_refusals_and_missing_bodies():
    assert pages.row_of(None) == pages.row_of("") == row(ELI, table="x") == {"refused": "no details"}
    assert row(ELI, title="<p><h2>T</h2></p>") == {"refused": "no title"}
    assert row("<tr><td>ELI: </td></tr>") == row("") == {"refused": "no identifier"}
    assert row('<tr><td>ELI: <a href="/u"></a></td></tr>')["eliUrl"] == "/u"
    assert row(ELI)["doc"] == '<div class="article-column"></div>'
    assert pages.row_of(page(ELI).replace("sl-content", "other"))["doc"] is None
    assert pages.row_of(page(ELI).replace('<div class="doc">', "<section><div class='doc'>"))["doc"] is None


def test_nested_tables_are_read_as_they_stand():
    nested = "<tr><td>Vrsta dokumenta: <table><tbody><tr><td>Stranica tiskanog izdanja: 7</td></tr></tbody></table></td></tr>"
    got = row(nested + ELI)
    assert got["vrsta"] == "Stranica tiskanog izdanja: 7" and got["stranica"] == "Vrsta dokumenta: 7"


def test_markup_keeps_what_the_page_says():
    body = '<p class=" a  b " data-x=\'"q"\'>1 &lt; 2 &amp; 3<br>four<!-- c --></p><script>if (a < b) {}</script><img src=x>tail'
    want = '<div class="article-column"><p class="a b" data-x=\'"q"\'>1 &lt; 2 &amp; 3<br/>four<!-- c --></p><script>if (a < b) {}</script><img src="x"/>tail</div>'
    assert row(ELI, body=body)["doc"] == want
    again = row(ELI, body=pages.first(pages.tree(want), "div").markup())["doc"]
    assert again == f'<div class="article-column">{want}</div>'


def walk(markup):
    """(path of names, ids and classes; texts below) of all elements of well-formed mark-up, by a plain pass over its tags."""
    out, open_ = [], []
    for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", markup):
        if text:
            for i in open_:
                out[i][1].append(unescape(text))
        elif tag.startswith("</"):
            open_.pop()
        else:
            name = re.match(r"<(\w+)", tag)[1]
            marks = {name} | {"#" + x for x in re.findall(r'id="([^"]*)"', tag)} | {"." + c for x in re.findall(r'class="([^"]*)"', tag) for c in x.split()}
            out.append(([*(out[i][0][-1] for i in open_), marks], []))
            open_.append(len(out) - 1)
    return out


def drawn(draw, depth=0):
    out = []
    for _ in range(draw.randrange(1, 4)):
        name = draw.choice(["div", "p", "tr", "td"])
        marks = draw.choice(["", ' id="a"', ' class="x"', ' class="y x"', ' id="b" class="y"'])
        inner = drawn(draw, depth + 1) if depth < 4 and draw.random() < 0.7 else draw.choice(["t", " &amp; ", "u "])
        out.append(f"<{name}{marks}>{inner}</{name}>")
    return draw.choice(["", "s "]).join(out)


def test_selection_equals_a_plain_walk():
    draw = random.Random(3)
    for _ in range(150):
        markup = drawn(draw)
        root, plain = pages.tree(markup), walk(markup)
        for selector in ("td", "div > p", "#a > .x", "tr td", "div.x", "p#b", "#a > div .y > td", "div p > td"):
            steps = re.findall(r"(>|\s)?\s*([^\s>]+)\s*", selector)
            fits = lambda marks, s: set(re.findall(r"[#.]?[^#.]+", s)) <= marks

            def reached(path, k, steps=steps, fits=fits):
                if not path or not fits(path[-1], steps[k][1]):
                    return False
                if k == 0:
                    return True
                below = [path[:-1]] if ">" in selector_between[k] else [path[:j] for j in range(1, len(path))]
                return any(reached(p, k - 1) for p in below)

            names = re.split(r"\s*>\s*|\s+", selector)
            selector_between = ["", *re.findall(r"\s*>\s*|\s+", selector)]
            steps = [("", n) for n in names]
            want = ["".join(texts) for path, texts in plain if reached(path, len(names) - 1, steps)]
            assert [e.text() for e in pages.select(root, selector)] == want, (selector, markup)


def test_rows_in_spark_and_paths_from_addresses(spark):
    table = [page(ELI), page('<tr><td>ELI: <a href="https://example.org/eli/sluzbeni/1991/3/44"></a></td></tr>'), "", None, page("")]
    df = spark.createDataFrame([(i, h, "x") for i, h in enumerate(table)], "id int, html string, doc string")
    got = pages.outcomes(df).orderBy("id").collect()
    assert [r["refused"] for r in got] == [None, None, "no details", "no details", "no identifier"]
    placed = acts.located(pages.rows(df)).orderBy("id").select("id", "year", "issue", "document").collect()
    assert [tuple(r) for r in placed] == [(0, "1990", "1", "2"), (1, "1991", "3", "44")]
    assert df.select(pages.field(F.col("html"), "ELI:").alias("x")).first()[0] == "/eli/sluzbeni/1990/1/2"
    assert pages.rows(df.limit(0)).collect() == []


def test_references_without_a_semicolon_stay_text_where_only_closed_ones_count(spark):
    html = '<body><article a="x&amp"><h1>a&amp;b &lt &am &#38; c&amp</h1><!-- &amp --><script>&amp</script></article></body>'
    df = spark.createDataFrame([(html,), (None,), ("<body><article><h1>&amp</h1></article>",)], "html string")
    got = df.select(pages.text_of(F.col("html"), "article > h1", True), pages.markup_of(F.col("html"), "article", True), pages.text_of(F.col("html"), "article > h1")).collect()
    assert tuple(got[0]) == ("a&b &lt &am & c&amp", '<article a="x&amp;amp"><h1>a&amp;b &amp;lt &amp;am &amp; c&amp;amp</h1><!-- &amp --><script>&amp</script></article>', "a&b < &am & c&")
    assert tuple(got[1]) == (None, None, None) and got[2][0] == "&amp"


def test_pages_reach_python_in_small_batches(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        for make in (acts.html_blocks, pages.fields, lambda c: pages.text_of(c, "p"), lambda c: pages.markup_of(c, "p")):
            spark.conf.set(names[0], "10000")
            spark.conf.set(names[1], "64")
            df = spark.range(700).select(make(F.lit("<p>a</p><p>b</p>")).alias("x"))
            assert [spark.conf.get(n) for n in names] == ["256", "64"] and df.count() == 700
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
