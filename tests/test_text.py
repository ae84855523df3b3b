from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.encoders import DEFAULT, encoder
from lexspark.functions import vectors as V
from lexspark.operators import evaluate, extract, search, store, summarize
from lexspark.sources import acts


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def plain(x):
    return [tuple(map(plain, r)) if isinstance(r, tuple) else list(r) if isinstance(r, list) else r for r in x] if isinstance(x, (list, tuple)) else x


def test_scalars(spark):
    assert [one(spark, d, T.parse_date) for d in ("13.2.1990.", "Datum: 1.12.2001.", "31.2.1990.", None)] == [datetime.date(1990, 2, 13), datetime.date(2001, 12, 1), None, None]
    assert [one(spark, x, T.normalize_issue) for x in ("10/1990", " nn  10/1990 ", "x 1/2")] == ["NN 10/1990", "NN 10/1990", "x 1/2"]
    assert one(spark, "opće-odredbe 3dana", T.title_case) == "opće-odredbe 3dana".title()
    assert one(spark, "Vidi čl. Tri. Kraj je. U 3. Dan! A. Be", T.legal_sentences) == ["Vidi čl. Tri.", "Kraj je.", "U 3. Dan!", "A. Be"]
    assert one(spark, "Zakon o šumama (tekst) i lovu, te vodama", T.title_subjects) == ["šumama", "lovu", "vodama"]
    assert one(spark, "II. OPĆE", T.strip_numeral) == "OPĆE" and one(spark, "/eli/sluzbeni/1990/3/7", T.eli_path) == "1990/3/7"
    html = "<!-- a --><p>b&amp;c</p><script>if (a) { '</p>' }</script><b>d</b>&nbsp;<style>x</style> e"
    assert one(spark, html, T.clean_html) == "b&c d e"
    assert one(spark, "&#353;&scaron;&#x161; a&ndash;b &amp;lt; &lt;&#38;gt; &nope; &#0; &#9999999; &euro;", T.clean_html) == "ššš a–b &lt; <&gt; &nope; &#0; &#9999999; €"
    assert one(spark, None, T.clean_html) is None
    assert [one(spark, x, lambda c: T.contains(c, F.lit("B"))) for x in ("abc", "", None)] == [True, False, False]


def test_lists_and_articles(spark):
    out = one(spark, ["1. a", "2. b", "- c", "- d", "Tekst"], T.list_items, "array<string>")
    assert [(r.kind, r["items"]) for r in out] == [("decimal", ["a", "b"]), ("disc", ["c"]), ("disc", ["d"]), ("paragraph", ["Tekst"])]
    out = one(spark, ["1. a", "da je", "3. c"], T.list_items, "array<string>")
    assert [(r.kind, r["items"]) for r in out] == [("decimal", ["a", "da je", "c"])]
    lines = ["4.d", "-e", "1. a", "2. b", "", "9. c", "11. x", " Paragraf ", "12345678. big", "12345679.next", "1.", "- ", "tail"]
    out = one(spark, lines, T.list_items, "array<string>")
    want = [("decimal", ["d"]), ("disc", ["e"]), ("decimal", ["a", "b", "", "c"]), ("decimal", ["x"]), ("paragraph", [" Paragraf "]), ("decimal", ["big", "next"])]
    assert [(r.kind, r["items"]) for r in out] == want + [("paragraph", ["1."]), ("paragraph", ["- "]), ("paragraph", ["tail"])]
    out = one(spark, "uvod Član 1. prvi Član 2. drugi", T.article_pieces)
    assert [tuple(r) for r in out] == [("", "uvod"), ("Član 1.", "prvi"), ("Član 2.", "drugi")]


def test_blocks_of_a_page(spark):
    html = "<body><div class=x>bare<p>one <b>two</b><p>three<br>four</p><script>'</p>'</script><ul><li>a<li>b</ul> tail </div><div>no</div></body>"
    assert one(spark, html, acts.html_blocks) == ["one two", "three four", "a b"]
    assert one(spark, None, acts.html_blocks) == [] and one(spark, "<p>x</p>y<p>z &scaron;</p>", acts.html_blocks) == ["x", "z š"]
    assert one(spark, "<html><head><title>t</title></head><body>w<p>x</p><ul><li>y</ul></body></html>", acts.html_blocks) == ["x", "y"]
    table = "<table><tr><td>Vrsta:</td><td>Zakon</td></tr><tr><td>ELI</td><td><a href='/e'>x &amp; y</a></td></tr></table>"
    assert tuple(one(spark, table, acts.link)) == ("x & y", "/e")


def test_extraction(spark):
    assert one(spark, "najkasnije u roku od 30 dana", extract.deadlines) == ["u roku od 30 dana", "najkasnije u roku od 30 dana"]
    long = "x" * 60
    assert one(spark, ["Abc", " abc ", "", long + "1", long + "2", None], lambda c: extract.dedupe(c, 250), "array<string>") == ["Abc", long + "1"]
    assert one(spark, ["Stranka je DUŽNA JE platiti.", "nedužan jež"], extract.obligations, "array<string>") == ["Stranka je DUŽNA JE platiti."]
    items = ["Nadležno je ministarstvo: Ministarstvo Financija."]
    assert one(spark, items, lambda c: extract.bodies(F.lit("MINISTARSTVO FINANCIJA RH;"), c), "array<string>") == ["Ministarstvo Financija", "Ministarstvo Financija Rh"]


def naive(vectors, query, k, weight):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    left, out = list(range(len(vectors))), []
    while left and len(out) < k:
        def score(i):
            rel = unit(vectors[i]) @ unit(query)
            return rel if not out else weight * rel - (1 - weight) * max(unit(vectors[i]) @ unit(vectors[j]) for j in out)
        best = max(left, key=lambda i: (round(score(i), 9), -i))
        out.append(best)
        left.remove(best)
    return sorted(out)


def test_marginal_relevance(spark):
    draw = np.random.default_rng(2)
    for n in (0, 1, 3, 12):
        v, q = draw.random((n, 5)), draw.random(5)
        for k, w in ((3, 0.7), (2, 0.45), (20, 0.8)):
            assert summarize.chosen(v, q, k, w, 9) == naive(v, q, k, w)
    same = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert summarize.chosen(same, np.array([1.0, 0]), 1, 0.7) == [0]


def test_summaries(spark):
    long = " ".join(f"Word{i} thing{i % 7} other. " for i in range(250))
    df = spark.createDataFrame([(1, "Jedan. Dva."), (2, long), (3, ""), (4, None), (5, "A b. C d! E f? G h. I j.")], "id long, x string")
    out = {r.id: r for r in summarize.summaries(df, "x").collect()}
    assert out[1].short == "Jedan. Dva." and out[3].short == "" and out[4].short is None and len(out[2].detailed.split(". ")) == 8
    # chunks are held against their own texts, and what is left against the text that it makes
    items = [f"Word{i} thing{i % 7} other." for i in range(250)]
    encode = encoder(DEFAULT)
    vectors, places = encode(items), []
    for a in range(0, 250, 95):
        part = np.arange(a, min(a + 100, 250))
        places += part[summarize.chosen(vectors[part], encode([" ".join(items[p] for p in part)])[0], 3, 0.65)].tolist()
    query = encode([" ".join(items[p] for p in places)])[0]
    assert out[2].detailed == " ".join(items[places[p]] for p in summarize.chosen(vectors[places], query, 8, 0.65))
    one_ = {r.id: r.summary for r in summarize.summary(df, "x", 2).collect()}
    assert one_[1] == "Jedan. Dva." and len(one_[5].split()) == 4


def test_chunks_and_packing(spark):
    for n, size, starts in ((195, 100, [0, 95, 190]), (290, 100, [0, 95, 190, 285]), (101, 100, [0, 95]), (0, 100, [])):
        out = one(spark, [str(i) for i in range(n)], lambda c, size=size: summarize.overlapping(c, size), "array<string>")
        assert [int(x[0]) for x in out] == starts
    assert one(spark, ["a", "bb", "ccc", "d"], lambda c: summarize.packed(c, 4), "array<string>") == ["a bb", "ccc d"]
    draw = random.Random(1)
    for _ in range(10):
        items = ["x" * draw.randrange(1, 9) for _ in range(draw.randrange(0, 15))]
        done, now = [], []
        for x in items:
            if now and sum(map(len, now)) + len(x) > 10:
                done, now = [*done, " ".join(now)], []
            now.append(x)
        assert one(spark, items, lambda c: summarize.packed(c, 10), "array<string>") == done + ([" ".join(now)] if now else [])


def test_requests_and_order(spark):
    for bad in ({"query": ""}, {"query": "a", "page": 0}, {"query": "a", "page_size": 101}, {"query": "a", "search_type": "x"}):
        with pytest.raises(ValueError):
            search.Request(**bad)
    df = spark.createDataFrame([(1, "9.1.1990."), (2, None), (3, "10.1.1990.")], "id long, datum string")
    assert [r.datum for r in search.page_of(df, 1, 10, search.newest()).collect()] == [None, "9.1.1990.", "10.1.1990."]
    rows = spark.createDataFrame([(k, f"e{k}", t) for k, t in enumerate(["a\\x", "ab", "100%"])], "id long, naslov string, doc_cleaned string").withColumn("eli", F.col("naslov"))
    assert [r.id for r in search.lexical(rows, "a\\x").collect()] == [0] and search.lexical(rows, "%").count() == 3


def test_store(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id long, eli string, naslov string")
    source = spark.createDataFrame([("b", "Y"), (None, "Z"), ("d", "W"), ("c", "V")], "eli string, naslov string")
    out = store.upsert(target, source, ["eli"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", "x"), (2, "b", "Y"), (3, None, "Z"), (4, "c", "V"), (5, "d", "W")]
    assert sorted(map(tuple, store.upsert(out, source, ["eli"]).collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(ValueError):
        store.assert_unique(out.union(out), ["id"])
    assert store.not_done(target, target.limit(3), "id").count() == 0 and store.not_done(target, target, "id", force=True).count() == 3
    tables = {"documents": target, "document_segments": spark.createDataFrame([(1, 1), (2, 2)], "id long, document_id long")}
    left = store.delete_documents(tables, target.where("id = 1"))
    assert left["documents"].count() == 2 and [r.document_id for r in left["document_segments"].collect()] == [2]
    assert [r.naslov for r in store.update(target, 2, {"eli": "q"}, replace=True).where("id = 2").collect()] == [None]
    assert all(df.count() == 0 for df in store.purge(spark, "k", "k").values())
    with pytest.raises(PermissionError):
        store.purge(spark, "k", "x")
    good, bad = store.split_valid(target, {"has_eli": F.col("eli").isNotNull()})
    assert good.count() == 2 and bad.first().errors == ["has_eli"]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "p int, a int")
    assert tuple(evaluate.precision_recall(df, [], F.col("p") == 1, F.col("a") == 1).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(evaluate.precision_recall(df.where("p = 0 and a = 0"), [], F.col("p") == 1, F.col("a") == 1).first())[4:] == (0.0, 0.0, 0.0)


def test_packing_in_one_pass_equals_the_chunks(spark):
    from lexspark.operators import embed

    texts = ["", "Jedna rečenica.", "A b c. D e? F! g h i j k. L.", "one_two three. 4 5 6 7 8 9. x.", " ".join(f"W{i} x y z." for i in range(60))]
    for tokens in (1, 3, 7, 40):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", embed.chunks(F.col("t"), tokens).alias("c"), T.sentences(F.col("t")).alias("s")).collect()
        assert [r.c for r in rows] == [embed._packed(r.s, tokens) or [texts[r.i]] for r in rows]
