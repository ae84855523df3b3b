from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lexspark.operators import segment


def run(spark, paragraphs):
    df = spark.createDataFrame([(1, paragraphs)], "id long, blocks array<string>")
    rows = segment.carried(segment.paragraphs(df, "id", "blocks"), "id")
    opis = [r.opis for r in segment.preamble(rows, "id").collect()]
    nested = [r.doc_segmented for r in segment.nested(rows, "id").collect()]
    tree = [(c["glava"], [(a["članak"], [(s["stavak"], list(s["točke"])) for s in a["stavci"]]) for a in c["članci"]]) for c in (nested[0] if nested else [])]
    return (opis[0] if opis else ""), tree


def test_articles_carry_over_chapters(spark):
    opis, tree = run(spark, ["uvod", "I. OPĆE", "Član 1.", "(1) a", "b", "(2) c", "II. DRUGO", "nastavak", "Član 2.", "x"])
    assert opis == "uvod"
    assert tree == [
        ("I. OPĆE", [("Član 1.", [("(1)", ["(1) a", "b"]), ("(2)", ["(2) c"])])]),
        ("II. DRUGO", [("Član 1.", [(None, ["nastavak"])]), ("Član 2.", [(None, ["x"])])]),
    ]


def test_no_article_modern_article_and_conjunction(spark):
    assert run(spark, ["I. A", "tekst"]) == ("tekst", [])
    assert run(spark, ["Članak 1.", "tekst"]) == ("Članak 1. tekst", [])
    assert run(spark, ["Član 1.", "i tako dalje"]) == ("", [])
    assert run(spark, ["Član 1.", "a"]) == ("", [(None, [("Član 1.", [(None, ["a"])])])])
    assert run(spark, ["", "  "]) == ("", [])


def machine(paragraphs):
    """The same, one paragraph after the other: runs of (chapter, chapter run, article, run, label, texts)."""
    chapter = article = None
    chapters = runs = 0
    opis, out = [], {}
    label, group = None, 0
    for p in filter(None, (" ".join(x.split()) for x in paragraphs)):
        if re.match(r"(?i)^[IVX]+\.?\s+.+", p):
            chapter, chapters, runs, label, group = p, chapters + 1, runs + 1, None, 0
        elif re.match(r"(?i)^Član\s+\d+\.\s*$", p):
            article, runs, label, group = p, runs + 1, None, 0
        elif article is None:
            opis.append(p)
        else:
            m = re.match(r"^\(\d+\)", p)
            if m:
                label, group = m.group(), group + 1
            out.setdefault((chapters, runs, group), (chapter, article, label, []))[3].append(p)
    return " ".join(opis), out


def test_against_a_state_machine(spark):
    draw = random.Random(6)
    kinds = ["a b", "I. X", "vi ste", "Član 3.", "član 4. ", "(1) q", "(2) r", "", "tekst", "Članak 9."]
    docs = [(k, [draw.choice(kinds) for _ in range(draw.randrange(0, 30))]) for k in range(120)]
    rows = segment.carried(segment.paragraphs(spark.createDataFrame(docs, "id long, blocks array<string>"), "id", "blocks"), "id").collect()
    for k, blocks in docs:
        opis, out = machine(blocks)
        own = sorted((r for r in rows if r.id == k), key=lambda r: r.pos)
        assert " ".join(r.text for r in own if r.article is None) == opis
        found = {}
        for r in own:
            if r.article is not None:
                found.setdefault((r.chapter_run, r.article_run, r.label_run), (r.chapter, r.article, r.label, []))[3].append(r.text)
        assert found == out


def test_items_scope_and_previews(spark):
    df = spark.createDataFrame([(1, ["uvod", "Član 1.", "(1) a", "b", "Član 2.", "c"])], "id long, blocks array<string>")
    rows = segment.carried(segment.paragraphs(df, "id", "blocks"), "id")
    one = segment.nested(rows, "id").join(segment.preamble(rows, "id"), "id")
    r = one.select(segment.items(F.col("opis"), F.col("doc_segmented")).alias("i"), segment.scope_text(F.col("opis"), F.col("doc_segmented"), F.lit("all")).alias("s"), segment.article_previews(F.col("doc_segmented")).alias("p")).first()
    assert r.i == ["uvod", "(1) a", "b", "c"] and r.s == "uvod (1) a b" and [tuple(x) for x in r.p] == [("Član 1.", "(1) a"), ("Član 2.", "c")]
    assert [tuple(x)[1:] for x in segment.articles(rows, "id").orderBy("segment_order").collect()] == [(0, None, "Član 1.", "(1) a b"), (1, None, "Član 2.", "c")]
