"""Segmentation of acts: paragraphs into chapters, articles, numbered paragraphs and items, by window functions.

A table of paragraphs has one row for each (document, position). One shuffle by document serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def paragraphs(df: DataFrame, id: str, blocks: str) -> DataFrame:
    """(id, pos, text): the paragraphs of an array column that are not blank, in order."""
    return df.select(id, F.posexplode(blocks).alias("pos", "text")).withColumn("text", T.squeeze(F.col("text"))).where("text <> ''")


def classify(df: DataFrame, strict: bool = False, modern: bool = False) -> DataFrame:
    """kind: a chapter heading is looked for first, then an article heading; anything else is a paragraph."""
    return df.withColumn("kind", F.when(T.is_chapter(F.col("text"), strict), "chapter").when(T.is_article(F.col("text"), modern), "article").otherwise("paragraph"))


def carried(df: DataFrame, id: str, strict: bool = False, modern: bool = False) -> DataFrame:
    """Each paragraph with the chapter and article that it stands under, and the runs these form.

    A new chapter does not end the article before it: paragraphs between a chapter heading and the chapter's first
    article keep the label of the article before. Headings of either kind begin a new run of paragraphs.
    """
    w = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = classify(df, strict, modern)
    chapter, article = F.col("kind") == "chapter", F.col("kind") == "article"
    rows = rows.select(
        "*",
        F.last(F.when(chapter, F.col("text")), ignorenulls=True).over(w).alias("chapter"),
        F.last(F.when(article, F.col("text")), ignorenulls=True).over(w).alias("article"),
        F.sum(F.when(chapter, 1).otherwise(0)).over(w).alias("chapter_run"),
        F.sum(F.when(F.col("kind") != "paragraph", 1).otherwise(0)).over(w).alias("article_run"),
    )
    rows = rows.where("kind = 'paragraph'").drop("kind")
    label = T.paragraph_label(F.col("text"))
    v = Window.partitionBy(id, "article_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "*",
        F.last(F.when(label != "", label), ignorenulls=True).over(v).alias("label"),
        F.sum(F.when(label != "", 1).otherwise(0)).over(v).alias("label_run"),
    )


def preamble(rows: DataFrame, id: str) -> DataFrame:
    """(id, opis): the paragraphs before the first article, those under chapters included, headings not."""
    own = rows.where("article is null").groupBy(id).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("z"))
    return own.select(id, F.array_join("z.text", " ").alias("opis"))


def articles(rows: DataFrame, id: str) -> DataFrame:
    """(id, segment_order, chapter, article, text): each run of paragraphs under an article as one text, from 0 on."""
    runs = rows.where("article is not null").groupBy(id, "chapter_run", "article_run").agg(F.first("chapter").alias("chapter"), F.first("article").alias("article"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("z"))
    flat = runs.withColumn("text", F.trim(F.array_join("z.text", " "))).where("text <> ''")
    return flat.select(id, (F.row_number().over(Window.partitionBy(id).orderBy("article_run")) - 1).alias("segment_order"), "chapter", "article", "text")


def nested(rows: DataFrame, id: str) -> DataFrame:
    """(id, doc_segmented): chapters of articles of labelled groups of items, as arrays of structs in order."""
    own = rows.where("article is not null")
    groups = own.groupBy(id, "chapter_run", "article_run", "label_run").agg(F.first("chapter").alias("chapter"), F.first("article").alias("article"), F.max("label").alias("stavak"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("z"))
    groups = groups.withColumn("g", F.struct("label_run", "stavak", F.col("z.text").alias("točke")))
    runs = groups.groupBy(id, "chapter_run", "article_run").agg(F.first("chapter").alias("chapter"), F.first("article").alias("članak"), F.array_sort(F.collect_list("g")).alias("z"))
    stavci = F.transform("z", lambda g: F.struct(g["stavak"].alias("stavak"), g["točke"].alias("točke")))
    runs = runs.withColumn("a", F.struct("article_run", "članak", stavci.alias("stavci")))
    chapters = runs.groupBy(id, "chapter_run").agg(F.first("chapter").alias("glava"), F.array_sort(F.collect_list("a")).alias("z"))
    inner = F.transform("z", lambda a: F.struct(a["članak"].alias("članak"), a["stavci"].alias("stavci")))
    chapters = chapters.withColumn("c", F.struct("chapter_run", "glava", inner.alias("članci")))
    out = chapters.groupBy(id).agg(F.array_sort(F.collect_list("c")).alias("z"))
    return out.select(id, F.transform("z", lambda c: F.struct(c["glava"].alias("glava"), c["članci"].alias("članci"))).alias("doc_segmented"))


def items(opis: Column, segmented: Column) -> Column:
    """The preamble and all items, in order."""
    each = F.flatten(F.transform(segmented, lambda c: F.flatten(F.transform(c["članci"], lambda a: F.flatten(F.transform(a["stavci"], lambda s: s["točke"]))))))
    return F.concat(F.filter(F.array(F.trim(opis)), lambda x: F.coalesce(x, F.lit("")) != ""), F.coalesce(each, F.array().cast("array<string>")))


def scope_text(opis: Column, segmented: Column, cleaned: Column) -> Column:
    """The preamble and the first article's items; the whole text where both are empty."""
    first = F.try_element_at(F.try_element_at(segmented, F.lit(1))["članci"], F.lit(1))
    body = F.trim(F.concat_ws(" ", opis, F.array_join(F.flatten(F.transform(first["stavci"], lambda s: s["točke"])), " ")))
    return F.coalesce(F.nullif(body, F.lit("")), cleaned)


def article_previews(segmented: Column) -> Column:
    """Chapters flattened to articles, each with the first item of its first group."""
    flat = F.flatten(F.transform(segmented, lambda c: c["članci"]))
    return F.transform(flat, lambda a: F.struct(a["članak"].alias("članak"), F.try_element_at(F.try_element_at(a["stavci"], F.lit(1))["točke"], F.lit(1)).alias("preview")))
