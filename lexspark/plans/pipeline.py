"""The enrichment pipeline: raw acts to normalized, summarized, extracted and embedded ones, and to store tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.config import Config
from lexspark.encoders import check_dimension, encoder
from lexspark.functions import text as T
from lexspark.operators import embed, extract, imports, segment, summarize
from lexspark.operators.versions import Versions
from lexspark.sources import acts


def normalize(raw: DataFrame, id: str = "eli", html: str = "doc", container: str = "div", strict: bool = False, modern: bool = False) -> DataFrame:
    """raw without `doc`, with opis, doc_cleaned and doc_segmented. Acts without a page pass with nulls."""
    blocks = raw.where(F.col(html).isNotNull()).select(id, acts.html_blocks(F.col(html), container).alias("blocks"))
    rows = segment.carried(segment.paragraphs(blocks, id, "blocks"), id, strict, modern)
    out = raw.withColumn("doc_cleaned", T.clean_html(F.col(html))).drop(html)
    out = out.join(segment.preamble(rows, id), id, "left").join(segment.nested(rows, id), id, "left")
    none = F.array().cast(segment.nested(rows, id).schema["doc_segmented"].dataType)
    has = F.col("doc_cleaned").isNotNull()
    return out.withColumn("opis", F.when(has, F.coalesce("opis", F.lit("")))).withColumn("doc_segmented", F.when(has, F.coalesce("doc_segmented", none)))


def with_text(df: DataFrame) -> DataFrame:
    return df.where(F.length(F.trim(F.coalesce("doc_cleaned", F.lit("")))) > 0)


def summarized(df: DataFrame, config: Config = Config()) -> DataFrame:
    """df with summaries: short, detailed, and a map of structured ones, of which one is of the scope text."""
    grid = tuple(g for g in summarize.GRID if g[0] != "sto_zakon_ureduje")
    scope = tuple(g for g in summarize.GRID if g[0] == "sto_zakon_ureduje")
    rows = with_text(df).withColumn("__scope", segment.scope_text(F.col("opis"), F.col("doc_segmented"), F.col("doc_cleaned")))
    own, limit = encoder(config.summarizer, config.max_tokens, config.embed_batch_size), config.chunk_sentence_limit
    rows = summarize.summaries(summarize.summaries(rows, "doc_cleaned", grid, limit, own), "__scope", scope, limit, own)
    names = [g[0] for g in summarize.GRID[2:]]
    structured = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return rows.withColumn("summaries", F.struct(F.col("short"), F.col("detailed"), structured.alias("structured"))).drop("__scope", *[g[0] for g in summarize.GRID])


def extracted(df: DataFrame) -> DataFrame:
    rows = with_text(df)
    items = segment.items(F.col("opis"), F.col("doc_segmented"))
    headings = F.filter(F.transform("doc_segmented", lambda c: c["glava"]), lambda g: g.isNotNull())
    return rows.withColumn("key_information", extract.extract(F.col("naslov"), F.col("doc_cleaned"), items, headings))


def embedded(df: DataFrame, id: str = "eli", config: Config = Config()) -> DataFrame:
    """(id, embedding_type, segment_order, model_name, embedding_dim, embedding): one row for each text of a document."""
    rows = with_text(df).withColumns({"short": F.col("summaries.short"), "detailed": F.col("summaries.detailed")} | {g[0]: F.try_element_at("summaries.structured", F.lit(g[0])) for g in summarize.GRID[2:]})
    flat = F.flatten(F.transform("doc_segmented", lambda c: c["članci"]))
    text = F.transform(flat, lambda a: F.trim(F.array_join(F.flatten(F.transform(a["stavci"], lambda s: s["točke"])), " ")))
    articles = rows.select(id, F.posexplode(F.filter(text, lambda x: x != "")).alias("segment_order", "text"))
    texts = embed.levels(rows, articles, id, [g[0] for g in summarize.GRID])
    check_dimension(config)
    own = encoder(config.encoder, config.max_tokens, config.batch_size)
    out = embed.embed(texts, [id, "embedding_type", "segment_order"], "text", config.max_tokens, own, F.col("embedding_type").isin(*embed.LONG))
    return out.withColumns({"model_name": F.lit(config.encoder), "embedding_dim": F.size("embedding"), "embedding": F.col("embedding").cast("array<float>")})


STAGES: tuple[tuple[str, Callable], ...] = (("normalize", normalize), ("summarize", summarized), ("extract", extracted))


def run(raw: DataFrame, save: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(documents, vectors). save may write a stage's result and read it again; a stage that fails stops the run."""
    df = raw
    for name, stage in STAGES:
        try:
            df = save(stage(df, config=config) if stage is summarized else stage(df), name)
        except Exception as error:
            raise RuntimeError(f"stage {name} failed") from error
    return df, save(embedded(df, config=config), "embed")


def enriched(documents: DataFrame, vectors: DataFrame, id: str = "eli") -> DataFrame:
    """What run() gives as acts ready for the import: documents with their vectors as one struct, and a path made of the identifier. A document's vectors are
    as many as its texts."""
    flat = F.flatten(F.transform("doc_segmented", lambda c: c["članci"]))
    text = F.filter(F.transform(flat, lambda a: F.trim(F.array_join(F.flatten(F.transform(a["stavci"], lambda s: s["točke"])), " "))), lambda x: x != "")
    of = lambda kind: F.max(F.when(F.col("embedding_type") == kind, F.col("embedding")))
    named = F.collect_list(F.when(F.col("embedding_type").startswith("summary_"), F.struct(F.expr("substring(embedding_type, 9)").alias("key"), F.col("embedding").alias("value"))))
    parts = F.array_sort(F.collect_list(F.when(F.col("embedding_type") == "segment", F.struct("segment_order", "embedding"))))
    own = vectors.groupBy(id).agg(F.max("model_name").alias("model_name"), F.max("embedding_dim").alias("embedding_dim"), of("document").alias("document_embedding"), of("title").alias("title_embedding"), F.map_from_entries(named).alias("summary_embeddings"), parts.alias("__parts"))
    rows = documents.join(own, id, "left").withColumn("__texts", text)
    segments = F.transform("__parts", lambda p: F.struct(F.lit(None).cast("string").alias("glava"), F.lit(None).cast("string").alias("članak"), F.get("__texts", p["segment_order"]).alias("text"), p["embedding"].alias("embedding")))
    kinds = StructType.fromDDL(imports.ENRICHED)
    made = {"path": F.concat(F.lit("acts"), F.col(id), F.lit(".json")), "embeddings": F.when(F.col("model_name").isNotNull(), F.struct("model_name", "embedding_dim", "document_embedding", "title_embedding", "summary_embeddings", segments.alias("segment_embeddings")))}
    rows = rows.withColumns(made)
    return rows.select("path", *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def store_acts(spark: SparkSession, root: str, documents: DataFrame, vectors: DataFrame, config: Config = Config()) -> imports.Outcome:
    """Import what run() gives into the store below root, in one commit."""
    return imports.import_acts(spark, Versions(spark, root), enriched(documents, vectors), config.embedding_dim)
