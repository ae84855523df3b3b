"""Import of enriched acts into the five tables of the store: each act as a whole or not at all, all acts in one commit.

Acts are read as a tree of JSON files. An act that can't be stored (unreadable, without an identifier, with values
longer than their columns or vectors of another dimension) is refused with a message and changes nothing; the others are merged table by table with
joins on their keys. Several files of one identifier take effect one after the other, in the order of their paths: the first of each, then
the second of each, and so on. Null and missing fields are one and the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources import acts as sources
from lexspark.staging import at_once, staged

from . import store
from .versions import Versions

GROUPS = "array<struct<stavak: string, `točke`: array<string>>>"
ARTICLES = f"array<struct<`članak`: string, stavci: {GROUPS}>>"
SEGMENTED = f"array<struct<`glava`: string, `članci`: {ARTICLES}>>"
LISTS = ("responsible_bodies", "obligations", "deadlines", "scope", "subjects", "sanctions")
VECTOR = "array<float>"
ENRICHED = (
    "dio string, vrsta string, izdanje string, izdanjeUrl string, brojDokumenta string, stranica string, donositelj string, datum string, eli string, eliUrl string, naslov string, opis string, doc_cleaned string, "
    f"doc_segmented {SEGMENTED}, summaries struct<short: string, detailed: string, structured: map<string, string>>, key_information struct<{', '.join(f'{c}: array<string>' for c in LISTS)}>, "
    f"embeddings struct<model_name: string, embedding_dim: int, document_embedding: {VECTOR}, title_embedding: {VECTOR}, summary_embeddings: map<string, {VECTOR}>, segment_embeddings: array<struct<`glava`: string, `članak`: string, text: string, embedding: {VECTOR}>>>"
)
# Fields by column of the documents table, longest values by column, names of stored vectors, and the dimension where an act names none.
FIELDS = {
    "eli": "eli", "eli_url": "eliUrl", "broj_dokumenta": "brojDokumenta", "dio": "dio", "vrsta": "vrsta", "izdanje": "izdanje", "izdanje_url": "izdanjeUrl",
    "donositelj": "donositelj", "datum": "datum", "opis": "opis", "doc_cleaned": "doc_cleaned",
}
LONGEST = {"eli": 255, "brojDokumenta": 32, "dio": 64, "vrsta": 64, "izdanje": 64, "datum": 32}
LONGEST_LABEL, LONGEST_SUMMARY, LONGEST_VECTOR, LONGEST_MODEL = 32, 64, 100, 128
VECTORS = {
    "short": "summary_short", "detailed": "summary_detailed", "structured_što_zakon_uređuje": "summary_structured_sto_zakon_ureduje",
    "structured_na_koga_se_odnosi": "summary_structured_na_koga_se_odnosi", "structured_što_uvodi_ili_mijenja": "summary_structured_sto_uvodi_ili_mijenja",
}
DIMENSION = 384


@dataclass(frozen=True)
class Outcome:
    """What an import has done; outcomes has a row for each file: path, eli, status (processed or error), message."""

    version: int
    processed: int
    errors: int
    outcomes: DataFrame


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _articles() -> Column:
    """An array of (label, text) of an act's articles that have text."""
    empty = lambda kind: F.array().cast(kind)
    flat = F.flatten(F.transform(F.coalesce("doc_segmented", empty(SEGMENTED)), lambda c: F.coalesce(c["članci"], empty(ARTICLES))))
    parts = lambda a: F.flatten(F.transform(F.coalesce(a["stavci"], empty(GROUPS)), lambda s: F.coalesce(s["točke"], empty("array<string>"))))
    text = lambda a: F.regexp_replace(F.array_join(parts(a), " "), r"(?U)^\s+|\s+$", "")
    rows = F.transform(flat, lambda a: F.struct(F.coalesce(a["članak"], F.lit("")).alias("label"), text(a).alias("text"), F.exists(parts(a), lambda x: x.isNull()).alias("gap")))
    return F.filter(rows, lambda r: (r["text"] != "") | r["gap"])


def _vectors() -> Column:
    """An array of (type, text, embedding) of an act's vectors that are not empty; text is that of the segment, in their order."""
    e = F.col("embeddings")
    names = F.create_map(*[F.lit(x) for pair in VECTORS.items() for x in pair])
    one = lambda kind, v, text=None: F.struct(kind.alias("type"), (_none("string") if text is None else text).alias("text"), v.alias("embedding"))
    flat = F.array(one(F.lit("document"), e["document_embedding"]), one(F.lit("title"), e["title_embedding"]))
    kind = f"array<struct<type: string, text: string, embedding: {VECTOR}>>"
    summaries = F.transform(F.map_entries(e["summary_embeddings"]), lambda x: one(F.coalesce(F.try_element_at(names, x["key"]), F.concat(F.lit("summary_"), x["key"])), x["value"]))
    segments = F.transform(F.filter(e["segment_embeddings"], lambda s: F.coalesce(s["text"], F.lit("")) != ""), lambda s: one(F.lit("segment"), s["embedding"], s["text"]))
    own = F.concat(flat.cast(kind), F.coalesce(summaries.cast(kind), F.array().cast(kind)), F.coalesce(segments.cast(kind), F.array().cast(kind)))
    return F.filter(own, lambda v: F.coalesce(F.size(v["embedding"]), F.lit(0)) > 0)


def _summaries() -> Column:
    """An array of (type, text) of an act's summaries that are not empty."""
    s = F.col("summaries")
    kind = "array<struct<type: string, text: string>>"
    structured = F.transform(F.map_entries(s["structured"]), lambda x: F.struct(F.concat(F.lit("structured_"), x["key"]).alias("type"), x["value"].alias("text")))
    own = F.concat(F.array(*[F.struct(F.lit(n).alias("type"), s[n].alias("text")) for n in ("short", "detailed")]).cast(kind), F.coalesce(structured.cast(kind), F.array().cast(kind)))
    return F.filter(own, lambda x: F.coalesce(x["text"], F.lit("")) != "")


def judged(acts: DataFrame, dim: int) -> DataFrame:
    """acts with `articles`, `vectors`, `texts`, `model` and `message`: why an act is refused, null if it is not."""
    rows = acts.withColumns({"articles": _articles(), "vectors": _vectors(), "texts": _summaries(), "model": F.coalesce("embeddings.model_name", F.lit(""))})
    long = lambda c, n: F.length(c) > n
    rules = [(F.col("_corrupt_record").isNotNull(), "unreadable")] if "_corrupt_record" in acts.columns else []
    rules += [(F.coalesce("eli", F.lit("")) == "", "Missing 'eli' field")]
    rules += [(long(F.col(c), n), f"{c} is longer than {n} characters") for c, n in LONGEST.items()]
    rules += [
        (F.exists("articles", lambda a: a["gap"]), "a segment has an item that is no text"),
        (F.exists("articles", lambda a: long(a["label"], LONGEST_LABEL)), f"a label is longer than {LONGEST_LABEL} characters"),
        (F.exists("texts", lambda s: long(s["type"], LONGEST_SUMMARY)), f"a kind of summary is longer than {LONGEST_SUMMARY} characters"),
        (F.exists("vectors", lambda v: long(v["type"], LONGEST_VECTOR)), f"a kind of vector is longer than {LONGEST_VECTOR} characters"),
        (long(F.col("model"), LONGEST_MODEL), f"the model's name is longer than {LONGEST_MODEL} characters"),
        (F.exists("vectors", lambda v: F.size(v["embedding"]) != dim), f"a vector is not of {dim} dimensions"),
        (F.exists("vectors", lambda v: F.exists(v["embedding"], lambda x: x.isNull())), "a vector has a component that is no number"),
    ]
    return rows.withColumn("message", F.coalesce(*[F.when(rule, F.lit(message)) for rule, message in rules]))


def merged(tables: dict[str, DataFrame], acts: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The tables after acts that are judged valid, one for each identifier. Ids are given once, to keys that are staged; texts and vectors go from the acts
    into the tables that the caller writes. Tables that do not need each other are merged side by side."""
    source = acts.select(*[F.col(f).alias(c) for c, f in FIELDS.items()], F.coalesce("naslov", F.lit("")).alias("naslov"), T.parse_date(F.col("datum")).cast("timestamp_ntz").alias("publication_date"))
    out = {"documents": store.upsert_documents(tables["documents"], source, now)}
    known = acts.join(staged(out["documents"].select("eli", F.col("id").alias("document_id")), "ids"), "eli")

    def segments_and_vectors() -> tuple[DataFrame, DataFrame]:
        # acts with a model are stored anew: their segments go, and the vectors of those segments, of whatever model
        anew = staged(known.where("model <> ''").select("document_id", "model"), "anew")
        segments = tables["document_segments"].join(anew.select("document_id"), "document_id", "left_anti").select(*tables["document_segments"].columns)
        lost = tables["document_segments"].join(anew.select("document_id"), "document_id", "left_semi").select(F.col("id").alias("segment_id"))
        vectors = tables["document_embeddings"].join(lost, "segment_id", "left_anti")
        same = anew.select("document_id", F.col("model").alias("model_name"), F.lit("segment").alias("embedding_type"))
        vectors = vectors.join(same, ["document_id", "model_name", "embedding_type"], "left_anti").select(*tables["document_embeddings"].columns)

        each = lambda df: df.select("document_id", F.posexplode("articles").alias("segment_order", "a")).select("document_id", "segment_order", F.col("a.label").alias("clanak_label"), F.col("a.text").alias("text"))
        segments = store.upsert_segments(segments, each(known))
        placed = each(known.where(F.exists("vectors", lambda v: v["type"] == "segment"))).withColumn("h", T.text_hash(F.col("text"))).drop("clanak_label", "text").join(segments.select("document_id", "segment_order", "id"), ["document_id", "segment_order"])
        named = placed.groupBy("document_id", "h").agg(F.max(F.struct("segment_order", "id")).alias("z")).select("document_id", "h", F.col("z.id").alias("segment_id"))

        each = known.select("document_id", F.col("model").alias("model_name"), F.coalesce("embeddings.embedding_dim", F.lit(DIMENSION)).alias("embedding_dim"), F.posexplode("vectors").alias("at", "v")).select("*", "v.*").drop("v")
        flat = each.where("type <> 'segment'").withColumn("segment_id", _none("long"))
        own = each.where("type = 'segment'").withColumn("h", T.text_hash(F.col("text"))).join(named, ["document_id", "h"]).drop("h")
        both = flat.unionByName(own).withColumnRenamed("type", "embedding_type").drop("text")
        last = staged(store.last_of(both, store.KEYS["document_embeddings"], "at").drop("at"), "vectors")
        return segments, store.upsert(vectors, last, store.KEYS["document_embeddings"], ("id", "embedding_dim"))

    def summaries() -> DataFrame:
        texts = known.select("document_id", "model", F.explode("texts").alias("t")).select("document_id", F.col("t.type").alias("summary_type"), F.col("t.text").alias("text"), F.col("model").alias("model_name"))
        return store.upsert_summaries(tables["document_summaries"], texts)

    def information() -> DataFrame:
        info = known.where(F.coalesce(*[F.col(f"key_information.{c}") for c in LISTS]).isNotNull()).select("document_id", "key_information.*")
        return store.upsert_key_information(tables["document_key_information"], info)

    (segments, vectors), texts, info = at_once(acts.sparkSession, segments_and_vectors, summaries, information)
    return out | {"document_segments": segments, "document_summaries": texts, "document_key_information": info, "document_embeddings": vectors}


def import_acts(spark: SparkSession, versions: Versions, acts: DataFrame, dim: int, now: Column | None = None, base: int | None = None, notes: dict | None = None) -> Outcome:
    """Import acts (ENRICHED, with `path`) into the store in one commit. Its notes hold the counts, which are observed while outcomes are written, and what
    `notes` adds; notes under `streams` are kept from commit to commit.

    Without a valid act there is no commit, and the version stays. A run that fails leaves the store as it was.
    """
    base = versions.commit_of()["version"] if base is None else base
    if not base:
        versions.create(dim)
        base = versions.commit_of()["version"]
    tables, changed = versions.tables(base), {}
    counts = Observation("import")
    good = F.col("message").isNull()
    # what articles, vectors and texts were made of is not staged beside them
    whole = judged(acts, dim).withColumns({"embeddings": F.struct("embeddings.embedding_dim"), "__row": F.monotonically_increasing_id()}).drop("doc_segmented", "summaries")
    rows = staged(whole.observe(counts, F.count(F.when(good, 1)).alias("processed"), F.count(F.when(~good, 1)).alias("errors")), "acts")
    found = counts.get
    name = F.element_at(F.split("path", "/"), -1)
    outcomes = rows.select("path", "eli", F.when(good, "processed").otherwise("error").alias("status"), F.when(~good, F.concat_ws(": ", name, "message")).alias("message"))
    if not found["processed"] and not notes:
        return Outcome(base, 0, found["errors"], outcomes)
    # paths are ordered part by part
    turn = Window.partitionBy("eli").orderBy(F.split("path", "/"))
    later = staged(rows.where(good).select("eli", "path", "__row").withColumn("turn", F.row_number().over(turn)).where("turn > 1").select("__row", "turn"), "turns")
    last = later.agg(F.max("turn")).first()[0] or 1
    for k in range(1, last + 1) if found["processed"] else ():
        own = rows.where(good).join(later, "__row", "left_anti") if k == 1 else rows.join(later.where(F.col("turn") == k).select("__row"), "__row", "left_semi")
        changed = merged(tables, own.drop("__row"), now)
        tables = changed if k == last else {name: staged(df, name) for name, df in changed.items()}
    streams = versions.commit_of(base)["notes"].get("streams")
    kept = {"streams": streams} if streams else {}
    version = versions.commit(changed, base, dim, kept | {"processed": found["processed"], "errors": found["errors"]} | (notes or {}))
    return Outcome(version, found["processed"], found["errors"], outcomes)


def import_tree(spark: SparkSession, root: str, path: str, dim: int) -> Outcome:
    """Import all JSON files below path into the store below root."""
    return import_acts(spark, Versions(spark, root), sources.read_acts(spark, path, ENRICHED), dim)
