from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexspark.config import Config
from lexspark.operators import index, store
from lexspark.operators.versions import Versions
from lexspark.plans import pipeline
from lexspark.sources import acts
from lexspark.streaming.incremental import enrich_stream

PAGE = "<div><p>Ovaj zakon odnosi se na sve.</p><p>I. OPĆE ODREDBE</p><p>Član 1.</p><p>(1) Stranka je dužna platiti u roku od 8 dana.</p><p>Član 2.</p><p>Novčana kazna.</p></div>"


def write(folder, **acts_):
    for name, act in acts_.items():
        path = folder / "1990" / "3" / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(act if isinstance(act, str) else json.dumps(act))


def test_raw_acts_to_vectors(spark, tmp_path):
    eli = "/eli/sluzbeni/1990/3/{}"
    write(tmp_path, a={"eli": eli.format(1), "naslov": "Zakon o lovu", "doc": PAGE}, b={"eli": eli.format(2), "naslov": "Bez teksta"}, c="{broken", d={"naslov": "bez oznake"})
    raw = acts.located(acts.read_acts(spark, str(tmp_path)))
    assert [r.eli for r in acts.read_acts(spark, str(tmp_path)).where("_corrupt_record is not null").select("eli", "path").collect()] == [None]
    assert [(r.year, r.issue, r.document) for r in raw.orderBy("eli").collect()] == [("1990", "3", "1"), ("1990", "3", "2")]
    documents, vectors = pipeline.run(raw)
    (r,) = documents.collect()
    assert r.opis == "Ovaj zakon odnosi se na sve." and [a["članak"] for a in r.doc_segmented[0]["članci"]] == ["Član 1.", "Član 2."]
    assert r.key_information.deadlines == ["u roku od 8 dana"] and r.key_information.scope == ["Ovaj zakon odnosi se na sve."]
    assert r.key_information.subjects == ["lovu", "OPĆE ODREDBE"] and r.key_information.sanctions == ["Novčana kazna."]
    assert set(r.summaries.structured) == {"sto_zakon_ureduje", "na_koga_se_odnosi", "sto_uvodi_ili_mijenja"}
    kinds = sorted(v.embedding_type for v in vectors.collect())
    assert kinds.count("segment") == 2 and "title" in kinds and "summary_structured_na_koga_se_odnosi" in kinds
    done = pipeline.store_acts(spark, str(tmp_path / "store"), documents, vectors)
    tables = {n: df.collect() for n, df in Versions(spark, str(tmp_path / "store")).tables().items()}
    assert (done.processed, done.errors) == (1, 0) and [d["eli"] for d in tables["documents"]] == [eli.format(1)]
    assert [(s["clanak_label"], s["segment_order"]) for s in sorted(tables["document_segments"], key=lambda s: s["segment_order"])] == [("Član 1.", 0), ("Član 2.", 1)]
    assert sorted(v["embedding_type"] for v in tables["document_embeddings"]) == kinds and all(len(v["embedding"]) == 64 for v in tables["document_embeddings"])
    assert {v["segment_id"] for v in tables["document_embeddings"] if v["embedding_type"] == "segment"} == {s["id"] for s in tables["document_segments"]}
    assert tables["document_key_information"][0]["deadlines"] == ["u roku od 8 dana"]
    assert {s["summary_type"] for s in tables["document_summaries"]} >= {"short", "detailed"}


def test_sinks_streams_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(f"/eli/sluzbeni/1990/{k % 3}/{k}", f"t{k}", f"{k}.1.1990.") for k in range(12)], "eli string, naslov string, datum string")
    acts.write_acts(rows, str(tmp_path / "acts"))
    assert acts.act(spark, str(tmp_path / "acts"), "/eli/sluzbeni/1990/2/5").first().naslov == "t5"
    written = index.search_index(rows)
    index.write_index(written, str(tmp_path / "index"))
    loaded = index.load_index(spark, str(tmp_path / "index"))
    assert sorted(map(str, loaded.collect())) == sorted(map(str, written.collect())) and index.manifest(loaded).first() == index.manifest(written.repartition(3)).first()
    for version in (1, 2):
        store.write_version(rows.limit(version), str(tmp_path / "table"), version)
    assert store.read_current(spark, str(tmp_path / "table")).count() == 2
    for k in range(2):
        rows.limit(4).write.mode("append").parquet(str(tmp_path / "in"))
        enrich_stream(spark, str(tmp_path / "in"), "eli string, naslov string, datum string", lambda df: df.selectExpr("eli", "upper(naslov) as naslov"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4 * (k + 1)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# comment\nmax_tokens: 128\nencoder: 'own'  # name\n")
    assert Config.read(str(path)) == Config(max_tokens=128, encoder="own")


def test_site_maps(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc> https://h/sitemap_1.xml </loc></sitemap></sitemapindex>')
    (tmp_path / "b.xml").write_text("<n:urlset xmlns:n='x'><n:url><n:loc>https://h/clanci/sluzbeni/1.html</n:loc></n:url><n:url><n:loc>https://h/x.pdf</n:loc></n:url></n:urlset>")
    found = acts.wanted(acts.site_map(spark, str(tmp_path)), "https://h/sitemap_", "https://h/clanci/sluzbeni/")
    assert sorted((r.kind, r["loc"]) for r in found.collect()) == [("index", "https://h/sitemap_1.xml"), ("page", "https://h/clanci/sluzbeni/1.html")]
    cdata = '<urlset><url><loc><![CDATA[https://h/a?b=1&c=2.html]]></loc></url><url><loc>https://h/x?y=1&amp;z=2</loc></url></urlset>'
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.xml").write_text(cdata)
    assert sorted(r["loc"] for r in acts.site_map(spark, str(tmp_path / "c")).collect()) == ["https://h/a?b=1&c=2.html", "https://h/x?y=1&z=2"]


def test_import_semantics(spark):
    import datetime

    held = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  each version is written before the next one
    one, two = (F.lit(datetime.datetime(2020, 1, d)).cast("timestamp_ntz") for d in (1, 2))
    docs = held(store.upsert_documents(store.empty(spark, "documents"), spark.createDataFrame([("a", "A"), ("b", "B")], "eli string, naslov string"), one))
    docs = held(store.upsert_documents(docs, spark.createDataFrame([("b", "B2"), ("c", "C")], "eli string, naslov string"), two))
    rows = {r.eli: (r.id, r.naslov, r.created_at.day, r.updated_at.day) for r in docs.collect()}
    assert rows == {"a": (1, "A", 1, 1), "b": (2, "B2", 1, 2), "c": (3, "C", 2, 2)}
    kind = "document_id long, segment_order int, clanak_label string, text string"
    segments = held(store.upsert_segments(store.empty(spark, "document_segments"), spark.createDataFrame([(1, 0, "x", "old")], kind)))
    segments = held(store.upsert_segments(segments, spark.createDataFrame([(1, 0, "y", "new"), (1, 1, "z", "more")], kind)))
    assert sorted((r.segment_order, r.clanak_label, r.text) for r in segments.collect()) == [(0, "y", "old"), (1, "z", "more")]
    kind = "document_id long, summary_type string, text string, model_name string"
    found = held(store.upsert_summaries(store.empty(spark, "document_summaries"), spark.createDataFrame([(1, "short", "s", "m"), (2, "short", "", "m")], kind)))
    found = held(store.upsert_summaries(found, spark.createDataFrame([(1, "short", "", "n")], kind)))
    found = held(store.upsert_summary(found, 1, "short", "t"))
    assert [(r.document_id, r.text, r.model_name) for r in found.collect()] == [(1, "t", "m")]
    assert store.upsert_summary(found, 1, "short", "u", "k").first().model_name == "k"
    info = held(store.upsert_key_information(store.empty(spark, "document_key_information"), spark.createDataFrame([(1, ["o"])], "document_id long, obligations array<string>")))
    info = store.upsert_key_fields(info, 1, scope=["s"]).first()
    assert (info.obligations, info.scope, info.deadlines) == (["o"], ["s"], [])
    kind = "document_id long, segment_id long, embedding_type string, model_name string, embedding_dim int, embedding array<float>"
    vectors = held(store.upsert_embeddings(store.empty(spark, "document_embeddings"), spark.createDataFrame([(1, None, "title", "m", 1, [1.0]), (1, None, "short", "m", 0, [])], kind)))
    vectors = held(store.upsert_embeddings(vectors, spark.createDataFrame([(1, None, "title", "m", 1, [2.0])], kind)))
    assert [(r.id, r.embedding) for r in vectors.collect()] == [(1, [2.0])]


def test_one_file_an_act(spark, tmp_path):
    path = tmp_path / "out"
    rows = [("/eli/sluzbeni/1990/3/7", "x"), ("/eli/sluzbeni/1990/3/8", "y")]
    acts.write_act_files(spark.createDataFrame([*rows, ("/eli/sluzbeni/1991/1/1", "old")], "eli string, naslov string"), str(path))
    acts.write_act_files(spark.createDataFrame(rows, "eli string, naslov string"), str(path))
    found = sorted(str(p.relative_to(path).parent) for p in path.rglob("*.json"))
    assert found == ["year=1990/issue=3/document=7", "year=1990/issue=3/document=8"]
