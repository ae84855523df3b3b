"""Encoders, configuration, address cache, look-ups, pooled vectors, scored summaries and the search with a fallback."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark import encoders
from lexspark.config import Config
from lexspark.functions import vectors as V
from lexspark.operators import ann, embed, evaluate, search, summarize
from lexspark.plans import pipeline
from lexspark.sources import acts


def test_nested_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(
        "models:\n  summarizers:\n    - name: org/one\n      description: first\n    - name: org/two\n  embeddings:\n    - name: e/one\n      embedding_dim: 384\n"
        "selected_model:\n  summarizer: org/two\n  embedding:\n    name: e/one\n    embedding_dim: 384 # note\n\ntimeout: 5\n"
    )
    assert Config.read(str(path)) == Config(timeout=5, summarizer="org/two", encoder="e/one", embedding_dim=384, encoders=("e/one",), summarizers=("org/one", "org/two"))
    path.write_text("selected_model:\n  other: x\n")
    with pytest.raises(KeyError):
        Config.read(str(path))


def test_encoders():
    encoders.register("test", lambda texts: np.ones((len(texts), 2)))
    assert encoders.encoder("test")(["a"]).tolist() == [[1, 1]]
    assert encoders.warm_up(Config(encoders=("test", "absent"))) == ["absent"]
    with pytest.raises(ValueError):
        encoders.encoder("absent")


def test_cached_addresses(spark, tmp_path):
    calls = []

    def collect():
        calls.append(1)
        return spark.createDataFrame([("a",), ("b",)], "loc string")

    for _ in range(2):
        assert sorted(r.loc for r in acts.cached_addresses(spark, str(tmp_path / "urls"), collect).collect()) == ["a", "b"]
    assert calls == [1]


def test_by_eli_and_preview(spark):
    df = spark.createDataFrame([("eli/a b",), ("eli/a+b",)], "eli string")
    assert [r.eli for r in search.by_eli(df, "eli%2Fa%20b").collect()] == ["eli/a b"]
    assert [r.eli for r in search.by_eli(df, "eli/a+b").collect()] == ["eli/a+b"]
    info = spark.createDataFrame([(1, list("abcd"), list("xyz")), (2, None, [])], "document_id long, subjects array<string>, deadlines array<string>")
    found = {r.document_id: r.key_info_preview.asDict() for r in search.preview(info).collect()}
    assert found == {1: {"subjects": ["a", "b", "c"], "deadlines": ["x", "y"]}, 2: {"subjects": [], "deadlines": []}}


def test_masked_mean(spark):
    rows = [([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([[4.0, 2.0], [5.0, 5.0]], [1])]
    df = spark.createDataFrame(rows, "v array<array<double>>, m array<int>")
    assert [r.x for r in df.select(V.masked_mean(F.col("v"), F.col("m")).alias("x")).collect()] == [[2.0, 4.0], [0.0, 0.0], [4.0, 2.0]]


def test_vectors_with_segments(spark):
    vectors = spark.createDataFrame([(1, 5, [1.0]), (2, 5, [2.0]), (1, None, [3.0])], "document_id long, segment_id long, embedding array<double>")
    segments = spark.createDataFrame([(5, 1, 0, "Član 1.", "x")], "id long, document_id long, segment_order int, clanak_label string, text string")
    found = {(r.document_id, r.segment_id): r.segment_text for r in embed.with_segments(vectors, segments).collect()}
    assert found == {(1, 5): "x", (2, 5): None, (1, None): None}
    assert embed.without_vector(vectors).columns == ["document_id", "segment_id"]


def test_ranked_sentences(spark):
    texts = ["Porez je obavezan. Nebo je plavo. Porez je porez.", "Jedna.", "", None]
    rows = summarize.ranked(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", 2).orderBy("k").collect()
    plain = V.encoded([texts[0], "Porez je obavezan.", "Nebo je plavo.", "Porez je porez."])
    scores = plain[1:] @ plain[0]
    assert [x.idx for x in rows[0].ranked] == np.argsort(-scores, kind="stable").tolist()
    assert [x.score for x in rows[0].ranked] == pytest.approx(sorted(scores, reverse=True))
    assert [r.summary for r in rows[1:]] == ["Jedna.", "", ""] and rows[2].ranked == [] and rows[3].ranked == []


def test_search_falls_back(spark):
    index = spark.createDataFrame([("a", "Zakon o porezu", "x"), ("b", "Pravilnik", "x")], "eli string, naslov string, vrsta string").selectExpr("*", "'' as izdanje", "naslov as short_summary", "'' as donositelj", "'' as datum")
    request = search.Request("porez")

    def works(_):
        return spark.createDataFrame([("b", 0.5), ("gone", 0.4)], "eli string, score double")

    def fails(_):
        return spark.range(1).select(F.raise_error(F.lit("down")).alias("eli"))

    assert [(r.eli, r.naslov) for r in search.dispatched(request, works, index)[0].collect()] == [("b", "Pravilnik")]
    for backend in (fails, None):
        found, offline = search.dispatched(request, backend, index)
        assert offline and found.first()["eli"] == "a"


class Letters:
    """Letters as tokens, with vectors that depend on the letter, and no counting of its own."""

    dimension = 3

    def tokens(self, text):
        return [ord(c) % 7 for c in text], [(i, i + 1) for i in range(len(text))]

    def vectors(self, ids, mask):
        return np.stack([ids, ids**2, np.ones_like(ids)], axis=2) * 1.0


def test_token_encoders_cut_pad_and_pool():
    texts = ["", None, "a", "abc", "x" * 40 + "y" * 1000, "Riječ riječi " * 400]
    for known, most in ((Letters(), 40), (encoders.HashedWords(16), 512)):
        encoders.register("tokens", known)
        whole = encoders.encoder("tokens", most, 4)(texts)
        assert whole.shape == (6, known.dimension) and (whole[:2] == 0).all()
        for batch in (1, 2, 100):
            assert np.allclose(encoders.encoder("tokens", most, batch)(texts), whole)
        cut = [encoders.truncated(t or "", known, most) for t in texts]
        assert len(cut[4]) == (40 if most == 40 else 1040) and np.allclose(encoders.encoder("tokens", 10**6)(cut), whole)
        for text, row in zip(texts, whole, strict=True):
            ids = np.array(known.tokens(text or "")[0][:most], np.int64)[None, :]
            mean = known.vectors(ids, np.ones(ids.shape))[0].mean(axis=0) if ids.size else np.zeros(known.dimension)
            assert np.allclose(row, mean / (np.linalg.norm(mean) or 1))


def test_default_encoder_counts_words_as_before():
    texts = ["Porez je porez.", "", "Šuma 12 šuma_b", "a " * 600]
    assert np.allclose(encoders.encoder(encoders.DEFAULT)(texts), V.encoded(texts))
    assert not np.allclose(encoders.encoder(encoders.DEFAULT)(["a " * 512 + "b"]), V.encoded(["a " * 512 + "b"]))


def test_configured_encoders_make_summaries_and_vectors(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return np.arange(len(texts))[:, None] * np.ones((1, 2)) + 1

    encoders.register("counting", counting)
    df = spark.createDataFrame([("e", "T", "Jedan. Dva. Tri. Četiri. Pet.", "", "x")], "eli string, naslov string, doc_cleaned string, opis string, doc string")
    none = "array<struct<`glava`: string, `članci`: array<struct<`članak`: string, stavci: array<struct<stavak: string, `točke`: array<string>>>>>>>"
    df = df.withColumn("doc_segmented", F.lit(None).cast(none))
    pipeline.summarized(df, Config(summarizer="counting")).collect()
    assert calls.value > 0
    with pytest.raises(ValueError, match="dimensions"):
        pipeline.embedded(df.withColumn("summaries", F.struct(F.lit("s").alias("short"), F.lit("d").alias("detailed"), F.lit(None).cast("map<string,string>").alias("structured"))), config=Config(embedding_dim=384))


def test_hyperplane_buckets_find_nine_of_ten(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    more = spark.createDataFrame([(10**6 + i, [1.0] * 64) for i in range(40)] + [(2 * 10**6, None), (2 * 10**6 + 1, [1.0]), (2 * 10**6 + 2, [0.0] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    rows, planes = rows.unionByName(more), ann.Planes(64)
    asked = rows.where("vec_id % 20 = 0 and vec_id < 1000001")
    found, exact = ann.nearest_in(ann.hyperplane_index(rows, planes), asked, planes), ann.exact_nearest(rows.where("size(embedding) = 64"), asked)
    got = ann.recall(found, exact).collect()
    assert sum(r["found"] for r in got) >= 0.9 * sum(r["wanted"] for r in got) and len(got) == 26
    copies = [r for r in found.collect() if r["query_id"] == 10**6]
    assert [(r["id"], r["score"]) for r in sorted(copies, key=lambda r: r["rank"])] == [(10**6 + i, 1.0) for i in range(1, 11)]
    with pytest.raises(ValueError):
        ann.Planes(64, bits=4, probes=5)


def test_pairs_are_encoded_one_by_one(spark):
    rows = [("Porez na dohodak", "dohodak i porez", 1), ("Porez", "Šuma je zelena", 0), ("", "x", 0), (None, None, 1)]
    df = spark.createDataFrame(rows, "a string, b string, label int").withColumn("s", evaluate.pair_similarity(F.col("a"), F.col("b"), encoders.encoder(encoders.DEFAULT)))
    want = [float(V.encoded([a or ""])[0] @ V.encoded([b or ""])[0]) for a, b, _ in rows]
    assert [r.s for r in df.collect()] == pytest.approx(want)
    assert evaluate.separation(df, F.col("s"), F.col("label")).first()["mean_similar"] == pytest.approx((want[0] + want[3]) / 2, abs=1e-6)


def test_exact_neighbours_by_products_of_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 2.0, 0.0]), (202, [0.0] * 4), (203, [1.0, 2.0]), (204, [float("nan")] * 4), (205, [1e30, -1e30, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0 or vec_id > 200")
    a, b = asked.where("vec_id is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df.where("vec_id is not null").select(F.col("vec_id").alias("id"), "embedding")
    pairs = a.join(b, F.col("id") != F.col("query_id")).select("query_id", "id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 7").select("query_id", "rank", "id", "score")
    found = ann.exact_nearest(df, asked, 7, block=4, rows=9)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert ann.exact_nearest(df.limit(0), asked, 7).count() == 0 == ann.exact_nearest(df, asked.limit(0), 7).count()


def test_hyperplane_buckets_in_parts(spark, sf_dir):
    rows, planes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), ann.Planes(64)
    asked, index = rows.where("vec_id % 50 = 0"), ann.hyperplane_index(rows, planes)
    met = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(ann.buckets(F.col("embedding"), planes, True)).alias("bucket")).join(index, "bucket")
    each = met.select("query_id", F.round(V.cosine(F.col("q"), F.col("vector")), 6).alias("score"), F.explode("ids").alias("id")).where("id <> query_id").distinct()
    want = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 10").select("query_id", "rank", "id", "score")
    for parts in (1, 3):
        assert sorted(map(str, ann.nearest_in(index, asked, planes, parts=parts).collect())) == sorted(map(str, want.collect()))
    assert "Join" not in ann.nearest_in(index, asked, planes)._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_with_a_memory_of_limited_size():
    known = encoders.HashedWords(8)
    known._most = 3
    texts = ["Porez je porez İstanbul ΟΔΟΣ straße_x", "", "a b c d e f a b", "x" * 50 + " " + "x" * 50]
    for most in (512, 3):
        want = []
        for text in texts:
            ids = np.array(known.tokens(text)[0][:most], np.int64)[None, :]
            want.append(known.vectors(ids, np.ones(ids.shape))[0].mean(axis=0) if ids.size else np.zeros(8))
        assert np.allclose(known.counted(texts, most), want) and len(known._bins) <= 3 and max(map(len, known._bins)) <= 40


def test_picks_are_the_same_whether_or_not_products_are_shared():
    rng, seen = np.random.default_rng(1), {}
    vectors, query = rng.normal(size=(30, 8)), rng.normal(size=8)
    for k, weight in ((3, 0.75), (8, 0.65), (2, 0.8), (2, 0.45)):
        assert summarize.chosen(vectors, query, k, weight, seen=seen) == summarize.chosen(vectors, query, k, weight)


def test_texts_of_a_batch_are_encoded_together(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(1)
        return V.encoded(texts)

    rows = [(i, f"Porez {i}. Dohodak je {'porez ' * i}." if i % 7 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embed.embed(df, ["id"], "text", 10, counting).collect()}
    assert calls.value == 1
    for i, text in rows:
        total = V.encoded(embed._packed([s for s in text.split(". ") if s], 10) or [text]).sum(axis=0)
        assert np.allclose(got[i], total / (np.linalg.norm(total) or 1))
