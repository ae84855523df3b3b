from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from lexspark.llm import quality, queries, toxicity

from .helpers import documents, invented


def remainder(i):
    return zlib.crc32(str(i).encode()) % 3


def results(spark, sf_dir, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = query(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (remainder(r.doc_id) == 1) and 0 <= r.score <= 1 for r in out)
    return [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    pairs = results(spark, "/root/testdata/sf0.01", queries.op7_quality_gam, "quality")
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    pairs = results(spark, "/root/testdata/sf0.1", queries.op8_toxicity_automata, "toxic")
    assert np.mean([a == b for a, b in pairs]) > 0.97
    assert np.mean([b for a, b in pairs if a]) > 0.85 and np.mean([b for a, b in pairs if not a]) < 0.01


AWKWARD = ["", None, " ", "é" * 50_000, "word " * 30_000, "a", "a", '"' * 9, "\n" * 50]


def test_awkward_rows_and_missing_labels(spark):
    df = documents(spark, AWKWARD, ids=[*range(len(AWKWARD) - 1), None], extra={"score": "s", "y": "1", "predicted": "p"})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, None, None), (1, 1, 1), (1, 0, 0), (None, 1, 1), (99, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for module, least in ((quality, 0.5), (toxicity, 0.7)):
            out = module.scored(df, module.train(df, labels)).collect()
            assert len(out) == len(AWKWARD)
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) and r.held_out is not None for r in out)
            assert module.scored(df.limit(0), module.train(df.limit(0), labels)).count() == 0
    assert quality.keep_good(df.limit(0), quality.train(df, none)).count() == 0
    kept = quality.keep_good(df, quality.train(df, none))
    assert kept.columns == df.columns and kept.count() == len(AWKWARD)


def test_model_learns_steps_and_pairs():
    draw = np.random.default_rng(3)
    x = draw.random((4000, 4))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.95)).astype(float)
    model = quality.fit(x[:3000], y[:3000], pairs=3)
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    bent = quality.fit(x[:3000], y[:3000], pairs=0)
    assert ((bent.score(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.8


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distances():
    entries = ["idiot", "moron", "scum", "stinker*", "chón*", "moronic"]
    automaton, draw = toxicity.build(entries), random.Random(4)
    words = ["idiot", "idi0t", "idot", "iditot", "idoit", "scam", "scums", "scum", "chónito", "chonito", "stinkerly", "stnkerly", "stinkre", "moronic", "MORON", "moroni"]
    for _ in range(3000):
        w = list(draw.choice(entries).removesuffix("*"))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(w) + 1)
            w[at : at + draw.randrange(2)] = draw.choice(["", "x", "i", "o", "é"])
        words.append("".join(w) + draw.choice(["", "", "s", "ly"]) or "q")
    points, offsets = toxicity.characters(pa.array(words))
    starts, ends, _ = toxicity.words_in(points, offsets)
    assert len(starts) == len(words)
    kinds, met = automaton.run(points, starts, ends)
    for w, kind, entry in zip(words, kinds, met, strict=True):
        want = {}
        for k, e in enumerate(entries):
            body, stem = e.removesuffix("*"), e.endswith("*")
            near = min(edits(w.lower()[:n], body) for n in range(len(w) + 1)) if stem else edits(w.lower(), body)
            if near == 0 or near == 1 and len(body) >= (6 if stem else 5):
                want[k] = near + 1
        assert kind == min(want.values(), default=0) and (not kind or want[int(entry)] == kind), (w, kind, entry, want)


def test_quotation_is_told_from_abuse(spark):
    clean = invented(400, 2, 80)
    bad = [t + " you idiot " + u for t, u in zip(invented(200, 5), invented(200, 6), strict=True)]
    df = documents(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert "idiot" in model.entries
    probe = ["he is an idiot", "they wrote “what an idiot” and left", "> what an idiot\nwe do not agree", "an idioot he is", "IDIOT!"]
    score = [r.score for r in toxicity.scored(documents(spark, probe), model).orderBy("doc_id").collect()]
    beside = ["😀😀idiot", "idiot。ok", "idiot！！", "idiot😀", "you idiot"]
    apart = [r.score for r in toxicity.scored(documents(spark, beside), model).collect()]
    assert min(apart) > 0.7
    again = documents(spark, [probe[0], probe[0], ""], ids=[1, 1, None])
    assert sorted(r.score for r in toxicity.scored(again, model).collect())[1:] == [score[0]] * 2
    assert score[0] > 0.7 and score[4] > 0.7 and max(score[1], score[2]) < 0.5 and score[3] > score[1]


def test_lexicon_holds_every_term_with_evidence(spark):
    words = [f"{j:03d}abcdefg" for j in range(500)]
    rows = [(i, i % 2, " ".join(words) if i % 2 else "plain text") for i in range(50)]
    assert {t for t, _ in toxicity.learn_words(spark.createDataFrame(rows, "i long, y int, x string"))} == set(words)


def test_query_scores_equal_a_plain_loop_over_the_tables(spark, sf_dir):
    import bisect
    import math

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op7_quality_gam(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        (row,) = quality.features(pa.array([text], pa.string())).tolist()
        total = model.base + sum(t[bisect.bisect_right(e.tolist(), x)] for e, t, x in zip(model.edges, model.tables, row, strict=True))
        places = [bisect.bisect_right(e.tolist(), x) for e, x in zip(model.coarse, row, strict=True)]
        total += sum(plane[places[a], places[b]] for (a, b), plane in zip(model.pairs, model.planes, strict=True))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9
