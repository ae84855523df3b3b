from __future__ import annotations

import os
import shutil

import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from lexspark.llm import decontamination, quality, queries

from .helpers import WORD, documents
from .test_neardup import brute as near_brute


def expected(rows, model, items):
    """The stages, one row after the other. rows: [(doc_id, text)]."""
    good = model.score(quality.features(pa.array([t for _, t in rows], pa.string()))) >= 0.5
    rows = [r for r, ok in zip(rows, good, strict=True) if ok]
    kept = {r[0] for r in near_brute(rows, 5, 80) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    first, out = {}, []
    for i, t in rows:
        words = WORD.findall(t or "")
        for p in range(len(words) - 49):
            key = tuple(words[p : p + 50])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for p in range(len(words) - 49):
            if first[tuple(words[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        text = " ".join(w for p, w in enumerate(words) if p not in gone) if gone else t
        if not gone or text:
            out.append((i, text))
    patterns = [(decontamination.Pattern(f), decontamination.budget(len(f), 0.06)) for f in map(decontamination.fold, items)]
    clean = [(i, t) for i, t in out if not any(p.best(decontamination.fold(t), most) for p, most in patterns)]
    library = Tokenizer.from_file(queries.word_bpe())
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}


def test_whole_pipeline_against_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = read("documents")
    model = quality.train(docs, read("labels"))
    want = expected([(r.doc_id, r.text) for r in docs.collect()], model, [r.text for r in read("benchmark").collect()])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_take_awkward_tables(spark, sf_dir, tmp_path):
    for name in ("labels", "benchmark"):
        path = f"{sf_dir}/{name}.parquet"
        (shutil.copytree if os.path.isdir(path) else shutil.copy)(path, tmp_path / f"{name}.parquet")
    df = documents(spark, ["", None, "one two three", "one two three", "x " * 9000], ids=[1, 2, 3, None, 5], extra={"__i": "a", "score": "b", "cut": "c"})
    for docs in (df, df.limit(0)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, str(tmp_path))
            assert sorted(out.columns) == sorted(df.columns), name
            assert out.count() <= docs.count()
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()
