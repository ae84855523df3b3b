from __future__ import annotations

import hashlib
import random

import numpy as np

from lexspark.llm import fingerprints, queries

from .helpers import WORD, documents, invented


def plain_shingles(text):
    words = ["\0"] * 4 + WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else set()


def likeness(a, b):
    x, y = plain_shingles(a), plain_shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for j, (i, text) in enumerate(order):
        text, after = text or "", order[(j + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after)))
    return out


def held(found, rows):
    want = {}
    for i, n, sha, e, x in brute(rows):
        want.setdefault((i, n, sha), []).append((e, x))
    assert len(found) == len(rows)
    off = []
    for r in found:
        e, x = want[r.doc_id, r.n_chars, r.edited_sha256].pop()
        off += [r.near_edited - e, r.near_next - x]
    assert np.abs(off).max() < 0.25 and np.sqrt(np.mean(np.square(off))) < 0.045


def test_against_brute_force(spark):
    texts = [*invented(150, 4, 120), "", None, "é", "äöü " * 9, "x" * 50_000, "same text here", "same text here", "word " * 20_000]
    ids = [*range(500, 500 + len(texts) - 4), 9, 9, -4, None]
    df = documents(spark, texts, ids, extra={"b": "1", "x": "2", "guest": "3"})
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for blocks in (1, 7, 40):
        held(fingerprints.with_next(df, blocks=blocks).collect(), rows)
    by = {}
    alone = documents(spark, texts)
    for r in fingerprints.fingerprint(alone).join(alone, "doc_id").collect():
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.with_next(df.limit(0)).count() == 0
    held(fingerprints.with_next(df.limit(1)).collect(), rows[:1])


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held(queries.op5_minhash_fingerprints(spark, sf_dir).collect(), rows)


def classes(rows, percent=80):
    """The least id that links of texts reach, by comparing all pairs."""
    up = list(range(len(rows)))

    def root(j):
        while up[j] != j:
            j = up[j]
        return j

    sets = [plain_shingles(t) for _, t in rows]
    for j in range(len(rows)):
        for q in range(j):
            common = len(sets[j] & sets[q])
            if rows[j][0] is not None and rows[q][0] is not None and common and 100 * common >= percent * (len(sets[j]) + len(sets[q]) - common):
                up[root(j)] = root(q)
    least = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            least[root(j)] = min(i, least.get(root(j), i))
    return [None if i is None else least[root(j)] for j, (i, _) in enumerate(rows)]


def near_families():
    """Families whose members are alike by 0.75 to 0.95, so that links and near misses lie side by side."""
    draw, texts = random.Random(6), []
    for f in range(40):
        base = [f"f{f}w{x}" for x in range(160)]
        for _ in range(5):
            own = list(base)
            for at in draw.sample(range(160), draw.randrange(0, 7)):
                own[at] = f"e{draw.random()}"
            texts.append(" ".join(own))
    return texts


def test_classes_are_those_of_all_pairs(spark):
    """Recall against brute force: every class of 200 texts about the threshold, and of awkward rows."""
    texts = [*near_families(), "", None, "a", "a", "A", *("w " * n for n in (3, 4, 90)), *(" ".join([*(f"v{i}" for i in range(200)), f"end{j}"]) for j in range(12))]
    ids = [*range(len(texts) - 3), 7, 7, None]
    df = documents(spark, texts, ids, extra={"t": "t", "c": "c", "class_id": "b"})
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(zip((i for i, _ in rows), classes(rows), strict=True), key=str)
    assert sorted(((r.doc_id, r.class_id) for r in fingerprints.similar(df).collect()), key=str) == want
    out = fingerprints.with_classes(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in out), key=str) == want
    held(out, rows)
    assert fingerprints.similar(df.limit(0)).count() == 0 and fingerprints.with_classes(df.limit(0)).count() == 0
