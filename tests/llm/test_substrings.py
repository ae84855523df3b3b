from __future__ import annotations

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexspark.llm import queries, substrings

from .helpers import WORD, documents, invented
from .test_neardup import thue_morse


def brute(rows, window):
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    """The columns of the contract; longest is held against the words of the texts by test_longest."""
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def planted(seed=3):
    draw = random.Random(seed)
    texts = invented(60, seed, 160)
    passage = " ".join(f"p{i}" for i in range(70))
    for k in draw.sample(range(60), 20):
        words = texts[k].split()
        at = draw.randrange(len(words) + 1)
        texts[k] = "\n".join([" ".join(words[:at]), passage, " ".join(words[at:])])
    return [*texts, texts[3], texts[3] + " tail", "", None, "onnd " * 3000, "onnd " * 400, "é x " * 60, " \t\n "]


def test_against_brute_force(spark):
    texts = planted()
    for window in (50, 7):
        df = documents(spark, texts, extra={"cut": "c", "i": "1", "t": "2"})
        assert rows_of(substrings.remove_repeats(df, window=window)) == brute(list(enumerate(texts)), window)


def test_repeated_rows_and_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, a), (5, b), (7, a), (None, a), (9, b + " " + a)]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    assert rows_of(substrings.remove_repeats(df)) == brute(rows, 50)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(queries.op10_substring_dedup(spark, sf_dir)) == brute([(r.doc_id, r.text) for r in df.collect()], 50)


def test_stripped_documents_keep_their_columns(spark):
    a = " ".join(f"a{i}" for i in range(80))
    df = documents(spark, [a, "x  y\n" + a, a, None, "q"], extra={"cut": "c", "__note": "n"})
    out = {r.doc_id: r for r in substrings.strip_repeats(df, length="n_chars").collect()}
    assert sorted(out) == [0, 1, 3, 4] and out[1].text == "x y" and out[1].n_chars == 3 and out[0].text == a
    assert out[1].cut == "c" and list(out[1].asDict()) == df.columns and out[3].text is None


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("ab"), min_size=8, max_size=120), st.integers(2, 8))
def test_equal_windows_pick_alike(letters, window):
    import numpy as np

    words = np.array([ord(x) for x in letters], np.uint64)
    each, places, _ = substrings.picks(words, window)
    seen = {}
    for p in range(len(letters) - window + 1):
        assert seen.setdefault(tuple(letters[p : p + window]), each[p] - p) == each[p] - p
    assert set(places) == set(each) and len(set(places)) == len(places)


def test_longest(spark):
    """Never more than the longest stretch that stands in a smaller document too; all of it in a copy."""
    texts = planted(4) + [" ".join(f"z{i}" for i in range(a, b)) for a, b in ((0, 900), (300, 700), (350, 1200), (880, 940), (100, 1190))]
    texts += [" ".join(f"y{i}" for i in range(777))] * 2
    last = len(texts) - 1
    words = [WORD.findall(t or "") for t in texts]
    for r in substrings.remove_repeats(documents(spark, texts)).collect():
        own, true = words[r.doc_id], 0
        for other in words[: r.doc_id]:
            if set(own) & set(other):
                before = [0] * (len(other) + 1)
                for w in own:
                    row = [0] * (len(other) + 1)
                    for q, v in enumerate(other):
                        if v == w:
                            row[q + 1] = before[q] + 1
                    true, before = max(true, max(row)), row
        true = true if true >= 50 else 0
        assert (r.longest > 0) == (true > 0) == (r.n_removed > 0) and r.longest <= true, (r, true)
        assert r.longest >= true / 8 - 75 and (r.doc_id != last or r.longest == true == len(own)), (r, true)


def test_windows_are_compared_by_their_words(spark):
    a, b = thue_morse(11)
    texts = [" ".join([w, *(f"x{i}" for i in range(58))]) for w in (a, b)] + [" ".join([w] * 60) for w in (a, b)]
    assert rows_of(substrings.remove_repeats(documents(spark, texts))) == brute(list(enumerate(texts)), 50)
