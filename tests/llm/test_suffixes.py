from __future__ import annotations

from lexspark.llm import queries, suffixes

from .helpers import WORD, documents
from .test_neardup import thue_morse
from .test_substrings import planted


def windows(rows, window):
    """Window -> ids, and the windows of each document."""
    where = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - window + 1):
            where.setdefault(tuple(words[p : p + window]), set()).add(i)
    return where


def held(out, rows, window):
    texts, where = dict(rows), windows(rows, window)
    covered = {}
    for r in out:
        a, b = WORD.findall(texts[r.doc_id]), WORD.findall(texts[r.other_id])
        assert r.doc_id != r.other_id and r.n_words >= window and len(a) >= r.start + r.n_words
        assert " ".join(b[r.other_start : r.other_start + window]) in " ".join(a[r.start : r.start + r.n_words])
        assert r.match_words >= window and r.start <= r.match_start and r.match_start + r.match_words <= r.start + r.n_words
        assert a[r.match_start : r.match_start + r.match_words] == b[r.other_start : r.other_start + r.match_words]
        mine = covered.setdefault(r.doc_id, set())
        assert r.start not in mine and r.start - 1 not in mine  # passages are as long as they can be
        mine.update(p for p in range(r.start, r.start + r.n_words))
    for i, text in rows:
        words = WORD.findall(text or "")
        wanted = set()
        for p in range(len(words) - window + 1):
            if len(where[tuple(words[p : p + window])]) > 1:
                wanted.update(range(p, p + window))
        mine = covered.get(i, set())
        assert mine <= wanted, i
        # what a non-neighbour shares by chance beside a common passage is all that may be missing
        assert all(p - 3 in mine or p + 3 in mine or {p - 2, p + 2} & mine or {p - 1, p + 1} & mine for p in wanted - mine), i


def test_against_brute_force(spark):
    texts = [t for t in planted() if not (t or "").startswith("onnd")]
    df = documents(spark, texts, extra={"h": "h", "s": "s", "z": "z"})
    for window, limit in ((50, 4096), (50, 3), (12, 4096)):
        held(suffixes.repeated_passages(df, window=window, limit=limit).collect(), list(enumerate(texts)), window)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.op3_sparse_suffix_arrays(spark, sf_dir).collect()
    assert out and exact(out, rows, 50) == 1
    held(out, rows, 50)
    again = suffixes.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit=8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_words_that_simple_hashes_confuse(spark):
    a, b = thue_morse(11)
    texts = [" ".join([w, *(f"x{i}" for i in range(49))]) for w in (a, b)] + [" ".join([w] * 60) for w in (a, b)]
    assert suffixes.repeated_passages(documents(spark, texts)).count() == 0


def test_awkward_rows(spark):
    a = " ".join(f"a{i}" for i in range(90))
    rows = [(5, a), (5, a), (None, a), (6, ""), (7, None), (8, "x " * 20_000), (9, "q " + a), (10, "x " * 300)]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    out = {(r.doc_id, r.start, r.n_words, r.other_id, r.other_start) for r in suffixes.repeated_passages(df).collect()}
    assert {(5, 0, 90, 9, 1), (9, 1, 90, 5, 0)} == {r for r in out if r[0] < 10 and r[0] != 8} and {r[:3] for r in out if r[0] in (8, 10)} == {(8, 0, 20_000), (10, 0, 300)}
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def exact(out, rows, window):
    """The share of documents with repeats whose covered words are just those of all repeated windows."""
    where, wanted, covered = windows(rows, window), {}, {}
    for i, text in rows:
        words = WORD.findall(text)
        for p in range(len(words) - window + 1):
            if len(where[tuple(words[p : p + window])]) > 1:
                wanted.setdefault(i, set()).update(range(p, p + window))
    for r in out:
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert wanted and covered.keys() <= wanted.keys()
    return sum(covered.get(i) == w for i, w in wanted.items()) / len(wanted)


def hot(before, common, after, n):
    """n documents that share a run of words; pairs of them also share words before and after it."""
    texts = []
    for j in range(n):
        own = lambda side: " ".join(f"{side}{j}o{x}" for x in range(40))
        pair = lambda side, k: " ".join(f"{side}{j // 2}p{x}" for x in range(k))
        texts.append(" ".join([own("l"), pair("a", before), " ".join(f"c{x}" for x in range(common)), pair("z", after), own("r")]))
    return texts


def test_pairs_inside_a_common_passage(spark):
    texts = hot(15, 40, 0, 40) + [t.replace("c", "d") for t in hot(8, 45, 0, 40)]
    out = suffixes.repeated_passages(documents(spark, texts)).collect()
    assert exact(out, list(enumerate(texts)), 50) == 1
    held(out, list(enumerate(texts)), 50)


def test_pairs_inside_a_split_group(spark):
    texts = hot(0, 40, 15, 40) + [t.replace("c", "d") for t in hot(0, 45, 8, 40)]
    found = []
    for limit in (4096, 5):
        out = suffixes.repeated_passages(documents(spark, texts), limit=limit).collect()
        assert exact(out, list(enumerate(texts)), 50) == 1, limit
        found.append(sorted(map(tuple, out)))
    assert found[0] == found[1]


def test_a_passage_of_several_matches_names_one_of_them(spark):
    run = lambda name, n: " ".join(f"{name}{x}" for x in range(n))
    texts = [f"{run('q', 7)} {run('a', 60)} {run('b', 60)}", f"{run('r', 20)} {run('b', 60)}", f"{run('a', 60)} {run('s', 9)}"]
    out = {tuple(r) for r in suffixes.repeated_passages(documents(spark, texts)).collect()}
    assert out == {(0, 7, 120, 1, 20, 67, 60), (1, 20, 60, 0, 67, 20, 60), (2, 0, 60, 0, 7, 0, 60)}
