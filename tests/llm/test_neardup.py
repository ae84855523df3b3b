from __future__ import annotations

import random

import numpy as np

from lexspark.llm import neardup, queries
from lexspark.llm.components import components

from .helpers import WORD, documents, invented, rows_of


def sets(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    each = [(i, sets(t, k)) for i, t in rows]
    by = {}
    for j, (i, s) in enumerate(each):
        for x in s:
            by.setdefault(x, []).append(j)
    up = list(range(len(each)))

    def root(j):
        while up[j] != j:
            j = up[j]
        return j

    for j, (i, s) in enumerate(each):
        if i is None:
            continue
        for q in {q for x in s for q in by[x] if q < j}:
            if each[q][0] is not None:
                common = len(s & each[q][1])
                if 100 * common >= percent * (len(s) + len(each[q][1]) - common):
                    up[root(j)] = root(q)
    least = {}
    for j, (i, _) in enumerate(each):
        least[root(j)] = min(least.get(root(j), i), i) if i is not None else None
    return sorted(((i, len(s), least[root(j)], i is None or i == least[root(j)]) for j, (i, s) in enumerate(each)), key=str)


def edited(text, draw, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def planted(seed=5):
    draw = random.Random(seed)
    base = invented(40, seed, 200, 3000)
    texts = list(base)
    for t in base:
        if len(t.split()) > 40:
            texts += [edited(t, draw, draw.randrange(0, 6)) for _ in range(4)]
    chain = " ".join(f"c{i}" for i in range(300)).split()
    texts += [" ".join(chain[15 * i : 15 * i + 200]) for i in range(6)]
    return [*texts, "A b", "a B", "a", "", None, " \n", "x" * 100_000, "word " * 30_000]


def test_against_brute_force(spark):
    texts = planted()
    df = documents(spark, texts, ids=[*range(1000, 1000 + len(texts) - 8), 3, 2, 1, 0, 7, 8, 9, None], extra={"k": "k", "c": "c", "n": "1"})
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for words, percent in ((3, 85), (5, 80)):
        assert rows_of(neardup.near_duplicates(df, words=words, percent=percent)) == brute(rows, words, percent)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op4_chosen_path_near_dedup(spark, sf_dir)) == brute(rows, 3, 85)


def test_large_nodes_branch_and_end_in_blocks(spark):
    texts = planted(8)
    rows = list(enumerate(texts))
    assert rows_of(neardup.near_duplicates(documents(spark, texts), words=3, percent=85, start=0, limit=4, depth=1)) == brute(rows, 3, 85)


def test_large_nodes_lose_no_links(spark):
    """Pairs of similarity 0.802 among texts that share most of their words with all others."""
    texts = []
    for j in range(80):
        own = [f"t{x}" for x in range(78)] + [f"o{j}x{x}" for x in range(22)]
        texts += [" ".join(own), " ".join([*own[:89], *(f"e{j}x{x}" for x in range(11))])]
    out = rows_of(neardup.near_duplicates(documents(spark, texts), words=1, percent=80, limit=4))
    assert out == brute(list(enumerate(texts)), 1, 80)


def test_repeated_rows_and_empty_tables(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(5, t), (5, t), (5, "quite another text stands under this same id"), (3, t.upper())]
    df = documents(spark, [x for _, x in rows], ids=[i for i, _ in rows])
    assert rows_of(neardup.near_duplicates(df)) == brute(rows, 5, 80)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(df).collect()) == [(3, t.upper()), (5, rows[2][1])]


def test_further_trees_find_what_one_misses():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 16, (2000, 256)).astype(np.uint16)
    b = np.where(draw.random((2000, 256)) < 0.8, a, draw.integers(0, 1 << 16, (2000, 256)).astype(np.uint16))
    met = np.zeros(2000, bool)
    rates = []
    for tree in range(6):
        x, y = (neardup.token_hashes(s) for s in (a, b))
        nodes = []
        for t in (x, y):
            at = np.full((2000, 1), tree + 1, np.uint64)
            for level in range(3):
                at = np.concatenate([neardup.choose(t, at[:, c], 2 if level < 2 else 1) for c in range(at.shape[1])], axis=1)
            nodes.append(at)
        own = (nodes[0][:, :, None] == nodes[1][:, None, :]).any(axis=(1, 2))
        rates.append(own.mean())
        met |= own
    assert min(rates) > 0.7 and met.mean() > 0.998


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 300)] + [(draw.randrange(400, 600), draw.randrange(400, 600)) for _ in range(150)]
    out = {r.v: r.m for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert out == {v: m for v, m in up.items() if v in touched}


def thue_morse(n):
    """Two different words of 2**n letters that polynomials modulo 2**64 can't tell apart from n = 11 on."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_links_are_confirmed_on_words(spark):
    a, b = thue_morse(11)
    texts = [" ".join([a, "one", "two", *(f"x{j}" for j in range(9))]), " ".join([b, "one", "two", *(f"x{j}" for j in range(9))]), a, b]
    for words, percent in ((3, 95), (5, 80)):
        assert rows_of(neardup.near_duplicates(documents(spark, texts), words=words, percent=percent)) == brute(list(enumerate(texts)), words, percent)


def test_exact_sets():
    import pyarrow as pa

    from lexspark.llm.common import Words
    from lexspark.llm.minhash import Sets

    texts = [*invented(20, 4), "A b  c\td\n", "", None, "x", "x y", "a b c d", "long" + "x" * 300 + " z"]
    for k in (1, 2, 3, 5):
        found, wanted = Sets(Words(pa.array(texts), lower=True), k), [sets(t, k) for t in texts]
        one, two = np.divmod(np.arange(len(texts) ** 2), len(texts))
        assert found.size.tolist() == [len(s) for s in wanted]
        assert found.common(one, two).tolist() == [len(wanted[i] & wanted[j]) for i, j in zip(one, two, strict=True)]


def test_the_query_misses_no_link_on_a_larger_table(spark):
    """All pairs that share a shingle, by counting, over a table on which node sizes differ."""
    import re
    from collections import Counter, defaultdict

    from lexspark.llm.queries import op4_chosen_path_near_dedup

    sf_dir = "/root/testdata/sf0.01"
    sets = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    common = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            least[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op4_chosen_path_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    assert sum(not kept for _, _, kept in got.values()) > 20
