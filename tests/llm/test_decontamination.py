from __future__ import annotations

import random

from lexspark.llm import decontamination as d
from lexspark.llm import queries

from .helpers import documents, invented


def distance(pattern, text):
    """The least distance of the pattern to any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_is_the_tables():
    draw = random.Random(3)
    for _ in range(400):
        pattern = "".join(draw.choices("abcé ", k=draw.randrange(1, 90)))
        text = "".join(draw.choices("abcé ", k=draw.randrange(0, 120)))
        if draw.random() < 0.5:
            text = text[:20] + pattern[: draw.randrange(len(pattern) + 1)] + "x" + pattern[draw.randrange(len(pattern)) :] + text[20:]
        want = distance(pattern, text)
        found = d.Pattern(pattern).best(text, len(pattern))
        assert (found[0] if found else len(pattern)) == min(want, len(pattern))
        assert d.Pattern(pattern).best(text, want - 1) is None


def brute(docs, items, share):
    out = set()
    for i, t in docs:
        folded = d.fold(t or "")
        for k, b in items:
            own = d.fold(b or "")
            if own and folded:
                n = distance(own, folded)
                if n <= d.budget(len(own), share):
                    out.add((i, k, n))
    return out


def edited(text, draw, n):
    out = list(text)
    for _ in range(n):
        at = draw.randrange(len(out))
        out[at : at + draw.randrange(2)] = draw.choice(["", "z", "Q", "é"])
    return "".join(out)


def test_against_brute_force(spark):
    draw = random.Random(5)
    items = [(k, t) for k, t in enumerate(invented(12, 9, 40, 3000))] + [(20, None), (21, ""), (22, "Tiny"), (23, " \n"), (24, invented(12, 9, 40, 3000)[3])]
    texts = invented(40, 11, 60, 3000)
    for j in range(25):
        own = items[j % 12][1]
        texts[j] = texts[j] + "\n " + edited(own, draw, draw.randrange(0, 1 + int(0.09 * len(own)))).upper().replace(" ", " \t") + " " + texts[j]
    texts += ["", None, "tiny", "x" * 200_000]
    df, benchmark = documents(spark, texts, extra={"item_id": "i", "end": "e"}), spark.createDataFrame(items, "item_id long, text string")
    found = d.leaks(df, benchmark).collect()
    want = brute(enumerate(texts), items, 0.06)
    best = {}
    for r in found:
        best[r.doc_id, r.item_id] = min(r.distance, best.get((r.doc_id, r.item_id), 1 << 30))
    assert {(*k, n) for k, n in best.items()} == want and len(want) > 12
    folded = {i: d.fold(b or "") for i, b in items}
    for r in found:
        assert d.fold(texts[r.doc_id])[r.start : r.end] == r.passage and distance(folded[r.item_id], r.passage) == r.distance <= r.allowed
    kept = d.drop_leaks(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _, _ in want}
    for empty in (d.leaks(df.limit(0), benchmark), d.leaks(df, benchmark.limit(0)), d.drop_leaks(df.limit(0), benchmark)):
        assert empty.count() == 0
    assert d.drop_leaks(df, benchmark.limit(0)).count() == len(texts)


def test_parts_find_the_same(spark, sf_dir, monkeypatch):
    whole = {tuple(r) for r in queries.op1_pigeonhole_decontamination(spark, sf_dir).collect()}
    monkeypatch.setattr(d, "PART_BYTES", 3000)
    assert whole and {tuple(r) for r in queries.op1_pigeonhole_decontamination(spark, sf_dir).collect()} == whole


def test_every_place_is_reported_and_repeated_pieces_cost_their_length_once(spark):
    import time

    item = invented(1, 2, 60, 3000)[0] + " end of it"
    text = f"{item} {'filler ' * 200}{item}x {'filler ' * 200}"
    out = d.leaks(documents(spark, [text]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.start for r in out) == [0, text.rindex(item)] and {r.distance for r in out} == {0}
    matcher, times = d.Matcher([(1, "word " * 60 + "ends quite otherwise, with letters that stand nowhere else" * 3)], 0.06), []
    for n in (2_000, 20_000):
        began = time.perf_counter()
        assert matcher.match("word " * n) == []
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * max(times[0], 0.02), times


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "the"), (2, "42."), (3, "北京")], "item_id long, text string")
    texts = ["another bathe, then", "see The, end", "thethe the", "x42. 142.", "it is 42.", "在北京市", "the"]
    found = {(r.doc_id, r.item_id, r.start) for r in d.leaks(documents(spark, texts), items).collect()}
    assert found == {(1, 1, 4), (2, 1, 7), (4, 2, 6), (5, 3, 1), (6, 1, 0)}
    assert {r.doc_id for r in d.drop_leaks(documents(spark, texts), items).collect()} == {0, 3}


def test_shorter_pieces_allow_the_whole_share(spark):
    draw = random.Random(8)
    whole = d.fold(" ".join(invented(8, 21, 200, 3000)))
    items = [(k, d.fold(whole[200 * k : 200 * k + 104])) for k in range(8)]
    assert all(d.budget(len(t), 0.06) < int(0.06 * len(t)) == d.budget(len(t), 0.06, 6) for _, t in items)
    texts = [f"before {edited(t, draw, int(0.06 * len(t)))} after" for _, t in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.distance for r in d.leaks(documents(spark, texts), benchmark, piece=6).collect()}
    want = {(i, k): distance(t, d.fold(x)) for i, x in enumerate(texts) for k, t in items}
    assert out == {(i, k): n for (i, k), n in want.items() if n <= int(0.06 * len(items[k][1]))} and len(out) == 8
    assert len({r.doc_id for r in d.leaks(documents(spark, texts), benchmark).collect()}) < 8
