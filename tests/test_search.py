from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lexspark.operators import index, search
from lexspark.operators.deadline import within


def index_of(spark, rows):
    """rows: eli, title, summary, issue, date."""
    return spark.createDataFrame([(*r, "Zakon") for r in rows], "eli string, naslov string, short_summary string, izdanje string, datum string, vrsta string").withColumn("donositelj", F.lit(None).cast("string"))


ROWS = [("a", "Zakon o porezu na dohodak", "o svemu", "NN 10/1990", "1.1.1990."), ("b", "Pravilnik", "kratko o porezu", "NN 11/1990", "2.1.1990."), ("c", None, None, "NN 12/1990", None), ("d", "Žš", "xw Q y", "NN 13/1990", "3.1.1990.")]


def test_fuzzy_finds_misspelled_words_inside_fields(spark):
    found = search.fuzzy(index_of(spark, ROWS), "poerzu").orderBy(F.desc("score")).collect()
    assert {r["eli"] for r in found[:2]} == {"a", "b"} and all(0 <= r["score"] <= 1 for r in found)
    assert next(r["highlights"] for r in found if r["eli"] == "a") == ["porezu"]
    assert all(len(h) >= 2 for r in found for h in r["highlights"]) and all(1 <= len(r["highlights"]) <= 3 for r in found)


def test_direct_matches_and_issues_and_blank_queries(spark):
    own = index_of(spark, ROWS)
    direct = search.fallback(own, " q ").collect()  # one letter has no run of two, but stands in a summary
    assert [(r.eli, r.rank, r.score, r.bucket, r.highlights) for r in direct] == [("d", 1, 0.99, 0, [])]
    assert search.fallback(own, "10/1990").first()["eli"] == "a" and search.fallback(own, "nn  11/1990").first()["eli"] == "b"
    assert [r.eli for r in search.fallback(own, " \t").orderBy("rank").collect()] == ["d", "b", "a", "c"]
    assert [r.eli for r in search.fallback(own, "", izdanje="12/1990").collect()] == ["c"]
    assert search.fallback(own, "zakon", vrsta="Uredba").collect() == []
    assert search.normalized_query(" NN 7/2001 ") == "NN 7/2001" and search.normalized_query("NN 7/20011") == "NN 7/20011"


def test_results_keep_the_backends_order(spark):
    own = index_of(spark, ROWS)
    backend = lambda _: spark.createDataFrame([("b", 0.5), ("gone", 0.45), ("a", 0.4)], "eli string, score double").coalesce(1)
    found, offline = search.search_documents("zakon", own, backend, seconds=90)
    assert not offline and [(r.eli, r.match_score, r.match_type, r.highlights) for r in found.collect()] == [("b", 0.5, "hybrid", []), ("a", 0.4, "hybrid", [])]
    ranked = spark.createDataFrame([("a", 2), ("b", 1)], "eli string, rank int")
    assert [r.eli for r in search.enriched(ranked, own).collect()] == ["b", "a"]
    found, offline = search.search_documents("", own, backend)  # no backend takes a blank query
    assert offline and [r.eli for r in found.collect()] == ["d", "b", "a", "c"]


def slow(spark):
    """A job that takes far longer than any limit here."""
    return spark.range(0, 10**9, 1, 4).select(F.sum(F.sha2(F.col("id").cast("string"), 512).substr(1, 1).cast("int")).alias("eli")).withColumn("eli", F.col("eli").cast("string"))


def running(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_slow_backend_falls_back_in_time_and_leaves_no_job(spark):
    own = index_of(spark, ROWS)
    for call in (lambda: search.search_documents("zakon", own, lambda _: slow(spark), seconds=1.5)[0].collect(), lambda: search.suggestions("zakon", own, lambda _: slow(spark).withColumn("naslov", F.lit("x")), seconds=1.5).collect()):
        began = time.monotonic()
        assert [r.eli for r in call()][0] == "a"
        assert time.monotonic() - began < 30
        for _ in range(100):
            if not running(spark):
                break
            time.sleep(0.1)
        assert not running(spark)
    assert spark.range(5).count() == 5  # the session goes on


def test_a_call_that_goes_on_after_its_time_gets_no_more_jobs(spark):
    went = []

    def stubborn():
        time.sleep(1.5)
        try:
            slow(spark).collect()
        except Exception as error:
            went.append(error)

    with pytest.raises(TimeoutError):
        within(spark, 0.5, stubborn)
    for _ in range(150):
        if went:
            break
        time.sleep(0.1)
    assert went and not running(spark)
    assert within(spark, 60, lambda: spark.range(7).count()) == 7
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)


def test_suggestions(spark):
    own = index_of(spark, ROWS)
    assert [tuple(r) for r in search.suggestions("x", own, lambda q: spark.createDataFrame([("e", "t")], "eli string, naslov string")).collect()] == [("e", "t")]
    assert search.suggestions("porez", own).first()["eli"] == "a"


def test_the_index_is_ordered_as_strings_are_compared(spark):
    words = ["z", "ž", "s", "š", "c", "č", "cz", "ča", "Ž", "", None, "10.1.1990.", "9.1.1990.", "1.1.1990."]
    df = spark.createDataFrame([(w, f"e{i}") for i, w in enumerate(words)], "datum string, eli string")
    got = [r["datum"] for r in df.orderBy(*index.newest_first()).collect()]
    assert got == ["Ž", "ž", "z", "š", "s", "cz", "ča", "č", "c", "9.1.1990.", "10.1.1990.", "1.1.1990.", None, ""]  # equal dates by eli
    bytes_ = [r["datum"] for r in df.orderBy(*index.newest_first("UTF8_BINARY")).collect()]
    assert bytes_[:6] == ["ž", "Ž", "š", "ča", "č", "z"]


def test_old_indexes_are_removed(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", "t", f"{i}.1.1990.") for i in range(4)], "eli string, naslov string, datum string")
    first = index.write_index(index.search_index(rows), str(tmp_path))
    again = index.write_index(index.search_index(rows), str(tmp_path))
    assert first == again and index.load_index(spark, str(tmp_path)).count() == 4
    second = index.write_index(index.search_index(rows.limit(2)), str(tmp_path))
    assert second != first and index.load_index(spark, str(tmp_path)).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == sorted(["manifest", second.split("/")[-1]])
