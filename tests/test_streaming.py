from __future__ import annotations

import json

import pytest

from lexspark.operators.versions import Versions
from lexspark.streaming import incremental

from .test_imports import ACT, DIM, plain_import, stored, written


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables here have a handful of rows, and an import runs many jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def acts(*keys, **more):
    return {f"{k}.json": json.dumps(ACT | {"eli": k} | more) for k in keys}


def run(spark, tmp_path, files=None):
    incremental.import_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check"), DIM, files=files).awaitTermination()


def test_files_are_imported_once_as_they_come(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    first = acts("a", "b") | {"bad.json": "{"}
    written(tmp_path / "in", first)
    run(spark, tmp_path)
    assert stored(versions.tables()) == plain_import(first)[:5]
    version = versions.commit_of()["version"]
    run(spark, tmp_path)
    assert versions.commit_of()["version"] == version
    second = {"c.json": json.dumps(ACT | {"eli": "a", "naslov": "new"})}
    written(tmp_path / "in", second)
    run(spark, tmp_path)
    assert stored(versions.tables())[0]["a"][0] == "new" and versions.commit_of()["notes"]["streams"] == {"acts": 1}


def test_a_batch_replayed_after_a_kill_changes_nothing(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path / "store"))
    written(tmp_path / "in", acts("a"))
    own = incremental.import_batch

    def killed_after_its_commit(*args):
        own(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(incremental, "import_batch", killed_after_its_commit)
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path)
    monkeypatch.undo()
    before, rows = versions.commit_of(), {n: sorted(map(str, df.collect())) for n, df in versions.tables().items()}
    assert before["notes"]["streams"] == {"acts": 0} and len(rows["documents"]) == 1
    run(spark, tmp_path)  # the same batch comes again
    assert versions.commit_of() == before and {n: sorted(map(str, df.collect())) for n, df in versions.tables().items()} == rows
    written(tmp_path / "in", acts("b"))
    run(spark, tmp_path)
    assert sorted(stored(versions.tables())[0]) == ["a", "b"]
