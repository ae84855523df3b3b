from __future__ import annotations

import os

import duckdb

from lexspark.llm import licenses, queries

from .helpers import documents, rows_of

MIT = licenses.KNOWN[9][1]
TEXTS = [
    MIT, "Copyright (c) 2020 A. Nother\n" + MIT.upper().replace(",", " ,\n"), MIT + " and more", "x\nReleased  under the *MIT* Licence!\ny",
    "LICENSED UNDER THE APACHE LICENCE, V. 2.0", "released under the mit license.\r\nReleased under the MIT License.", "", None, " \n ", "a" * 200_000,
    "line\n" * 20_000, "© 2021 somebody\nReleased under the MIT License.", "copyrighted words\nReleased under the MIT License.",
]


def test_spellings_notices_and_awkward_rows(spark):
    df = documents(spark, TEXTS, extra={"digest": "d", "license": "l", "text_digest": "t"})
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(out) == len(TEXTS)
    assert [out[i].text_license for i in (0, 1, 2, 3, 4)] == ["MIT", "MIT", None, None, "Apache-2.0"]
    assert out[3].line_licenses == "MIT" and out[5].line_licenses == "MIT" and out[5].n_notices == 2 and out[6].line_licenses == ""
    assert out[11].text_license == "MIT" and out[12].text_license is None and out[12].line_licenses == "MIT"
    assert out[6].text_digest == out[7].text_digest == out[8].text_digest
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, texts=()).where("n_notices > 0 or text_license is not null").count() == 0


def test_sql_agrees(spark, sf_dir):
    with duckdb.connect() as c:
        path = f"{sf_dir}/documents.parquet"
        c.sql(f"create view documents as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view documents as select * from '{path}'")
        want = c.sql(queries.oracle_sql()["op9_license_digests"]).fetchall()
        assert sorted(want, key=str) == rows_of(queries.op9_license_digests(spark, sf_dir).select("doc_id", "text_digest", "text_license", "line_licenses", "n_notices"))
        c.sql("create table odd as select * from (values " + ", ".join(f"({i}, ?)" for i in range(len(TEXTS))) + ") t(doc_id, text)", params=TEXTS)
        want = c.sql(licenses.sql(table="odd")).fetchall()
        assert sorted(want, key=str) == rows_of(licenses.scan(documents(spark, TEXTS)).select("doc_id", "text_digest", "text_license", "line_licenses", "n_notices"))


def test_plan_is_native(spark, sf_dir):
    plan = queries.op9_license_digests(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
