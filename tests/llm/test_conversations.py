from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from lexspark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BODY = re.compile("[^\x20\x09-\x0d]")


def plainly_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def every_repair(rows, faults):
    """All (cost, audit, repaired rows) that end in a legal conversation, with at most two turns put in at a place."""
    found = []

    def go(at, cost, audit, done, put):
        roles = "".join(r[:1] if r else "?" for r, _ in done)
        if not re.fullmatch("(s?(ua)*u?)?", roles) or found and cost > min(found)[0]:
            return  # no way to a legal conversation, or to a cheaper one
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, done))
        if put < 2:
            for role in ("user", "assistant"):
                go(at, cost + 2, audit + "I", [*done, (role, "")], put + 1)
        if at < len(rows):
            role, text = rows[at]
            go(at + 1, cost + 3, audit + "D", done, 0)
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                go(at + 1, cost + more, audit + "K", [*done, (role, text)], 0)
                for other in ("user", "assistant"):
                    go(at + 1, cost + 2 + more, audit + "R", [*done, (other, text)], 0)

    go(0, 0, "", [], 0)
    return min(found, key=lambda x: x[:2])


def plainly(rows):
    """conv_id -> result, from the definitions alone."""
    damaged, out = plainly_damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = BODY.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, done = every_repair([r[2:] for r in own], faults)
        body = "\n".join(f"{r}:{t}" for r, t in done)
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def random_rows(seed, conversations_, most, awkward=True):
    draw, out = random.Random(seed), []
    for conv in range(conversations_):
        for turn in range(draw.randrange(1, most + 1)):
            role = draw.choice(["user", "assistant", "assistant", "user", "system", *(["tool", "", None, "scribe"] if awkward else [])])
            text = draw.choice(["Yes.", "No.", "Why?", "open end", " \t\n", "ends. \n", "café!", *(["", None, " ", "x" * 40_000 + "."] if awkward else [])])
            out.append((conv, draw.choice([turn, turn, turn, turn + 3, None]) if awkward else turn, role, text))
    return out


def as_dict(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_short_conversations_equal_every_possible_repair(spark):
    rows = random_rows(1, 60, 4)
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    found = as_dict(conversations.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)))
    assert found == plainly(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("piece", [1, 2, 4])
def test_pieces_give_what_the_whole_gives(spark, piece):
    rows = random_rows(2, 12, 4) + [(50, t % 3, "user", "Same.") for t in range(4)]
    turns = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    assert as_dict(conversations.repair(turns, piece)) == plainly(rows)


def test_long_conversations_equal_the_recursion_in_one_database(spark, tmp_path):
    rows = random_rows(3, 3, 90) + [(7, t, "assistant" if t % 2 else "user", f"Turn {t}.") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "c.parquet")
    df.write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        want = {r[0]: tuple(r[1:]) for r in db.execute(conversations.sql()).fetchall()}
    assert as_dict(conversations.damaged_and_repaired(df)) == want
    assert as_dict(conversations.repair(conversations.damage(df), 16)) == want


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_and_repaired(empty).collect() == []
    rows = random_rows(4, 5, 3)
    more = spark.createDataFrame([(*r, "z", 1, "b") for r in rows], SCHEMA + ", unit string, n int, audit string")
    assert as_dict(conversations.damaged_and_repaired(more)) == plainly(rows)


def test_the_table_in_whole(spark, sf_dir):
    from lexspark.llm.queries import op12_conversation_repair

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
        want = {r[0]: tuple(r[1:]) for r in db.execute(conversations.sql()).fetchall()}
    assert as_dict(op12_conversation_repair(spark, sf_dir)) == want
