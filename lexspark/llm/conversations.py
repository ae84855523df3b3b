"""Repair of conversation structure: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

The edits of a row are Keep (0), Rerole to user or assistant (2) and Delete (3); an empty user or assistant turn can be
Inserted anywhere (2). Blank and duplicate rows must go, and a truncated row that stays costs 1. What a grammar state
needs next decides the role that an R or an I gives, so the initials of the edits say all.

Conversations are dealt to partitions by a hash of their id, and each batch of whole conversations is handed to one
recursive DuckDB query: every recursion advances all conversations of the batch by one row and keeps, for each state of
the grammar, the least (cost, audit). Prefixes of equal cost in one state are never prefixes of each other, so the
least audit of a whole is made of least audits.

A conversation of more than PIECE rows is not one unit: equal rows are counted first, the rest is sorted by range over many
tasks and cut into pieces of PIECE rows, each piece runs the same recursion from all four states, and pieces are put together
two by two, in as many rounds as the logarithm of their number. Only the hash of the repaired text, which is one running sum by definition, reads
such a conversation in one task, row by row as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, unstage

SPACES = " \t\n\x0b\x0c\r"
#: The most rows of a conversation, or of a piece of one, that are one unit of a batch: a power of two.
PIECE = 512
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 2, 3, 2, 1
#: state -> initial of a role that may follow -> next state. "" is the start; "" and "a" may end.
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}
STATES = list(GRAMMAR)
LEGAL = ("su", "ua", "au")


def _given(state: str) -> tuple[str, str] | None:
    """The role initial that R and I give in a state, and the state after it."""
    return next(((i, to) for i, to in GRAMMAR[state].items() if i in NAMES), None)


def _inserted(state: str) -> Iterator[tuple[str, int, str]]:
    """(edits, cost, state) of no, one and two turns put in; three never pay."""
    edits = ""
    for _ in range(3):
        yield edits, INSERT * len(edits), state
        edits, state = edits + "I", _given(state)[1]


def moves() -> list[tuple[int, str | None, str, int, int]]:
    """(state, initial or None for any, edits, cost, next state) of one row, with the turns put in before it."""
    out = []
    for state in STATES:
        out.append((state, None, "D", DELETE, state))
        for edits, cost, at in _inserted(state):
            out += [(state, i, edits + "K", cost + KEEP, to) for i, to in GRAMMAR[at].items()]
            out.append((state, None, edits + "R", cost + REROLE, _given(at)[1]))
    return [(STATES.index(a), i, e, c, STATES.index(b)) for a, i, e, c, b in out]


def endings() -> list[tuple[int, str, int]]:
    """(state, edits, cost): the least turns put in after the last row."""
    return [(STATES.index(s), *next((e, c) for e, c, at in _inserted(s) if at in ("", "a"))) for s in STATES]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: `turns` holds the rows of a batch: unit, pos (from 1), n equal rows, role, text, seen, open (truncated), blank, and `starts` (unit, rows, entry).
FAULTS = """
SELECT unit, pos, n, left(role, 1) AS initial, blank, NOT blank AND (seen OR row_number() OVER (PARTITION BY unit, role, text ORDER BY pos) > 1) AS again,
  open AND NOT blank AS cut FROM turns
"""
CHEAPEST = f"""
WITH RECURSIVE moves(state, initial, edits, cost, next) AS (VALUES {_values(moves())}),
faults AS MATERIALIZED (SELECT unit, pos, n, initial, blank OR again AS forced, (cut AND NOT again)::BIGINT AS cut FROM ({FAULTS})),
best AS (
  SELECT unit, entry, 0::BIGINT AS pos, entry AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS w FROM starts
  UNION ALL
  SELECT b.unit, b.entry, b.pos + 1, m.next, min({{'cost': b.w.cost + m.cost + {DELETE} * (f.n - 1) + CASE WHEN m.edits = 'D' THEN 0 ELSE {OPEN} * f.cut END,
    'audit': b.w.audit || m.edits || repeat('D', f.n - 1)}})
  FROM best b JOIN faults f ON f.unit = b.unit AND f.pos = b.pos + 1
  JOIN moves m ON m.state = b.state AND (m.initial IS NULL OR m.initial = f.initial) AND (m.edits = 'D' OR NOT f.forced)
  GROUP BY ALL
)
SELECT b.unit, b.entry, b.state, b.w.cost AS cost, b.w.audit AS audit FROM best b JOIN starts s ON s.unit = b.unit AND s.entry = b.entry AND s.rows = b.pos
"""
COUNTS = f"""
SELECT unit, sum(n * blank::BIGINT)::BIGINT AS blank, sum(CASE WHEN blank THEN 0 WHEN again THEN n ELSE n - 1 END)::BIGINT AS duplicate, sum((cut AND NOT again)::BIGINT)::BIGINT AS truncated,
  sum((n - 1) * (initial || initial NOT IN {LEGAL})::BIGINT + coalesce((before || initial NOT IN {LEGAL})::BIGINT, 0))::BIGINT AS illegal,
  arg_min(initial, pos) AS head, arg_max(initial, pos) AS tail
FROM (SELECT *, lag(initial) OVER (PARTITION BY unit ORDER BY pos) AS before FROM ({FAULTS})) GROUP BY unit
"""


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): the rows, damaged by crc32 of ``conv:turn`` modulo 20.

    n is how often a row stands: 0 where it is dropped, 2 where it is repeated. Null ids and turns count as one
    space in the crc and stay null; null roles and texts become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20).cast("int")
    body = F.when(kind == 1, "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space(role)).alias("role"), body.alias("text"), n.cast("long").alias("n"))


class Repaired:
    """The running SHA-256 of ``role:text`` of what stays, newline between, while rows and their edits go by."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.sum, self.first = audit, 0, "", hashlib.sha256(), True

    def _put(self, line: str) -> None:
        self.sum.update(("" if self.first else "\n").encode() + line.encode())
        self.first = False

    def _inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            initial, self.state = _given(self.state)
            self._put(NAMES[initial] + ":")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        self._inserts()
        edit = self.edits[self.at]
        if edit == "K":
            self.state = GRAMMAR[self.state][role[:1]]
            self._put(f"{role}:{text}")
        elif edit == "R":
            initial, self.state = _given(self.state)
            self._put(f"{NAMES[initial]}:{text}")
        self.at += n

    def hexdigest(self) -> str:
        self._inserts()
        return self.sum.hexdigest()


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by their first column, in tables that hold all rows of each value of it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        cut = pc.index(keys, keys[-1]).as_py()
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(0)[-1] != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _batch_db(table: pa.Table, entries: list[int] | None):
    """A DuckDB connection that holds the rows of a batch as `turns` and `starts`. entries: the states to start from."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    db.register("given", table)
    db.execute("CREATE TABLE turns AS SELECT dense_rank() OVER (ORDER BY unit) AS unit, row_number() OVER (PARTITION BY unit ORDER BY turn NULLS FIRST, role, text) AS pos, unit AS name, turn, role, text, n, seen, rtrim(text, $s) = '' AS blank, right(rtrim(text, $s), 1) NOT IN ('.', '!', '?') AS open FROM given WHERE n > 0", {"s": SPACES})
    states = "range(1)" if entries is None else f"(VALUES {_values([(e,) for e in entries])})"
    db.execute(f"CREATE TABLE starts AS SELECT unit, rows, entry::INTEGER AS entry FROM (SELECT unit, count(*) AS rows FROM turns GROUP BY unit), {states} AS e(entry)")
    return db


def _repair_short(kind: str):
    """An iterator function for mapInArrow: the result row of each conversation whose rows, sorted by unit, go by."""
    schema = ("unit", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def run(batches):
        for table in whole_units(batches):
            with _batch_db(table, None) as db:
                db.execute(f"CREATE TABLE ends(state, edits, cost) AS VALUES {_values(endings())}")
                db.execute(f"CREATE TABLE done AS SELECT unit, min({{'cost': c.cost + e.cost, 'audit': c.audit || e.edits}}) AS w FROM ({CHEAPEST}) c JOIN ends e USING (state) GROUP BY unit")
                found = db.execute(f"""
                    SELECT t.name AS unit, coalesce(t.hi - t.lo + 1 - t.turns, 0) AS gaps, c.blank, c.duplicate, c.truncated, c.illegal, d.w.cost AS cost, d.w.audit AS audit
                    FROM (SELECT unit, any_value(name) AS name, max(turn) AS hi, min(turn) AS lo, count(DISTINCT turn) AS turns FROM turns GROUP BY unit) t JOIN ({COUNTS}) c USING (unit) JOIN done d USING (unit)""").fetchall()
                rows = db.execute("SELECT name, role, text, n FROM turns ORDER BY unit, pos").fetchall()
            sums = {r[0]: Repaired(r[-1]) for r in found}
            for name, role, text, n in rows:
                sums[name].row(role, text, n)
            own = {r[0]: (*r[1:], sums[r[0]].hexdigest()) for r in found}
            names, firsts = table.column(0).to_pylist(), []
            for i, name in enumerate(names):
                if not i or name != names[i - 1]:
                    firsts.append(i)
            lines = [own.get(names[i], (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())) for i in firsts]
            columns = [pa.array([names[i] for i in firsts], pa.string()), table.column("conv_id").take(pa.array(firsts)).combine_chunks()]
            columns += [pa.array([x[j] for x in lines], pa.int64() if j < 6 else pa.string()) for j in range(8)]
            yield pa.RecordBatch.from_arrays(columns, names=list(schema))

    return run, f"unit string, conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair_pieces(batches):
    """For mapInArrow: least cost and audit of each piece for every two states, with its counts; unit is ``key:piece``."""
    for table in whole_units(batches):
        with _batch_db(table, list(range(len(STATES)))) as db:
            out = db.sql(f"SELECT t.name AS unit, b.entry::INTEGER AS entry, b.state::INTEGER AS state, b.cost, b.audit, c.blank, c.duplicate, c.truncated, c.illegal, c.head, c.tail FROM ({CHEAPEST}) b JOIN (SELECT DISTINCT unit, name FROM turns) t USING (unit) JOIN ({COUNTS}) c USING (unit)").to_arrow_table()
        yield from out.to_batches()


def _stream(batches):
    """For mapInArrow over rows sorted by unit and order, an audit row first: the hash of each repaired conversation."""
    unit, own = None, None
    for batch in batches:
        out = []
        for name, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("unit", "audit", "role", "text", "n")), strict=True):
            if name != unit:
                if own is not None:
                    out.append((unit, own.hexdigest()))
                unit, own = name, Repaired(audit)
            else:
                own.row(role, text, n)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["unit", "repaired_sha256"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([own.hexdigest()])], names=["unit", "repaired_sha256"])


def _unit(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces put together two by two until each conversation is one. Every round is staged."""
    while pieces.agg(F.max("piece")).first()[0]:
        half = F.floor(F.col("piece") / 2).alias("half")
        left = pieces.where("piece % 2 = 0").select("unit", half, "entry", F.col("state").alias("mid"), *[F.col(c).alias("l_" + c) for c in ("cost", "audit", "blank", "duplicate", "truncated", "illegal", "head", "tail")])
        right = pieces.where("piece % 2 = 1").select("unit", half, F.col("entry").alias("mid"), "state", *[F.col(c).alias("r_" + c) for c in ("cost", "audit", "blank", "duplicate", "truncated", "illegal", "head", "tail")])
        both = left.join(right, ["unit", "half", "mid"], "left")
        add = lambda c: (F.col("l_" + c) + F.coalesce(F.col("r_" + c), F.lit(0))).alias(c)
        seam = F.when(F.concat("l_tail", "r_head").isin(*LEGAL) | F.col("r_head").isNull(), 0).otherwise(1)
        w = F.struct(add("cost"), F.concat("l_audit", F.coalesce("r_audit", F.lit(""))).alias("audit"))
        rows = both.select("unit", "half", "entry", F.coalesce("state", "mid").alias("state"), w.alias("w"), add("blank"), add("duplicate"), add("truncated"), (F.col("l_illegal") + F.coalesce("r_illegal", F.lit(0)) + seam).alias("illegal"), F.col("l_head").alias("head"), F.coalesce("r_tail", "l_tail").alias("tail"))
        least = rows.groupBy("unit", "half", "entry", "state").agg(F.min("w").alias("w"), *[F.first(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "head", "tail")])
        before = pieces
        pieces = stage(least.select("unit", F.col("half").alias("piece"), "entry", "state", "w.*", "blank", "duplicate", "truncated", "illegal", "head", "tail"), "pieces")
        unstage(before)
    return pieces


def _repair_long(rows: DataFrame, piece: int) -> DataFrame:
    """The result rows of conversations that are cut into pieces of so many rows. rows: unit, conv_id, turn, role, text, n."""
    ids = rows.groupBy("unit").agg(F.min("conv_id").alias("conv_id"))
    each = stage(rows.where("n > 0").groupBy("unit", "turn", "role", "text").agg(F.sum("n").alias("n")), "turns")
    hashed = each.withColumn("h", F.sha2(F.concat_ws("\x00", F.lit("x"), F.octet_length("role").cast("string"), "role", "text"), 256))
    firsts = stage(hashed.groupBy("unit", "h").agg(F.count("*").alias("c"), F.min(F.struct(F.col("turn"))).alias("least")).where("c > 1").drop("c"), "firsts")
    # a struct of a null is less than any other, as nulls go first
    marked = hashed.join(firsts, ["unit", "h"], "left").withColumn("seen", F.col("least").isNotNull() & (F.struct("turn") > F.col("least"))).drop("h", "least")
    order = ["unit", F.col("turn").asc_nulls_first(), "role", "text"]
    cut = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stage(cut.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), piece.bit_length() - 1)), "cut")
    small_batches(rows.sparkSession)
    named = cut.select(F.concat_ws(":", "unit", F.col("piece").cast("string")).alias("unit"), "turn", "role", "text", "n", "seen")
    dealt = named.repartition("unit").sortWithinPartitions("unit")
    states = dealt.mapInArrow(_repair_pieces, "unit string, entry int, state int, cost long, audit string, blank long, duplicate long, truncated long, illegal long, head string, tail string")
    states = states.withColumns({"piece": F.substring_index("unit", ":", -1).cast("long"), "unit": F.expr("left(unit, length(unit) - 1 - length(substring_index(unit, ':', -1)))")})
    # some rows a piece: a conversation's share is its rows by PIECE / 16
    whole = stage(states.withColumn("piece", F.dense_rank().over(Window.partitionBy("unit").orderBy("piece")).cast("long") - 1), "pieces")
    whole = _joined(whole).where("entry = 0")
    ends = F.create_map(*[F.lit(x) for s, e, c in endings() for x in (s, e)]), F.create_map(*[F.lit(x) for s, e, c in endings() for x in (s, c)])
    w = F.struct((F.col("cost") + ends[1][F.col("state")]).alias("cost"), F.concat("audit", ends[0][F.col("state")]).alias("audit"))
    done = stage(whole.groupBy("unit").agg(F.min(w).alias("w"), *[F.first(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]).select("unit", "w.*", "blank", "duplicate", "truncated", "illegal"), "done")
    none = lambda kind: F.lit(None).cast(kind)
    lines = done.select("unit", F.lit(0).alias("body"), "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("n"))
    lines = lines.unionByName(cut.select("unit", F.lit(1).alias("body"), none("string").alias("audit"), "turn", "role", "text", "n"))
    lines = lines.repartition("unit").sortWithinPartitions("unit", "body", F.col("turn").asc_nulls_first(), "role", "text")
    sums = lines.mapInArrow(_stream, "unit string, repaired_sha256 string")
    turns = cut.select("unit", "turn").distinct().groupBy("unit").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    zero = lambda *names: [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names]
    out = ids.join(turns, "unit", "left").join(done, "unit", "left").join(sums, "unit", "left")
    return out.select("conv_id", *zero("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text, n; see damage): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, then by role and text in byte order, so equal rows stand together; n is how often
    a row stands, and 0 keeps the conversation without the row. A null conv_id is a conversation of its own. Conversations without a row get
    zeros, an empty audit and the hash of nothing; an empty table gives no rows. Texts are never cut; further columns are not read.
    """
    spark = turns.sparkSession
    rows = turns.select(_unit(F.col("conv_id")).alias("unit"), "conv_id", "turn", "role", "text", "n")
    long = stage(rows.groupBy("unit").agg(F.count("*").alias("c")).where(F.col("c") > piece).select("unit"), "long")
    some = not long.isEmpty()
    short = rows.join(long, "unit", "left_anti") if some else rows
    small_batches(spark)
    columns = ["unit", "conv_id", F.col("turn"), "role", F.when(F.col("n") > 0, F.col("text")).alias("text"), "n", F.lit(False).alias("seen")]
    run, schema = _repair_short(turns.schema["conv_id"].dataType.simpleString())
    out = short.select(*columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema).drop("unit")
    return out.unionByName(_repair_long(rows.join(long, "unit", "left_semi"), piece)) if some else out


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The contract of operator 12: each conversation of the table, damaged and repaired."""
    return repair(damage(conversations))


def sql(table: str = "conversations") -> str:
    """The same in DuckDB over a whole table: the crc by bits, and one recursion over all conversations that carries the repaired text along."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    # state: 0 start, 1 system, 2 user, 3 assistant; what is due there is the assistant in 2 and the user elsewhere
    due = "(CASE WHEN {s} = 2 THEN 'assistant' ELSE 'user' END)"
    after = "(CASE WHEN {s} = 2 THEN 3 ELSE 2 END)"
    put = lambda s: f"chr(10) || {due.format(s=s)} || ':'"
    second = after.format(s="b.state")
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM {table}),
kinds AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM keyed),
kept AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open, left(role, 1) AS initial FROM kept),
faults AS MATERIALIZED (SELECT *, blank OR again AS forced, (open AND NOT blank AND NOT again)::BIGINT AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed)),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::BIGINT)::BIGINT AS blank, sum((again AND NOT blank)::BIGINT)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
  sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT)::BIGINT AS illegal FROM faults GROUP BY conv_id),
best AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}} AS w FROM counts
  UNION ALL
  SELECT conv_id, pos, state, min(w) FROM (
    SELECT b.conv_id, b.pos + 1 AS pos, CASE e.edit WHEN 'D' THEN b.state WHEN 'R' THEN CASE WHEN b.at = 2 THEN 3 ELSE 2 END ELSE CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      {{'cost': b.w.cost + CASE e.edit WHEN 'D' THEN 3 ELSE 2 * b.i + f.cut + CASE e.edit WHEN 'R' THEN 2 ELSE 0 END END,
        'audit': b.w.audit || repeat('I', b.i) || e.edit,
        'body': b.w.body || b.more || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || {due.format(s="b.at")} || ':' || f.text END}} AS w
    FROM (SELECT b.*, i.i, CASE i.i WHEN 0 THEN b.state WHEN 1 THEN {second} ELSE {after.format(s=second)} END AS at,
        CASE i.i WHEN 0 THEN '' WHEN 1 THEN {put("b.state")} ELSE {put("b.state")} || {put(second)} END AS more FROM best b, range(3) AS i(i)) b
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1
    JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit) ON CASE e.edit WHEN 'D' THEN b.i = 0 WHEN 'R' THEN NOT f.forced
      ELSE NOT f.forced AND CASE b.at WHEN 0 THEN f.initial IN ('s', 'u') WHEN 2 THEN f.initial = 'a' ELSE f.initial = 'u' END END) GROUP BY ALL
),
ended AS (SELECT b.conv_id, min({{'cost': b.w.cost + CASE b.state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': b.w.audit || CASE b.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'body': b.w.body || CASE b.state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS w
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.pos GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(e.w.cost, 0) AS cost, coalesce(e.w.audit, '') AS audit, sha256(coalesce(substr(e.w.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
