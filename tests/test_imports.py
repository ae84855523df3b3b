"""The import of acts against a plain one, file by file; commits that fail, collide or repeat."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import imports, store
from lexspark.operators.versions import Conflict, Versions, Violation, dimension
from lexspark.sources import acts as sources

DIM = 3


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables here have a handful of rows, and an import runs many jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_import(files):
    """The five tables by natural keys, and the messages, after files (path -> text) are imported one at a time."""
    docs, segments, summaries, info, vectors, messages = {}, {}, {}, {}, {}, {}
    for path in sorted(files, key=lambda p: p.split("/")):
        try:
            act = json.loads(files[path])
        except ValueError:
            messages[path] = "unreadable"
            continue
        eli, e = act.get("eli"), act.get("embeddings") or {}
        own = [("document", None, e.get("document_embedding")), ("title", None, e.get("title_embedding"))]
        own += [(imports.VECTORS.get(k, f"summary_{k}"), None, v) for k, v in (e.get("summary_embeddings") or {}).items()]
        own += [("segment", s["text"], s.get("embedding")) for s in e.get("segment_embeddings") or [] if s.get("text")]
        own = [v for v in own if v[2]]
        why = "Missing 'eli' field" if not eli else "dio is longer than 64 characters" if len(act.get("dio") or "") > 64 else f"a vector is not of {DIM} dimensions" if any(len(v[2]) != DIM for v in own) else None
        if why:
            messages[path] = why
            continue
        docs[eli] = (act.get("naslov") or "", act.get("datum"), act.get("opis"))
        model = e.get("model_name") or ""
        if model:
            gone = {k for k in segments if k[0] == eli}
            vectors = {k: v for k, v in vectors.items() if not (k[0] == eli and k[1] is not None)}
            segments = {k: v for k, v in segments.items() if k not in gone}
        order, by_hash = 0, {}
        for chapter in act.get("doc_segmented") or []:
            for article in chapter.get("članci") or []:
                text = " ".join(t for s in article.get("stavci") or [] for t in s.get("točke") or []).strip()
                if text:
                    old = segments.get((eli, order))
                    segments[eli, order] = (article.get("članak") or "", old[1] if old else text)
                    by_hash[hashlib.sha256(text.encode()).hexdigest()[:12]] = order
                    order += 1
        s = act.get("summaries") or {}
        for kind, text in [("short", s.get("short")), ("detailed", s.get("detailed")), *((f"structured_{k}", t) for k, t in (s.get("structured") or {}).items())]:
            if text:
                summaries[eli, kind] = (text, model)
        if any(v is not None for v in (act.get("key_information") or {}).values()):
            info[eli] = tuple(tuple(act["key_information"].get(c) or ()) for c in imports.LISTS)
        for kind, text, vector in own:
            at = None if text is None else by_hash.get(hashlib.sha256(text.encode()).hexdigest()[:12])
            if text is None or at is not None:
                key = (eli, at, kind, model)
                vectors[key] = (vectors[key][0] if key in vectors else e.get("embedding_dim") or 384, tuple(vector))
    return docs, segments, summaries, info, vectors, messages


def stored(tables):
    eli = {r["id"]: r["eli"] for r in tables["documents"].collect()}
    order = {r["id"]: r["segment_order"] for r in tables["document_segments"].collect()}
    return (
        {r["eli"]: (r["naslov"], r["datum"], r["opis"]) for r in tables["documents"].collect()},
        {(eli[r["document_id"]], r["segment_order"]): (r["clanak_label"], r["text"]) for r in tables["document_segments"].collect()},
        {(eli[r["document_id"]], r["summary_type"]): (r["text"], r["model_name"]) for r in tables["document_summaries"].collect()},
        {eli[r["document_id"]]: tuple(tuple(r[c]) for c in imports.LISTS) for r in tables["document_key_information"].collect()},
        {(eli[r["document_id"]], order.get(r["segment_id"]), r["embedding_type"], r["model_name"]): (r["embedding_dim"], tuple(r["embedding"])) for r in tables["document_embeddings"].collect()},
    )


def invented_act(draw, k):
    word = lambda: draw.choice(["lov", "šuma", "porez", "voda", ""])
    vector = lambda: draw.choice([[float(draw.randrange(9)) for _ in range(DIM)]] * 4 + [[], None])
    articles = [{"članak": f"Član {j}.", "stavci": [{"stavak": None, "točke": [word() for _ in range(draw.randrange(3))]}]} for j in range(draw.randrange(4))]
    act = {"eli": f"/eli/sluzbeni/1990/1/{k}", "naslov": word(), "datum": draw.choice(["13.2.1990.", "x", None]), "opis": word(), "doc_segmented": [{"glava": "I. A", "članci": articles}]}
    if draw.random() < 0.8:
        act["summaries"] = {"short": word(), "detailed": word(), "structured": {"sto_zakon_ureduje": word()}}
    if draw.random() < 0.7:
        act["key_information"] = {c: [word()] for c in imports.LISTS if draw.random() < 0.6}
    if draw.random() < 0.8:
        act["embeddings"] = {"model_name": draw.choice(["m1", "m2", ""]), "embedding_dim": DIM, "document_embedding": vector(), "title_embedding": vector(), "summary_embeddings": {"short": vector(), "structured_što_zakon_uređuje": vector(), "other": vector()}}
        act["embeddings"]["segment_embeddings"] = [{"text": " ".join(a["stavci"][0]["točke"]).strip(), "embedding": vector()} for a in articles] + [{"text": "no such text", "embedding": vector()}]
    fault = draw.randrange(12)
    if fault == 0:
        act.pop("eli")
    elif fault == 1:
        act["dio"] = "x" * 65
    elif fault == 2:
        act.setdefault("embeddings", {})["title_embedding"] = [1.0]
    return act


def written(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.mark.parametrize("seed", [1, 2])
def test_import_equals_a_plain_one(spark, tmp_path, seed):
    draw = random.Random(seed)
    rounds, root = [], str(tmp_path / "store")
    for r in range(2):
        files = {f"{draw.choice('ab')}/{k}-{j}.json": json.dumps(invented_act(draw, k)) for k in range(8) for j in range(draw.choice([1, 1, 2]))}
        files["z/broken.json"] = "{no"
        rounds.append(files)
        found = imports.import_tree(spark, root, written(tmp_path / f"in{r}", files), DIM)
        # rounds follow each other, so do their files
        want = plain_import({f"{q}/{p}": t for q, fs in enumerate(rounds) for p, t in fs.items()})
        assert stored(Versions(spark, root).tables()) == want[:5]
        messages = {p.split("/", 1)[1]: m for p, m in want[5].items() if p.startswith(f"{r}/")}
        got = {"/".join(o["path"].split("/")[-2:]): o["message"] for o in found.outcomes.collect() if o["status"] == "error"}
        assert got == {p: f"{p.split('/')[-1]}: {m}" for p, m in messages.items()}
        assert (found.processed, found.errors) == (len(files) - len(messages), len(messages))
        assert Versions(spark, root).commit_of()["notes"] == {"processed": found.processed, "errors": found.errors}


def acts_of(spark, tmp_path, name, *acts):
    return sources.read_acts(spark, written(tmp_path / name, {f"{k}.json": json.dumps(a) for k, a in enumerate(acts)}), imports.ENRICHED)


ACT = {
    "eli": "e1", "naslov": "n", "doc_segmented": [{"glava": "g", "članci": [{"članak": "Član 1.", "stavci": [{"točke": ["a", "b"]}]}]}], "summaries": {"short": "s"},
    "embeddings": {"model_name": "m", "embedding_dim": DIM, "title_embedding": [1.0, 2.0, 3.0], "segment_embeddings": [{"text": "a b", "embedding": [1.0, 1.0, 1.0]}]},
}


def test_twice_gives_the_same_rows_and_bad_acts_change_nothing(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    both = acts_of(spark, tmp_path, "a", ACT, ACT | {"eli": "e2"})
    first = imports.import_acts(spark, versions, both, DIM)
    rows = stored(versions.tables())
    assert (first.processed, first.errors) == (2, 0) and len(rows[4]) == 4
    imports.import_acts(spark, versions, both, DIM)
    assert stored(versions.tables()) == rows
    bad = ACT | {"naslov": "other", "embeddings": ACT["embeddings"] | {"title_embedding": [1.0]}}
    last = versions.commit_of()
    found = imports.import_acts(spark, versions, acts_of(spark, tmp_path, "b", bad), DIM)
    assert (found.processed, found.errors, found.version) == (0, 1, last["version"])
    assert versions.commit_of() == last and stored(versions.tables()) == rows
    assert imports.import_acts(spark, versions, acts_of(spark, tmp_path, "c", ACT).limit(0), DIM).processed == 0


def test_a_run_killed_between_its_writes_is_invisible(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path / "store"))
    imports.import_acts(spark, versions, acts_of(spark, tmp_path, "a", ACT), DIM)
    before, rows = versions.commit_of(), stored(versions.tables())

    def killed(self, commit):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        imports.import_acts(spark, versions, acts_of(spark, tmp_path, "b", ACT | {"eli": "e2"}), DIM)
    monkeypatch.undo()
    assert versions.commit_of() == before and stored(versions.tables()) == rows
    gone = versions.vacuum(keep=1)
    assert len(gone) > 5 and stored(versions.tables()) == rows
    assert imports.import_acts(spark, versions, acts_of(spark, tmp_path, "b", ACT | {"eli": "e2"}), DIM).processed == 1
    assert len(stored(versions.tables())[0]) == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    versions.create(DIM)
    base = versions.commit_of()["version"]
    imports.import_acts(spark, versions, acts_of(spark, tmp_path, "a", ACT), DIM, base=base)
    with pytest.raises(Conflict):
        imports.import_acts(spark, versions, acts_of(spark, tmp_path, "b", ACT | {"eli": "e2"}), DIM, base=base)
    assert list(stored(versions.tables())[0]) == ["e1"] and stored(versions.tables(base)) == ({}, {}, {}, {}, {})


def test_constraints_hold_at_the_write(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    imports.import_acts(spark, versions, acts_of(spark, tmp_path, "a", ACT), DIM)
    tables, base = versions.tables(), versions.commit_of()["version"]
    with pytest.raises(Violation, match="document_id names no row"):
        versions.commit({"documents": store.empty(spark, "documents")}, base)
    with pytest.raises(Violation, match="not unique"):
        versions.commit({"document_summaries": tables["document_summaries"].unionByName(tables["document_summaries"])}, base)
    with pytest.raises(Violation, match="null"):
        versions.commit({"documents": tables["documents"].withColumn("naslov", F.lit(None).cast("string"))}, base)
    assert versions.commit_of()["version"] == base
    gone = store.delete_documents(tables, tables["documents"].select("id"))
    versions.commit(gone, base)
    assert stored(versions.tables()) == ({}, {}, {}, {}, {})


def test_dimension_is_known_without_reading_vectors(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "store"))
    imports.import_acts(spark, versions, acts_of(spark, tmp_path, "a", ACT), DIM)
    path = versions.commit_of()["tables"]["document_embeddings"]
    assert dimension(spark.read.parquet(path)) == DIM and dimension(versions.tables()["document_embeddings"]) == DIM
    assert versions.create(DIM)["document_embeddings"].count() == 2
    left = versions.create(DIM + 1)
    assert left["document_embeddings"].count() == 0 and dimension(left["document_embeddings"]) == DIM + 1 and left["documents"].count() == 1


def test_texts_are_staged_once(spark, tmp_path, monkeypatch):
    """What an import stages beside the tables: each act's text and its articles' texts, and no more of them."""
    letters = random.Random(5)
    texts = [hashlib.sha512(str(letters.random()).encode()).hexdigest() * 2 + "".join(chr(letters.randrange(0x4E00, 0x9000)) for _ in range(20000)) for _ in range(6)]
    rows = [{"eli": f"e{i}", "naslov": "n", "doc_cleaned": t, "doc_segmented": [{"glava": "g", "članci": [{"članak": "1", "stavci": [{"stavak": None, "točke": [t]}]}]}]} for i, t in enumerate(texts)]
    df = spark.read.schema(imports.ENRICHED + ", path string").json(spark.sparkContext.parallelize([json.dumps(r | {"path": r["eli"]}) for r in rows], 1))
    monkeypatch.setattr("lexspark.staging.shared_folder", lambda _: f"file://{tmp_path}/staged")
    done = imports.import_acts(spark, Versions(spark, f"file://{tmp_path}/store"), df, DIM)
    assert (done.processed, done.errors) == (6, 0)
    assert sum(f.stat().st_size for f in (tmp_path / "staged").rglob("*.parquet")) < 2.2 * sum(len(t.encode()) for t in texts)
