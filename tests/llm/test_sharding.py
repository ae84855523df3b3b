from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

from lexspark.llm import sharding
from lexspark.llm.common import mix

from .helpers import documents


def plain_jump(key: int, shards: int) -> int:
    key, at, ahead = int(mix(np.array([key], np.int64).view(np.uint64))[0]), -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_is_the_published_loop():
    keys = np.array([0, 1, 2, -1, 2**62, -(2**63), *range(1000, 1200)], np.int64)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_only_into_the_new_shard_and_sizes_are_even():
    keys = np.arange(100_000)
    for n in (1, 5, 16):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all()
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.01
    counts = np.bincount(sharding.jump(keys, 16))
    assert counts.min() > 0.9 * counts.mean() and counts.max() < 1.1 * counts.mean()


def test_slots_sizes_and_awkward_rows(spark):
    texts = ["héé", None, "", "x" * 300_000, "same", "same", *[f"t{i}" for i in range(200)]]
    df = documents(spark, texts, ids=[1, 2, 3, 4, 5, 5, *range(100, 299), None], extra={"shard": "s", "slot": "9"})
    out = sharding.shard(df, 16).collect()
    assert len(out) == len(texts)
    by, want = defaultdict(list), Counter((None if t is None else t) for t in texts)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.size, r.text_crc32) for r in out) == Counter(((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in want.elements()))
    assert sharding.shard(df.limit(0), 16).count() == 0


def test_the_query_places_every_document_as_the_loop_does(spark, sf_dir):
    from lexspark.llm.queries import op2_jump_sharding

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_jump_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["shard"] == plain_jump(r["doc_id"], 16) and r["grown_shard"] == plain_jump(r["doc_id"], 17)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
