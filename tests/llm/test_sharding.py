from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from litrewise.llm import sharding
from tests.llm import helpers


def test_contract(spark, prose, odd):
    for df in (prose, odd):
        docs = df.collect()
        rows = sharding.shard_documents(df, 16).collect()
        want = sorted(((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sharding.shard_documents(df, 16).columns[:3] == ["doc_id", "size", "text_crc32"]


def test_shares_and_movement(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id as doc_id", "'x' as text")
    rows = sharding.shard_documents(df, 16).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and all(abs(c / (n / 16) - 1) < 0.15 for c in counts.values())
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert abs(moved / (n / 17) - 1) < 0.15


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """Also step by step: what `shards + 1` gives is where the next number begins."""
    from pyspark.sql import functions as F

    places = [sharding.shard_of(F.col("id"), sharding.uniform_tree(n)).alias(f"n{n}") for n in range(1, 42)]
    rows = spark.range(3000).select(*places).collect()
    for n in range(1, 41):
        moved = {r[f"n{n + 1}"] for r in rows if r[f"n{n}"] != r[f"n{n + 1}"]}
        assert moved == {n}
        assert {r[f"n{n}"] for r in rows} == set(range(n))
    df = spark.range(500).selectExpr("id as doc_id", "'x' as text")
    for n in (1, 4, 16, 17):
        grown = {r["doc_id"]: r["grown_shard"] for r in sharding.shard_documents(df, n).collect()}
        assert grown == {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, n + 1).collect()}


def test_weights_move_rows_in_their_subtree_only(spark):
    """A heavier shard draws rows, through its rack and region, and gives none away."""
    from pyspark.sql import functions as F

    def tree(weight):
        leaf = sharding.Node
        a = leaf("rack-a", children=(leaf("s0", shard=0), leaf("s1", weight, shard=1)))
        b = leaf("rack-b", children=(leaf("s2", shard=2), leaf("s3", shard=3)))
        return (leaf("west", children=(a,)), leaf("east", children=(b,)))

    rows = spark.range(8000).select(
        sharding.shard_of(F.col("id"), tree(1.0)).alias("before"), sharding.shard_of(F.col("id"), tree(3.0)).alias("after")
    ).collect()
    moves = Counter((r["before"], r["after"]) for r in rows if r["before"] != r["after"])
    assert moves and {b for _, b in moves} == {1}
    shares = Counter(r["after"] for r in rows)
    assert all(abs(shares[s] / 8000 - w / 6) < 0.02 for s, w in ((0, 1), (1, 3), (2, 1), (3, 1)))


def test_rows_without_an_id_spread_over_parts(spark):
    """A third without an id, and one text a third of the table: no window gets them together."""
    rows = [(None, f"text {i}") for i in range(400)] + [(None, "same")] * 400 + [(i, "x") for i in range(400)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 1200 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    home = next(r["shard"] for r in found if r["doc_id"] is None)
    places = sorted(r["slot"] for r in found if r["doc_id"] is None and r["text_crc32"] == zlib.crc32(b"same"))
    assert places == list(range(places[0], places[0] + 400)) and len(slots[home]) >= 800
    others = sorted(r["slot"] for r in found if r["shard"] == home and r["doc_id"] is not None)
    assert others[0] < 600 < others[-1] or len(others) > 50


def test_native_and_empty(prose, empty, spark):
    plan = sharding.shard_documents(prose, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.shard_documents(empty, 16).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(prose, 1).collect()} == {0}
    assert helpers.SCHEMA
