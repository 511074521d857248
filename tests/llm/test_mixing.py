from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from litrewise.llm import mixing
from tests.llm import helpers


def filled(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing what is above the most until nothing is."""
    total, target, open_ = share * sum(sizes.values()), {}, dict(zip(sizes, weights))
    while open_:
        part = total / sum(open_.values())
        above = [s for s in open_ if part * open_[s] > most * sizes[s]]
        if not above:
            return target | {s: part * w for s, w in open_.items()}
        for s in above:
            target[s] = most * sizes[s]
            total -= target[s]
            del open_[s]
    return target


def check(df):
    rows = mixing.mix_sizes(df).collect()
    docs = df.collect()
    assert len(rows) == len(docs)
    by_source = defaultdict(int)
    for d in docs:
        by_source[d["source"]] += len((d["text"] or "").split())
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]
    want = filled({s: by_source[s] for s in order}, weights)
    assert sorted(r["target"] for r in rows) == pytest.approx(sorted(want[d["source"]] for d in docs))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        largest[key] = max(largest[key], r["size"])
        target[key] = r["target"]
    for key in taken:
        assert abs(taken[key] - target[key]) <= largest[key]


def test_targets_and_taken_words(spark, prose):
    check(prose)
    rng = random.Random(3)
    rows = [helpers.row(i, " ".join(helpers.words(rng, rng.randint(1, 60))), source=f"s{min(i % 40, 7)}") for i in range(400)]
    check(spark.createDataFrame(rows, helpers.SCHEMA))


def test_odd_rows(odd):
    rows = mixing.mix_sizes(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    copies = {str(r["doc_id"]): r["copies"] for r in rows if r["doc_id"] in (4, 5, 6, 7)}
    for doc_id, n in copies.items():
        assert mixed.filter(F.col("doc_id") == int(doc_id)).count() == n


def test_repeated_rows_meet_the_target(spark):
    """Equal rows are no block: with and without ids, also where one row is the whole source."""
    for doc_id in (None, 5):
        rows = [helpers.row(doc_id, "one two three four five six seven eight nine", source="a")] * 900
        rows += [helpers.row(i, "w " * 40, source="b") for i in range(50)]
        frame = spark.createDataFrame(rows, helpers.SCHEMA).repartition(3)
        check(frame)
        taken = mixing.mix_sizes(frame).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
        assert all(abs(r["t"] - r["target"]) <= 40 for r in taken)
        mixed = mixing.mix_documents(frame)
        words = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()
        assert sorted(r["t"] for r in words) == sorted(r["t"] for r in taken)


def test_reruns_agree(prose):
    a = sorted(mixing.mix_sizes(prose.repartition(2)).select("doc_id", "taken").collect())
    b = sorted(mixing.mix_sizes(prose.repartition(9)).select("doc_id", "taken").collect())
    assert a == b


def test_long_documents_have_better_odds(spark):
    rng = random.Random(8)
    rows = [helpers.row(i, " ".join(helpers.words(rng, 5 if i % 2 else 300)), source="abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, helpers.SCHEMA)
    drawn = mixing.mix_sizes(df).filter("target < 2 * source_size").withColumn("long", F.col("size") > 100)
    rates = {r["long"]: r["c"] for r in drawn.groupBy("long").agg(F.avg("copies").alias("c")).collect()}
    assert rates[True] > rates[False]


def test_empty(empty):
    assert mixing.mix_sizes(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
