from __future__ import annotations

import random
import zlib

import numpy as np

from litrewise.llm import quality
from tests.llm import helpers


def labelled(spark, n=300):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = helpers.words(rng, rng.randint(10, 80))
        good = rng.random() < 0.7
        text = " ".join(words) if good else "!! ".join(w.upper() for w in words)
        docs.append(helpers.row(i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classify_documents(docs, labels).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark, 120)
    from pyspark.sql import functions as F

    flipped = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")
    )
    a = sorted(quality.classify_documents(docs, labels).collect())
    b = sorted(quality.classify_documents(docs, flipped).collect())
    assert a == b


def test_odd_rows(spark, odd, empty):
    docs, labels = labelled(spark, 120)
    model = quality.learn(docs, labels)
    scored = quality.score_documents(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    kept = quality.keep_good(odd, model)
    assert kept.schema == odd.schema
    assert kept.count() == sum(r["score"] >= 0.5 for r in scored)
    assert quality.score_documents(empty, model).count() == 0


def test_no_labels(spark, odd):
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify_documents(odd, labels).collect()
    assert {r["score"] for r in rows} == {0.5}


def sample_model(n=60):
    rng = np.random.default_rng(2)
    terms = quality.TermNumbers()
    texts = [" ".join(helpers.words(random.Random(i), 20)) + "!" * (i % 5) for i in range(n)]
    rows = [quality.features(t, terms) for t in texts]
    return rows, quality.fit(rows, rng.integers(0, 2, n).astype(float))


def test_blocked_vote_equals_brute_force():
    rows, model = sample_model()
    labels = model.labels
    for (numbers, values), score in zip(rows, model.scores(rows)):
        # Whole numbers of any size, one product after the other.
        vector = [sum(int(v) * int(model.projection[k, d]) for k, v in zip(numbers, values)) for d in range(model.projection.shape[1])]
        length = np.sqrt((np.array(vector, dtype=np.float64) ** 2).sum())
        unit = [int(np.rint(x / length * quality.VECTOR_UNIT)) for x in vector]
        cosines = [sum(a * int(b) for a, b in zip(unit, v)) for v in model.vectors]
        k = int(min(quality.NEIGHBOURS, labels.sum(), len(labels) - labels.sum()))
        last = sorted(cosines)[-k]
        votes = [(max(c, 1), y) for c, y in zip(cosines, labels) if c >= last]
        assert score == sum(c * int(y) for c, y in votes) / sum(c for c, _ in votes)


def test_scores_do_not_depend_on_the_block():
    rows, model = sample_model()
    whole = model.scores(rows)
    for size in (1, 7, 33):
        parts = [model.scores(rows[i : i + size]) for i in range(0, len(rows), size)]
        assert np.concatenate(parts).tolist() == whole.tolist()
    shuffled = np.random.default_rng(1).permutation(len(rows))
    assert model.scores([rows[i] for i in shuffled]).tolist() == whole[shuffled].tolist()


def test_repeated_rows_teach_once_and_reach_the_driver_once(spark):
    """A third of all rows are one document, and one id has many texts and labels."""
    docs, labels = labelled(spark, 90)
    more = spark.createDataFrame([helpers.row(3, "copy of a good text")] * 200 + [helpers.row(5, f"text {i}") for i in range(50)], helpers.SCHEMA)
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(7, 0, 0), (7, 1, 0)], labels.schema))
    model = quality.learn(docs.unionByName(more), again)
    once = quality.learn(docs.unionByName(more.distinct()), labels.filter("doc_id <> 7"))
    assert len(model.labels) <= 90 + 1 + 50
    assert np.array_equal(model.vectors, once.vectors) and np.array_equal(model.labels, once.labels)


def test_words_alone_can_decide(spark):
    rng = random.Random(3)
    good, bad = helpers.words(rng, 30), helpers.words(rng, 30)
    docs = [helpers.row(i, " ".join(rng.choices(good if i % 2 else bad, k=40))) for i in range(200)]
    labels = [(i, i % 2, 0) for i in range(200)]
    rows = quality.classify_documents(
        spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
