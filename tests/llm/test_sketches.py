from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from litrewise.llm import sketches
from tests.llm import helpers


def order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))


def edited(rows):
    texts = [r["text"] or "" for r in rows]
    following = texts[1:] + texts[:1]
    return [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following)]


@pytest.mark.parametrize("per_part", [1, 7, 500])
def test_edited_texts(prose, odd, per_part):
    for df in (prose, odd):
        rows = order(df.collect())
        got = sketches.fingerprint_documents(df, per_part).collect()
        want = [(r["doc_id"], len(r["text"] or ""), hashlib.sha256(e.encode()).hexdigest()) for r, e in zip(rows, edited(rows))]
        assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got), key=str) == sorted(want, key=str)


def shingle_set(text):
    words = [w for w in __import__("re").findall(r"[^\W_]+", text.lower())]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_estimates(spark, prose):
    rows = order(prose.collect())
    got = {g["doc_id"]: g for g in sketches.fingerprint_documents(prose).collect()}
    for r, e in zip(rows, edited(rows)):
        a, b = shingle_set(r["text"]), shingle_set(e)
        true = len(a & b) / len(a | b) if a | b else 1.0
        near = got[r["doc_id"]]["near_edited"]
        # Below the sketch's size everything is exact.
        assert near == pytest.approx(true, abs=1e-9 if len(a | b) <= sketches.SKETCH_SIZE else 0.15)
        assert got[r["doc_id"]]["distinct_shingles"] == len(a)


def test_equal_texts_equal_fingerprints(prose):
    by_text = {}
    texts = {r["doc_id"]: r["text"] for r in prose.collect()}
    for g in sketches.fingerprint_documents(prose).collect():
        assert by_text.setdefault(texts[g["doc_id"]], g["fingerprint"]) == g["fingerprint"]


def test_merging_parts(spark, prose):
    parts = prose.select((F.col("doc_id") % 4).alias("part"), sketches.sketch(F.col("text"), 64).alias("s"))
    merged = sketches.merge_groups(parts.withColumn("all", F.lit(1)), ["all"], "s", 64).first()["s"]
    hashes = prose.select(F.explode(sketches.shingle_hashes(F.col("text"))).alias("h")).distinct().orderBy("h").limit(64)
    assert merged == [r["h"] for r in hashes.collect()]


def test_large_sets(spark):
    rng = __import__("random").Random(9)
    words = helpers.words(rng, 9000)
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[sketches.sketch(F.col(c)).alias(c) for c in "ab"])
    r = df.select(
        sketches.resemblance(F.col("a"), F.col("b")).alias("r"),
        sketches.containment(F.col("a"), F.col("b")).alias("c"),
        sketches.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    assert abs(r["r"] - 1 / 3) < 0.1 and abs(r["c"] - 0.5) < 0.15 and abs(r["n"] / 6000 - 1) < 0.2


def test_no_python_in_the_plan(prose):
    plan = sketches.fingerprint_documents(prose)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_and_none(spark, empty):
    one = spark.createDataFrame([helpers.row(1, "abcdefgh")], helpers.SCHEMA)
    assert sketches.fingerprint_documents(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert sketches.fingerprint_documents(empty).count() == 0


@pytest.mark.parametrize("per_part", [5, 40])
def test_rows_without_id_are_cut_into_parts(spark, per_part):
    rng = __import__("random").Random(2)
    rows = [helpers.row(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(helpers.words(rng, 12))) for i in range(300)]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    narrow = docs.select("doc_id", "text")
    tie = sketches.tie_of(narrow, per_part)
    sizes = [r["count"] for r in narrow.groupBy(sketches.part_of(narrow, tie, 300, per_part).alias("p")).count().collect()]
    assert max(sizes) <= 4 * per_part
    ordered = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32(r["text"].encode()), r["text"]))
    want = [hashlib.sha256(e.encode()).hexdigest() for e in edited(ordered)]
    got = [g["edited_sha256"] for g in sketches.fingerprint_documents(docs, per_part).collect()]
    assert sorted(got) == sorted(want)


def test_large_ids_keep_their_order(spark):
    ids = [2**53 + k for k in range(6)] + [2**62 + k for k in range(6)] + [-(2**62) + k for k in range(6)]
    docs = spark.createDataFrame([helpers.row(i, f"text of the row {i} " * 3) for i in ids], helpers.SCHEMA)
    rows = order(docs.collect())
    want = {r["doc_id"]: hashlib.sha256(e.encode()).hexdigest() for r, e in zip(rows, edited(rows))}
    assert {g["doc_id"]: g["edited_sha256"] for g in sketches.fingerprint_documents(docs, 1).collect()} == want


def test_each_text_is_sketched_once_beside_its_edited_form(prose):
    plan = sketches.fingerprint_documents(prose)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
