from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from litrewise.llm import forest, mixing, pieces, quality, queries, repeats
from litrewise.llm.common import table
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, SF, "documents"), {}
    found["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        found[name] = docs
    return found


def test_stages_keep_columns_and_take_effect(spark, stages):
    columns = stages["input"].columns
    for name in ("quality", "near_copies", "repeats", "mix"):
        assert stages[name].columns == columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in stages.items()}
    assert set(ids["input"]) > set(ids["quality"]) >= set(ids["near_copies"]) == set(ids["repeats"])
    assert set(ids["mix"]) <= set(ids["repeats"]) and sorted(ids["mix"]) == sorted(ids["pieces"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = [i for i in ids["input"] if labels.get(i) == 1]
    assert sum(i in set(ids["quality"]) for i in good) >= 0.98 * len(good)
    assert forest.join_documents(stages["near_copies"]).filter("n_links > 0").count() == 0
    assert stages["pieces"].filter("not lossless").count() == 0


def test_queries_are_registered():
    names = set(queries.registered())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}


def small_corpus(spark, folder):
    """Prose with near copies and shared passages, some of it bad, and labels for a part."""
    rng = random.Random(21)
    rows, labels = [], []
    for i, row in enumerate(helpers.prose_rows(160, seed=5)):
        text = row[1] if i % 5 else "!! ".join(w.upper() for w in row[1].split())
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels += [(i, int(i % 5 > 0), 0)] * (rng.random() < 0.7)
    rows += [(160 + k, rows[1][1], "en", "s1", rows[1][4]) for k in range(4)] + [(None, rows[2][1], None, None, rows[2][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def plain_near_copies(rows):
    """One row of each class that links of 0.8 connect, by all pairs: the smallest id names it."""
    hashes = forest.WordHashes()
    sets = [set(forest.shingles(r[1], hashes).tolist()) for r in rows]
    classes = [{i} for i in range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if classes[a] is not classes[b] and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                classes[a] |= classes[b]
                for i in classes[a]:
                    classes[i] = classes[a]
    names = {min(c, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for c in classes}
    return [rows[i] for i in sorted(names)]


def plain_repeats(rows, length=100):
    """The texts without bytes of any window that starts earlier as well."""
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = row[1].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = b"x" * length
            seen.add(data[k : k + length])
        text = bytes(c for c, g in zip(data, gone) if not g).decode()
        out.append((row[0], text, row[2], row[3], len(text)))
    return out


def test_run_equals_plain_python(spark, tmp_path):
    """Rows and texts; scores, draws and pieces are those of the single operators."""
    rows = small_corpus(spark, str(tmp_path))
    docs, labels = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")
    model = quality.learn(docs, quality.training_labels(labels))
    terms = quality.TermNumbers()
    good = [r for r in rows if model.scores([quality.features(r[1], terms)])[0] >= 0.5]
    assert 100 < len(good) < len(rows) - 20
    single = plain_near_copies(good)
    assert len(single) < len(good) - 10
    cut = plain_repeats(single)
    assert sum(len(a[1]) for a in single) > sum(len(b[1]) for b in cut) + 1000
    frame = spark.createDataFrame(cut, docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(frame).collect()}
    expected = Counter((r[0], r[3], r[2], r[1]) for r in cut for _ in range(copies[r[0]]))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns[:3] == ["doc_id", "source", "lang"] and found.filter("not lossless").count() == 0
    decoded = pieces.decode_documents(found).collect()
    assert Counter((r["doc_id"], r["source"], r["lang"], r["decoded"]) for r in decoded) == expected


def test_stages_take_odd_and_no_rows(spark, tmp_path, odd, empty):
    """Null columns, empty and very long texts, repeated rows and no rows, through all stages."""
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
            assert name == "pieces" or docs.columns == columns
        assert docs.filter("not lossless").count() == 0


def large_model():
    """A quality model of its full size, of random numbers."""
    rng = np.random.default_rng(3)
    n = 2 * quality.SAMPLE_PER_LABEL
    projection = np.rint(rng.standard_normal((quality.FEATURES, quality.DIMENSIONS)) * quality.PROJECTION_UNIT)
    vectors = np.rint(rng.standard_normal((n, quality.DIMENSIONS)) * (quality.VECTOR_UNIT // 8))
    return quality.Model(projection, vectors, np.arange(n) % 2.0)


# With the MB that each may allocate at a time.
WORKER_STEPS = {
    "quality": (25, lambda docs: quality.keep_good(docs, large_model())),
    "signatures": (12, lambda docs: forest.signed(docs, 4)),
    "blobs": (12, lambda docs: forest._blobs(docs)),
    "runs": (45, lambda docs: repeats.window_runs(repeats._keyed(docs), 100)),
    "compressed": (12, lambda docs: repeats.compressed(repeats._keyed(docs), carry=False)),
    "pieces": (45, lambda docs: pieces.encode_documents(docs, check=True)),
}


@pytest.mark.parametrize("step", WORKER_STEPS)
def test_worker_holds_little_beside_a_batch(spark, monkeypatch, step):
    """What a Python worker allocates beside an Arrow batch of 12 MB or more, Arrow's own memory not counted."""
    rng = random.Random(8)
    parts = [" ".join(helpers.words(rng, 40)) for _ in range(3000)]
    texts = [" ".join(rng.choices(parts, k=8)) for _ in range(8000)]
    assert sum(map(len, texts)) > 12 << 20
    docs = spark.createDataFrame([], "doc_id long, text string")
    captured = []
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, f, schema: captured.append(f))
        most, build = WORKER_STEPS[step]
        build(docs)
    numbers = np.arange(len(texts))
    columns = {"doc_id": numbers, "id": numbers, "doc": numbers, "tie": numbers, "text": texts}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    del texts
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in captured[-1](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 0 or step == "quality"
    assert peak < most * 1e6, f"{peak / 1e6:.0f} MB"


def test_worker_keeps_no_lattices_after_a_task(spark):
    docs = spark.createDataFrame([(i, " ".join(helpers.words(random.Random(i), 50))) for i in range(40)], "doc_id long, text string")
    assert pieces.encode_documents(docs.repartition(2)).filter("n_pieces > 0").count() == 40

    def living(batches):
        import gc

        for _ in batches:
            gc.collect()
            n = sum(isinstance(x, pieces.Lattices) for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    left = spark.range(0, 64, 1, 32).mapInArrow(living, "n long").groupBy().max("n").first()[0]
    assert left == 0
