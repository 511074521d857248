from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from litrewise.llm import repeats


def expected(rows, length):
    """Brute force over (doc_id, text) in order: removed spans and digest of what is left."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data, spans, own = (text or "").encode(), [], []
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
            seen.add(window)
        left, at = b"", 0
        for a, b in spans:
            left, at = left + data[at:a], b
        left += data[at:]
        out[doc_id, text] = (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest())
    return out


def found(df):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()),
        key=str,
    )


@pytest.mark.parametrize("length", [20, 100])
def test_equals_brute_force(prose, length):
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    want = sorted(((k[0], *v) for k, v in expected(rows, length).items()), key=str)
    assert found(repeats.dedup_digests(prose, length)) == want


def test_odd_rows(odd):
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    once = expected(rows, repeats.LENGTH)
    want = sorted(((r["doc_id"], *once[r["doc_id"], r["text"]]) for r in odd.collect()), key=str)
    assert found(repeats.dedup_digests(odd)) == want


def test_empty(empty):
    assert repeats.dedup_digests(empty).count() == 0
    assert repeats.dedup_documents(empty).columns == empty.columns


def test_documents_keep_columns_and_characters(odd):
    result = repeats.dedup_documents(odd)
    assert result.schema.names == odd.schema.names
    rows = result.collect()
    assert len(rows) == odd.count()
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == -1 for r in rows)


def test_spans_keep_characters_whole():
    text = "aé漢b".encode()
    assert repeats.whole_characters(text, [(0, 2)]) == "é漢b"
    assert repeats.whole_characters(text, [(2, 5)]) == "aé漢b"
    assert repeats.whole_characters(text, [(1, 6)]) == "ab"
    assert repeats.whole_characters(text, [(0, len(text))]) == ""


def test_index_equals_brute_force():
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 9):
        for _ in range(5):
            texts = [rng.integers(0, 3, int(rng.integers(0, 50))).astype(np.uint8).tobytes() for _ in range(10)]
            texts = [t for t in texts if len(t) >= length]
            got = [np.zeros(len(t), bool) for t in texts]
            n = np.arange(len(texts))
            for run, a, b in repeats.index_runs(texts, n, n * 0, length) if texts else []:
                got[run][a : b + length] = True
            seen: set[bytes] = set()
            for text, mask in zip(texts, got):
                want = np.zeros(len(text), bool)
                for k in range(len(text) - length + 1):
                    if text[k : k + length] in seen:
                        want[k : k + length] = True
                    seen.add(text[k : k + length])
                assert (mask == want).all()


def test_intervals_are_extended_by_doubling(monkeypatch):
    """Windows of 100 bytes take 8 rounds of expansion, not 100, with the classes of plain comparison."""
    rng = np.random.default_rng(5)
    parts = [bytes(rng.integers(97, 99, n).tolist()) for n in (130, 99, 250, 101)]
    text = b"".join(parts[i] + b"|" for i in (0, 1, 2, 0, 3, 2, 1, 3))
    symbols = np.concatenate([[0], np.frombuffer(text, dtype=np.uint8) % 124]).astype(np.int16)
    rounds, repeat = [], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a: rounds.append(1) or repeat(*a))
    places, classes = repeats.equal_windows(symbols, 100)
    monkeypatch.undo()
    windows = {}
    for at in range(len(text) - 99):
        if b"|" not in text[at : at + 100]:
            windows.setdefault(text[at : at + 100], []).append(at + 1)
    found = {}
    for place, of in zip(places.tolist(), classes.tolist()):
        found.setdefault(of, []).append(place)
    assert sorted(map(sorted, found.values())) == sorted(w for w in windows.values() if len(w) > 1)
    assert len(found) == 31 + 151 + 2 and len(rounds) <= 8


@pytest.mark.parametrize("name_bytes", [1, 150, 1000])
def test_large_names_go_by_windows(prose, name_bytes):
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    want = sorted(((k[0], *v) for k, v in expected(rows, 40).items()), key=str)
    assert found(repeats.dedup_digests(prose, 40, index_bytes=50, name_bytes=name_bytes)) == want


@pytest.mark.parametrize("name_bytes", [repeats.NAME_BYTES, 5000])
def test_small_index_and_long_runs(spark, name_bytes):
    """Many indexes in a task, periodic texts and cut runs give the same result."""
    rng = random.Random(5)
    texts = ["ab" * 3000, "a" * 9000, "xyz" + "ab" * 2500, "".join(rng.choices("ab", k=3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((k[0], *v) for k, v in expected(list(enumerate(texts)), 30).items()), key=str)
    assert found(repeats.dedup_digests(df, 30, index_bytes=50, name_bytes=name_bytes)) == want
