from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litrewise.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary()


def segmentations(text, vocabulary):
    """All ways to write a short text without byte pieces, with their log weights."""
    by_piece = {p: i for i, p in enumerate(vocabulary.pieces) if p and i not in set(vocabulary.byte_ids.tolist())}
    data = text.encode()

    def go(at):
        if at == len(data):
            yield (), 0.0
        for end in range(at + 1, len(data) + 1):
            i = by_piece.get(data[at:end])
            if i is not None:
                for rest, weight in go(end):
                    yield (i, *rest), weight + vocabulary.log_weights[i]

    return dict(go(0))


def test_draws_follow_the_lattice(vocabulary):
    text = "thing"
    ways = segmentations(" " + text, vocabulary)
    total = sum(map(math.exp, ways.values()))
    n = 20_000
    ids, offsets = pieces.sample([text] * n, list(range(n)), pieces.Lattices(vocabulary))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
    assert set(seen) <= set(ways)
    for way, weight in ways.items():
        share = math.exp(weight) / total
        assert abs(seen[way] / n - share) < 4 * math.sqrt(share / n) + 1e-3


def test_round_trip_and_columns(odd, prose):
    for df in (odd, prose):
        encoded = pieces.encode_documents(df)
        back = pieces.decode_documents(encoded).collect()
        assert len(back) == df.count()
        assert all(r["decoded"] == r["text"] and r["size"] == -1 for r in back)
        assert all(r["n_pieces"] == len(r["piece_ids"] or []) for r in back)


def test_same_row_same_pieces(prose):
    a = {r["doc_id"]: r["piece_ids"] for r in pieces.encode_documents(prose.repartition(1)).collect()}
    b = {r["doc_id"]: r["piece_ids"] for r in pieces.encode_documents(prose.repartition(7)).collect()}
    assert a == b


def test_query_columns(odd):
    rows = pieces.encode_and_check(odd)
    assert rows.columns == ["doc_id", "piece_ids", "n_pieces", "lossless"]
    assert rows.filter(~F.col("lossless")).count() == 0


def test_empty(empty):
    assert pieces.encode_and_check(empty).count() == 0


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts, keys = ["the thing and another", "one more thing", "and the end"], [1, 2, 3]
    want = pieces.sample(texts, keys, pieces.Lattices(vocabulary))
    monkeypatch.setattr(pieces, "MOST_UNITS", 1)
    lattices = pieces.Lattices(vocabulary)
    for text, key, a, b in zip(texts, keys, want[1], want[1][1:]):
        ids, _ = pieces.sample([text], [key], lattices)
        assert np.array_equal(ids, want[0][a:b])


def test_long_unit(vocabulary):
    text = "theand" * 20_000
    ids, _ = pieces.sample([text], [1], pieces.Lattices(vocabulary))
    assert pieces.decode(ids.tolist(), vocabulary.pieces) == text


def test_places_one_by_one_equal_all_together(vocabulary, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [
        "".join(rng.choice(list("thean▁漢字ü😀 "), p=[0.1] * 9 + [0.099, 0.001], size=n)) for n in (1, 40, 700, 3000, 0, 5000)
    ]
    keys = list(range(len(texts)))
    monkeypatch.setattr(pieces, "TOGETHER", 10_000)
    want = pieces.sample(texts, keys, pieces.Lattices(vocabulary))
    monkeypatch.setattr(pieces, "WINDOW", 50)
    for together in (1, 100):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        got = pieces.sample(texts, keys, pieces.Lattices(vocabulary))
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    ids, offsets = want
    assert [pieces.decode(ids[a:b].tolist(), vocabulary.pieces) for a, b in zip(offsets, offsets[1:])] == texts


def test_remembered_characters_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PLACES", 5000)
    lattices = pieces.Lattices(vocabulary)
    for key in range(9):
        text = f"{key}the" * 1000
        ids, _ = pieces.sample([text], [key], lattices)
        assert pieces.decode(ids.tolist(), vocabulary.pieces) == text
        assert len(lattices.group) <= 5000 + 2 * len(text)


def test_half_a_million_characters_without_a_space(vocabulary):
    text = "漢字かな" * 125_000
    ids, _ = pieces.sample([text], [1], pieces.Lattices(vocabulary))
    assert pieces.decode(ids.tolist(), vocabulary.pieces) == text
