"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from litrewise.llm.recompression import extensions, grammar
from litrewise.llm.runs import find_runs, plant_periods, run_digests, runs_of
from tests.llm import helpers


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, looked for period by period."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            if i > start and length >= max(6, 4 * period):
                found.setdefault((start, length), period)
            i += 1
    return sorted(((s, l, p) for (s, l), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text) -> list[str]:
    words = [] if text is None else [w.decode() for w in text.encode().split()]
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text) -> tuple:
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, l, p in runs for i in range(s + p, s + l)}
    lines = "".join(f"{s},{l},{p}\n" for s, l, p in runs)
    best = None
    for s, l, p in runs:
        if best is None or l * best[2] > best[1] * p:
            best = (s, l, p)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    columns = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *columns, *sha)


def periodic_words(rng: random.Random) -> list[int]:
    n = rng.choice([0, 1, 5, 6, 7, 8, 25, 90, 200])
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    if n > 8 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 4))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.4:
            words[rng.randrange(n)] = 77
    return words


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_their_definition(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(rng.randint(1, 40))]
    flat = np.array([w for t in texts for w in t], dtype=np.int64)
    which, runs = runs_of(flat, np.array([len(t) for t in texts]))
    for i, words in enumerate(texts):
        assert [tuple(r) for r in runs[:, which == i].T.tolist()] == plain_runs(words)


@pytest.mark.parametrize("seed", range(10))
def test_grammar_derives_the_words_and_answers_extensions(seed):
    rng = random.Random(seed)
    words = [90, *[w for _ in range(30) for w in periodic_words(rng)], 91]
    levels = grammar(np.array(words), most_left=8)
    for below, above in zip(levels, levels[1:]):
        first, last = below.ends
        sums = [below.size[f : l + 1].sum() for f, l in zip(first, last)]
        assert above.size.tolist() == sums
        derived = {}
        for symbol, f, l in zip(above.symbol.tolist(), first, last):
            assert derived.setdefault(symbol, below.symbol[f : l + 1].tolist()) == below.symbol[f : l + 1].tolist()
    assert levels[-1].size.sum() == len(words)
    places = [sorted(rng.sample(range(1, len(words) - 1), 2)) for _ in range(300)]
    a, b = np.array(places).T

    def agree(i, j, step):
        n = 0
        while words[i] == words[j]:
            n, i, j = n + 1, i + step, j + step
        return n

    assert extensions(levels, a, b).tolist() == [agree(i, j, 1) for i, j in places]
    assert extensions(levels, a, b, forward=False).tolist() == [agree(i, j, -1) for i, j in places]


def planted_rows() -> list[tuple]:
    rng = random.Random(6)
    rows = [helpers.row(i, " ".join(helpers.words(rng, rng.randint(1, 80)))) for i in range(120)]
    rows += [helpers.row(500 + i, " ".join(["na"] * i)) for i in range(9)]
    # Equal exponents: the earlier run wins; a greater exponent wins over a longer run.
    rows.append(helpers.row(520, "a b a b a b a b x c d c d c d c d y " + "z " * 4))
    rows.append(helpers.row(521, "a b c a b c a b c a b c x y y y y y y"))
    return rows


def test_digests_equal_brute_force(spark, odd, empty):
    frame = odd.unionByName(spark.createDataFrame(planted_rows(), helpers.SCHEMA)).repartition(4)
    got = sorted((tuple(r) for r in run_digests(frame).collect()), key=str)
    expected = sorted((plain_digest(r.doc_id, r.text) for r in frame.collect()), key=str)
    assert got == expected
    assert any(r[1] > 0 for r in got)
    assert run_digests(empty).count() == 0


def test_only_long_runs_are_planted_and_rows_without_words_stay(spark, odd):
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    for r in plant_periods(odd).select("doc_id", "text").collect():
        if (r.doc_id, r.text) not in rows:
            assert zlib.crc32(str(r.doc_id).encode()) % 10 == 0


def test_the_operator_gives_spans_and_text_beside_the_row(spark, odd):
    named = odd.withColumn("words", odd["n_chars"]).withColumn("runs", odd["key"])
    rows = find_runs(named).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = [] if r.document.text is None else [w.decode() for w in r.document.text.encode().split()]
        assert r.words == len(words)
        assert [tuple(x) for x in r.runs] == plain_runs(words)


def test_one_very_long_text(spark):
    words = ["w%d" % (i * i % 1009) for i in range(60_000)]
    frame = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    found = find_runs(frame).first()
    # The squares modulo a prime repeat after it.
    assert [tuple(r) for r in found.runs] == [(0, 60_000, 1009)]
    assert len(found.collapsed.split(" ")) == 1009
