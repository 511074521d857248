from __future__ import annotations

import random

import numpy as np
import pytest

from litrewise.llm import token_counts


def blocks_frame(spark, files, size):
    """Flat files as rows of `size` tokens, in random order."""
    rows = []
    for name, tokens in files.items():
        data = np.array(tokens, dtype="<u2")
        for seq, start in enumerate(range(0, max(len(data), 1), size)):
            rows.append((name, seq, bytearray(data[start : start + size].tobytes())))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file string, seq long, data binary").repartition(3)


@pytest.mark.parametrize("size,bits", [(1, 2), (7, 1), (1000, 12)])
def test_stitching_equals_splitting(spark, monkeypatch, size, bits):
    monkeypatch.setattr(token_counts, "STRETCH_BITS", bits)
    rng = random.Random(size)
    files = {f"f{k}": rng.choices([1, 2, 0], weights=[5, 5, rng.choice([0, 1, 5])], k=rng.randint(0, 120)) for k in range(8)}
    want = set()
    for name, tokens in files.items():
        counts, n = [], 0
        for t in tokens:
            if t == 0:
                counts.append(n)
                n = 0
            else:
                n += 1
        want |= {(name, i, c, True) for i, c in enumerate(counts)}
        if n:
            want.add((name, len(counts), n, False))
    got = token_counts.count_flat(blocks_frame(spark, files, size), separator=0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_documents(spark, prose, odd):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={})
    for df in (prose, odd):
        want = sorted(((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in df.collect()), key=str)
        got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.count_documents(df).collect()]
        assert sorted(got, key=str) == want


SPACES = [" ", "\n", "\t", " \n", "\r\n", "\u00a0", "\u3000 ", "\x85"]


@pytest.mark.parametrize("space", SPACES)
def test_long_white_space_has_the_tokens_of_the_split(space):
    encoder = token_counts.Encoder(token_counts.read_ranks())
    for n in (255, 256, 257, 3000):
        run = (space * n)[:n]
        for text in (run, "a" + run, run + "b", f"a{run}b", f"a {run}!", f"a{run}'s{run} 7{run}", f"{run}\x1c{run}x"):
            assert encoder.encode(text) == encoder.words.encode_ordinary(text)


def test_a_million_spaces(spark):
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x" + " \t\n" * 400_000, "e" * 300_000]
    rows = [(i, t) for i, t in enumerate([*texts, None, ""])]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The vocabulary has a token for two line breaks; the last one before a letter stands alone.
    assert got[0] == 1_000_000 and got[1] == 1 + 500_000 + 1 + 1 and got[4] == got[5] == 0
    assert 400_000 <= got[2] <= 1_200_001 and 0 < got[3] <= 300_000


def test_raw_files(spark, tmp_path):
    np.array([5, 5, 0, 0, 7], dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([3, 0], dtype="<u2").tofile(tmp_path / "b.bin")
    blocks = token_counts.read_flat(spark, str(tmp_path), block_tokens=2)
    got = sorted((r["file"][-5:], r["ordinal"], r["n_tokens"], r["ended"]) for r in token_counts.count_flat(blocks, 0).collect())
    assert got == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, False), ("b.bin", 0, 1, True)]


def test_empty(spark, empty):
    assert token_counts.count_documents(empty).count() == 0
