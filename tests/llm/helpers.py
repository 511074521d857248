"""Documents with every odd case, and random prose with copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, node string, row string"
SYLLABLES = ["an", "the", "re", "tion", "ou", "er", "ing", "st", "ble", "nd", "ha", "ty"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def row(doc_id, text, lang="en", source="a"):
    """A document with extra columns whose names clash with those of results."""
    return (doc_id, text, lang, source, None if text is None else len(text), -1, "k", "n", "r")


def odd_rows() -> list[tuple]:
    rng = random.Random(4)
    long = " ".join(words(rng, 6000))
    return [
        row(1, None),
        row(2, "", None, None),
        row(3, " \n\t "),
        row(4, "word"),
        row(5, "two words", "fr", None),
        row(6, "ünï©ödé ▁ 漢字 😀 " * 40, "de", "ä"),
        row(7, long, "en", "b"),
        row(8, long, "en", "b"),
        row(8, long, "en", "b"),
        row(9, "x" * 5000, None, "b"),
        row(None, "no id but some text that is long enough to be shingled well " * 3),
        row(None, None, None, None),
        row(10, "1234 5678 !!!", "en", "c"),
    ]


def prose_rows(n: int, seed: int = 1) -> list[tuple]:
    """Random documents; some repeat an earlier one, with or without a changed word, or share
    a passage with it."""
    rng = random.Random(seed)
    texts: list[list[str]] = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            new = list(rng.choice(texts))
        elif texts and kind < 0.35:
            new = list(rng.choice(texts))
            new[rng.randrange(len(new))] = "changed"
        elif texts and kind < 0.5:
            other = rng.choice(texts)
            at = rng.randrange(len(other))
            new = words(rng, 30) + other[at : at + 60] + words(rng, 30)
        else:
            new = words(rng, rng.randint(3, 200))
        texts.append(new)
    return [row(i, " ".join(t), "en", f"s{i % 3}") for i, t in enumerate(texts)]
