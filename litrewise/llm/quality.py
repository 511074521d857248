"""A quality classifier that lets the nearest labelled documents vote.

Texts become vectors of character-class trigrams (what kinds of characters follow each other), of
hashed words, and of a few repetition measures, weighted by rarity and projected on the leading
singular vectors of a bounded labelled sample (latent-semantic vectors). The sample's vectors, a
few thousand at most, are broadcast; every document's cosines with all of them are computed, in
blocks, and the labels of the nearest are averaged with the similarities as weights.

Features, projection and vectors are whole numbers (in units of a power of two) that are small
enough for their products and sums to be exact in any order, so that a score depends on the text
and the model alone, not on the block it is computed in.

Rows: a null text counts as empty; an empty text has a vector (of constants) and so a score;
equal texts have equal scores; texts are read whole. Neighbours as near as the last one needed
all vote. Null labels teach nothing, nor do ids with both labels; repeated rows teach once; rows of
one id with different texts teach each. Without any label every score is 0.5. Extra columns are
kept by `keep_good`. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.llm.common import remainder, small_batches
from litrewise.llm.sampling import lowest_per_class, row_name

# The bound of the labelled sample, and the size of the model made from it.
SAMPLE_PER_LABEL = 2000
DIMENSIONS = 48
NEIGHBOURS = 15
TRIGRAMS = 16**3
MEASURES = 6
TERMS = 1 << 12
FEATURES = TRIGRAMS + MEASURES + TERMS
# What the words of a text weigh beside its trigrams.
TERM_SHARE = 0.5
# What bounds a Python worker's memory while it scores: words remembered, bytes of text taken at
# once, and texts whose cosines with the whole sample are held (SCORE_ROWS * 4000 numbers).
MOST_WORDS = 100_000
BATCH_BYTES = 2 << 20
SCORE_ROWS = 64
# Rows of a block in fitting; its sums, and so the model, depend on it.
BLOCK_ROWS = 512

# Units of the whole numbers: features, projection, and vectors of length 1. The largest sums are
# 2^14 * 2^21 * FEATURES and 2^40 * DIMENSIONS and 2^40 * 2 * SAMPLE_PER_LABEL, all below 2^53.
FEATURE_UNIT = 1 << 14
PROJECTION_UNIT = 1 << 16
VECTOR_UNIT = 1 << 20

# The class of each ASCII character; anything else is class 1 as a letter.
CLASSES = {
    1: "abcdefghijklmnopqrstuvwxyz",
    2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    3: "0123456789",
    4: " \t",
    5: "\n\r",
    6: ".",
    7: ",;:",
    8: "!?",
    9: "#$%&*@^~+=",
    10: "|<>{}[]()/\\_",
    11: "'\"`-",
}


def class_table() -> np.ndarray:
    codes = np.zeros(256, dtype=np.int16)
    codes[128:] = 1
    for code, characters in CLASSES.items():
        for character in characters:
            codes[ord(character)] = code
    return codes


_CODES = class_table()


class TermNumbers(dict):
    """The bucket of each word, remembered; emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = TRIGRAMS + MEASURES + zlib.crc32(word.encode()) % TERMS
        self[word] = value
        return value


def features(text: str | None, terms: TermNumbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values (in FEATURE_UNIT) of the features a text has: square roots of trigram
    shares, repetition measures, and square roots of the shares of hashed words."""
    text = text or ""
    codes = _CODES[np.frombuffer(text.encode(), dtype=np.uint8)]
    found, values = [], []
    if len(codes) > 2:
        counts = np.bincount(codes[:-2] * 256 + codes[1:-1] * 16 + codes[2:], minlength=TRIGRAMS)
        found.append(np.flatnonzero(counts))
        values.append(np.sqrt(counts[found[-1]] / (len(codes) - 2)))
    words = text.lower().split()
    lines = [line for line in text.split("\n") if line]
    n = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    found.append(np.arange(TRIGRAMS, TRIGRAMS + MEASURES))
    values.append(
        np.array(
            [
                np.sqrt(same / n),
                1.0 - len(set(words)) / n if words else 0.0,
                1.0 - len(set(lines)) / len(lines) if lines else 0.0,
                min(1.0, len(text) / n / 20.0),
                min(1.0, np.log1p(len(words)) / 12.0),
                0.25,
            ]
        )
    )
    if words:
        buckets, counts = np.unique(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)), return_counts=True)
        found.append(buckets)
        values.append(TERM_SHARE * np.sqrt(counts / n))
    numbers = np.concatenate(found).astype(np.uint16)
    whole = np.rint(np.concatenate(values) * FEATURE_UNIT).astype(np.uint16)
    return numbers[whole > 0], whole[whole > 0]


@dataclass(frozen=True)
class Model:
    """Weighted projection, labelled vectors and labels, all whole numbers; a few megabytes."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def vectors_of(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Projected rows of length VECTOR_UNIT, as whole numbers."""
        projected = np.array([values.astype(np.float64) @ self.projection[numbers] for numbers, values in rows])
        length = np.sqrt((projected * projected).sum(axis=1, keepdims=True))
        return np.rint(projected / np.maximum(length, 1e-12) * VECTOR_UNIT)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosines = self.vectors_of(rows) @ self.vectors.T
        # No more neighbours than the rarer label has rows, or it could never win.
        rarer = min(n for n in (self.labels.sum(), (1 - self.labels).sum()) if n)
        k = int(min(NEIGHBOURS, rarer))
        last = np.partition(cosines, -k, axis=1)[:, [-k]]
        weights = np.where(cosines >= last, np.maximum(cosines, 1.0), 0.0)
        return (weights @ self.labels) / weights.sum(axis=1)


def _dense_blocks(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(rows), BLOCK_ROWS):
        part = rows[start : start + BLOCK_ROWS]
        block = np.zeros((len(part), FEATURES))
        for i, (numbers, values) in enumerate(part):
            block[i, numbers] = values / FEATURE_UNIT
        yield slice(start, start + len(part)), block * weights


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Rarity weights and leading singular vectors (by randomised power iteration, in blocks)."""
    if not rows:
        return Model(np.zeros((FEATURES, DIMENSIONS)), np.zeros((0, DIMENSIONS)), labels)
    seen = np.bincount(np.concatenate([numbers for numbers, _ in rows]), minlength=FEATURES)
    weights = np.where(seen > 0, np.log1p(len(rows) / np.maximum(seen, 1)), 0.0)
    weights[TRIGRAMS : TRIGRAMS + MEASURES] = 1.0
    wide = min(DIMENSIONS + 16, len(rows), FEATURES)

    def gathered(left: np.ndarray) -> np.ndarray:
        return sum(block.T @ left[at] for at, block in _dense_blocks(rows, weights))

    def projected(basis: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ basis for _, block in _dense_blocks(rows, weights)])

    basis = gathered(np.random.default_rng(seed).standard_normal((len(rows), wide)))
    for _ in range(4):
        basis, _ = np.linalg.qr(gathered(projected(basis)))
    _, _, right = np.linalg.svd(projected(basis), full_matrices=False)
    projection = np.rint((weights[:, None] * (basis @ right.T)[:, :DIMENSIONS]) * PROJECTION_UNIT)
    model = Model(projection, np.zeros((0, projection.shape[1])), labels)
    return Model(projection, model.vectors_of(rows), labels)


def feature_rows(documents: DataFrame) -> DataFrame:
    """row_id, digest, quality, and the features of each text as bytes of their numbers and
    values, two bytes each."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermNumbers()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found = [features(t, terms) for t in batch.column("text").to_pylist()]
            packed = [[np.ascontiguousarray(x).astype("<u2").tobytes() for x in part] for part in zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row_id", "digest", "quality")], *[pa.array(p, pa.binary()) for p in packed]],
                names=["row_id", "digest", "quality", "numbers", "values"],
            )

    return documents.select("row_id", "digest", "quality", "text").mapInArrow(
        compute, "row_id string, digest string, quality int, numbers binary, values binary"
    )


def learn(documents: DataFrame, labels: DataFrame, seed: str = "quality") -> Model:
    """Fit on at most SAMPLE_PER_LABEL documents of each label (labels: doc_id, quality)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    named = texts.select("doc_id", *row_name()).join(known, "doc_id").select("row_id", "digest", "quality").distinct()
    chosen = lowest_per_class(named, "quality", SAMPLE_PER_LABEL, seed).drop("_draw")
    # Two labels with SAMPLE_PER_LABEL different rows each; one text for each of them.
    found = texts.select(*row_name(), "text").join(F.broadcast(chosen), ["row_id", "digest"])
    sample = found.groupBy("row_id", "digest", "quality").agg(F.first("text").alias("text"))
    rows = sorted(feature_rows(sample).collect())
    sparse = [(np.frombuffer(r["numbers"], "<u2"), np.frombuffer(r["values"], "<u2")) for r in rows]
    return fit(sparse, np.array([float(r["quality"]) for r in rows]))


SCORE_SCHEMA = "doc_id long, score double"


def _scores(model: Model, texts: list[str | None], terms: TermNumbers) -> np.ndarray:
    parts = [texts[i : i + SCORE_ROWS] for i in range(0, len(texts), SCORE_ROWS)]
    return np.concatenate([model.scores([features(t, terms) for t in part]) for part in parts])


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; shuffles nothing."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermNumbers()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            values = _scores(shared.value, batch.column("text").to_pylist(), terms)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"]
            )

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(score, SCORE_SCHEMA)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The documents the classifier does not reject, with their own columns and rows."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermNumbers()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            values = _scores(shared.value, batch.column("text").to_pylist(), terms)
            yield batch.filter(pa.array(values >= 0.5))

    return documents.mapInArrow(kept, documents.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 remainder of the id not 1."""
    return labels.filter(remainder(F.col("doc_id"), 3) != 1)


def classify_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(documents, training_labels(labels))
    scored = score_documents(documents, model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
