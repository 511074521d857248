"""Periodic runs of words: stretches that repeat their first words at least four times.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
at least max(6, 4q) words, which no neighbouring word extends with that period. Texts of a
batch are compressed together into one run-length grammar (`recompression`), with a mark that
occurs once between texts. For every period p the places 0, 3p, 6p ... are candidates: a run of
that period has 3p places or more that equal the one p further, so one of them is a candidate.
That is a harmonic sum of places in all. The grammar tells how far the words agree with those p
further on, forward and back, and so the exact run.

Words are maximal stretches of other bytes than space and 0x09 to 0x0D. Null and empty texts
have no words and no runs. Equal texts have equal runs, whatever batch they are in. The memory
of a task is bounded by a batch of texts, or by one text where it is longer. Extra columns of
any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litrewise.llm.common import small_batches
from litrewise.llm.recompression import extensions, grammar

# Fixed values of a run: fewest words, and fewest times the period.
LEAST_WORDS = 6
LEAST_EXPONENT = 4
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 2 * 1024 * 1024
CANDIDATES_AT_ONCE = 2_000_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _candidates(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """text, place and period of every candidate, in bounded portions."""
    step = LEAST_EXPONENT - 1
    periods = np.where(lengths >= LEAST_WORDS, lengths // LEAST_EXPONENT, 0)
    for first in range(0, len(lengths), 512):
        chosen = periods[first : first + 512]
        text = np.repeat(np.arange(first, first + len(chosen)), chosen)
        period = np.arange(len(text)) - np.repeat(np.cumsum(chosen) - chosen, chosen) + 1
        places = (lengths[text] - 1 - period) // (step * period) + 1
        upto = np.cumsum(places)
        start = 0
        while start < len(text):
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + CANDIDATES_AT_ONCE, "right")))
            n = places[start:end]
            number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(period[start:end], n)
            yield np.repeat(text[start:end], n), number * step * p, p
            start = end


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of several texts: the text of each run, and its start, length and period, sorted
    by text, start and period. `words` are the numbers of all words, text after text."""
    lengths = lengths.astype(np.int64)
    texts = len(lengths)
    offsets = np.cumsum(lengths) - lengths + np.arange(1, texts + 1)
    marked = np.empty(len(words) + texts + 1, dtype=np.int64)
    is_mark = np.ones(len(marked), dtype=bool)
    is_mark[np.arange(len(words)) + np.repeat(np.arange(1, texts + 1), lengths)] = False
    marked[~is_mark] = words
    marked[is_mark] = int(words.max(initial=-1)) + 1 + np.arange(texts + 1)
    levels = grammar(marked, 4 * texts + 64)
    found = []
    for text, place, period in _candidates(lengths):
        a = offsets[text] + place
        same = np.flatnonzero(marked[a] == marked[a + period])
        text, place, period, a = text[same], place[same], period[same], a[same]
        ahead = extensions(levels, a, a + period)
        back = extensions(levels, a - 1, a + period - 1, forward=False)
        length = ahead + back + period
        enough = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
        found.append(np.stack([text, place - back, length, period])[:, enough])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros((3, 0), dtype=np.int64)
    text, start, length, period = np.concatenate(found, axis=1)
    # Several candidates meet one run, also by multiples of its period: the smallest is its own.
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], np.stack([start, length, period])[:, order]


def _repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of `n` words lie in a run after its first period."""
    start, length, period = runs
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _batch_runs(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    split = [b"" if t is None else t for t in batch.column(text).cast(pa.binary()).to_pylist()]
    split = [t.split() for t in split]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    flat = pa.array([w for words in split for w in words], pa.binary())
    numbers = np.asarray(flat.dictionary_encode().indices, dtype=np.int64)
    del flat
    which, runs = runs_of(numbers, lengths)
    cuts = np.searchsorted(which, np.arange(len(split) + 1))
    collapsed = []
    for i, words in enumerate(split):
        own = runs[:, cuts[i] : cuts[i + 1]]
        if own.shape[1]:
            words = [words[k] for k in np.flatnonzero(~_repeated(len(words), own))]
        collapsed.append(b" ".join(words))
    items = pa.StructArray.from_arrays([pa.array(r) for r in runs], ["start", "length", "period"])
    columns = {n: batch.column(n) for n in batch.schema.names if n != text}
    columns["words"] = pa.array(lengths)
    columns["runs"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)
    columns["collapsed"] = pa.array(collapsed, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def find_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """`document` (the row as it was) with words, runs (start, length, period; by start, then
    period) and collapsed (the words that no run repeats, joined by one space)."""
    rows = documents.select(F.struct("*").alias("document"), F.col(text).alias("_text"))
    added = T.StructType.fromDDL(f"words bigint, runs array<{RUN}>, collapsed binary")
    schema = T.StructType([rows.schema["document"], *added])

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", BATCH_BYTES):
            yield _batch_runs(batch, "_text")

    return rows.mapInArrow(found, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def plant_periods(documents: DataFrame) -> DataFrame:
    """Documents of which some are made periodic from a word on: one in ten by the checksum of
    the id. Rows without an id, and texts without a word, stay as they are."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    rows = documents.withColumn("_h", checksum).withColumn("_g", F.floor(F.col("_h") / 10))
    chosen = (F.col("_h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.withColumn("_words", F.when(chosen, words))
    n = F.size("_words")
    start = F.col("_g") % n
    period = F.lit(1) + F.floor((n - start) / (F.lit(3) + F.col("_g") % 8))
    rows = rows.withColumn("_a", F.when(n > 0, start)).withColumn("_p", F.when(n > 0, period))

    def planted(word: Column, i: Column) -> Column:
        source = (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
        return F.when(i < F.col("_a"), word).otherwise(F.get("_words", source))

    text = F.when(F.col("_p").isNotNull(), F.array_join(F.transform("_words", planted), " "))
    rows = rows.withColumn("text", F.coalesce(text, F.col("text")))
    return rows.drop("_h", "_g", "_words", "_a", "_p")


def run_digests(documents: DataFrame) -> DataFrame:
    """Per document: its number of runs, the run of greatest exact exponent, and digests of all
    runs and of the collapsed text."""
    found = find_runs(plant_periods(documents.select("doc_id", "text")))

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    # Runs are sorted by start, then period, so that the first of equal exponents stays.
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    rows = found.withColumn("best", best)
    return rows.select(
        F.col("document.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
