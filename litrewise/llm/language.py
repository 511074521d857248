"""Language identification by compression.

For each language a bounded sample of its texts becomes a raw-content zstandard dictionary: an
equal share of bytes from each of TEXTS_PER_LANGUAGE texts, taken at a place that a hash decides.
Short texts teach only languages that have no others, and the MOST_LANGUAGES most frequent
languages are learned. A text is compressed with every dictionary; the language of the smallest result wins. The
distance to the second best is the margin: where it is narrow the prediction is marked as
not accepted (column `accepted`), and the caller decides what to do with it.

Rows: a null text, or one without letters, is `und` with score 0; texts are compressed whole,
in blocks; ties go to the language that sorts first; equal texts have equal results. Only the
given id and text columns are used. Repeated rows teach once. An empty table gives an empty result; nothing to learn
from makes every text `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.llm.common import remainder, small_batches
from litrewise.llm.sampling import lowest_per_class, row_name

# What a dictionary is learned from: at most so many texts of a language, and so many bytes in
# all. Texts of fewer characters than SHORT_TEXT are the second choice.
TEXTS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 96 * 1024
SHORT_TEXT = 40
MOST_LANGUAGES = 256

LEVEL = 6
SHORT_LEVEL = 12
SHORT_BYTES = 400
BLOCK_BYTES = 16 * 1024
# Bits by which the best must beat the second, and bits that make odds of e to 1 of the score.
NARROW_BITS = 16.0
BITS_PER_NAT = 16.0
UNDETERMINED = "und"

# Letters by Unicode class: numbers of any kind are none.
_NOT_LETTERS = regex.compile(r"\P{L}+")


def plain(text: str | None) -> bytes:
    """Lower-case letters in words parted by one space, as UTF-8."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode()


def equal_shares(texts: list[bytes], most: int) -> list[bytes]:
    """The texts cut to one length, the largest with which they have `most` bytes or fewer."""
    left, share = most, most
    for done, size in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - done)
        if size > share:
            break
        left -= size
    return [t[:share] for t in texts]


def learn_dictionaries(labelled: DataFrame, seed: str = "language") -> dict[str, bytes]:
    """A dictionary for each lang of `labelled` (doc_id, text, lang); rows without lang or
    letters teach nothing.

    The driver gets at most TEXTS_PER_LANGUAGE cuts of MOST_LANGUAGES languages, with twice
    DICTIONARY_BYTES characters of each language in all.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select(*row_name(), "lang", "text", (F.length("text") < SHORT_TEXT).alias("short"))
    rows = usable.select("row_id", "digest", "lang", "short").distinct()
    langs = rows.groupBy("lang", "short").agg(F.count(F.lit(1)).alias("n"))
    langs = langs.groupBy("lang").agg(F.sum("n").alias("rows"), F.min(F.struct("short", "n")).alias("best"))
    # One row for each learned language: bounded by the parameter.
    langs = langs.orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).select("lang", "best.short", "best.n")
    chosen = lowest_per_class(
        rows.join(F.broadcast(langs), ["lang", "short"]).select("row_id", "digest", "lang"), "lang", TEXTS_PER_LANGUAGE, seed
    )
    chosen = chosen.join(F.broadcast(langs.select("lang", "n")), "lang")
    # At most TEXTS_PER_LANGUAGE rows of each learned language.
    found = usable.join(F.broadcast(chosen), ["row_id", "digest", "lang"])
    chars = F.ceil(F.lit(2 * DICTIONARY_BYTES) / F.least("n", F.lit(TEXTS_PER_LANGUAGE))).cast("int")
    # The lowest hashes are near 0: their last digits decide the place.
    spot = F.pmod(F.col("_draw"), F.lit(float(1 << 20))) / F.lit(float(1 << 20))
    start = F.floor(spot * F.greatest(F.length("text") - chars, F.lit(0))).cast("int") + 1
    cut = found.select("lang", "row_id", "digest", "_draw", F.substr("text", start, chars).alias("cut"))
    cuts = cut.groupBy("lang", "row_id", "digest", "_draw").agg(F.first("cut").alias("cut")).collect()
    words: dict[str, list[bytes]] = {}
    for row in sorted(cuts, key=lambda r: (r["lang"], r["_draw"], r["row_id"], r["digest"])):
        if found_words := plain(row["cut"]):
            words.setdefault(row["lang"], []).append(found_words + b" ")
    return {lang: b"".join(equal_shares(texts, DICTIONARY_BYTES)) for lang, texts in sorted(words.items())}


class Compressors:
    """The dictionaries, ready to compress with; one object per task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard

        self.languages = sorted(dictionaries)
        self.by_level = {}
        for level in (LEVEL, SHORT_LEVEL):
            self.by_level[level] = []
            for lang in self.languages:
                content = zstandard.ZstdCompressionDict(
                    dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                content.precompute_compress(level=level)
                self.by_level[level].append(
                    zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False)
                )

    def sizes(self, words: bytes) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        use = self.by_level[SHORT_LEVEL if len(words) <= SHORT_BYTES else LEVEL]
        total = np.zeros(len(use))
        for start in range(0, len(words), BLOCK_BYTES):
            block = words[start : start + BLOCK_BYTES]
            total += [len(c.compress(block)) for c in use]
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin in bits."""
        words = plain(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        bits = self.sizes(words) * 8.0
        best = int(np.argmin(bits))
        above = np.sort(bits - bits[best])
        margin = float(above[1]) if len(above) > 1 else float("inf")
        score = 1.0 / float(np.exp(-above / BITS_PER_NAT).sum())
        return self.languages[best], score, margin


PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double, margin_bits double, accepted boolean"


def identify(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """PREDICTION_SCHEMA for every document; reads doc_id and text only, shuffles nothing."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value)
        for batch in small_batches(batches, "text", 16 << 20):
            found = [compressors.predict(t) for t in batch.column("text").to_pylist()]
            langs, scores, margins = zip(*found)
            accepted = [m >= NARROW_BITS for m in margins]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin_bits", "accepted"],
            )

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(predict, PREDICTION_SCHEMA)


def identify_documents(documents: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32 remainder is not 2, predict all of them."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    dictionaries = learn_dictionaries(documents.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(documents, dictionaries).withColumn("held_out", held_out)
