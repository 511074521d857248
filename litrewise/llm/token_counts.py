"""Token counts of the documents in flat token files.

A flat file is one run of fixed-width token ids in which every document ends with a separator;
there is no index, and blocks are cut without regard to documents. Each block is scanned for
separators at once; what a document has in other blocks is added by a prefix scan over the
blocks of its file. The scan has two levels (blocks in stretches, stretches in a file), so
that a file of any number of blocks is never one task. Files that `write_flat` makes are rows of
blocks throughout; raw files, which Spark only hands out whole, may have 2 GB (`read_flat`).

Rows: a null or empty document is a lone separator and counts 0; a null id is kept, and repeated
rows are documents of their own; very long texts and runs of white space are encoded whole;
extra columns are left out. Tokens after a file's last separator
are a document of their own, marked as not ended; an empty block adds nothing; files and
blocks may come in any order. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litrewise.llm.common import small_batches
from litrewise.placement import settle

BLOCK_TOKENS = 1 << 14
STRETCH_BITS = 12
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
TOKEN = np.dtype("<u2")

# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Fixed value: white space as the vocabulary's split takes it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The split's search fails on runs of white space of some 100,000 characters: runs from so many
# characters on are cut out beforehand.
LONG_RUN = 256
_LONG_RUNS = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """A vocabulary file: base64 bytes and rank on each line."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """The vocabulary's tokens of a text, however long its runs of white space are."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.words = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaces = tiktoken.Encoding("spaces", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """As the split takes it, a run of white space is one piece but for its last character,
        which belongs to what follows; at the end of the text the run is one piece whole."""
        tokens: list[int] = []
        start = 0
        for run in _LONG_RUNS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            tokens += self.words.encode_ordinary(text[start : run.start()])
            tokens += self.spaces.encode_ordinary(text[run.start() : end])
            start = end
        return tokens + self.words.encode_ordinary(text[start:])


def write_flat(documents: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode documents into flat files, one for each task, in blocks of `block_tokens`.

    Returns, written to the shared folder: rows of kind `block` (file, seq, data) and of kind
    `document` (file, seq, doc_id), the second being the order of documents in a file.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        file = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        held, blocks, documents_seen = 0, 0, 0
        for batch in small_batches(batches, "text", 4 << 20):
            kinds, seqs, ids, data = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array([*encoder.encode(text or ""), SEPARATOR], dtype=TOKEN)
                kinds.append("document"), seqs.append(documents_seen), ids.append(doc_id), data.append(None)
                documents_seen += 1
                waiting.append(tokens)
                held += len(tokens)
                if held >= block_tokens:
                    flat = np.concatenate(waiting)
                    whole = held - held % block_tokens
                    for start in range(0, whole, block_tokens):
                        kinds.append("block"), seqs.append(blocks), ids.append(None)
                        data.append(flat[start : start + block_tokens].tobytes())
                        blocks += 1
                    waiting, held = [flat[whole:]], held - whole
            yield _rows(file, kinds, seqs, ids, data)
        if held:
            yield _rows(file, ["block"], [blocks], [None], [np.concatenate(waiting).tobytes()])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(narrow.mapInArrow(encode, "file long, kind string, seq long, doc_id long, data binary"))


def _rows(file: int, kinds: list, seqs: list, ids: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * len(kinds), pa.int64()),
            pa.array(kinds, pa.string()),
            pa.array(seqs, pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array(data, pa.binary()),
        ],
        names=["file", "kind", "seq", "doc_id", "data"],
    )


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Blocks (file, seq, data) of raw token files below `path`, read by Spark.

    Spark hands a task one whole file at a time, which is cut there: a file may have 2 GB at most
    and must fit into a task. Longer runs of tokens are written as several files, or as blocks.
    """
    size = block_tokens * width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                view = memoryview(content.as_buffer())
                for seq, start in enumerate(range(0, len(view), size)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()], pa.string()),
                            pa.array([seq], pa.int64()),
                            pa.array([bytes(view[start : start + size])], pa.binary()),
                        ],
                        names=["file", "seq", "data"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, seq long, data binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, token: np.dtype = TOKEN) -> DataFrame:
    """Per block: n_tokens, n_ends (separators), head (tokens before the first), last (place of
    the last, -1 if none) and inner (lengths between neighbouring separators)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, heads, lasts, inner = [], [], [], [], []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer(), dtype=token) if data.is_valid else np.zeros(0, token)
                at = np.flatnonzero(tokens == separator)
                sizes.append(len(tokens)), ends.append(len(at))
                heads.append(int(at[0]) if len(at) else len(tokens))
                lasts.append(int(at[-1]) if len(at) else -1)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("seq"),
                    *[pa.array(x, pa.int64()) for x in (sizes, ends, heads, lasts)],
                    pa.array(inner, pa.list_(pa.int64())),
                ],
                names=["file", "seq", "n_tokens", "n_ends", "head", "last", "inner"],
            )

    kind = blocks.schema["file"].dataType.simpleString()
    schema = f"file {kind}, seq long, n_tokens long, n_ends long, head long, last long, inner array<long>"
    return blocks.select("file", "seq", "data").mapInArrow(scan, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """file, ordinal (from 0), n_tokens and ended of every document, from `scan_blocks`."""
    rows = scanned.withColumn("stretch", F.shiftright("seq", STRETCH_BITS))
    inside = Window.partitionBy("file", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # Places and counts within the stretch first.
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.sum("n_ends").over(inside), F.lit(0)))
    own_last = F.when(F.col("last") >= 0, F.col("start") + F.col("last"))
    rows = rows.withColumn("own_last", own_last).withColumn("seen_last", F.max("own_last").over(inside))
    sums = scanned.withColumn("stretch", F.shiftright("seq", STRETCH_BITS))
    # The last separator of a stretch, as its distance from the stretch's end.
    last_block = F.max(F.when(F.col("last") >= 0, F.struct("seq", (F.col("n_tokens") - F.col("last")).alias("to_end"))))
    sums = sums.groupBy("file", "stretch").agg(
        F.sum("n_tokens").alias("tokens"), F.sum("n_ends").alias("ends"), last_block.alias("mark")
    )
    after_mark = scanned.withColumn("stretch", F.shiftright("seq", STRETCH_BITS)).join(
        sums.select("file", "stretch", F.col("mark.seq").alias("mark_seq")), ["file", "stretch"]
    )
    rest = after_mark.filter("seq > mark_seq").groupBy("file", "stretch").agg(F.sum("n_tokens").alias("rest"))
    sums = sums.join(rest, ["file", "stretch"], "left")
    behind = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("file_start", F.coalesce(F.sum("tokens").over(behind), F.lit(0)))
    sums = sums.withColumn("file_before", F.coalesce(F.sum("ends").over(behind), F.lit(0)))
    end = F.col("file_start") + F.col("tokens")
    place = F.when(
        F.col("mark").isNotNull(), end - F.coalesce("rest", F.lit(0)) - F.col("mark.to_end")
    )
    sums = sums.withColumn("place", place).withColumn("file_last", F.max("place").over(behind))
    starts = sums.select("file", "stretch", "file_start", "file_before", "file_last")
    joined = rows.join(starts, ["file", "stretch"])
    previous = F.coalesce(F.col("file_start") + F.col("seen_last"), F.col("file_last"), F.lit(-1))
    first = F.col("file_start") + F.col("start") - previous - 1 + F.col("head")
    ended = joined.filter("n_ends > 0").select(
        "file",
        (F.col("file_before") + F.col("before")).alias("base"),
        F.posexplode(F.concat(F.array(first), "inner")).alias("i", "n_tokens"),
    )
    ended = ended.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    files = sums.groupBy("file").agg(
        F.sum("ends").alias("ordinal"), F.sum("tokens").alias("all"), F.max("place").alias("place")
    )
    open_tokens = F.col("all") - F.coalesce(F.col("place"), F.lit(-1)) - 1
    open_ends = files.select("file", "ordinal", open_tokens.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_ends.filter("n_tokens > 0"))


def count_flat(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, n_tokens, ended for the documents of flat files given as blocks."""
    return stitch(settle(scan_blocks(blocks, separator)))


def count_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat files written from them."""
    written = write_flat(documents, vocabulary)
    blocks = written.filter("kind = 'block'").select("file", "seq", "data")
    order = written.filter("kind = 'document'").select("file", F.col("seq").alias("ordinal"), "doc_id")
    counted = count_flat(blocks)
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
