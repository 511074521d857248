"""Repair of the structure of conversations: faulty rows found, cheapest edits to legal turns.

Rows are taken by turn (null first), then role and MD5 of the text; equal rows are one entry with
a count, so that repeated rows are gathered before any shuffle. Entries are dealt by ranges of
(conversation, place), so that one long conversation spreads over many tasks, and cut into chunks
of CHUNK entries. Each chunk is one step of `block_tables`, found by block lookups. A pass over
the steps of a conversation, without its rows, tells each chunk the cost vector behind it and
the state before it; the chunks are then expanded to edits independently.

Texts stay aside until the edits are known: the rows that stay fetch theirs, one row for each
distinct text. Only the digest of a repaired conversation is a chain over all of its text, which
streams through one task in sorted order and constant memory.

Nulls in conv_id, role and text are one space wherever they are text; a null conv_id is a
conversation of its own. A role counts by its first character; an empty role can only be deleted
or changed. Empty texts are blank. Conversations without rows have zeros, no edits and no text.
Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litrewise.llm.block_tables import (
    FOLLOWING,
    INITIALS,
    MUST_GO,
    NEW_ROLE,
    START,
    Step,
    closing,
    composed,
    expanded,
    symbol_of,
    tables,
)
from litrewise.placement import settle

CHUNK = 4096
# White space, closing marks, and the neighbours that are legal.
SPACE = " \t\n\x0b\x0c\r"
CLOSING_MARKS = ".!?"
LEGAL = ("su", "ua", "au")

ENTRY = ["key", "has_turn", "turn", "role", "digest"]
COUNTS = ("blank", "duplicate", "truncated", "illegal")

_CHUNK_ROW = (
    "key string, part int, seq long, symbols binary, entries array<struct<has_turn: boolean, turn: bigint, "
    "role: string, digest: string, n: bigint>>, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, lowest long, highest long, turns long, vector binary, growth binary, leaves binary"
)
_SCAN_ROW = (
    "key string, part int, seq long, after int, state int, is_last boolean, cost long, blank long, "
    "duplicate long, truncated long, illegal long, gaps long"
)
_EDIT_ROW = (
    "key string, part int, seq long, audit string, turns array<struct<place: bigint, edit: string, "
    "has_turn: boolean, turn: bigint, old_role: string, digest: string, role: string>>"
)


class Repaired(NamedTuple):
    """`summary`: conv_id with counts, cost and audit; `turns`: key, part, seq and place (the
    order within a conversation), edit, role and text of each row after repair."""

    summary: DataFrame
    turns: DataFrame


def conversation_key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "0").otherwise(F.concat(F.lit("1"), conv_id.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of rows with faults put in by a checksum of
    conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    damaged = F.when(fault == 1, "").when(fault == 2, F.translate(text, CLOSING_MARKS, "")).otherwise(text)
    return rows.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        damaged.alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(SPACE))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(
        conversation_key(F.col("conv_id")).alias("key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
        (trimmed == "").alias("is_blank"),
        (~F.right(trimmed, F.lit(1)).isin(list(CLOSING_MARKS))).alias("is_cut"),
        copies.cast("long").alias("copies"),
    )


def _entries(marked: DataFrame) -> DataFrame:
    """One row per different row of a conversation: n, is_blank, is_cut and whether no earlier
    row has its role and text."""
    entries = marked.groupBy(*ENTRY, "is_blank", "is_cut").agg(F.sum("copies").alias("n"))
    same = ["key", "role", "digest"]
    earliest = entries.groupBy(*same).agg(F.min(F.struct("has_turn", "turn")).alias("earliest"))
    new = F.struct("has_turn", "turn") == F.col("earliest")
    return entries.join(earliest, same).withColumn("is_new", new).drop("earliest")


def _chunk(key: str, part: int, seq: int, rows: pa.Table) -> dict:
    entries = rows.select(["has_turn", "turn", "role", "digest", "n"]).to_pylist()
    flags = list(zip(*[rows.column(c).to_pylist() for c in ("is_blank", "is_cut", "is_new")]))
    symbols, counts = [], dict.fromkeys(COUNTS, 0)
    previous = None
    for entry, (blank, cut, new) in zip(entries, flags):
        initial, n = entry["role"][:1], entry["n"]
        counts["blank"] += n if blank else 0
        counts["duplicate"] += 0 if blank else n - new
        counts["truncated"] += bool(not blank and new and cut)
        if previous is not None:
            counts["illegal"] += previous + initial not in LEGAL
        counts["illegal"] += n - 1
        previous = initial
        symbols.append(symbol_of(initial, cut) if new and not blank else MUST_GO)
    step = composed(np.array(symbols))
    # The other copies of an entry can only be deleted, which leaves all else as it is.
    others = sum(e["n"] - 1 for e in entries)
    turns = [e["turn"] for e in entries if e["has_turn"]]
    return {
        "key": key, "part": part, "seq": seq, "symbols": bytes(symbols), "entries": entries, **counts,
        "first": entries[0]["role"][:1], "last": previous, "lowest": turns[0] if turns else None,
        "highest": turns[-1] if turns else None, "turns": len(set(turns)), "vector": step.vector.tobytes(),
        "growth": (step.growth + 4 * others).astype("<i8").tobytes(), "leaves": step.leaves.tobytes(),
    }


def _key_stretches(batches: Iterable[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal `keys`, from batches sorted by them, in tables of `most` rows or fewer."""
    waiting: list[pa.RecordBatch] = []
    held, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i < batch.num_rows and named[i] == named[start] and i - start < most:
                continue
            if waiting and (named[start] != last or held + i - start > most):
                yield last, pa.Table.from_batches(waiting)
                waiting, held = [], 0
            waiting.append(batch.slice(start, i - start))
            held, last = held + i - start, named[start]
            start = i
    if waiting:
        yield last, pa.Table.from_batches(waiting)


def _as_batches(rows: Iterable[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == most:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _chunks(entries: DataFrame, most: int) -> DataFrame:
    """Ranges of sorted entries cut into chunks; (part, seq) is their order."""
    ranged = entries.repartitionByRange(*ENTRY).sortWithinPartitions(*ENTRY)
    schema = _arrow(_CHUNK_ROW)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = _key_stretches(batches, ["key", "part"], most)
        yield from _as_batches((_chunk(k, p, seq, rows) for seq, ((k, p), rows) in enumerate(stretches)), schema, 64)

    return settle(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(cut, _CHUNK_ROW))


def _scanned(key: str, chunks: Iterator[dict]) -> Iterator[dict]:
    """What each chunk of a conversation has to know of the others, from the last chunk to the
    first; a chunk leaves 4 states and its place in memory."""
    vectors = tables().vectors
    after, cost = 0, 0
    totals = dict.fromkeys(COUNTS, 0)
    places: list[tuple[int, int, int]] = []
    leaves: list[bytes] = []
    following = lowest = highest = None
    turns = 0
    for row in chunks:
        n = len(vectors)
        step = Step(
            np.frombuffer(row["vector"], np.uint8),
            np.frombuffer(row["growth"], "<i8"),
            np.frombuffer(row["leaves"], np.uint8).reshape(n, 4),
        )
        places.append((row["part"], row["seq"], after))
        leaves.append(step.leaves[after].tobytes())
        cost += int(step.growth[after])
        after = int(step.vector[after])
        for c in COUNTS:
            totals[c] += row[c]
        if following is not None:
            totals["illegal"] += row["last"] + following not in LEGAL
        following = row["first"]
        if row["turns"]:
            # Entries of one turn may lie in two chunks.
            turns += row["turns"] - (lowest is not None and row["highest"] == lowest)
            lowest, highest = row["lowest"], row["highest"] if highest is None else highest
    cost += int(vectors[after][START])
    gaps = 0 if lowest is None else highest - lowest + 1 - turns
    state = START
    for i in range(len(places) - 1, -1, -1):
        part, seq, behind = places[i]
        whole = {"cost": cost, "gaps": gaps, **totals} if i == 0 else {}
        yield {"key": key, "part": part, "seq": seq, "after": behind, "state": state, "is_last": i == 0, **whole}
        state = leaves[i][state]


def _scan(chunks: DataFrame) -> DataFrame:
    narrow = chunks.drop("symbols", "entries").repartition("key")
    ordered = narrow.sortWithinPartitions("key", F.desc("part"), F.desc("seq"))
    schema = _arrow(_SCAN_ROW)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (row for batch in batches for row in batch.to_pylist())
        found = (r for key, own in groupby(rows, key=lambda r: r["key"]) for r in _scanned(key, own))
        yield from _as_batches(found, schema)

    return ordered.mapInArrow(scan, _SCAN_ROW)


def _edited(row: dict) -> dict:
    """The audit of a chunk and the turns that it gives."""
    edits, state = expanded(np.frombuffer(row["symbols"], np.uint8), row["after"], row["state"])
    at, audit, turns = row["state"], [], []

    def turn(edit: str, role: str, entry: dict | None) -> None:
        own = {"has_turn": None, "turn": None, "old_role": None, "digest": None}
        if entry is not None:
            own = {"has_turn": entry["has_turn"], "turn": entry["turn"], "old_role": entry["role"], "digest": entry["digest"]}
        turns.append({"place": len(turns), "edit": edit, "role": role, **own})

    for letters, entry in zip(edits, row["entries"]):
        audit.append(letters + "D" * (entry["n"] - 1))
        for letter in letters:
            if letter == "I":
                turn("I", NEW_ROLE[at], None)
                at = FOLLOWING[at]
            elif letter == "R":
                turn("R", NEW_ROLE[at], entry)
                at = FOLLOWING[at]
            elif letter == "K":
                turn("K", entry["role"], entry)
                at = 1 + (0, 2, 1)[INITIALS.index(entry["role"][0])]
    if row["is_last"]:
        for letter in closing(state):
            audit.append(letter)
            turn("I", NEW_ROLE[at], None)
            at = FOLLOWING[at]
    return {"key": row["key"], "part": row["part"], "seq": row["seq"], "audit": "".join(audit), "turns": turns}


def _edits(chunks: DataFrame, scanned: DataFrame) -> DataFrame:
    schema = _arrow(_EDIT_ROW)

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _as_batches((_edited(row) for batch in batches for row in batch.to_pylist()), schema, 64)

    known = scanned.select("key", "part", "seq", "after", "state", "is_last")
    rows = chunks.select("key", "part", "seq", "symbols", "entries").join(known, ["key", "part", "seq"])
    return settle(rows.mapInArrow(edit, _EDIT_ROW))


def _with_texts(edits: DataFrame, marked: DataFrame) -> DataFrame:
    turns = edits.select("key", "part", "seq", F.explode("turns").alias("t")).select("key", "part", "seq", "t.*")
    place = ["key", "part", "seq", "place", "edit"]
    texts = marked.groupBy(*ENTRY).agg(F.first("text").alias("text"))
    own = turns.filter("digest is not null").withColumnRenamed("role", "new_role").withColumnRenamed("old_role", "role")
    own = own.join(texts, ENTRY).select(*place, F.col("new_role").alias("role"), "text")
    return own.unionByName(turns.filter("digest is null").select(*place, "role", F.lit("").alias("text")))


def repair_conversations(rows: DataFrame, *, chunk: int = CHUNK) -> Repaired:
    """Repair `rows` (conv_id, turn, role, text and, if given, copies: how often a row stands)."""
    marked = _marked(rows)
    chunks = _chunks(_entries(marked), chunk)
    scanned = settle(_scan(chunks))
    edits = _edits(chunks, scanned)
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "")
    audits = edits.groupBy("key").agg(audit.alias("audit"))
    summary = scanned.filter("is_last").select("key", "gaps", *COUNTS, "cost").join(audits, "key")
    ids = rows.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    return Repaired(ids.join(summary, "key"), _with_texts(edits, marked))


def text_digests(turns: DataFrame) -> DataFrame:
    """key and repaired_sha256: of `role:text` of all turns in order, joined by line breaks."""
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    lines = turns.select("key", "part", "seq", "place", line).repartition("key")
    lines = lines.sortWithinPartitions("key", "part", "seq", "place").select("key", "line")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

        def rows() -> Iterator[dict]:
            last, state = None, None
            for batch in batches:
                for key, text in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                    if key != last:
                        if last is not None:
                            yield {"key": last, "repaired_sha256": state.hexdigest()}
                        last, state = key, hashlib.sha256(text)
                    else:
                        state.update(b"\n" + text)
            if last is not None:
                yield {"key": last, "repaired_sha256": state.hexdigest()}

        yield from _as_batches(rows(), schema, 1000)

    return lines.mapInArrow(digest, "key string, repaired_sha256 string")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage all conversations and repair them: one row per original conv_id."""
    repaired = repair_conversations(damage(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    rows = ids.join(repaired.summary.drop("conv_id"), "key", "left").join(text_digests(repaired.turns), "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256")
    )
