"""Sharding by a hierarchical weighted hash tree.

Every row walks down a tree of regions, racks and shards. A shard draws a number from the row's
key and its own name, an exponential draw divided by its weight; a rack's draw is the least of its
shards' and a region's the least of its racks', which are exponential draws for the sums of their
weights. At each level the smallest draw wins, so a child is taken in proportion to the weight below
it. A change of one weight, and a new shard in whatever rack, moves rows only into or out of that
shard: the draws of all others stay. So one law holds for any number of shards, and `shards + 1`
differs from `shards` by rows that move into the new shard.

Rows: a null key is hashed as an empty text; rows with equal keys go to the same shard; equal rows
are numbered as one group; extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litrewise.llm.common import hex_number, uniform
from litrewise.placement import fits_broadcast, settle

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
SLOT_BITS = 12


@dataclass(frozen=True)
class Node:
    """A shard with its weight, or a region or rack with `children`; names are unique."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None


def uniform_tree(shards: int) -> tuple[Node, ...]:
    """Regions of two racks of four equal shards; the last of each may be partly filled."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    racks = []
    for first in range(0, shards, SHARDS_PER_RACK):
        own = range(first, min(first + SHARDS_PER_RACK, shards))
        racks.append(Node(f"rack{first // SHARDS_PER_RACK}", children=tuple(Node(f"shard{s}", shard=s) for s in own)))
    regions = []
    for first in range(0, len(racks), RACKS_PER_REGION):
        own_racks = tuple(racks[first : first + RACKS_PER_REGION])
        regions.append(Node(f"region{first // RACKS_PER_REGION}", children=own_racks))
    return tuple(regions)


def node_draw(key: Column, node: Node) -> Column:
    """The least draw below `node` and the shard that has it."""
    if node.shard is not None:
        draw = -F.ln(uniform(F.concat(key, F.lit(f"/{node.name}")))) / F.lit(node.weight)
        return F.struct(draw.alias("draw"), F.lit(node.shard).alias("shard"))
    return choose(key, node.children)


def choose(key: Column, level: tuple[Node, ...]) -> Column:
    """The winner among the nodes of `level`: its draw and the shard below it."""
    draws = [node_draw(key, node) for node in level]
    return draws[0] if len(draws) == 1 else F.array_min(F.array(*draws))


def shard_of(key: Column, tree: tuple[Node, ...]) -> Column:
    return choose(F.coalesce(key.cast("string"), F.lit("")), tree)["shard"]


def with_slots(rows: DataFrame, key: Column) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a hash of all columns.

    Equal rows are counted first and numbered as a group, so that a repeated row is never one
    task. A shard is not one either: the leading bits of the hash cut it into `2**SLOT_BITS`
    parts, whose counts are summed; rows are ranked inside their part only. The hash is of the key
    and what else the row has, so that rows without a key, or under one, spread over the parts.
    """
    from pyspark.sql import Window

    columns = rows.columns
    others = [F.col(c).cast("string") for c in columns if c != "shard"]
    hashed = hex_number(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), *others))
    part = F.floor(F.col("_hash") / F.lit(float(2 ** (52 - SLOT_BITS)))).cast("int")
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    groups = settle(groups.withColumn("_hash", hashed).withColumn("_part", part))
    counts = groups.groupBy("shard", "_part").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("shard", "_part").orderBy("_hash", *columns)
    place = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.withColumn("_rank", place)
    # At most shards x 2**SLOT_BITS rows, whatever the table's size; measured all the same.
    joined = ranked.join(F.broadcast(starts) if fits_broadcast(starts) else starts, ["shard", "_part"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy")
    numbered = joined.select(*columns, "_start", "_rank", copies)
    return numbered.withColumn("slot", F.col("_start") + F.col("_rank") + F.col("_copy")).drop("_start", "_rank", "_copy")


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    `size` is the number of UTF-8 bytes of the text (null: none) plus 1. The text itself
    is not shuffled. `grown_shard` is the place with one more shard.
    """
    text = F.col("text").cast("binary")
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    placed = narrow.withColumn("shard", shard_of(F.col("doc_id"), uniform_tree(shards)))
    numbered = with_slots(placed, F.col("doc_id"))
    grown = shard_of(F.col("doc_id"), uniform_tree(shards + 1))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
