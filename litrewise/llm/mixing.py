"""Mixing sources to target weights by Pareto order sampling.

A source that is to give `e` times its words gives `floor(e)` whole copies of every document
for certain; the rest is a fixed-size sample without replacement. A document's inclusion odds
are the source's base odds times the document's preference. Its rank is the odds of a uniform
draw divided by its inclusion odds, and the documents of lowest rank are taken until their
words are as near the rest as whole documents allow.

Finding where to stop needs no sorted pass over a source: ranks are 52-bit numbers, and the
words below each digit are summed digit by digit, so that a task gets at most 8192 sums of
one source however many documents it has.

Rows: a null text has size 0 and is taken as often as any document of its source (no words);
a null source is a source of its own, last in order; a null id draws as an empty text would.
Equal rows are grouped and numbered, and each number draws for itself, so that repeated rows are
taken by ones like any others. In `mix_documents` rows that differ in other columns than id,
source and text only draw alike. Extra columns are kept there. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litrewise.llm.common import uniform
from litrewise.placement import fits_broadcast, settle

# Fixed values of the mix: weights repeat over the ordered sources.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"

RANK_BITS = 52
DIGIT_BITS = 13
SHORT = 100.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key in which no source looks like a missing one."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def preference(size: Column) -> Column:
    """Odds factor of a document: near 1, less for texts of a few dozen words."""
    return (size + F.lit(1.0)) / (size + F.lit(SHORT))


def source_targets(
    sources: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """Words each source is to give: its weight's part of `share` of all words, at most `most`
    times its own, with what is above shared anew by weight until nothing is above.

    `sources` has source, key and source_size, one row per source. Sources fill up in the
    order of size per weight, so the final level follows from running sums. The sums run over
    one row per source, not over documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0)
    )
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("cap_rank", "level"))
    rows = rows.withColumn("cap_rank", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("final", F.min(free).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return rows.select("source", "key", "source_size", target.alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """All rows, equal ones told apart by `_copy` from 0. They are counted before the shuffle and
    given out again, so that no task gets all copies of a row as rows."""
    columns = rows.columns
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy")
    return groups.select(*columns, copies)


def with_rank(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Add key and the draw's odds divided by the preference (as `draw`) to numbered rows with
    doc_id, source, size and digest."""
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("_copy").cast("string"), F.lit(seed))
    u = uniform(name)
    return rows.withColumn("key", source_key(F.col("source"))).withColumn(
        "draw", (u / (F.lit(1.0) - u)) / preference(F.col("size"))
    )


def text_columns() -> dict[str, Column]:
    """What a draw needs of a text: its size and a digest."""
    text = F.col("text")
    return {"size": word_count(text), "digest": F.md5(F.coalesce(text, F.lit("")).cast("binary"))}


def rank_number(draw: Column, fraction: Column) -> Column:
    """The Pareto rank as a whole number of RANK_BITS bits, in the same order (null where
    nothing is sampled)."""
    rank = F.try_divide(draw, fraction / (F.lit(1.0) - fraction))
    return F.least(
        F.floor(rank / (rank + F.lit(1.0)) * F.lit(float(2**RANK_BITS))),
        F.lit(2**RANK_BITS - 1),
    )


def attach(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join one row per source; broadcast only if its measured size allows it."""
    small = F.broadcast(per_source) if fits_broadcast(per_source) else per_source
    return rows.join(small, "key")


def sample_cuts(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: certain copies, the sampled fraction, and the last rank that is taken."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(copies)
    plans = settle(
        targets.withColumn("whole", whole)
        .withColumn("fraction", copies - whole)
        .withColumn("rest", F.col("target") - whole * F.col("source_size"))
    )
    drawn = plans.filter("fraction > 0 and rest > 0").select("key", "fraction", "rest")
    state = drawn.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    sized = ranked.filter("size > 0").select("key", "size", "draw")
    for used in range(0, RANK_BITS, DIGIT_BITS):
        shift = RANK_BITS - used - DIGIT_BITS
        rows = attach(sized, state).withColumn("rank", rank_number(F.col("draw"), F.col("fraction")))
        rows = rows.filter(F.shiftright("rank", shift + DIGIT_BITS) == F.col("prefix"))
        sums = rows.groupBy(
            "key", "fraction", "rest", "below", F.shiftright("rank", shift).alias("next_prefix")
        ).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("key").orderBy("next_prefix")
        sums = sums.withColumn("upto", F.col("below") + F.sum("words").over(running))
        crossing = F.min(F.when(F.col("upto") >= F.col("rest"), F.col("next_prefix")))
        last = F.max("next_prefix")
        found = sums.withColumn(
            "chosen", F.coalesce(crossing.over(Window.partitionBy("key")), last.over(Window.partitionBy("key")))
        ).filter(F.col("next_prefix") == F.col("chosen"))
        state = settle(
            found.select(
                "key",
                "fraction",
                "rest",
                F.col("chosen").alias("prefix"),
                (F.col("upto") - F.col("words")).alias("below"),
                "upto",
            )
        )
        if shift:
            state = state.drop("upto")
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("below")
    cuts = state.select("key", (F.col("prefix") - F.when(nearer, 0).otherwise(1)).alias("cut"))
    return plans.join(cuts, "key", "left").select(
        "key", "source_size", "target", "whole", "fraction", F.coalesce("cut", F.lit(-1)).alias("cut")
    )


def with_copies(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add source_size, target and copies: how often the mix takes the document."""
    rows = attach(ranked, cuts)
    sampled = (F.col("fraction") > 0) & (rank_number(F.col("draw"), F.col("fraction")) <= F.col("cut"))
    copies = F.col("whole") + F.when(sampled, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int"))


def plan_mix(documents: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The narrow ranked rows (written once) and the decisions per source."""
    narrow = documents.select("doc_id", "source", *[c.alias(n) for n, c in text_columns().items()])
    ranked = settle(with_rank(numbered(narrow), seed).select("doc_id", "source", "size", "key", "draw"))
    sources = ranked.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    return ranked, settle(sample_cuts(ranked, source_targets(sources)))


def mix_sizes(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) per document."""
    ranked, cuts = plan_mix(documents, seed)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return with_copies(ranked, cuts).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies"
    )


def mix_documents(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    _, cuts = plan_mix(documents, seed)
    rows = numbered(documents.select(F.struct(*documents.columns).alias("_row")))
    parts = rows.select("_row", "_copy", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "source", "text")])
    drawn = with_rank(parts.withColumns(text_columns()).drop("text"), seed)
    repeated = with_copies(drawn, cuts).filter("copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_time")
    )
    return repeated.select("_row.*")
