"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the `k` smallest distinct 64-bit hashes of a text's shingles
(five words, letters and digits only, lower case). Sketches of parts merge into the sketch of
the whole, and two sketches estimate resemblance, containment and distinct shingle counts.

Rows: a null text counts as empty; a text of one to four words has one shingle of all its
words; a text without words has an empty sketch, which resembles empty sketches only.
Equal texts have equal sketches. Rows of one id, or without, follow each other by checksum and
text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_SIZE = 256
SHINGLE_WORDS = 5
WORDS = r"[\p{L}\p{N}]+"
ROWS_PER_PART = 500
COARSE_PARTS = 1000
MAX_PARTS = 1_000_000  # above 500 million rows a part is a millionth of the table


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))

    def hashes(w: Column) -> Column:
        slide = F.transform(
            F.sequence(F.lit(0), F.size(w) - words),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]),
        )
        short = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(F.xxhash64(w))
        )
        return F.when(F.size(w) < words, short).otherwise(slide)

    return bound(F.transform(found, lambda word: F.xxhash64(word)), hashes)


def lowest(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = SKETCH_SIZE) -> Column:
    return lowest(shingle_hashes(text), k)


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Exact below `k` hashes, else estimated from the largest one kept."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sketches."""

    def of(both: Column) -> Column:
        u = both[0]
        common = F.size(F.array_intersect(u, F.array_intersect(a, b)))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common / F.size(u))

    return bound(F.array(merged(a, b, k)), of)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the shingles of `a` that `b` has; 1 if `a` has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    part = F.least(F.lit(1.0), shared / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(part)


def merge_groups(rows: DataFrame, keys: list[str], column: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per group. Hashes are made distinct and cut to `k` on every task before and
    after the shuffle, so that a large group costs no more than a small one."""
    hashes = rows.select(*keys, F.explode(column).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    kept = hashes.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def written(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def tie_of(documents: DataFrame, most: int) -> Column:
    """What parts may cut rows of one id by: the checksum of the text if some id (or the lack of
    one) has more than `most` rows, else a constant, so that the passes that find the parts read
    no texts."""
    counts = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    crowded = (counts.agg(F.max("n")).first()[0] or 0) > most
    return F.crc32(F.col("text").cast("binary")) if crowded else F.lit(0).cast("long")


def part_of(documents: DataFrame, tie: Column, rows: int, rows_per_part: int = ROWS_PER_PART) -> Column:
    """A number that rises with (doc_id, tie) and cuts the table into parts of about equal size.

    Quantiles (at most COARSE_PARTS numbers) cut it coarsely, even steps between two
    quantiles finely. Null ids come last, as if they were one more than the largest.
    """
    parts = max(1, min(MAX_PARTS, -(-rows // rows_per_part)))
    coarse = min(parts, COARSE_PARTS)
    fine = -(-parts // coarse)
    largest = documents.agg(F.max("doc_id")).first()[0] or 0
    # Rounding keeps the order: beyond 2 ** 53 a fraction never reaches the next number.
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(largest) + 1.0)) + tie / F.lit(2.0**32)
    at = [i / coarse for i in range(coarse + 1)]
    found = documents.select(F.percentile_approx(place, at, 10_000).alias("q")).first()["q"]
    if not found:
        return F.lit(0).cast("long")
    bounds = sorted(set(found))
    edges = F.array(*[F.lit(b) for b in bounds])

    def placed(n: Column) -> Column:
        low = F.element_at(edges, F.greatest(n, F.lit(1)))
        high = F.element_at(edges, F.least(n + 1, F.lit(len(bounds))))
        width = F.when(high > low, high - low).otherwise(F.lit(1.0))
        step = F.floor((place - low) / width * F.lit(float(fine)))
        return n.cast("long") * fine + F.least(F.greatest(step, F.lit(0)), F.lit(fine - 1))

    return bound(F.size(F.filter(edges, lambda b: b <= place)), placed)


def with_next(documents: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """doc_id, text, own (the text's sketch), next_text and following: text and sketch of the next
    document in the order of doc_id (without one last), then of the text's CRC-32, then of the
    text; the first after the last.

    No task gets the whole order: a part is ranked alone, and the first document of each part
    (a few narrow rows, found from the ids) is sent to the part before as a guest. Rows without
    id, and those of a crowded id, are cut into parts as well; only rows equal in both id and
    checksum stay together. Each text is sketched once, where its part is.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = docs.count()
    tie = tie_of(docs, max(rows_per_part, -(-rows // MAX_PARTS)))
    docs = docs.withColumn("part", part_of(docs, tie, rows, rows_per_part)).withColumn("tie", tie)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    firsts = docs.groupBy("part").agg(F.min(key).alias("first"))
    order = Window.orderBy("part")  # one row per part, a few times MAX_PARTS at most
    last = F.max("part").over(Window.partitionBy())
    hosts = firsts.select("part", "first", F.coalesce(F.lag("part").over(order), last).alias("host"))
    marked = docs.join(F.broadcast(hosts), "part", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    own = F.struct(F.col("part").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    places = F.when(is_first, F.array(own, guest)).otherwise(F.array(own))
    dealt = marked.select("doc_id", "text", F.explode(places).alias("place")).select(
        "doc_id", "text", "place.*"
    )
    sketched = dealt.repartition("at").withColumn("own", sketch(F.col("text")))
    checksum = F.crc32(F.col("text").cast("binary"))
    inside = Window.partitionBy("at").orderBy("guest", F.col("doc_id").asc_nulls_last(), checksum, "text")
    return (
        sketched.withColumns({"next_text": F.lead("text").over(inside), "following": F.lead("own").over(inside)})
        .filter(~F.col("guest"))
        .drop("at", "guest")
    )


def fingerprint_documents(documents: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how much they resemble.

    In the edited text the last quarter of the code points is replaced by the first as many
    of the next document.
    """
    rows = with_next(documents, rows_per_part).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.col("n_chars").cast("int") - cut
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        sketch(F.col("edited")).alias("changed"),
        "following",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("following")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("distinct_shingles"),
        containment(F.col("own"), F.col("changed")).alias("contained_in_edited"),
    )
