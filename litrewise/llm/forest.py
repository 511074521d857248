"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text is the set of its five-word shingles; equal sets are one node from the start. Every
node has a signature of minimum hashes in each of TREES prefix tries. Two nodes meet in a trie if
they share the prefix that one of them matches there. All prefixes start at LONGEST_PREFIX values
and are shortened, a level at a time, until a partner of the threshold's similarity is met with
the target probability: first the whole forest, as far as every node needs it, then node by node
and trie by trie, where the shorter prefix is not crowded. A node in a crowd (as of pages with one
template) so keeps its long prefixes in the crowded tries and is found by the others; only if
these are too few it takes on crowds, the smallest first. Up to CROWD nodes the choice goes by the
number of the trie and not by who is met there, as the recall would not hold otherwise.

Only nodes that met are compared, on their whole sets: the nodes under one prefix are a unit, cut
into blocks of bounded size, and each pair of blocks is a task's group, which counts common
shingles with matrix products. A pair that meets in several tries counts in the first of them; a
unit of the same nodes as one of an earlier trie, in which all of them met, is left out. No pair
of documents becomes a row, and a chain of nodes that each meet the next makes many small units.

Rows: a text with fewer than five words has one shingle of all its words; null, empty and
wordless texts have none and are linked to nothing, not to each other. Case, punctuation and
spacing do not matter. Rows are documents: repeated rows are copies of each other, and one of
them is compared. A null doc_id is kept; a class is named by its smallest non-null doc_id, and has a
null name if none of its documents has an id. Documents with one doc_id, or none, are told apart by
a 128-bit digest of their texts. Extra columns are kept by `keep_one`. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litrewise.llm.common import small_batches, sorted_groups
from litrewise.llm.components import components
from litrewise.placement import settle

SHINGLE_WORDS = 5
THRESHOLD = (4, 5)  # numerator and denominator of the least similarity
TREES = 20
LONGEST_PREFIX = 4
TARGET_RECALL = 0.99999
CROWD = 64
BLOCK_SHINGLES = 300_000
LEAST_WEIGHT = 400  # a document counts as this many shingles at least: bounds a block's rows
# What bounds a Python worker's memory: bytes of text taken at once, and words remembered.
BATCH_BYTES = 2 << 20
MOST_WORDS = 100_000
COLUMNS = 2048
PAIR_ROWS = 64

_WORD = re.compile(r"\w+")
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Plan(NamedTuple):
    """The level that every node needs, and in how many tries it needs one value less."""

    length: int
    shorter: int


def prefix_plan(
    threshold: float = THRESHOLD[0] / THRESHOLD[1],
    trees: int = TREES,
    longest: int = LONGEST_PREFIX,
    target: float = TARGET_RECALL,
) -> Plan:
    """Shorten the matched prefixes from `longest`, trie by trie and level by level, until sets of
    the threshold's similarity meet in one of the tries with probability `target` or more."""
    for length in range(longest, 0, -1):
        for shorter in range(trees if length > 1 else 1):
            missed = (1.0 - threshold**length) ** (trees - shorter) * (1.0 - threshold ** (length - 1)) ** shorter
            if 1.0 - missed >= target:
                return Plan(length, shorter)
    raise ValueError("too few trees for this recall")


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self[word] = value
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    size = min(SHINGLE_WORDS, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            total = total * _P1 + h[k : len(h) - size + 1 + k]
            total ^= total >> np.uint64(31)
        total *= _P2
        total ^= total >> np.uint64(29)
    return np.unique(total)


_rng = np.random.default_rng(23)
_FACTORS = _rng.integers(0, 2**63, TREES * LONGEST_PREFIX, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**64, TREES * LONGEST_PREFIX, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum hashes, TREES rows of LONGEST_PREFIX."""
    lowest = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(found), 4096):
            x = found[a : a + 4096, None] * _FACTORS + _OFFSETS
            x ^= x >> np.uint64(32)
            np.minimum(lowest, x.min(axis=0), out=lowest)
    return lowest.reshape(TREES, LONGEST_PREFIX)


def prefix_keys(signature_: np.ndarray, length: int) -> np.ndarray:
    """One number for the first `length` values of each tree."""
    key = np.arange(1, TREES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            key = (key ^ signature_[:, k]) * _P3
            key ^= key >> np.uint64(30)
    return key


def _tie(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode())


def _digest(text: str | None) -> bytes:
    """128 bits; `_text_digest` has the same for a column."""
    return hashlib.sha256((text or "").encode()).digest()[:16]


def _text_digest() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32))


def signed(documents: DataFrame, length: int) -> DataFrame:
    """doc_id, tie, digest, node (a digest of the shingle set; null for none), n_shingles, keys (a
    number for the prefix of `length` values in each trie) and stems (for one value less)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ties, digests, nodes, counts, keys, stems = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, hashes)
                ties.append(_tie(text)), digests.append(_digest(text)), counts.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                values = signature(found) if len(found) else None
                for listed, n in ((keys, length), (stems, max(1, length - 1))):
                    listed.append(None if values is None else prefix_keys(values, n).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ties, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(nodes, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(stems, pa.list_(pa.int64())),
                ],
                names=["doc_id", "tie", "digest", "node", "n_shingles", "keys", "stems"],
            )

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(
        sign, "doc_id long, tie long, digest binary, node binary, n_shingles long, keys array<long>, stems array<long>"
    )


UNIT = ["tree", "is_short", "prefix"]


def shared_posts(nodes: DataFrame) -> DataFrame:
    """node, tree, stem and n for every trie in which n > 1 nodes share the shorter prefix. Nodes
    that share none meet nobody, by a longer prefix neither."""
    posts = nodes.select("node", F.posexplode("stems").alias("tree", "stem"))
    sizes = posts.groupBy("tree", "stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return posts.join(sizes, ["tree", "stem"]).select("node", "tree", "stem", "n")


def shortened(posts: DataFrame, shorter: int, crowd: int) -> DataFrame:
    """node and short: the `shorter` tries in which a node matches the shorter prefix, those that
    are not crowded in the order of their numbers, then the least crowded."""
    crowded = F.when(F.col("n") > crowd, F.col("n")).otherwise(0)
    sizes = posts.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", crowded.alias("n")))).alias("sizes"))
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(F.coalesce(F.element_at("sizes", t), F.lit(0)).alias("n"), t.alias("tree"))
    )
    chosen = F.transform(F.slice(F.array_sort(tries), 1, shorter), lambda x: x["tree"])
    return sizes.select("node", chosen.alias("short"))


def units_of(nodes: DataFrame, posts: DataFrame, short: DataFrame) -> DataFrame:
    """UNIT, node and n_shingles of the members of every unit whose pairs are to be compared.

    Under a shorter prefix that one node matches all of its nodes are a unit; else those under
    each longer prefix are.
    """
    known = nodes.select("node", "keys", "n_shingles").join(short, "node")
    rows = posts.select("node", "tree", "stem").join(known, "node").select(
        "node", "n_shingles", "tree", "stem",
        F.element_at("keys", F.col("tree") + 1).alias("key"),
        F.array_contains("short", F.col("tree")).alias("matched"),
    )
    rows = settle(rows)
    stems = rows.groupBy("tree", "stem").agg(F.max("matched").alias("is_short"))
    rows = rows.join(stems, ["tree", "stem"])
    rows = rows.withColumn("prefix", F.when(F.col("is_short"), F.col("stem")).otherwise(F.col("key")))
    rows = settle(rows.select(*UNIT, "node", "n_shingles", "key", "matched"))
    other = F.when(~F.col("matched"), F.col("key"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    sets = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), *marks, F.min(other).alias("low"), F.max(other).alias("high"))
    sets = sets.filter("n > 1").withColumn("all_met", F.coalesce(F.col("low") == F.col("high"), F.lit(True)))
    same = ["n", "mark0", "mark1"]
    first = sets.filter("all_met").groupBy(*same).agg(F.min("tree").alias("first"))
    kept = sets.join(first, same, "left").filter("first is null or tree <= first").select(*UNIT)
    return rows.join(kept, UNIT).select(*UNIT, "node", "n_shingles")


def compare(sets: list[np.ndarray], others: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs are as similar as the threshold; against the same sets without `others`."""
    both = sets if others is None else sets + others
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))[: len(column)]
    split = len(sets)
    n_others = split if others is None else len(others)
    common = np.zeros((split, n_others))
    last = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, last + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        dense = np.zeros((len(both), min(COLUMNS, last - k * COLUMNS)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - k * COLUMNS] = 1.0
        common += dense[:split] @ (dense if others is None else dense[split:]).T
    sizes = np.array([len(s) for s in sets])
    other_sizes = sizes if others is None else np.array([len(s) for s in others])
    union = sizes[:, None] + other_sizes[None, :] - common
    links = common * THRESHOLD[1] >= union * THRESHOLD[0]
    if others is None:
        np.fill_diagonal(links, False)
    return links


def spanning_labels(links: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with."""
    n = len(links)
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        front = np.array([start])
        while len(front):
            near = links[front].any(axis=0) & (label < 0)
            front = np.flatnonzero(near)
            label[front] = start
    return label


def first_met(keys: np.ndarray, stems: np.ndarray, short: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first trie in which the nodes `a` and `b` of each pair meet (TREES if in none)."""
    met = (keys[a] == keys[b]) | ((stems[a] == stems[b]) & (short[a] | short[b]))
    return np.where(met.any(axis=1), met.argmax(axis=1), TREES)


_FOUND = pa.schema([("node", pa.binary()), ("n_links", pa.int64()), ("head", pa.binary())])


def verify(placed: DataFrame) -> DataFrame:
    """Per node and pair of blocks: the documents it is linked with by pairs that first met there,
    and the head of the nodes that such links connect it with (null if itself)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes = WordHashes()
        open_ = zstandard.ZstdDecompressor()
        out: list[tuple[bytes, int, bytes | None]] = []
        for unit in sorted_groups(batches, [*UNIT, "i", "j"]):
            node, copies = unit.column("node").to_pylist(), unit.column("copies").to_numpy()
            sets = [shingles(open_.decompress(b.as_py()).decode(), hashes) for b in unit.column("blob")]
            keys, stems = (np.array(unit.column(c).to_pylist(), dtype=np.int64) for c in ("keys", "stems"))
            short = np.zeros(keys.shape, dtype=bool)
            for k, trees in enumerate(unit.column("short").to_pylist()):
                short[k, trees] = True
            block = unit.column("block").to_numpy()
            i, j, tree = (unit.column(c)[0].as_py() for c in ("i", "j", "tree"))
            if i == j:
                links = compare(sets, None)
            else:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                links = np.zeros((len(sets), len(sets)), dtype=bool)
                if len(left) and len(right):
                    part = compare([sets[k] for k in left], [sets[k] for k in right])
                    links[np.ix_(left, right)] = part
                    links[np.ix_(right, left)] = part.T
            for start in range(0, len(sets), PAIR_ROWS):
                a, b = np.nonzero(links[start : start + PAIR_ROWS])
                links[a + start, b] = first_met(keys, stems, short, a + start, b) == tree
            counts = links @ copies
            label = spanning_labels(links)
            out += [
                (node[k], int(counts[k]), node[label[k]] if label[k] != k else None)
                for k in range(len(node))
                if counts[k]
            ]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    dealt = placed.repartition(*UNIT, "i", "j").sortWithinPartitions(*UNIT, "i", "j", "node")
    return dealt.mapInArrow(check, "node binary, n_links long, head binary")


def _id() -> Column:
    """doc_id for joins: a number for a missing one as well."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def _blobs(documents: DataFrame) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([_digest(t) for t in texts], pa.binary()),
                    pa.array([press.compress((t or "").encode()) for t in texts], pa.binary()),
                ],
                names=["id", "digest", "blob"],
            )

    return documents.select(_id().alias("id"), "text").mapInArrow(squeeze, "id long, digest binary, blob binary")


def blocks_of(units: DataFrame, block_shingles: int) -> DataFrame:
    """Each member of a unit with its block and the pairs of blocks it takes part in."""
    weight = F.greatest("n_shingles", F.lit(LEAST_WEIGHT))
    sizes = units.groupBy(*UNIT).agg(F.ceil(F.sum(weight) / block_shingles).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int")
    placed = units.join(sizes, UNIT).withColumn("block", block)
    return placed.select(
        *UNIT, "node", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    ).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def members_of(nodes: DataFrame, short: DataFrame, documents: DataFrame) -> DataFrame:
    """What a comparison needs of every node that shares a prefix: one text, and where it meets.
    Rows of one id and text are one blob before any of them is moved."""
    wanted = nodes.join(short, "node").select("node", _id().alias("id"), "digest", "copies", "keys", "stems", "short")
    blobs = _blobs(documents).groupBy("id", "digest").agg(F.first("blob").alias("blob"))
    return settle(wanted.join(blobs, ["id", "digest"]).drop("id", "digest"))


def _name() -> Column:
    """The smallest of some documents: any id comes before none, and texts go by digest."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest"))


def named_documents(documents: DataFrame, block_shingles: int = BLOCK_SHINGLES, crowd: int = CROWD) -> DataFrame:
    """What `join_documents` has, and digest and `names`: whether the class has its name from
    this doc_id with this text (as all rows that are linked with nothing have)."""
    plan = prefix_plan()
    rows = settle(signed(documents, plan.length))
    nodes = rows.filter("node is not null").groupBy("node").agg(
        _name().alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("keys", "stems", "n_shingles")]
    )
    nodes = settle(nodes.select("node", "first.doc_id", "first.digest", "copies", "keys", "stems", "n_shingles"))
    posts = settle(shared_posts(nodes))
    short = settle(shortened(posts, plan.shorter, crowd))
    units = blocks_of(settle(units_of(nodes, posts, short)), block_shingles)
    found = settle(verify(units.join(members_of(nodes, short, documents), "node")))
    linked = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    roots = components(found.filter("head is not null").select(F.col("node").alias("a"), F.col("head").alias("b")))
    known = nodes.select("node", "doc_id", "digest", "copies").join(linked, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(_name().alias("name"))
    known = known.join(names, "root").select(
        "node", "name", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    names_it = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("digest") == F.col("name.digest"))
    return rows.select("doc_id", "tie", "digest", "node").join(known, "node", "left").select(
        "doc_id",
        "tie",
        "digest",
        F.coalesce("name.doc_id", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("name").isNull() | names_it).alias("names"),
    )


def join_documents(documents: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, tie (checksum of the text), class_id, n_links and n_copies of every row.

    class_id is the smallest doc_id of the documents that links connect; n_links counts the
    other rows that are as similar as the threshold, equal ones included; n_copies counts the
    rows with the same shingles, itself included.
    """
    return named_documents(documents, block_shingles).drop("digest", "names")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class: a row that names it. Columns as given."""
    key = ["_missing", "_id", "_digest"]
    missing = F.col("doc_id").cast("long").isNull().alias("_missing")
    linked = named_documents(documents).filter("n_links > 0")
    linked = linked.select(missing, _id().alias("_id"), F.col("digest").alias("_digest"), F.col("names").alias("_names"))
    keyed = documents.select(
        F.struct(*documents.columns).alias("_row"), missing, _id().alias("_id"), _text_digest().alias("_digest")
    )
    kept = keyed.join(linked.distinct(), key, "left").filter(F.coalesce("_names", F.lit(True)))
    # Repeated rows of a naming document are copies as well; what is linked with nothing stays,
    # each row under a number of its own. Copies are merged where they are.
    own = F.when(F.col("_names").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return kept.withColumn("_own", own).groupBy(*key, "_own").agg(F.min("_row").alias("_row")).select("_row.*")
