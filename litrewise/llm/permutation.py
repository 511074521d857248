"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which a few hundred pivots are near to it. It is posted
in the inverted files of its POSTINGS nearest pivots; a query reads the files of its own nearest
pivots, ranks what it finds by the footrule distance of the two orders (the sum of how far each
pivot is moved), and reranks the best share of it, and all as near by footrule as the last of that
share, by the exact measure on the vectors.

Pivots are chosen from a bounded sample; every vector is indexed. The index is cut into shards
and the queries into blocks, each pair of which is a task's group with its own inverted files,
so that neither has to fit into one task, and the best of each shard are merged at the end.
Equal vectors are one entry of a shard, with the ids that can still be among the nearest.

Rows: null vectors, zero vectors, vectors with null or non-finite components and vectors whose
length is not that of most sampled ones take no part, neither as query nor as candidate; very
large and very small components count like any others (vectors are scaled by powers of two); rows
with a null id neither. Rows that repeat a query's id are not its candidates. Ties go to the
smaller id. With too few vectors in the read files all of the shard are ranked, so that each
query gets its full number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litrewise.llm.common import hex_number, sorted_groups
from litrewise.placement import settle

PIVOTS = 256  # at most 256: places are stored in one byte
SAMPLE_ROWS = 4000
POSTINGS = 16
RERANKED_SHARE = 0.1
LEAST_RERANKED = 200
SHARD_ROWS = 8192
QUERY_ROWS = 512
NEAREST = 5
EVERY = 50
CLOSE = 0.95  # a pivot is not chosen if its cosine with one already chosen is above this


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero throughout."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component, which changes no cosine and
    keeps squares from over- and underflow."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    half = exponent // 2  # in two steps, as one factor may itself be out of range
    return np.ldexp(np.ldexp(vectors, -half[:, None]), -(exponent - half)[:, None])


def units_of(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit vectors from the SAMPLE_ROWS usable rows whose ids have the lowest hashes, not too
    close to each other unless nothing else is left."""
    draw = hex_number(F.concat(F.col("vec_id").cast("string"), F.lit("/pivots")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = rows.select("vec_id", "embedding", draw.alias("draw")).orderBy("draw", "vec_id").limit(sample_rows)
    found = [r["embedding"] for r in sorted(sample.collect(), key=lambda r: (r["draw"], r["vec_id"]))]
    if not found:
        return np.zeros((0, 0))
    width = Counter(map(len, found)).most_common(1)[0][0]
    units = units_of(scaled(np.array([v for v in found if len(v) == width], dtype=np.float64)))
    chosen: list[int] = []
    near = np.full(len(units), -2.0)
    for i in range(len(units)):
        if len(chosen) < pivots and near[i] <= CLOSE:
            chosen.append(i)
            near = np.maximum(near, units @ units[i])
    return units[chosen]


def pivot_places(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the place of every pivot in its order of nearness."""
    order = np.argsort(-(units @ pivots.T), axis=1, kind="stable")
    places = np.empty(order.shape, dtype=np.uint8)
    np.put_along_axis(places, order, np.arange(len(pivots), dtype=np.uint8)[None, :], axis=1)
    return places


_POINT = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("places", pa.binary())])


def index_vectors(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, vector (float64 bytes, scaled) and places (bytes) of every vector that takes part."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                flat = part.column("embedding").flatten()
                matrix = scaled(np.asarray(flat, dtype=np.float64).reshape(part.num_rows, -1))
                places = pivot_places(units_of(matrix), pivots)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.array([v.tobytes() for v in matrix], pa.binary()),
                        pa.array([p.tobytes() for p in places], pa.binary()),
                    ],
                    schema=_POINT,
                )

    embedding = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(embedding) & (F.size(embedding) == pivots.shape[1]))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.cast("array<double>").alias("embedding"))
    return rows.mapInArrow(place, "vec_id long, vector binary, places binary")


class Shard:
    """The distinct vectors of a shard, their ids, and the inverted file of each pivot."""

    def __init__(self, ids: np.ndarray, vectors: list[bytes], places: list[bytes]) -> None:
        entries: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        kept = []
        for i in np.argsort(ids, kind="stable").tolist():
            entry = entries.setdefault(vectors[i], len(entries))
            if entry == len(self.ids):
                self.ids.append([])
                kept.append(i)
            own = self.ids[entry]
            # One more than wanted: the query itself may be among them.
            if len(own) <= NEAREST and (not own or own[-1] != ids[i]):
                own.append(int(ids[i]))
        self.vectors = np.array([np.frombuffer(vectors[i]) for i in kept])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.places = np.array([np.frombuffer(places[i], dtype=np.uint8) for i in kept])
        entry, pivot = np.nonzero(self.places < POSTINGS)
        order = np.argsort(pivot, kind="stable")
        self.posted = entry[order]
        self.files = np.searchsorted(pivot[order], np.arange(self.places.shape[1] + 1))

    def candidates(self, places: np.ndarray) -> np.ndarray:
        """The entries to rerank: the nearest by footrule of those in the query's files."""
        files = np.flatnonzero(places < POSTINGS)
        found = np.zeros(len(self.ids), dtype=bool)
        for p in files.tolist():
            found[self.posted[self.files[p] : self.files[p + 1]]] = True
        wanted = max(LEAST_RERANKED, int(RERANKED_SHARE * len(self.ids)))
        entries = np.flatnonzero(found)
        if len(entries) <= NEAREST:
            entries = np.arange(len(self.ids))
        if len(entries) <= wanted:
            return entries
        moved = np.abs(self.places[entries].astype(np.int16) - places.astype(np.int16))
        footrule = moved.sum(axis=1, dtype=np.int32)
        return entries[footrule <= np.partition(footrule, wanted - 1)[wanted - 1]]

    def search(self, vec_id: int, vector: np.ndarray, places: np.ndarray) -> list[tuple[int, float]]:
        entries = self.candidates(places)
        # Summed by row, so that parallel vectors tie wherever they are in the matrix.
        cosines = (self.vectors[entries] * vector).sum(axis=1) / (self.norms[entries] * np.sqrt((vector * vector).sum()))
        best: list[tuple[float, int]] = []
        # Entries with as large a cosine as the last that is needed take part, for ties.
        wanted = min(len(cosines), NEAREST + 1)
        least = -np.partition(-cosines, wanted - 1)[wanted - 1]
        for k in np.flatnonzero(cosines >= least).tolist():
            best += [(-float(cosines[k]), i) for i in self.ids[entries[k]] if i != vec_id]
        return [(i, -c) for c, i in sorted(best)[:NEAREST]]


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shards(dealt: DataFrame) -> DataFrame:
    """The best of each shard for each query; candidates come before queries in a group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in sorted_groups(batches, ["shard", "block"]):
            split = int(np.searchsorted(unit.column("kind").to_numpy(), 1))
            ids = unit.column("vec_id").to_numpy()
            vectors, places = unit.column("vector").to_pylist(), unit.column("places").to_pylist()
            if split == 0 or split == len(ids):
                continue
            shard = Shard(ids[:split], vectors[:split], places[:split])
            hits = []
            for k in range(split, len(ids)):
                query = np.frombuffer(vectors[k])
                near = shard.search(int(ids[k]), query, np.frombuffer(places[k], dtype=np.uint8))
                hits += [(int(ids[k]), i, c) for i, c in near]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits), _HITS)], schema=_HITS)

    rows = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    return rows.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the NEAREST rows found for each query (the rows whose
    id is divisible by `every`), by largest cosine."""
    pivots = choose_pivots(vectors)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = settle(index_vectors(vectors, pivots))
    asked = points.filter(F.col("vec_id") % every == 0)
    shards = max(1, -(-points.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    columns = ["shard", "block", "kind", "vec_id", "vector", "places"]
    held = points.withColumns({"shard": part(shards), "kind": F.lit(0)}).withColumn("block", all_of(blocks))
    asking = asked.withColumns({"block": part(blocks), "kind": F.lit(1)}).withColumn("shard", all_of(shards))
    hits = search_shards(held.select(columns).unionByName(asking.select(columns)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEAREST)
    return ranked.select("query_id", "rank", "vec_id", "score")
