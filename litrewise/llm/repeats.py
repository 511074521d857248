"""Suffix-array dedup: remove every byte inside a long string that also starts earlier.

Equal strings of `LENGTH` bytes are found in four steps.

1. Routing. Each window of LENGTH bytes is named by the smallest hash of its ROUTE_BYTES-byte
   strings. Equal windows have equal names, and neighbouring windows mostly share theirs, so a
   text becomes a few runs of windows. Names that occur once are dropped before any text moves.
2. Texts that are equal as a whole are found by their digests; all but the first go whole. The
   text of the remaining runs goes to the task that owns the name. Equal runs are merged
   on both sides of the shuffle: later ones are repeats as a whole.
3. Indexing. A task joins its different runs into one text, builds the suffix array and the
   Burrows-Wheeler transform, and expands intervals breadth-first by backward extension:
   common prefixes of 1, 2, 4, ... bytes follow from each other, each interval extended by as
   many symbols as it has, intervals of one row are dropped, and the expansion stops at LENGTH.
   What is left are the classes of equal windows.
4. In each class all but the earliest window are removed, as byte ranges of their documents.

A name with more different text than NAME_BYTES is not indexed. Its windows become rows, which
Spark groups by their digests: no task holds such a name, and nothing of it is left out.

"Earlier" is a smaller doc_id, or an earlier start in the same document. Matches never cross
documents and are judged on the input.

Rows: a null text counts as empty; texts shorter than LENGTH lose nothing; a null doc_id comes
after all others; rows with equal id and text are one document and share its result; different
texts under one id are ordered by their checksum. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litrewise.llm.common import small_batches, sorted_groups
from litrewise.placement import settle

LENGTH = 100
ROUTE_BYTES = 32
BATCH_BYTES = 4 << 20
TEXT_BYTES = 2 << 20  # of text that is taken for compression at once
SENT_BYTES = 16 << 20  # of runs that a task remembers having sent
INDEX_BYTES = 1 << 19
NAME_BYTES = 32 << 20
MOST_WINDOWS = 4096  # of a run; longer ones are cut
LAST_ID = 2**63 - 1

_rng = np.random.default_rng(11)
_BYTE_HASHES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Router:
    """Cuts texts into runs of windows with the same name."""

    def __init__(self, length: int = LENGTH, route_bytes: int = ROUTE_BYTES, chunk: int = 1 << 18) -> None:
        self.length, self.route, self.chunk = length, min(route_bytes, length), chunk
        n = chunk + length + 1
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def _names(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all short strings, and for each window the smallest of its own."""
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_HASHES[data] * self.up[: len(data)], out=sums[1:])
            h = (sums[self.route :] - sums[: -self.route]) * self.down[: len(data) - self.route + 1]
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
        return h, sliding_min(h, self.length - self.route + 1)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Name, first window, number of windows, and whether windows inside may be equal."""
        parts = []
        width = self.length - self.route + 1
        windows = len(text) - self.length + 1
        for first in range(0, max(windows, 0), self.chunk):
            data = np.frombuffer(text, dtype=np.uint8)[first : first + self.chunk + self.length - 1]
            h, names = self._names(data)
            starts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
            counts = np.diff(np.append(starts, len(names)))
            if counts.max() > MOST_WINDOWS:
                starts = np.concatenate([np.arange(s, s + n, MOST_WINDOWS) for s, n in zip(starts, counts)])
                counts = np.diff(np.append(starts, len(names)))
            # Equal windows inside a run need a smallest string that enters or leaves twice.
            enters = np.flatnonzero(h[width - 1 :] == names) + width - 1
            leaves = np.flatnonzero(h[: len(names)] == names)
            found, times = np.unique(h[np.union1d(enters, leaves)], return_counts=True)
            twice = found[times > 1]
            if len(twice):
                at = np.minimum(np.searchsorted(twice, names[starts]), len(twice) - 1)
                inner = twice[at] == names[starts]
            else:
                inner = np.zeros(len(starts), dtype=bool)
            parts.append((names[starts], starts + first, counts, inner))
        if not parts:
            empty = np.zeros(0, dtype=np.int64)
            return empty.astype(np.uint64), empty, empty, empty.astype(bool)
        return tuple(np.concatenate(column) for column in zip(*parts))


# A run is packed in one number: first window, windows - 1, repeated for sure, repeats inside.


def pack(start: np.ndarray, count: np.ndarray, sure: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return (start << 16) | ((count - 1) << 4) | (sure.astype(np.int64) << 1) | inner.astype(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc (null last), tie (checksum) and text, beside all other columns in `row`."""
    others = [c for c in documents.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
        F.struct(*[F.col(c) for c in others]).alias("row"),
    )


def _batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_RUNS = pa.schema([("route", pa.int64()), ("name", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("packed", pa.int64())])


def whole_copies(keyed: DataFrame, length: int) -> DataFrame:
    """doc, tie and size of every text that a smaller document has as well: all of it goes, and
    its runs need not be looked for. Texts shorter than LENGTH are left alone."""
    text = F.col("text").cast("binary")
    narrow = settle(keyed.select("doc", "tie", F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha")))
    narrow = narrow.filter(F.col("size") >= length)
    first = narrow.groupBy("sha").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    later = narrow.join(first.filter("n > 1"), "sha").filter("doc > first")
    return settle(later.select("doc", "tie", "size").distinct())


def first_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without the texts that a smaller document of the batch has as well."""
    order = np.lexsort((batch.column("doc").to_numpy(), batch.column("tie").to_numpy()))
    ties = batch.column("tie").to_numpy()[order]
    first = np.concatenate([[True], ties[1:] != ties[:-1]])
    return batch.take(pa.array(np.sort(order[first])))


def window_runs(keyed: DataFrame, length: int) -> DataFrame:
    """All runs of all documents. Of a name that a batch has often, one row goes to the name's
    task; the others are known to be repeated and go anywhere, so that no name is hot."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(length)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            batch = first_copies(batch)
            found = [router.runs(t.as_py().encode()) for t in batch.column("text")]
            sizes = np.array([len(f[0]) for f in found])
            if not sizes.sum():
                continue
            names, starts, counts, inner = (np.concatenate(c) for c in zip(*found))
            doc = np.repeat(batch.column("doc").to_numpy(), sizes)
            tie = np.repeat(batch.column("tie").to_numpy(), sizes)
            _, first, which, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            repeated = times[which] > 1
            asks = np.zeros(len(names), dtype=bool)
            asks[first] = True
            with np.errstate(over="ignore"):
                elsewhere = (doc.astype(np.uint64) + starts.astype(np.uint64)) * _MIX
            route = np.where(asks, names, elsewhere).view(np.int64)
            packed = pack(starts.astype(np.int64), counts.astype(np.int64), repeated, inner)
            for a in range(0, len(route), 1 << 18):
                z = slice(a, a + (1 << 18))
                yield _batch(_RUNS, route[z], names[z].view(np.int64), doc[z], tie[z], packed[z])

    return keyed.select("doc", "tie", "text").mapInArrow(cut, "route long, name long, doc long, tie long, packed long")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """The runs whose name occurs more than once in different texts; rows stream through in the
    order of names, and each looks at its neighbours only. Of equal texts the smallest
    document's run stays."""
    schema = pa.schema(list(_RUNS)[1:])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, whose neighbour is still to come
        before: int | None = None  # the name of the row before it
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [batch.column(c).to_numpy() for c in schema.names]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            name, doc, tie, packed = rows
            same = (name[1:] == name[:-1]) & (tie[1:] == tie[:-1]) & (packed[1:] >> 16 == packed[:-1] >> 16)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            # What is known of a dropped copy holds for the row that stays.
            packed = packed[starts] | np.bitwise_or.reduceat(packed & 3, starts)
            name, doc, tie = name[starts], doc[starts], tie[starts]
            alike = name[1:] == name[:-1]
            ok = (packed & 3) > 0
            ok[1:] |= alike
            ok[:-1] |= alike
            ok[0] |= before is not None and before == name[0]
            out = ok[:-1]
            yield _batch(schema, *[c[:-1][out] for c in (name, doc, tie, packed)])
            held = [c[-1:] for c in (name, doc, tie, packed)]
            before = int(name[-2]) if len(name) > 1 else before
        if held is not None and (int(held[0][0]) == before or held[3][0] & 3):
            yield _batch(schema, *held)

    dealt = runs.repartition("route").select("name", "doc", "tie", "packed")
    ordered = dealt.sortWithinPartitions("name", "tie", F.shiftright("packed", 16), "doc")
    return ordered.mapInArrow(keep, "name long, doc long, tie long, packed long")


def compressed(keyed: DataFrame, carry: bool) -> DataFrame:
    """The texts as they are shuffled: zstandard at its fastest usual level."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches, "text", TEXT_BYTES):
            blobs = pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            rest = [batch.column("row")] if carry else []
            names = ["doc", "tie", "blob"] + ["row"] * carry
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), blobs, *rest], names=names)

    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("blob", T.BinaryType())])
    columns = ["doc", "tie", "text"]
    if carry:
        schema = schema.add(keyed.schema["row"])
        columns.append("row")
    return keyed.select(*columns).mapInArrow(squeeze, schema)


def beside_texts(texts: DataFrame, *narrow: DataFrame) -> DataFrame:
    """Texts and narrow rows of the same document in one task: the text first (kind 0), then
    the rows of each narrow table (kind 1, 2, ...)."""
    both = texts.withColumn("kind", F.lit(0))
    for kind, rows in enumerate(narrow, 1):
        both = both.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return both.repartition("doc", "tie").sortWithinPartitions("doc", "tie", "kind")


def _text(group: pa.Table) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(group.column("blob")[0].as_py())


_ASKS = pa.schema(
    [("route", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("packed", pa.int64()), ("run", pa.binary())]
)
ASK_ROWS = 20_000


def run_texts(texts: DataFrame, runs: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """The bytes of each repeated run. A run that this task has already sent is a repeat as a
    whole: it goes on without bytes, to be spread over the tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        held, rows = 0, []
        for group in sorted_groups(batches, ["doc", "tie"]):
            kinds = group.column("kind").to_numpy()
            first = int(np.searchsorted(kinds, 1))
            if first == 0 or first == len(kinds) or kinds[-1] == 2:
                continue
            text = _text(group)
            doc, tie = group.column("doc")[0].as_py(), group.column("tie")[0].as_py()
            packed, at = np.unique(group.column("packed").to_numpy()[first:].astype(np.int64) & ~np.int64(2), return_index=True)
            names = group.column("name").to_numpy()[first:][at].astype(np.int64)
            for name, p in zip(names.tolist(), packed.tolist()):
                start, count = p >> 16, ((p >> 4) & 0xFFF) + 1
                run = text[start : start + count + length - 1]
                key = (name, run)
                if sent.setdefault(key, (doc, tie, start)) != (doc, tie, start):
                    rows.append((hash((doc, start)), doc, tie, p, None))
                else:
                    held += len(run) + 200
                    rows.append((name, doc, tie, p, run))
            if len(rows) >= ASK_ROWS:
                yield _batch(_ASKS, *map(list, zip(*rows)))
                rows = []
            if held > SENT_BYTES:
                sent, held = {}, 0
        if rows:
            yield _batch(_ASKS, *map(list, zip(*rows)))

    together = beside_texts(texts, runs, copies.select("doc", "tie"))
    return together.mapInArrow(cut, "route long, doc long, tie long, packed long, run binary")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first `depth` symbols (9 bits each), by prefix doubling."""
    n = len(symbols)
    step = 7
    padded = np.concatenate([symbols, np.zeros(step, dtype=symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(step):
        key = (key << np.uint64(9)) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        ranks = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        if step >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = ranks
        ahead = np.zeros(n, dtype=np.uint64)
        ahead[: n - step] = rank[step:] + np.uint64(1)
        key = (rank << np.uint64(32)) | ahead
        step *= 2


def equal_windows(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that start a string of `length` symbols without separator (0) which occurs at
    least twice, and the class of each; by interval expansion on the transform."""
    order = suffix_array(symbols, length)
    n = len(order)
    order = order.astype(np.int32)
    row_of = np.empty(n + 1, dtype=np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    row_of[n] = n
    # The transform, last column of the sorted rows: the symbol before each row, and at the end
    # that of the empty row. Position 0 is a separator and has a separator before it.
    last_column = np.append(symbols[order - 1], symbols[-1])
    # Backward extension takes a row whose last column is c to the row that begins with c. Here
    # each row knows the row it comes from, so that all intervals are extended by all symbols in
    # one pass.
    first_column = last_column[row_of[order + 1]]
    rows = np.flatnonzero(first_column > 0).astype(np.int32)
    # Interval of each row: number of its first row; -1 for dropped rows.
    interval = np.full(n + 1, -1, dtype=np.int32)
    now, ahead, size = first_column[rows], None, 1
    while True:
        starts = np.ones(len(rows), dtype=bool)
        starts[1:] = now[1:] != now[:-1]
        if ahead is not None:
            starts[1:] |= (ahead[1:] != ahead[:-1]) | (ahead[1:] < 0)
        ends = np.ones(len(rows), dtype=bool)
        ends[:-1] = starts[1:]
        keep = ~(starts & ends)
        interval[rows] = -1
        rows, starts = rows[keep], starts[keep]
        if not len(rows):
            break
        heads = np.flatnonzero(starts)
        now = np.repeat(rows[heads], np.diff(np.append(heads, len(rows))))
        interval[rows] = now
        if size == length:
            break
        # The next strings begin with one of `size` symbols and end with another, `step` behind:
        # the interval of the latter is extended by `step` symbols at once.
        step = min(size, length - size)
        ahead = interval[row_of[order[rows] + step]]
        size += step
    return order[rows], interval[rows]


def index_runs(runs: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Windows of `runs` that are equal to an earlier one, as (run, first, last offset).

    `docs` numbers the runs' documents in order; `starts` are the runs' places in them.
    """
    data = b"".join(runs)
    sizes = np.array([len(r) for r in runs])
    symbols = np.zeros(1 + len(data) + len(runs), dtype=np.int16)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(len(symbols), dtype=bool)
    inside[0] = False
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(data, dtype=np.uint8).astype(np.int16) + 1
    places, classes = equal_windows(symbols, length)
    if not len(places):
        return []
    run = np.searchsorted(begins, places, side="right") - 1
    offset = places - begins[run]
    order = np.lexsort((starts[run] + offset, docs[run], classes))
    run, offset, classes = run[order], offset[order], classes[order]
    later = np.concatenate([[False], classes[1:] == classes[:-1]])
    run, offset = run[later], offset[later]
    order = np.lexsort((offset, run))
    run, offset = run[order], offset[order]
    breaks = np.flatnonzero((run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    heads = np.concatenate([[0], breaks])[: len(run)]
    tails = np.concatenate([breaks, [len(run)]])[: len(heads)] - 1
    return list(zip(run[heads].tolist(), offset[heads].tolist(), offset[tails].tolist()))


_RANGES = pa.schema(
    [("doc", pa.int64()), ("tie", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("window", pa.binary())]
)


class Index:
    """Collects the different runs of some names and yields what is to be removed of them."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.runs: list[bytes] = []
        self.at: list[tuple[int, int, int]] = []
        self.size = 0

    def add_name(self, earliest: dict[bytes, tuple[int, int, int]], inner: bool) -> None:
        if len(earliest) > 1 or inner:
            self.runs += earliest
            self.at += earliest.values()
            self.size += sum(map(len, earliest))

    def ranges(self) -> list[tuple[int, int, int, int, None]]:
        if not self.runs:
            return []
        docs = sorted({(d, t) for d, t, _ in self.at})
        number = {d: i for i, d in enumerate(docs)}
        of_run = np.array([number[d, t] for d, t, _ in self.at])
        starts = np.array([s for _, _, s in self.at])
        found = index_runs(self.runs, of_run, starts, self.length)
        at = self.at
        out = [(at[r][0], at[r][1], at[r][2] + a, at[r][2] + b + self.length, None) for r, a, b in found]
        self.clear()
        return out


def window_rows(run: bytes, place: tuple[int, int, int], length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    doc, tie, start = place
    for k in range(len(run) - length + 1):
        digest = hashlib.blake2b(run[k : k + length], digest_size=16).digest()
        yield doc, tie, start + k, start + k + length, digest


def removed_ranges(asks: DataFrame, length: int, index_bytes: int, name_bytes: int) -> DataFrame:
    """Byte ranges (doc, tie, begin, end) that are to go, which may overlap; and, with a digest
    in `window`, the windows of names that are too large to be indexed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(length)
        out: list[tuple[int, int, int, int, bytes | None]] = []
        name, inner, size, large = None, False, 0, False
        earliest: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("route", "doc", "tie", "packed", "run")]
            for route, doc, tie, packed, run in zip(*columns):
                start = packed >> 16
                if run is None:
                    out.append((doc, tie, start, start + ((packed >> 4) & 0xFFF) + length, None))
                    continue
                if route != name:
                    index.add_name(earliest, inner)
                    if index.size >= index_bytes:
                        out += index.ranges()
                    name, inner, size, large, earliest = route, False, 0, False, {}
                inner |= bool(packed & 1)
                place = (doc, tie, start)
                if large:
                    out.extend(window_rows(run, place, length))
                    if len(out) >= ASK_ROWS:
                        yield _batch(_RANGES, *map(list, zip(*out)))
                        out = []
                    continue
                best = earliest.setdefault(run, place)
                if best != place:
                    if place < best:
                        earliest[run], best, place = place, place, best
                    out.append((*place, place[2] + len(run), None))
                    continue
                size += len(run)
                if size > name_bytes:
                    large = True
                    for known, where in earliest.items():
                        out.extend(window_rows(known, where, length))
                        if len(out) >= ASK_ROWS:
                            yield _batch(_RANGES, *map(list, zip(*out)))
                            out = []
                    inner, earliest = False, {}
            if len(out) >= ASK_ROWS:
                yield _batch(_RANGES, *map(list, zip(*out)))
                out = []
        index.add_name(earliest, inner)
        out += index.ranges()
        if out:
            yield _batch(_RANGES, *map(list, zip(*out)))

    dealt = asks.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(search, "doc long, tie long, begin long, end long, window binary")


def later_windows(windows: DataFrame) -> DataFrame:
    """The ranges of all windows but the earliest of each digest."""
    place = F.struct("doc", "tie", "begin")
    first = windows.groupBy("window").agg(F.min(place).alias("first"))
    return windows.join(first, "window").filter(place > F.col("first")).select("doc", "tie", "begin", "end")


def find_repeats(
    keyed: DataFrame, length: int = LENGTH, index_bytes: int = INDEX_BYTES, name_bytes: int = NAME_BYTES
) -> DataFrame:
    """Written byte ranges to remove from the rows of `_keyed`."""
    copies = whole_copies(keyed, length)
    runs = repeated_runs(window_runs(keyed, length))
    asks = run_texts(compressed(keyed, carry=False), runs, copies, length)
    found = settle(removed_ranges(asks, length, index_bytes, name_bytes))
    ranges = found.filter("window is null").drop("window")
    windows = found.filter("window is not null")
    if not windows.isEmpty():
        ranges = ranges.unionByName(later_windows(windows))
    whole = copies.select("doc", "tie", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
    return ranges.unionByName(whole)


def merged_spans(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that do not touch, covering the same bytes."""
    spans: list[tuple[int, int]] = []
    order = np.argsort(begins, kind="stable")
    for a, b in zip(begins[order].tolist(), ends[order].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left as text: a character goes only if all of its bytes are to go."""
    left, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        left.append(text[at:a])
        at = max(a, b)
    left.append(text[at:])
    return b"".join(left).decode()


def _finish(keyed: DataFrame, length: int, with_text: bool, **bounds: int) -> DataFrame:
    texts = compressed(keyed, carry=True)
    ranges = find_repeats(keyed, length, **bounds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, bytes, list[tuple[int, int]]]] = []
        rows: list[pa.ChunkedArray] = []
        held = 0
        for group in sorted_groups(batches, ["doc", "tie"]):
            kinds = group.column("kind").to_numpy()
            first = int(np.searchsorted(kinds, 1))
            text = _text(group)
            spans = merged_spans(
                group.column("begin").to_numpy()[first:].astype(np.int64), group.column("end").to_numpy()[first:].astype(np.int64)
            )
            for i in range(first):
                rows += group.column("row").slice(i, 1).chunks
                groups.append((first, text, spans))
                held += len(text)
            if held >= TEXT_BYTES or len(groups) >= 5000:
                yield _result(rows, groups, with_text)
                groups, rows, held = [], [], 0
        if groups:
            yield _result(rows, groups, with_text)

    schema = T.StructType([keyed.schema["row"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("kept_sha256", T.StringType())
    if with_text:
        schema = schema.add("text", T.StringType())
    return beside_texts(texts, ranges).mapInArrow(finish, schema)


def _result(rows: list, groups: list, with_text: bool) -> pa.RecordBatch:
    sizes, removed, counts, digests, texts = [], [], [], [], []
    for _, text, spans in groups:
        digest, at, gone = hashlib.sha256(), 0, 0
        for a, b in spans:
            digest.update(text[at:a])
            at, gone = b, gone + b - a
        digest.update(text[at:])
        sizes.append(len(text)), removed.append(gone), counts.append(len(spans)), digests.append(digest.hexdigest())
        if with_text:
            texts.append(whole_characters(text, spans))
    columns = [pa.concat_arrays(rows), *[pa.array(c, pa.int64()) for c in (sizes, removed, counts)], pa.array(digests, pa.string())]
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns.append(pa.array(texts, pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def dedup_digests(documents: DataFrame, length: int = LENGTH, **bounds: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    found = _finish(_keyed(documents.select("doc_id", "text")), length, with_text=False, **bounds)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeats, columns as given; characters are kept whole, and
    n_chars, if there is one, is counted anew. A null text becomes an empty one."""
    found = _finish(_keyed(documents), length, with_text=True).select("row.*", "text")
    if "n_chars" in found.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return found.select(*documents.columns)
