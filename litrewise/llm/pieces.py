"""SentencePiece encoding by sampling segmentations, and lossless decoding.

A text's segmentations form a lattice: every vocabulary piece that matches at a place is an
arc. Forward filtering sums the weights of all ways to reach each place; backward sampling
then draws arcs from the end, so that each segmentation comes with its probability. Draws are
a hash of the row's key, the word and the step: the same row is always cut the same way.

Pieces join spaces with what follows them but never the other way round, so the lattice falls
apart at the start of every run of spaces. Those units are filtered once for each distinct
unit of a batch, all units together, one array operation per place; every occurrence is then
sampled on its own. What lies far behind a unit's start (text without spaces) goes place by
place instead: few units are so long, and array calls would cost more than the sums.

Characters without a piece are written as byte pieces, as is a literal space mark, so that
decoding gives back exactly the text. Rows: a null text has no ids (null) and decodes to null;
an empty text has none and decodes to an empty one; texts are encoded whole, however long;
rows with equal keys and texts have equal ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litrewise.llm.common import slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# How sharply frequent pieces and long pieces are preferred: weights are rank ** -SHARPNESS.
SHARPNESS = 1.0
SEED = 20_011
BATCH_BYTES = 1 << 20
# How many distinct units, and characters in them, a task remembers between batches
# (300 bytes a unit, 50 a character or so).
MOST_UNITS = 40_000
MOST_PLACES = 400_000
# How many characters of new units are filtered at once (some 400 bytes each while it lasts).
FILTER_PLACES = 1 << 16
# How far from a unit's start (in sampling: from its end) all units are taken together.
TOGETHER = 4000
WINDOW = 1 << 16

_UNIT = re.compile(r" *[^ ]+| +")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.uint64(0x100000001B3)
_64_BITS = (1 << 64) - 1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log weights, and the hashes of all their beginnings, for array lookups."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    prefixes: np.ndarray
    prefix_ids: np.ndarray
    log_weights: np.ndarray
    longest: int


def hash_step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string with one more character."""
    h = (h ^ code) * _BASE
    return h ^ (h >> np.uint64(29))


def read_vocabulary(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    """Read a model file on the driver; what results is broadcast (about two megabytes)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    size = model.vocab_size()
    byte_ids = np.zeros(256, dtype=np.int32)
    pieces, ids_of = [], {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(SPACE, " ").encode())
            ids_of[piece] = i
    # Prefixes of pieces, so that a scan can stop where no piece goes on; -1 where none ends.
    known: dict[int, int] = {}
    with np.errstate(over="ignore"):
        for piece, i in ids_of.items():
            h = np.zeros(1, dtype=np.uint64)
            for n, character in enumerate(piece, 1):
                h = hash_step(h, np.array([ord(character)], dtype=np.uint64))
                known.setdefault(int(h[0]), -1)
            known[int(h[0])] = i
    keys = np.array(sorted(known), dtype=np.uint64)
    values = np.array([known[int(k)] for k in keys], dtype=np.int32)
    rank = np.arange(size, dtype=np.float64) + 2.0
    return Vocabulary(pieces, byte_ids, keys, values, -sharpness * np.log(rank), max(map(len, ids_of)))


def mix_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def mix_number(x: int) -> int:
    """`mix_bits` of one number."""
    x = ((x ^ (x >> 30)) * int(_M2)) & _64_BITS
    x = ((x ^ (x >> 27)) * int(_M3)) & _64_BITS
    return x ^ (x >> 31)


def row_seed(key: int | None) -> int:
    digest = hashlib.blake2b(f"{SEED}/{key}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little")


class Lattice:
    """The arcs of many units at once, sorted by the place where they end (longest first), and
    for each arc the probability, cumulated within its place, that backward sampling takes it."""

    def __init__(self, units: list[str], vocabulary: Vocabulary) -> None:
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        self.lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.first = np.cumsum(self.lengths) - self.lengths
        # A literal space mark is no space: it has no arc but its bytes.
        mark = ord(SPACE)
        shown = np.where(codes == 32, mark, codes).astype(np.uint64)
        shown[codes == mark] = np.uint64(0xFFFFFFFF)
        ends = np.repeat(self.first + self.lengths, self.lengths)
        start, size, piece = self._arcs(shown, ends, codes, vocabulary)
        end = start + size
        order = np.argsort(end, kind="stable")
        self.start, self.piece = start[order], piece[order]
        self._filter(end[order], vocabulary, len(codes))

    @staticmethod
    def _arcs(shown: np.ndarray, ends: np.ndarray, codes: np.ndarray, vocabulary: Vocabulary):
        """Start, length and id of all places where a piece matches, longest pieces first; then
        a byte arc for each character without a piece of its own, whose id is the size of the
        vocabulary plus the character's code point."""
        active = np.arange(len(shown))
        h = np.zeros(len(shown), dtype=np.uint64)
        own = np.zeros(len(shown), dtype=bool)
        found = []
        for n in range(vocabulary.longest):
            inside = active + n < ends[active]
            active, h = active[inside], h[inside]
            if not len(active):
                break
            h = hash_step(h, shown[active + n])
            at = np.minimum(np.searchsorted(vocabulary.prefixes, h), len(vocabulary.prefixes) - 1)
            known = vocabulary.prefixes[at] == h
            active, h = active[known], h[known]
            ids = vocabulary.prefix_ids[at[known]]
            full = ids >= 0
            found.append((active[full], np.full(int(full.sum()), n + 1), ids[full].astype(np.int64)))
            if n == 0:
                own[active[full]] = True
        bare = np.flatnonzero(~own)
        found.insert(0, (bare, np.ones(len(bare), dtype=np.int64), codes[bare] + np.int64(len(vocabulary.pieces))))
        return tuple(np.concatenate(column) for column in zip(*found[::-1]))

    def _filter(self, end: np.ndarray, vocabulary: Vocabulary, n: int) -> None:
        """Forward filtering in logarithms, over all places as far from their unit's start."""
        size = len(vocabulary.pieces)
        # A byte arc weighs as much as the rarest piece.
        weights = vocabulary.log_weights[np.minimum(self.piece, size - 1)]
        origin = np.repeat(self.first, self.lengths)[self.start]
        depth = (end - origin).astype(np.int32)
        at_origin = self.start == origin
        # alpha[p]: log weight of all ways from the unit's start to just behind character p.
        alpha = np.full(n + 1, -np.inf)
        by_depth = np.argsort(depth, kind="stable")
        together = max(TOGETHER, vocabulary.longest)
        deepest = min(int(depth.max(initial=0)), together)
        edges = np.searchsorted(depth[by_depth], np.arange(1, deepest + 2))
        value = np.where(at_origin, weights, 0.0)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            some = by_depth[a:b]
            later = some[~at_origin[some]]
            value[later] = alpha[self.start[later] - 1] + weights[later]
            np.logaddexp.at(alpha, end[some] - 1, value[some])
        for unit in np.flatnonzero(self.lengths > together).tolist():
            behind = self.first[unit] + np.array([together, self.lengths[unit]])
            self._filter_on(*np.searchsorted(end, behind, side="right").tolist(), end, weights, alpha, value)
        total = np.cumsum(np.exp(value - alpha[end - 1]))
        self.group = np.searchsorted(end, np.arange(1, n + 2))  # first arc behind character p
        below = np.concatenate([[0.0], total])[self.group[:-1]]
        self.upto = total - below[end - 1]

    def _filter_on(
        self, a: int, b: int, end: np.ndarray, weights: np.ndarray, alpha: np.ndarray, value: np.ndarray
    ) -> None:
        """Go on with the arcs `a` to `b` of one unit, in the order of their ends."""
        for a0 in range(a, b, WINDOW):
            arcs = slice(a0, min(a0 + WINDOW, b))
            low = int(self.start[arcs].min()) - 1
            high = int(end[arcs.stop - 1])
            near = alpha[low:high].tolist()
            ways = []
            for s, e, w in zip(
                (self.start[arcs] - 1 - low).tolist(), (end[arcs] - 1 - low).tolist(), weights[arcs].tolist()
            ):
                way, so_far = near[s] + w, near[e]
                ways.append(way)
                near[e] = max(way, so_far) + math.log1p(math.exp(-abs(way - so_far)))
            alpha[low:high] = near
            value[arcs] = ways


class Lattices:
    """Lattices of the units met so far; forgotten when they are more than MOST_UNITS or have
    more than MOST_PLACES characters."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.filtered = 0
        self.first = self.lengths = np.zeros(0, dtype=np.int64)
        self.group = np.zeros(1, dtype=np.int32)
        self.start = self.piece = np.zeros(0, dtype=np.int32)
        self.upto = np.zeros(0, dtype=np.float32)

    def extend(self) -> None:
        """Filter the units that `known` got since the last call."""
        new = list(self.known)[self.filtered :]
        if not new:
            return
        places, arcs = len(self.group) - 1, len(self.start)
        found = [(self.first, self.lengths, self.group[:-1], self.start, self.piece, self.upto)]
        for a, b in slices(np.fromiter(map(len, new), dtype=np.int64, count=len(new)), FILTER_PLACES):
            more = Lattice(new[a:b], self.vocabulary)
            group, start = (more.group + arcs).astype(np.int32), (more.start + places).astype(np.int32)
            piece, upto = more.piece.astype(np.int32), more.upto.astype(np.float32)
            found.append((more.first + places, more.lengths, group[:-1], start, piece, upto))
            places, arcs = places + len(group) - 1, arcs + len(start)
        self.first, self.lengths, self.group, self.start, self.piece, self.upto = map(np.concatenate, zip(*found))
        self.group = np.append(self.group, np.int32(arcs))
        self.filtered = len(self.known)

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each place (of a last character), the arc that a draw takes."""
        arc = self.group[place].astype(np.int64)
        last = self.group[place + 1] - 1
        going = np.flatnonzero((u > self.upto[arc]) & (arc < last))
        while len(going):
            arc[going] += 1
            now = arc[going]
            going = going[(u[going] > self.upto[now]) & (now < last[going])]
        return arc

    def draw_on(self, place: int, begin: int, base: int, step: int) -> np.ndarray:
        """What further draws take from `place` back to `begin`, after `step` draws."""
        taken = []
        while place >= begin:
            low = max(begin, place - WINDOW)
            group = self.group[low : place + 2].tolist()
            first = group[0]
            starts, piece, upto = (x[first : group[-1]].tolist() for x in (self.start, self.piece, self.upto))
            while place >= low:
                step += 1
                u = (mix_number((base + step * int(_M1)) & _64_BITS) >> 11) * 2.0**-53
                arc, last = group[place - low] - first, group[place - low + 1] - 1 - first
                while arc < last and u > upto[arc]:
                    arc += 1
                taken.append(piece[arc])
                place = starts[arc] - 1
        return np.array(taken, dtype=np.int64)


def sample(texts: list[str], keys: list[int | None], lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts, one after the other, and the offsets of each text's ids."""
    if len(lattices.known) > MOST_UNITS or len(lattices.group) > MOST_PLACES:
        lattices.forget()
    known = lattices.known
    which: list[int] = []
    counts = []
    for text in texts:
        # The encoder's space in front of a text; decoding takes it away again.
        found = [known.setdefault(u, len(known)) for u in _UNIT.findall(" " + text)] if text else []
        which += found
        counts.append(len(found))
    if not which:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        lattices.extend()
        unit = np.array(which, dtype=np.int64)
        per_text = np.array(counts)
        first_unit = np.cumsum(per_text) - per_text
        seeds = np.repeat(np.array([row_seed(k) for k in keys], dtype=np.uint64), per_text)
        number = np.arange(len(unit)) - np.repeat(first_unit, per_text)
        base = mix_bits(seeds + number.astype(np.uint64) * _M1)
        begin = lattices.first[unit]
        place = begin + lattices.lengths[unit] - 1
        active = np.arange(len(unit))
        steps = np.zeros(len(unit), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active) and len(taken) < TOGETHER:
            bits = mix_bits(base + np.uint64(len(taken) + 1) * _M1)
            u = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = lattices.draw(place, u)
            taken.append((active, lattices.piece[arc]))
            place = lattices.start[arc].astype(np.int64) - 1
            going = np.flatnonzero(place >= begin)
            steps[active] = len(taken)
            active, place, base, begin = active[going], place[going], base[going], begin[going]
    rest = []
    for i, *at in zip(active.tolist(), place.tolist(), begin.tolist(), base.tolist()):
        rest.append((i, lattices.draw_on(*at, len(taken))))
        steps[i] += len(rest[-1][1])
    ends = np.cumsum(steps)
    ids = np.empty(int(ends[-1]), dtype=np.int64)
    for step, (some, pieces) in enumerate(taken):
        ids[ends[some] - 1 - step] = pieces
    for i, pieces in rest:
        stop = ends[i] - len(taken)
        ids[stop - len(pieces) : stop] = pieces[::-1]
    offsets = np.concatenate([np.concatenate([[0], ends])[first_unit], [ends[-1]]])
    return spell_bytes(ids, offsets, lattices.vocabulary)


def spell_bytes(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Replace byte arcs by the ids of their characters' bytes."""
    size = len(vocabulary.pieces)
    codes = ids - size
    bare = np.flatnonzero(codes >= 0)
    if not len(bare):
        return ids.astype(np.int32), offsets
    c = codes[bare]
    many = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    repeats = np.ones(len(ids), dtype=np.int64)
    repeats[bare] = many
    ends = np.concatenate([[0], np.cumsum(repeats)])
    out = np.repeat(ids, repeats)
    at = ends[bare]
    lead = np.select([many == 1, many == 2, many == 3], [c, 0xC0 | (c >> 6), 0xE0 | (c >> 12)], 0xF0 | (c >> 18))
    out[at] = vocabulary.byte_ids[lead]
    for k in range(1, 4):
        more = many > k
        shift = 6 * (many[more] - 1 - k)
        out[at[more] + k] = vocabulary.byte_ids[0x80 | ((c[more] >> shift) & 0x3F)]
    return out.astype(np.int32), ends[offsets]


def decode(ids: list[int] | None, pieces: list[bytes]) -> str | None:
    """The text that was encoded: the pieces' bytes without the space put in front."""
    if ids is None:
        return None
    return b"".join([pieces[i] for i in ids])[1:].decode()


def _list_array(values: np.ndarray, offsets: np.ndarray, texts: list[str | None]) -> pa.Array:
    missing = np.array([t is None for t in texts])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
    if not missing.any():
        return lists
    return pa.ListArray.from_arrays(
        lists.offsets, lists.values, mask=pa.array(missing)
    )


def encode_documents(documents: DataFrame, model: str = MODEL, key: str = "doc_id", check: bool = False) -> DataFrame:
    """The rows with `piece_ids` (array<int>) and `n_pieces` added; shuffles nothing.

    With `check` every row is decoded again in the same pass, and `lossless` says whether that
    gave exactly its text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    added = ["piece_ids", "n_pieces"] + ["lossless"] * check
    documents = documents.select(*[c for c in documents.columns if c not in added])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        pieces = shared.value.pieces
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            ids, offsets = sample([t or "" for t in texts], batch.column(key).to_pylist(), lattices)
            columns = [_list_array(ids, offsets, texts), pa.array(np.diff(offsets), pa.int64())]
            if check:
                bounds = offsets.tolist()
                same = [
                    decode(None if t is None else ids[a:b].tolist(), pieces) == t
                    for t, a, b in zip(texts, bounds, bounds[1:])
                ]
                columns.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *added]
            )

    schema = T.StructType(list(documents.schema.fields))
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", T.LongType())
    if check:
        schema = schema.add("lossless", T.BooleanType())
    return documents.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model: str = MODEL, column: str = "decoded") -> DataFrame:
    """The rows with the text of their `piece_ids` added."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model).pieces)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [decode(ids, pieces) for ids in part.column("piece_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, column]
                )

    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])
    return encoded.mapInArrow(read, schema)


def encode_and_check(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, piece_ids, n_pieces and whether the decoded ids are exactly the text."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_documents(narrow, model, check=True).drop("text")
