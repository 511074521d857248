"""MLlib's forests and boosted trees, grown from histograms of compactly kept rows.

MLlib keeps each training row as objects (some 330 bytes in a forest of 50 trees) and goes over all
of them at every level; where they do not fit in memory, each level reads them back. Here MLlib's own
code finds the thresholds, bins the rows and draws the bootstrap, so that both are its own; then a
row is a byte a feature, a byte a tree and its label, in blocks on disk. A pass over them sums count,
label and squared label by tree, node, feature and bin in numpy; a task for each tree merges these
and chooses the splits. Splits, order of nodes and draws of features follow MLlib's, and so do the
trees, up to splits that tie but for the order in which floating-point numbers are summed. The
fitted model is MLlib's.

What these estimators do not grow (weights, categorical features, more than 256 bins; in boosting other
losses, subsamples and validation) is left to MLlib.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from litrewise.placement import settled_within, shared_folder

# Workers need numpy and pyarrow only, not this library: functions go to them by value, and rows and
# results as plain tuples.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 65536
# Levels of a tree whose nodes compare whole columns; their paths fit a byte.
TOP_LEVELS = 5
# Tasks of a pass for each core: a task sends the sums of all nodes of the pass.
TASKS_PER_CORE = 3
# Up to so many bytes of sums are merged by the driver, which spares a pass its second stage.
MAX_DRIVER_BYTES = 16 * 1024 * 1024
# A bin is kept in a byte.
MAX_BINS = 256
# Scala's Double.MinValue, the gain of a split that may not be made.
INVALID = -sys.float_info.max
EPSILON = sys.float_info.epsilon

NODE_SCHEMA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


# Rows as arrays: labels; bins by feature and row; draws of the bootstrap by tree and row, or None where
# every row counts once; what is predicted so far, while boosting.
Block = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]


class Settings(NamedTuple):
    """What MLlib's metadata and parameters say of the trees to grow."""

    thresholds: list[list[float]]
    n_trees: int
    features_per_node: int
    depth: int
    min_rows: int
    min_weight: float
    min_gain: float
    max_bytes: int
    seed: int

    @property
    def n_features(self) -> int:
        return len(self.thresholds)

    @property
    def n_bins(self) -> int:
        return max(len(t) for t in self.thresholds) + 1


# MLlib's random numbers


class JavaRandom:
    """java.util.Random."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def next_int(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        bits = self.state >> 16
        return bits - (1 << 32) if bits >> 31 else bits

    def next_long(self) -> int:
        high = self.next_int() << 32
        return (high + self.next_int()) & 0xFFFFFFFFFFFFFFFF


def _murmur3(data: bytes, seed: int) -> int:
    """scala.util.hashing.MurmurHash3.bytesHash of whole words."""
    h, mask = seed, 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h ^= k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """`k` of the numbers below `n`, as by SamplingUtils.reservoirSampleAndCount."""
    data = seed.to_bytes(8, "big")
    low = _murmur3(data, 0x3C074A61)
    state = _murmur3(data, low) << 32 | low
    kept = list(range(min(n, k)))
    for number in range(k, n):
        words = []
        for bits in (26, 27):
            state ^= state << 21 & 0xFFFFFFFFFFFFFFFF
            state ^= state >> 35
            state ^= state << 4 & 0xFFFFFFFFFFFFFFFF
            words.append(state & (1 << bits) - 1)
        place = int(((words[0] << 27) + words[1]) * 2.0**-53 * (number + 1))
        if place < k:
            kept[place] = number
    return kept


# A tree and the sums of its nodes


class Tree:
    """A growing tree: arrays by node, the root first, the right child behind the left."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.level = [-1], [0], [-1], [0]
        self.sums: list[np.ndarray | None] = [None]
        self.gain, self.is_valid = [-1.0], [True]

    def split(self, node: int, feature: int, cut: int, gain: float, sums: Sequence[np.ndarray]) -> int:
        left = len(self.left)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, left, gain
        for part in sums:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.level.append(self.level[node] + 1)
            self.sums.append(part)
            self.gain.append(-1.0)
            self.is_valid.append(True)
        return left

    def prediction(self, node: int) -> float:
        count, total, _ = self.sums[node]
        return float(total / count) if count else 0.0


class Walk(NamedTuple):
    """A tree as tables: where rows go from each node; an end leads to itself.

    `top` has the first levels: the nodes of each, by the path that leads to them as a number (an end
    goes on to the left). There whole columns of bytes are compared with the cut of each node, which
    is faster than fetching the bins of each row while the nodes are few.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    steps: int
    top: list[np.ndarray]

    @classmethod
    def of(cls, tree: Tree) -> Walk:
        steps = max(tree.level)
        left = np.array(tree.left)
        ends = left < 0
        left = np.where(ends, np.arange(len(left)), left)
        top = [np.zeros(1, int)]
        while len(top) <= min(steps, TOP_LEVELS):
            sides = [left[top[-1]], left[top[-1]] + ~ends[top[-1]]]
            top.append(np.stack(sides, 1).reshape(-1))
        return cls(np.where(ends, 0, tree.feature), np.where(ends, MAX_BINS, tree.cut), left, steps, top)

    def nodes(self, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node of each of `rows`, of those with these bins."""
        path = np.zeros(bins.shape[1], np.uint8)
        for nodes in self.top[:-1]:
            goes_right = np.zeros(len(path), bool)
            for number, node in enumerate(nodes.tolist()):
                if self.left[node] != node:
                    # A plain number is compared byte by byte, one of numpy's as 64 bits.
                    beyond = bins[self.feature[node]] > int(self.cut[node])
                    beyond &= path == number
                    goes_right |= beyond
            path <<= 1
            path |= goes_right
        node = self.top[-1].take(path.take(rows))
        begins, flat = self.feature * bins.shape[1], bins.reshape(-1)
        for _ in range(len(self.top) - 1, self.steps):
            at = begins.take(node)
            at += rows
            beyond = flat.take(at) > self.cut.take(node)
            node = self.left.take(node)
            node += beyond
        return node


class Wanted(NamedTuple):
    """The nodes of one tree to split in a pass: `slot` by node (the number of slots for others),
    and the features of each slot, by place among them and slot."""

    walk: Walk
    slot: np.ndarray
    features: np.ndarray


def histograms(blocks: Iterable[Block], wanted: dict[int, Wanted], n_bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each tree, the sums (count, label, squared label) by feature, slot and bin."""
    found: dict[int, np.ndarray] = {}
    for label, bins, counts, _ in blocks:
        n, flat = len(label), bins.reshape(-1)
        for number, (walk, slot, features) in wanted.items():
            if counts is None:
                rows, weight, y = np.arange(n), None, label
                weighted = y
            else:
                rows = np.flatnonzero(counts[number])
                weight, y = counts[number].take(rows).astype(float), label.take(rows)
                weighted = weight * y
            squared = weighted * y
            size = features.shape[1] * n_bins
            sums = found.setdefault(number, np.zeros((3, len(features), size)))
            # Rows at other nodes fall behind the slots.
            place = slot.take(walk.nodes(bins, rows))
            first = place * n_bins
            for j, of_slot in enumerate(features * n):
                at = np.append(of_slot, 0).take(place)
                at += rows
                key = flat.take(at) + first
                sums[0, j] += np.bincount(key, weight, size)[:size]
                sums[1, j] += np.bincount(key, weighted, size)[:size]
                sums[2, j] += np.bincount(key, squared, size)[:size]
    yield from found.items()


class Best(NamedTuple):
    """By slot: the sums of the node, its best gain, that split's feature and bin, and the sums of
    its sides."""

    parent: np.ndarray
    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray


def variance(sums: np.ndarray) -> np.ndarray:
    """MLlib's impurity of (count, label, squared label)."""
    count, total, squared = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count == 0, 0.0, (squared - total * total / count) / count)


def best_splits(sums: np.ndarray, features: np.ndarray, parent: np.ndarray | None, settings: Settings) -> Best:
    """The split of greatest gain of each slot; of equal ones the first, as in MLlib. `parent` has the
    sums of the nodes, or None for a root, whose sums follow from its first split."""
    places, slots = features.shape
    below = np.cumsum(sums.reshape(3, places, slots, -1), axis=-1)
    left, whole = below[..., :-1], below[..., -1:]
    right = whole - left
    n_cuts = np.array([len(t) for t in settings.thresholds])[features]
    is_cut = np.arange(left.shape[-1]) < n_cuts[..., None]
    if parent is None:
        first = (n_cuts > 0).argmax(0)
        at = (slice(None), first, np.arange(slots))
        parent = left[at][..., 0] + right[at][..., 0] if left.shape[-1] else whole[at][..., 0]
    impurity = variance(parent)
    weights = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity[:, None] - left[0] / weights * variance(left) - right[0] / weights * variance(right)
    least = max(settings.min_rows, settings.min_weight)
    gain = np.where((left[0] < least) | (right[0] < least) | (gain < settings.min_gain), INVALID, gain)
    gain = np.where(is_cut, gain, -np.inf).transpose(1, 0, 2).reshape(slots, -1)
    if not gain.shape[1]:
        return Best(parent, np.full(slots, INVALID), features[0], np.zeros(slots, int), parent, parent)
    best = gain.argmax(1)
    j, cut = np.divmod(best, left.shape[-1])
    chosen = (slice(None), j, np.arange(slots), cut)
    return Best(parent, gain[np.arange(slots), best], features[j, np.arange(slots)], cut, left[chosen], right[chosen])


# Growing


class Order:
    """The open nodes, the last first, and the features drawn for them, in MLlib's order."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.random = settings, JavaRandom(settings.seed)
        self.open = [(number, 0) for number in range(settings.n_trees)]

    def group(self) -> dict[int, list[tuple[int, list[int]]]]:
        """The nodes of one pass and their features, by tree: as many as fit in MLlib's memory."""
        settings, group, used = self.settings, {}, 0
        while self.open:
            number, node = self.open[-1]
            features = list(range(settings.n_features))
            if settings.features_per_node < settings.n_features:
                features = reservoir(settings.n_features, settings.features_per_node, self.random.next_long())
            size = 3 * 8 * sum(len(settings.thresholds[f]) + 1 for f in features)
            if used and used + size > settings.max_bytes:
                break
            self.open.pop()
            group.setdefault(number, []).append((node, features))
            used += size
        return group


def in_few_tasks(blocks: RDD) -> RDD:
    """The kept rows in partitions that suit the cores."""
    most = TASKS_PER_CORE * blocks.context.defaultParallelism
    return blocks.coalesce(most) if blocks.getNumPartitions() > most else blocks


def grow(blocks: RDD, settings: Settings, tree_order: Callable[[list[int]], list[int]]) -> list[Tree]:
    """All trees. `blocks` is an RDD of `Block`; `tree_order` puts the trees of a pass in the order in
    which MLlib looks at their splits (they come in the order of their first nodes)."""
    trees = [Tree() for _ in range(settings.n_trees)]
    order = Order(settings)
    while order.open:
        group = order.group()
        best = _pass(blocks, settings, trees, group)
        for number in tree_order(list(group)):
            for slot, (node, _) in enumerate(group[number]):
                for child in _decide(trees[number], node, best[number], slot, settings):
                    order.open.append((number, child))
    return trees


def _pass(blocks: RDD, settings: Settings, trees: list[Tree], group: dict[int, list[tuple[int, list[int]]]]) -> dict[int, Best]:
    wanted, parents = {}, {}
    for number, nodes in group.items():
        tree = trees[number]
        slot = np.full(len(tree.left), len(nodes))
        slot[[node for node, _ in nodes]] = np.arange(len(nodes))
        wanted[number] = Wanted(Walk.of(tree), slot, np.array([features for _, features in nodes]).T)
        parents[number] = None if nodes[0][0] == 0 else np.array([tree.sums[node] for node, _ in nodes]).T
    n_bins = settings.n_bins
    of_group = {number: (wanted[number].features, parents[number]) for number in group}

    def summed(part: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        return histograms(part, wanted, n_bins)

    def chosen(item: tuple[int, np.ndarray]) -> tuple[int, tuple[np.ndarray, ...]]:
        return item[0], tuple(best_splits(item[1], *of_group[item[0]], settings))

    sums = blocks.mapPartitions(summed)
    size = sum(w.features.size for w in wanted.values()) * settings.n_bins * 3 * 8
    if size * blocks.getNumPartitions() <= MAX_DRIVER_BYTES:
        merged: dict[int, np.ndarray] = {}
        for number, part in sums.collect():
            merged[number] = merged[number] + part if number in merged else part
        best = map(chosen, merged.items())
    else:
        best = sums.reduceByKey(np.add, min(len(group), blocks.context.defaultParallelism)).map(chosen).collect()
    return {number: Best(*parts) for number, parts in best}


def _decide(tree: Tree, node: int, best: Best, slot: int, settings: Settings) -> list[int]:
    """Split the node or leave it a leaf; its children that are to be split in turn."""
    tree.sums[node], gain = best.parent[:, slot], float(best.gain[slot])
    tree.is_valid[node] = gain > INVALID
    if gain <= 0 or tree.level[node] == settings.depth:
        return []
    sides = [best.left[:, slot], best.right[:, slot]]
    left = tree.split(node, int(best.feature[slot]), int(best.cut[slot]), gain, sides)
    if tree.level[left] == settings.depth:
        return []
    return [left + i for i, side in enumerate(sides) if not abs(variance(side)) < EPSILON]


def boost(blocks: RDD, settings: Settings, rounds: int, rate: float) -> tuple[list[Tree], list[float]]:
    """Trees for squared loss: the first of the labels, each other one of twice what is left.

    What is predicted so far is kept beside each row and brought up to date once a round.
    """
    trees, weights, kept = [], [], [blocks]
    try:
        for number in range(rounds):
            [tree] = grow(in_few_tasks(kept[-1]).map(_left_over), settings, list)
            trees.append(tree)
            weights.append(rate if number else 1.0)
            # The first pass of a round has written its rows from those of the round before.
            if len(kept) > 2:
                kept.pop(1).unpersist()
            if number + 1 < rounds:
                kept.append(kept[-1].map(_update(tree, weights[-1])).persist(StorageLevel.DISK_ONLY))
    finally:
        for rows in kept[1:]:
            rows.unpersist()
    return trees, weights


def _left_over(block: Block) -> Block:
    label, bins, counts, predicted = block
    return block if predicted is None else (2.0 * (label - predicted), bins, counts, predicted)


def _update(tree: Tree, weight: float) -> Callable[[Block], Block]:
    walk = Walk.of(tree)
    values = np.array([tree.prediction(node) for node in range(len(tree.left))])

    def updated(block: Block) -> Block:
        label, bins, counts, predicted = block
        added = values.take(walk.nodes(bins, np.arange(len(label)))) * weight
        return label, bins, counts, added if predicted is None else predicted + added

    return updated


# From MLlib and back


class _Java:
    """MLlib's own parts, reached through the gateway."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.impl = self.jvm.org.apache.spark.ml.tree.impl

    def named(self, name: str) -> Any:
        loader = self.jvm.java.lang.Thread.currentThread().getContextClassLoader()
        return self.jvm.java.lang.Class.forName(name, True, loader)

    def module(self, name: str) -> Any:
        return self.named(f"{name}$").getField("MODULE$").get(None)

    def array(self, of: Any, items: Sequence[Any]) -> Any:
        made = self.spark.sparkContext._gateway.new_array(of, len(items))
        for i, item in enumerate(items):
            made[i] = item
        return made

    def new(self, name: str, *items: Any) -> Any:
        [constructor] = [c for c in self.named(name).getConstructors() if c.getParameterCount() == len(items)]
        return constructor.newInstance(self.array(self.jvm.java.lang.Object, items))

    def encoder(self, of: str, **fields: Any) -> Any:
        """An encoder of objects of a class by their accessors."""
        encoders = "org.apache.spark.sql.catalyst.encoders.AgnosticEncoders"
        none, metadata = self.jvm.scala.Option.empty(), self.module("org.apache.spark.sql.types.Metadata").empty()
        listed = self.jvm.java.util.ArrayList()
        for name, encoder in fields.items():
            listed.add(self.new(f"{encoders}$EncoderField", name, encoder, False, metadata, none, none))
        sequence = self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(listed).toSeq()
        tag = self.module("scala.reflect.ClassTag").apply(self.named(of))
        return self.new(f"{encoders}$ProductEncoder", tag, sequence, none)

    def frame_of(self, bagged: Any) -> DataFrame:
        """MLlib's bagged rows as a DataFrame: label, bins, counts."""
        encoders = "org.apache.spark.sql.catalyst.encoders.AgnosticEncoders"
        number = self.module(f"{encoders}$PrimitiveDoubleEncoder")
        numbers = self.new(f"{encoders}$ArrayEncoder", self.module(f"{encoders}$PrimitiveIntEncoder"), False)
        point = self.encoder("org.apache.spark.ml.tree.impl.TreePoint", label=number, binnedFeatures=numbers)
        row = self.encoder("org.apache.spark.ml.tree.impl.BaggedPoint", datum=point, subsampleCounts=numbers)
        frame = DataFrame(self.spark._jsparkSession.createDataset(bagged, row).toDF(), self.spark)
        return frame.select("datum.label", "datum.binnedFeatures", "subsampleCounts")

    def tree_order(self, numbers: list[int]) -> list[int]:
        """The order in which MLlib goes through the trees of a pass: that of its hash map."""
        by_number = self.jvm.scala.collection.mutable.HashMap()
        for number in numbers:
            by_number.put(number, number)
        keys = by_number.toMap(self.module("scala.$less$colon$less").refl()).keysIterator()
        return [keys.next() for _ in numbers]


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks: labels, bins by feature, counts by tree (none where all are 1)."""

    def block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        label, bins, counts = (np.concatenate(column) for column in zip(*parts))
        sent = None if (counts == 1).all() else counts.T.tobytes()
        columns = [pa.array([v], pa.binary()) for v in (label.tobytes(), bins.T.tobytes(), sent)]
        return pa.RecordBatch.from_arrays(columns, names=["label", "bins", "counts"])

    waiting, n_waiting = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(0).to_numpy(zero_copy_only=False)
        lists = [batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(label), -1) for i in (1, 2)]
        for start in range(0, len(label), BLOCK_ROWS):
            part = slice(start, start + BLOCK_ROWS)
            if n_waiting + len(label[part]) > BLOCK_ROWS:
                yield block(waiting)
                waiting, n_waiting = [], 0
            waiting.append((label[part], lists[0][part], lists[1][part]))
            n_waiting += len(label[part])
    if waiting:
        yield block(waiting)


def _unpacked(row: Any) -> Block:
    label, bins, counts = row
    label = np.frombuffer(label)
    by_row = [None if v is None else np.frombuffer(v, np.uint8).reshape(-1, len(label)) for v in (bins, counts)]
    return label, *by_row, None


class _Prepared(NamedTuple):
    java: _Java
    settings: Settings
    blocks: RDD


def _prepared(estimator: Any, dataset: DataFrame, n_trees: int, bootstrap: bool) -> _Prepared | None:
    """The rows binned and drawn by MLlib, kept on disk; None if MLlib has to grow the trees itself."""
    java = _Java(dataset.sparkSession)
    estimator._transfer_params_to_java()
    own, jvm = estimator._java_obj, java.jvm
    features = dataset._jdf.schema().apply(estimator.getFeaturesCol())
    categories = java.module("org.apache.spark.ml.util.MetadataUtils").getCategoricalFeatures(features)
    if not categories.isEmpty() or estimator.isDefined("weightCol") or estimator.getMaxBins() > MAX_BINS:
        return None
    instances = java.module("org.apache.spark.ml.util.DatasetUtils").extractInstances(own, dataset._jdf, jvm.scala.Option.empty())
    kind = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    variance_of = java.module("org.apache.spark.mllib.tree.impurity.Variance")
    strategy = own.getOldStrategy(categories, 0, kind, variance_of)
    getattr(strategy, "bootstrap_$eq")(bootstrap)
    metadata = java.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, n_trees, estimator.getFeatureSubsetStrategy())
    splits = java.module("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, estimator.getSeed())
    settings = Settings(
        [[s.threshold() for s in of_feature] for of_feature in splits], n_trees, metadata.numFeaturesPerNode(),
        estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), metadata.minWeightPerNode(), estimator.getMinInfoGain(),
        estimator.getMaxMemoryInMB() * 1024 * 1024, estimator.getSeed(),
    )
    points = java.impl.TreePoint.convertToTreeRDD(instances, splits, metadata)
    weight = getattr(java.impl.BaggedPoint, "convertToBaggedRDD$default$5")()
    bagged = java.impl.BaggedPoint.convertToBaggedRDD(
        points, estimator.getSubsamplingRate(), n_trees, bootstrap, weight, estimator.getSeed()
    )
    packed = java.frame_of(bagged).mapInArrow(_packed, "label binary, bins binary, counts binary")
    return _Prepared(java, settings, packed.rdd.map(_unpacked).persist(StorageLevel.DISK_ONLY))


def _node_rows(number: int, tree: Tree, thresholds: list[list[float]]) -> list[tuple]:
    """The tree as MLlib stores it: nodes numbered from the root, left side first; leaves that
    predict the same are one."""
    rows: list[tuple] = []

    def merged(node: int) -> float | None:
        """The value of a node that is a leaf, or becomes one."""
        if tree.left[node] < 0:
            return tree.prediction(node)
        sides = [merged(tree.left[node]), merged(tree.left[node] + 1)]
        if sides[0] is not None and sides[0] == sides[1]:
            tree.left[node] = -1
            return sides[0]
        return None

    def add(node: int) -> int:
        place, sums, left = len(rows), tree.sums[node], tree.left[node]
        rows.append(())
        impurity = float(variance(sums)) if tree.is_valid[node] else -1.0
        what = (tree.prediction(node), impurity, sums.tolist(), int(sums[0]))
        if left < 0:
            rows[place] = (number, (place, *what, -1.0, -1, -1, (-1, [], -1)))
        else:
            split = (tree.feature[node], [thresholds[tree.feature[node]][tree.cut[node]]], -1)
            rows[place] = (number, (place, *what, tree.gain[node], add(left), add(left + 1), split))
        return place

    merged(0)
    add(0)
    return rows


def _model(java: _Java, estimator: Any, kind: Any, trees: list[Tree], weights: list[float] | None, thresholds: list[list[float]]) -> Any:
    """MLlib's model of these trees: a model of empty trees is saved, given the nodes, and loaded."""
    jvm, own, n_features = java.jvm, estimator._java_obj, len(thresholds)
    regression = jvm.org.apache.spark.ml.regression
    numbers = java.array(jvm.double, [0.0] * 3)
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(numbers, 0)
    leaf = jvm.org.apache.spark.ml.tree.LeafNode(0.0, 0.0, calculator)
    identify = java.module("org.apache.spark.ml.util.Identifiable")
    nothing = jvm.org.apache.spark.ml.param.ParamMap.empty()
    empty = [
        own.copyValues(regression.DecisionTreeRegressionModel(identify.randomUID("dtr"), leaf, n_features), nothing) for _ in trees
    ]
    rest = [] if weights is None else [java.array(jvm.double, weights)]
    bare = getattr(regression, kind.__name__)(
        own.uid(), java.array(regression.DecisionTreeRegressionModel, empty), *rest, n_features
    )
    with settled_within(java.spark):
        path = shared_folder(java.spark)
        own.copyValues(bare, nothing).save(path)
        rows = [row for number, tree in enumerate(trees) for row in _node_rows(number, tree, thresholds)]
        java.spark.createDataFrame(rows, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
        model = kind.load(path)
    return estimator._copyValues(model)


class Forest(RandomForestRegressor):
    """RandomForestRegressor that grows its trees by `grow`."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        found = _prepared(self, dataset, self.getNumTrees(), self.getBootstrap())
        if found is None:
            return super()._fit(dataset)
        try:
            trees = grow(in_few_tasks(found.blocks), found.settings, found.java.tree_order)
        finally:
            found.blocks.unpersist()
        return _model(found.java, self, RandomForestRegressionModel, trees, None, found.settings.thresholds)


class BoostedTrees(GBTRegressor):
    """GBTRegressor that grows its trees by `boost`."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        ordinary = self.getLossType() == "squared" and self.getSubsamplingRate() == 1 and self.getFeatureSubsetStrategy() == "all"
        found = _prepared(self, dataset, 1, False) if ordinary and not self.isDefined("validationIndicatorCol") else None
        if found is None:
            return super()._fit(dataset)
        try:
            trees, weights = boost(found.blocks, found.settings, self.getMaxIter(), self.getStepSize())
        finally:
            found.blocks.unpersist()
        return _model(found.java, self, GBTRegressionModel, trees, weights, found.settings.thresholds)
