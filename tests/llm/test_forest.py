from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from litrewise.llm import components, forest
from tests.llm import helpers


def brute_force(rows):
    """Class and links of each row, from all pairs."""
    hashes = forest.WordHashes()
    sets = [set(forest.shingles(text, hashes).tolist()) for _, text in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for a in range(len(rows)):
        members[root(a)].append(rows[a][0])
    names = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return sorted(((rows[a][0], names[root(a)], links[a]) for a in range(len(rows))), key=str)


@pytest.mark.parametrize("block,crowd", [(forest.BLOCK_SHINGLES, forest.CROWD), (500, 1)])
def test_equals_brute_force(prose, block, crowd):
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    got = forest.named_documents(prose, block, crowd).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_force(rows)
    assert any(r["n_links"] > 2 for r in got)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = forest.join_documents(odd).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_force(rows)


def test_one_of_each_class_stays(prose, odd, empty):
    kept = forest.keep_one(prose)
    assert kept.columns == prose.columns
    want = {r["class_id"] for r in forest.join_documents(prose).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert forest.keep_one(odd).count() == odd.count() - 2
    assert forest.keep_one(empty).count() == 0


def kept_of(spark, rows):
    docs = spark.createDataFrame([helpers.row(*r) for r in rows], helpers.SCHEMA).repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in forest.keep_one(docs).collect()), key=str)


def near_texts(seed):
    words = helpers.words(random.Random(seed), 120)
    return " ".join(words), " ".join([*words[:-1], "changed"]), " ".join([*words[:-1], "moved"])


def test_one_of_a_class_without_ids_stays(spark):
    (a, b, c), (d, e, _) = near_texts(1), near_texts(2)
    kept = kept_of(spark, [(None, a), (None, b), (None, c), (None, d), (None, d), (3, e)])
    assert [t for i, t in kept if i is None] in ([a], [b], [c])
    assert [(i, t) for i, t in kept if i is not None] == [(3, e)]
    assert kept_of(spark, [(None, a), (None, a), (None, a.upper())]) in ([(None, a)], [(None, a.upper())])


def test_one_of_near_texts_under_one_id_stays(spark):
    a, b, c = near_texts(3)
    kept = kept_of(spark, [(7, a), (7, a), (7, b), (9, c), (7, "another text of the same id")])
    assert len(kept) == 2 and (7, "another text of the same id") in kept
    assert {(7, a), (7, b)} & set(kept)


def test_rows_linked_with_nothing_stay(spark):
    # The two words have the same crc32.
    rows = [(None, "plumless"), (None, "buckeroo"), (None, "?!"), (None, "?!"), (None, None), (None, "")]
    assert kept_of(spark, rows) == sorted(rows, key=str)
    # The largest id is not that of rows without one.
    a, b, _ = near_texts(4)
    assert kept_of(spark, [(2**63 - 1, a), (None, a), (None, b)]) == [(2**63 - 1, a)]


def test_prefixes_are_shortened_to_the_target():
    def recall(plan, trees):
        missed = (1 - 0.8**plan.length) ** (trees - plan.shorter) * (1 - 0.8 ** (plan.length - 1)) ** plan.shorter
        return 1 - missed

    for trees, longest, target in ((16, 6, 0.999), (16, 6, 0.9999), (20, 4, 0.99999), (64, 8, 0.9999), (6, 4, 0.99)):
        plan = forest.prefix_plan(0.8, trees, longest, target)
        assert recall(plan, trees) >= target
        if plan.shorter:
            assert recall(forest.Plan(plan.length, plan.shorter - 1), trees) < target
        if plan.length < longest:
            assert recall(forest.Plan(plan.length + 1, trees - 1), trees) < target
    with pytest.raises(ValueError):
        forest.prefix_plan(0.5, trees=1, longest=3, target=0.99)


def test_crowded_tries_keep_their_long_prefix(spark):
    posts = [(1, t, 0, 500 - t if t % 2 else 3) for t in range(forest.TREES)]  # odd tries are crowded
    posts += [(2, t, 0, 2) for t in (0, 5)]
    posts += [(3, t, 0, 1000 - 10 * t) for t in range(forest.TREES)]
    frame = spark.createDataFrame(posts, "node long, tree int, stem long, n long")
    short = {r["node"]: r["short"] for r in forest.shortened(frame, 6, 64).collect()}
    assert short[1] == [0, 2, 4, 6, 8, 10]
    assert short[2] == [0, 1, 2, 3, 4, 5]  # not by who is met there
    assert sorted(short[3]) == list(range(forest.TREES - 6, forest.TREES))
    short = {r["node"]: r["short"] for r in forest.shortened(frame, 12, 64).collect()}
    assert short[1] == [*range(0, 20, 2), 19, 17]


def test_near_pairs_are_met(spark):
    """Pairs of 0.8 to 0.85, of which a forest may miss one in a hundred at most; also in a crowd."""
    rng = random.Random(14)
    rows = []
    for k in range(300):
        words = helpers.words(rng, 130)
        near = list(words)
        for place in rng.sample(range(10, 120, 12), 2):
            near[place] = f"new{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame([helpers.row(*r) for r in rows], helpers.SCHEMA).repartition(4)
    hashes = forest.WordHashes()
    sets = {i: set(forest.shingles(t, hashes).tolist()) for i, t in rows}
    linked = [i for i in range(0, 600, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    assert len(linked) > 250
    for crowd in (forest.CROWD, 1):
        found = {r["doc_id"]: r["class_id"] for r in forest.named_documents(docs, crowd=crowd).collect()}
        assert sum(found[i + 1] == i for i in linked) >= 0.99 * len(linked)


def test_a_chain_of_pages_is_no_group(spark):
    """Each page has half of its words in common with the next: what is compared grows with their
    number and not with its square."""
    rng = random.Random(15)
    work = []
    for n in (200, 400):
        parts = [" ".join(helpers.words(rng, 60)) for _ in range(n + 1)]
        rows = [helpers.row(i, f"{parts[i]} {parts[i + 1]}") for i in range(n)]
        docs = spark.createDataFrame(rows, helpers.SCHEMA).repartition(4)
        plan = forest.prefix_plan()
        nodes = forest.signed(docs, plan.length).withColumns({"copies": forest.F.lit(1)})
        posts = forest.settle(forest.shared_posts(nodes))
        units = forest.units_of(nodes, posts, forest.shortened(posts, plan.shorter, forest.CROWD))
        sizes = [r["n"] for r in units.groupBy(*forest.UNIT).agg(forest.F.count("*").alias("n")).collect()]
        assert max(sizes, default=0) <= 4
        work.append(sum(k * k for k in sizes))
    assert forest.join_documents(docs).filter("n_links > 0").count() == 0
    assert work[1] <= 4 * max(work[0], 20)


def test_one_text_without_ids_is_a_third_of_all_rows(spark):
    a, b, c = near_texts(9)
    rows = [(None, a)] * 300 + [(i, f"{t} {i // 100}") for i, t in enumerate([b, c] * 150)] + [(None, f"own text {i} " * 4) for i in range(300)]
    docs = spark.createDataFrame([helpers.row(*r) for r in rows], helpers.SCHEMA).repartition(4)
    got = forest.join_documents(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_force(rows)
    kept = [r["doc_id"] for r in forest.keep_one(docs).collect()]
    assert len(kept) == len({r["class_id"] for r in got if r["class_id"] is not None}) + 300


def test_products_count_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    links = forest.compare(sets, None)
    cross = forest.compare(sets[:12], sets[12:])
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            u, v = set(x.tolist()), set(y.tolist())
            want = 5 * len(u & v) >= 4 * len(u | v)
            assert links[a, b] == (want and a != b)
            if a < 12 <= b:
                assert cross[a, b - 12] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
