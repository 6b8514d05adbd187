"""Dual-tree rounds against plain ones: trees, ties, large components, rows that are left out."""

import math

import numpy as np
import pytest

from tallygrove.llm import clusters
from tallygrove.llm.clusters import Tree


def plain_assign(points, centroids):
    away = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centroids] for p in points]
    return [min(range(len(centroids)), key=lambda c: (d[c], c)) for d in away]


def plain_rounds(points, centroids, rounds):
    for _ in range(rounds):
        own = plain_assign(points, centroids)
        for c in range(len(centroids)):
            some = [p for p, o in zip(points, own) if o == c]
            if some:
                centroids[c] = tuple(sum(map(int, x)) // len(some) for x in zip(*some))
    return centroids, plain_assign(points, centroids)


def crowds(rng, n, dims, spread):
    middle = rng.integers(-500, 500, (5, dims))
    return np.unique(middle[rng.integers(0, 5, n)] + rng.integers(-spread, spread + 1, (n, dims)), axis=0)


@pytest.mark.parametrize("spread", [0, 3, 100, 2000])
def test_tree_covers_and_separates(spread):
    rng = np.random.default_rng(spread)
    points = crowds(rng, 400, 6, spread)
    tree, order = Tree.of(points, np.ones(len(points), np.int64), 4)
    assert sorted(order) == list(range(len(points))) and (tree.points == points[order]).all()
    for centre, first, many, child, children in tree.nodes:
        at = list(tree.nodes[:, 0]).index(centre)
        assert at >= 0 and first <= centre < first + many
        if children:
            own = tree.nodes[child : child + children]
            assert sum(own[:, 2]) == many and sorted(own[:, 1])[0] == first
            away = [math.dist(tree.points[a], tree.points[b]) for i, a in enumerate(own[:, 0]) for b in own[:i, 0]]
            largest = max(math.dist(tree.points[centre], p) for p in tree.points[first : first + many])
            reach = 2.0 ** (math.ceil(math.log2(largest)) - 1)
            assert all(d > reach for d in away)
    for node, radius in zip(tree.nodes, tree.radii):
        assert all(math.dist(tree.points[node[0]], p) <= radius for p in tree.points[node[1] : node[1] + node[2]])


@pytest.mark.parametrize("k", [1, 2, 8, 40])
@pytest.mark.parametrize("spread", [0, 3, 100, 2000])
def test_assign(spread, k):
    rng = np.random.default_rng(k)
    points = crowds(rng, 500, 8, spread)
    times = rng.integers(1, 4, len(points))
    tree, _ = Tree.of(points, times, 16)
    # Some centroids are points themselves and some are twins, so that there are ties.
    centroids = [tuple(map(int, p)) for p in rng.integers(-600, 600, (k, 8))]
    centroids[k // 2 :: 3] = [tuple(map(int, points[i % len(points)])) for i in range(len(centroids[k // 2 :: 3]))]
    centroids[-1] = centroids[0]
    own, sums, counts = clusters.assign(tree, *clusters.centroid_tree(centroids))
    assert own.tolist() == plain_assign(tree.points, centroids)
    for c in range(k):
        assert counts[c] == tree.times[own == c].sum() and (sums[c] == (tree.points * tree.times[:, None])[own == c].sum(axis=0)).all()


def test_whole_nodes_are_taken_without_their_points():
    """Far crowds: the comparison of leaves stays small."""
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(-3, 4, (800, 8)) + np.repeat([[0], [9000]], 400, axis=0), axis=0)
    tree, _ = Tree.of(points, np.ones(len(points), np.int64), 16)
    seen, plain = [], clusters._nearest
    clusters._nearest = lambda *a: seen.append(len(a[2])) or plain(*a)
    try:
        own, _, _ = clusters.assign(tree, *clusters.centroid_tree([(0,) * 8, (9000,) * 8]))
    finally:
        clusters._nearest = plain
    assert not seen and own.tolist() == plain_assign(tree.points, [(0,) * 8, (9000,) * 8])


def odd(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(120)]
    good += [(7, good[7][1]), (200, good[7][1]), (None, good[3][1]), (201, [1e30] * 64), (202, [-3e38] * 63 + [1.0]), (203, [200_000.5] * 64)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [1.0] * 63 + [float("inf")])]
    return good, spark.createDataFrame([(i, v, "c", "d") for i, v in good + bad], "vec_id long, embedding array<float>, cluster string, distance string")


def test_against_plain_rounds_with_odd_rows(spark):
    import hashlib

    good, df = odd(spark)
    # As the table holds them: 32-bit floats.
    whole = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in good]
    start = [w for _, w in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), w) for i, w in whole if i is not None)[:8]]
    centroids, own = plain_rounds([w for _, w in whole], start, 10)
    got = clusters.cluster(df).collect()

    def row(i, w, c):
        d = sum((a - b) ** 2 for a, b in zip(w, centroids[c]))
        return (i, c, d if d < 1 << 63 else None, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())

    assert sorted(map(repr, ((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got))) == sorted(map(repr, (row(i, w, c) for (i, w), c in zip(whole, own))))
    for r in got:
        away = [x.distance for x in got if x.cluster == r.cluster]
        assert r.cluster_inertia == (None if None in away else sum(away))


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    one = clusters.cluster(spark.createDataFrame([(5, [0.5] * 64), (5, [0.5] * 64)], kind)).collect()
    assert [(r.vec_id, r.distance, r.inertia) for r in one] == [(5, 0, 0)] * 2 and {r.cluster for r in one} == {0}
    assert clusters.cluster(spark.createDataFrame([], kind)).count() == 0
    assert clusters.cluster(spark.createDataFrame([(None, [0.5] * 64), (1, [0.5])], kind)).count() == 0


def test_other_sizes(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(-50, 50, (300, 3))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: r.cluster for r in clusters.cluster(df, k=20, rounds=3, seed=9, dims=3, scale=1).collect()}
    start = clusters.first_centroids(df, 20, 9, 3, 1)
    _, own = plain_rounds([tuple(p) for p in points], list(start), 3)
    assert [got[i] for i in range(300)] == own
