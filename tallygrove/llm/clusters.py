"""Lloyd's algorithm with two trees: a cover tree over each block of vectors and a tree over the centroids of the round.

Vectors of whole numbers are packed once into blocks of at most BLOCK rows with the tree of their distinct points, written to the
shared folder. Each round reads the blocks and goes down both trees at once. A pair of nodes is dropped if the distance of their
centres less both radii is over what some centroid can guarantee for the whole vector node; a node with one centroid left gives
its stored sum; where neither bound decides, leaf pairs are compared exactly. Rounds shuffle sums and counts alone.

All sums and distances are whole numbers; bounds are floats with a margin, so they never drop the nearest centroid or one that
ties with it. Vectors with components so large that squared distances may leave a long go into blocks of Python's own whole numbers,
which is slow and exact too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_rows, dropped, schema, written

BLOCK, LEAF = 1024, 16
#: Bounds are widened by this share, far above the rounding of their floats.
MARGIN = 1e-9
#: Pairs of a point and a centroid that are compared at once.
PAIRS = 1 << 15
#: Sums are carried in digits to this base, so that each fits into a long.
DIGIT = 1 << 60
#: Most numbers in all centroids together: they are held by the driver and sent to every task.
MOST_NUMBERS = 1 << 22

_BLOCK = "ids array<long>, points binary, point_of binary, times binary, nodes binary, radii binary, far boolean"
#: Blocks that one Arrow batch brings to a task.
BLOCKS_AT_ONCE = 16


def far_from(dims: int) -> int:
    """Below this, components fit into 32 bits and squared distances into 63."""
    return min(1 << 30, math.isqrt((1 << 60) // dims))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: of longs if all components are under far_from(), else of Python's whole numbers."""
    d = a - b
    return (d * d).sum(axis=-1)


def _rooted(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        squares = np.frompyfunc(lambda x: float(x) if x < 1 << 1000 else math.inf, 1, 1)(squares)
    return np.sqrt(squares.astype(np.float64))


class Tree:
    """A simplified cover tree: a node's points lie within its radius of its centre, and centres of siblings lie further apart than
    half the distance that covers their parent. Points are in the order of the leaves, so that every node is a range of them.

    nodes: centre, first point, number of points, first child, number of children (one row each, children next to each other).
    """

    def __init__(self, points: np.ndarray, times: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.points, self.times, self.nodes, self.radii = points, times, nodes, radii
        #: Sums and counts of all points before each one, so that a node's are a difference.
        self.before = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points * times[:, None], axis=0)])
        self.many = np.concatenate([[0], np.cumsum(times)])

    @classmethod
    def of(cls, points: np.ndarray, times: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """The tree of distinct points, and their order in it."""
        n = len(points)
        order: list[np.ndarray] = []
        nodes, radii = [[0, 0, n, 0, 0]], [0.0]
        stack = [(0, 0, np.arange(n), _rooted(_square(points, points[:1])))]
        placed = 0
        # Depth first, so that a node's points are placed one after the other.
        while stack:
            at, centre, own, away = stack.pop()
            radius = float(away.max())
            nodes[at][:3], radii[at] = [centre, placed, len(own)], radius * (1 + MARGIN)
            if len(own) <= leaf or radius == 0 or radius == math.inf:
                order.append(own)
                placed += len(own)
                continue
            # Half of the power of two that covers the node: siblings' centres keep that distance, children's points are within it.
            reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            children, left, left_away = [], own, away
            next_centre = centre
            while len(left):
                if next_centre is None:
                    next_centre = int(left[0])
                    left_away = _rooted(_square(points[left], points[next_centre]))
                near = left_away <= reach
                children.append((next_centre, left[near], left_away[near]))
                left, next_centre = left[~near], None
            first = len(nodes)
            nodes[at][3:] = [first, len(children)]
            for child, (c, some, d) in enumerate(children):
                nodes.append([c, 0, 0, 0, 0])
                radii.append(0.0)
                stack.append((first + child, c, some, d))
        ordered = np.concatenate(order)
        table = np.array(nodes, np.int64)
        place = np.empty(n, np.int64)
        place[ordered] = np.arange(n)
        table[:, 0] = place[table[:, 0]]
        return cls(points[ordered], times[ordered], table, np.array(radii)), ordered


def _ragged(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of ranges one after the other, and the range that each is of."""
    of = np.repeat(np.arange(len(first)), many)
    ends = np.cumsum(many)
    return np.arange(int(ends[-1]) if len(ends) else 0) - (ends - many)[of] + first[of], of


def _nearest(points: np.ndarray, centroids: np.ndarray, point: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs sorted by point: each point once, and the nearest of its centroids; of equals the smaller number."""
    square = np.concatenate([_square(points[point[i : i + PAIRS]], centroids[number[i : i + PAIRS]]) for i in range(0, len(point), PAIRS)])
    order = np.lexsort((number, square, point)) if square.dtype != object else np.array(sorted(range(len(point)), key=lambda i: (point[i], square[i], number[i])))
    point, number = point[order], number[order]
    first = np.ones(len(point), bool)
    first[1:] = point[1:] != point[:-1]
    return point[first], number[first]


def assign(tree: Tree, centres: Tree, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's centroid, and the sums and counts of each centroid. numbers: the centroid that each point of `centres` is."""
    k, dims = len(numbers), tree.points.shape[1]
    kind = object if object in (tree.points.dtype, centres.points.dtype) else np.int64
    sums, counts = np.zeros((k, dims), kind), np.zeros(k, np.int64)
    cluster = np.full(len(tree.points), -1, np.int64)
    by_number = np.empty((k, dims), centres.points.dtype)
    by_number[numbers] = centres.points
    # Pairs of a vector node and a node of the centroids, sorted by the vector node.
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        away = _rooted(_square(tree.points[tree.nodes[q, 0]], centres.points[centres.nodes[r, 0]]))
        # The centre of a node of centroids is itself a centroid: all vectors of q have one within this distance.
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        many = np.diff(np.append(start, len(q)))
        most = np.repeat(np.minimum.reduceat(away, start), many) + tree.radii[q]
        stays = ~(away - tree.radii[q] - centres.radii[r] > most + MARGIN * (1 + most + away))
        q, r = q[stays], r[stays]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        many = np.diff(np.append(start, len(q)))
        inner = centres.nodes[r, 4] > 0
        # Centroids are split first where their node is the larger one; then all pairs of a vector node go down together.
        split = inner & ((centres.radii[r] >= tree.radii[q]) | (tree.nodes[q, 4] == 0))
        busy = np.repeat(np.logical_or.reduceat(split, start), many)
        alone = np.repeat(many == 1, many) & ~inner & (centres.nodes[r, 2] == 1)
        leaf = (tree.nodes[q, 4] == 0) & ~busy & ~alone
        down = ~busy & ~alone & ~leaf
        for node, number in zip(q[alone], numbers[centres.nodes[r[alone], 1]]):
            first, size = tree.nodes[node, 1], tree.nodes[node, 2]
            cluster[first : first + size] = number
            sums[number] += tree.before[first + size] - tree.before[first]
            counts[number] += tree.many[first + size] - tree.many[first]
        if leaf.any():
            own, of = _ragged(centres.nodes[r[leaf], 1], centres.nodes[r[leaf], 2])
            owner = q[leaf][of]
            point, pair = _ragged(tree.nodes[owner, 1], tree.nodes[owner, 2])
            number = numbers[own][pair]
            order = np.argsort(point, kind="stable")
            point, number = _nearest(tree.points, by_number, point[order], number[order])
            cluster[point] = number
            np.add.at(counts, number, tree.times[point])
            np.add.at(sums, number, tree.points[point] * tree.times[point][:, None])
        # What is left: split centroids' nodes, or children of vector nodes with all that their parent has kept.
        parts = []
        if busy.any():
            child, of = _ragged(centres.nodes[r[split], 3], centres.nodes[r[split], 4])
            parts += [(q[busy & ~split], r[busy & ~split]), (q[split][of], child)]
        if down.any():
            child, of = _ragged(tree.nodes[q[down], 3], tree.nodes[q[down], 4])
            parts.append((child, r[down][of]))
        q, r = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((r, q))
        q, r = q[order], r[order]
    return cluster, sums, counts


def centroid_tree(centroids: list[tuple[int, ...]]) -> tuple[Tree, np.ndarray]:
    """The tree over the centroids of a round; equal ones are different leaves of one place."""
    far = any(abs(x) >= far_from(len(c)) for c in centroids for x in c)
    points = np.array(centroids, object if far else np.int64).reshape(len(centroids), -1)
    tree, order = Tree.of(points, np.ones(len(points), np.int64), 1)
    return tree, order


def _floor(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale


def blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Packed blocks of the vectors with exactly `dims` components, all of them there and finite; the others are left out."""
    kind = schema(_BLOCK)

    def pack(ids: list, whole: np.ndarray, far: bool) -> tuple:
        if far:
            seen: dict[tuple, int] = {}
            point_of = np.array([seen.setdefault(tuple(row), len(seen)) for row in whole], np.int32)
            points = np.array(list(seen), object).reshape(len(seen), dims)
        else:
            points, point_of = np.unique(whole, axis=0, return_inverse=True)
        times = np.bincount(point_of.reshape(-1), minlength=len(points)).astype(np.int64)
        tree, order = Tree.of(points, times, LEAF)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        points = ",".join(map(str, tree.points.reshape(-1))).encode() if far else tree.points.astype("<i4").tobytes()
        return ids, points, place[point_of.reshape(-1)].astype("<i4").tobytes(), tree.times.astype("<i8").tobytes(), tree.nodes.astype("<i4").tobytes(), tree.radii.astype("<f8").tobytes(), far

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bool, list] = {False: [], True: []}
        held = {False: 0, True: 0}

        def packed(far: bool) -> pa.RecordBatch:
            ids = [i for some, _ in rows[far] for i in some]
            whole = np.concatenate([w for _, w in rows[far]])
            rows[far], held[far] = [], 0
            return _batch([pack(ids, whole, far)])

        for batch in batches:
            column = batch.column(1)
            good = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            kept = column.filter(pa.array(good))
            flat = kept.flatten()
            values = np.array(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            finite = np.isfinite(values).all(axis=1) & (flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims)).all(axis=1)
            ids = np.array(batch.column(0).filter(pa.array(good)).to_pylist(), object)[finite]
            values = values[finite]
            small = (np.abs(values) < far_from(dims) / scale / 2).all(axis=1)
            for far, some in ((False, small), (True, ~small)):
                if some.any():
                    own = np.floor(values[some] * scale).astype(np.int64) if not far else np.frompyfunc(lambda x: _floor(x, scale), 1, 1)(values[some])
                    own_ids = ids[some].tolist()
                    begin = 0
                    while begin < len(own):
                        end = begin + BLOCK - held[far]
                        rows[far].append((own_ids[begin:end], own[begin:end]))
                        held[far] += len(own[begin:end])
                        begin = end
                        if held[far] == BLOCK:
                            yield packed(far)
        for far in (False, True):
            if held[far]:
                yield packed(far)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], kind.names)

    return vectors.mapInArrow(work, kind)


def _read(batch: pa.RecordBatch, row: int, dims: int) -> tuple[list, np.ndarray, Tree]:
    ids, points, point_of, times, nodes, radii, far = (batch.column(i)[row].as_py() for i in range(7))
    whole = np.array([int(y) for y in points.decode().split(",")], object) if far else np.frombuffer(points, "<i4").astype(np.int64)
    tree = Tree(whole.reshape(-1, dims), np.frombuffer(times, "<i8"), np.frombuffer(nodes, "<i4").astype(np.int64).reshape(-1, 5), np.frombuffer(radii, "<f8"))
    return ids, np.frombuffer(point_of, "<i4"), tree


def _digits(number: int) -> Iterator[tuple[int, int]]:
    """A whole number in digits to the base DIGIT, all with its sign."""
    sign, rest, place = (1 if number >= 0 else -1), abs(int(number)), 0
    while rest:
        rest, digit = divmod(rest, DIGIT)
        yield place, sign * digit
        place += 1


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[tuple[int, ...]]:
    """The vectors whose `seed:id` has the smallest SHA-256 in hexadecimal, as whole numbers; rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    good = F.coalesce((F.size("embedding") == dims) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    rows = vectors.where(good & F.col("vec_id").isNotNull()).select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [tuple(_floor(x, scale) for x in map(float, r.embedding)) for r in rows]


def _sums(packed: DataFrame, centroids: list[tuple[int, ...]], dims: int) -> DataFrame:
    """cluster, part (a component's number, `dims` for the count), place (of a digit), digit: one row each for each task."""
    kind = schema("cluster int, part int, place int, digit long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = centroid_tree(centroids)
        sums, counts = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                _, _, points = _read(batch, row, dims)
                _, some, many = assign(points, tree, numbers)
                sums, counts = sums + some, counts + many
        rows = [(int(c), p, place, digit) for c in np.flatnonzero(counts) for p, x in enumerate([*sums[c], counts[c]]) for place, digit in _digits(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.int64()])], kind.names)

    return packed.mapInArrow(work, kind).groupBy("cluster", "part", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))


def _moved(packed: DataFrame, centroids: list[tuple[int, ...]], dims: int) -> list[tuple[int, ...]]:
    totals: dict[tuple[int, int], int] = {}
    for r in _sums(packed, centroids, dims).collect():
        totals[r.cluster, r.part] = totals.get((r.cluster, r.part), 0) + int(r.digit) * DIGIT**r.place
    return [tuple(totals.get((c, p), 0) // totals[c, dims] for p in range(dims)) if (c, dims) in totals else old for c, old in enumerate(centroids)]


def fit(packed: DataFrame, centroids: list[tuple[int, ...]], rounds: int, dims: int) -> list[tuple[int, ...]]:
    """The centroids after so many rounds over blocks(): each round a job that sends sums of at most k x dims numbers to the driver."""
    if len(centroids) * dims > MOST_NUMBERS:
        raise ValueError(f"centroids hold over {MOST_NUMBERS} numbers")
    for _ in range(rounds):
        new = _moved(packed, centroids, dims)
        if new == centroids:
            break
        centroids = new
    return centroids


def members(packed: DataFrame, centroids: list[tuple[int, ...]], dims: int) -> DataFrame:
    """vec_id, cluster, distance (squared; null beyond a long) of every packed vector."""
    kind = schema("vec_id long, cluster int, distance long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = centroid_tree(centroids)
        plain = np.empty((len(centroids), dims), tree.points.dtype)
        plain[numbers] = tree.points
        for batch in batches:
            for row in range(batch.num_rows):
                ids, point_of, points = _read(batch, row, dims)
                cluster, _, _ = assign(points, tree, numbers)
                away = _square(points.points, plain[cluster])
                away = [int(x) if x < 1 << 63 else None for x in away] if away.dtype == object else away.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster[point_of], pa.int32()), pa.array([away[i] for i in point_of], pa.int64())], kind.names)

    return packed.mapInArrow(work, kind)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (vec_id, embedding) that is kept.

    Kept are vectors with exactly `dims` components, none of them null or not finite, each turned into floor(scale * x). Rows that
    repeat a vector or an id count each. A null id starts no centroid; with fewer than k ids there are fewer centroids, without one
    there is no row. A cluster without a vector keeps its centroid. Sums of distances and distances beyond a long are null.
    """
    spark: SparkSession = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    start = first_centroids(own, k, seed, dims, scale)
    if not start:
        return spark.createDataFrame([], schema("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"))
    packed = written(blocks(own, dims, scale), "vector-blocks")
    with arrow_rows(spark, BLOCKS_AT_ONCE):
        centroids = fit(packed, start, rounds, dims)
        out = written(members(packed, centroids, dims), "vector-clusters")
    dropped(spark, packed)
    # A sum of which a part is beyond a long is so too.
    beyond = F.count_if(F.col("distance").isNull()) > 0
    total = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), beyond.alias("beyond")).collect()
    all_of = None if any(r.beyond for r in total) else sum(int(r.total) for r in total)

    def held(x: int | None) -> int | None:
        return x if x is not None and x < 1 << 63 else None

    rows = [(r.cluster, held(None if r.beyond else int(r.total)), held(all_of), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in total]
    about = spark.createDataFrame(rows, schema("cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
