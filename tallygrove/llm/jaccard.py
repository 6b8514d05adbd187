"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Texts become sets of 64-bit hashes of word shingles; texts with equal sets form a class, named by a digest of the set, and
only classes are compared. Shingles have one global order: by how common they are (levels of a count sketch of fixed size
over all documents), then by hash. Fragments cut that order by hash range.

1. Discovery. Two sets of a Jaccard similarity of t or more share a shingle among their first n - ceil(t n) + 1. These go,
   packed, to their fragment; a fragment pairs up the classes that share a shingle there, bounds the pairs by size and by the
   shingle's position, and counts what each pair shares; the counts of all fragments are summed, and pairs that can't reach t
   any more are out. A shingle of over `crowd` classes isn't paired out there: each class is paired with one of them, and the
   other pairs follow, dealt in blocks of `BLOCK` classes by `BLOCK`, once these are verified. `join` takes all of them that
   size and position allow, so its links are whole, and a group of near copies costs the square of its size, as its links do.
   `cluster` asks for components alone: it merges the links found and pairs only classes of different components, so there a
   group costs its size; the links it leaves out lie within a component and change none. Each set has a signature, the parity of
   its shingles in at least two bits for each: two signatures differ in no more bits than their sets in shingles, so where a pair
   in a crowd meets, what can't be similar enough goes at once, before its sets are moved.
2. Verification. The sets of the classes in pairs are cut into the fragments of the order, partial overlaps are counted
   fragment by fragment, and summed per pair; the sum decides.

Hashes decide equality: among 10**10 different shingles or sets a chance collision is expected to be rare, and one would
change a count by one. The sketch only orders; what it holds wrongly costs time and no link. Broadcast are the sketch's
levels (`SKETCH` bytes) and a Bloom filter of the classes in pairs (`BLOOM` bits at most, whatever the input).

Defined results: a null or empty text, or one without words, has no shingles and no links; one of fewer than k words has one
shingle, the whole sequence; equal sets link; rows that repeat an id are answered each by itself and count as one document;
a row with a null id takes no part and has a null component; other columns are left behind; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as X
from .bloom import bloom, in_bloom
from .components import components
from .shared import batch_rows, columns, dropped, holding, merged, schema, trim, written

K, PERCENT = 5, 75
SKETCH = 1 << 22
SKETCH_PARTS = 16
BLOOM = 1 << 27
FRAGMENT_SHINGLES = 1 << 20
LEAST_FRAGMENTS = 32
SEGMENTS = 4
CROWD = 32
BLOCK = 512
#: 64-bit numbers of a signature at most: 8 kB, for sets of 32,768 shingles and more.
MOST_LONGS = 1 << 10
_U = np.uint64


def _sets(piece: pa.RecordBatch, k: int):
    data, at = X.utf8(piece.column(1))
    data = X.LOWER[data]
    begins, ends, before = X.words(data, at, X.SPACES)
    grams, cut = X.shingles(X.span_hash(X.prefix_hash(data), begins, ends), before, k)
    return X.distinct_in_documents(grams, cut)


def _digests(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (3, 5):
        running = np.zeros(len(values) + 1, _U)
        np.cumsum(X.mix(values * _U(2 * salt + 1) + _U(salt << 32)), out=running[1:])
        out.append(X.mix((running[ends[1:]] - running[ends[:-1]]) + np.diff(ends).astype(_U)).view(np.int64))
    return out[0], out[1]


def _signatures(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Of each set, the parity of the shingles that fall on each bit of a power of two of 64-bit numbers, two bits a shingle at least;
    none for an empty set."""
    n = np.diff(ends)
    longs = np.where(n > 0, 1 << np.ceil(np.log2(np.clip(n / 32, 1, MOST_LONGS))).astype(np.int64), 0)
    at = np.r_[0, np.cumsum(longs)]
    owner = np.repeat(np.arange(len(n)), n)
    # Which number, then which of its bits: so the halves of a signature put together by xor are the signature of half its length.
    place = (X.mix(values) & _U(64 * MOST_LONGS - 1)).astype(np.int64)
    place = 64 * (at[owner] + (place >> 6 & longs[owner] - 1)) + (place & 63)
    odd = np.zeros(64 * at[-1], np.uint8)
    np.add.at(odd, place, np.uint8(1))  # modulo 256, which leaves the parity
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.packbits(odd & 1).view(np.int64)))


def _scan(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows' set sizes, digests and signatures, and the parts of the count sketch."""
    kind = schema("id long, n long, class long, other long, bits array<long>, part int, counts binary")

    def work(batches):
        holding("jaccard", X.forget)
        counts = np.zeros(SKETCH, np.uint32)
        some = False
        for batch in batches:
            for piece in X.pieces(batch, "text"):
                values, ends = _sets(piece, k)
                if len(values):
                    some = True
                    np.add.at(counts, (values % _U(SKETCH)).astype(np.int64), np.uint32(1))
                one, two = _digests(values, ends)
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends)), pa.array(one), pa.array(two), _signatures(values, ends), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], kind.names)
        if some:
            packed = [zstandard.compress(part.tobytes(), 1) for part in np.split(counts, SKETCH_PARTS)]
            none, task = pa.nulls(SKETCH_PARTS, pa.int64()), pa.array([TaskContext.get().partitionId()] * SKETCH_PARTS, pa.int64())
            # The task's number stands in for a size.
            yield pa.RecordBatch.from_arrays([none, task, none, none, pa.nulls(SKETCH_PARTS, pa.list_(pa.int64())), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], kind.names)

    table = written(df.mapInArrow(work, kind), "sets")
    return table.where("part IS NULL").select("id", "n", "class", "other", "bits"), table.where("part IS NOT NULL").select("part", F.col("n").cast("int").alias("at"), F.col("counts").alias("data"))


def _levels(parts: DataFrame, total: int) -> np.ndarray:
    """How common the shingles of each cell are: 0 if it holds no more than chance puts into a cell, else 1, and one more for
    each doubling of the surplus."""

    def add(packed: list[bytes]) -> bytes:
        out = np.zeros(SKETCH // SKETCH_PARTS, np.uint64)
        for part in packed:
            out += np.frombuffer(zstandard.decompress(part), np.uint32)
        return zstandard.compress(np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes(), 1)

    levels = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.uint8)
    mean = total / SKETCH
    least = max(8.0, 6 * mean**0.5)
    for row in merged(parts, add).collect():
        counts = np.frombuffer(zstandard.decompress(bytes(row.data)), np.uint32)
        surplus = np.maximum(counts - mean, 1)
        levels[row.part] = np.where(surplus > least, np.log2(surplus / least).astype(np.int64) + 1, 0)
    return levels.ravel()


def _small(numbers: np.ndarray) -> bytes:
    """Small numbers, packed."""
    return zstandard.compress(numbers.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4")


def _fragment(values: np.ndarray, fragments: int, percent: int) -> np.ndarray:
    """Ranges of the order. Prefixes lie at its begin, so nine tenths of the fragments cut the hashes up to a little more than a
    prefix's share, and the others the rest."""
    place, whole = (values >> _U(32)).astype(np.int64), 1 << 32
    head = min(whole - 1, whole * (105 - percent) // 100)
    many = max(1, fragments * 9 // 10)
    return np.where(place < head, place * many // head, np.minimum(many + (place - head) * (fragments - many) // (whole - head), fragments - 1))


def _postings(df: DataFrame, levels: np.ndarray, fragments: int, k: int, percent: int) -> DataFrame:
    """For each batch and fragment, packed: shingles, the places of their classes in a list, their positions in their sets'
    order, and that list with sizes."""
    kind = schema("fragment int, shingles binary, places binary, positions binary, classes binary, sizes binary")
    shared = df.sparkSession.sparkContext.broadcast(levels)

    def work(batches):
        holding("jaccard", X.forget)
        for batch in batches:
            trim()
            for piece in X.pieces(batch, "text", 2 * X.PIECE_BYTES):
                values, ends = _sets(piece, k)
                if not len(values):
                    continue
                n = np.diff(ends)
                names, _ = _digests(values, ends)
                valid = np.flatnonzero((n > 0) & piece.column(0).is_valid().to_numpy(zero_copy_only=False))
                _, first = np.unique(names[valid], return_index=True)  # equal sets of a piece once
                take = np.zeros(len(n), bool)
                take[valid[first]] = True
                owner = np.repeat(np.arange(len(n)), n)
                values, owner = values[take[owner]], owner[take[owner]]
                order = np.lexsort((values, shared.value[(values % _U(SKETCH)).astype(np.int64)], owner))
                values = values[order]
                start = np.zeros(len(n), np.int64)
                np.cumsum((n * take)[:-1], out=start[1:])
                prefix = n - -(-percent * n // 100) + 1
                position = np.arange(len(values)) - start[owner]
                keep = position < prefix[owner]
                values, owner, position = values[keep], owner[keep], position[keep].astype(np.int32)
                where = _fragment(values, fragments, percent)
                order = np.argsort(where, kind="stable")
                values, owner, where, position = values[order], owner[order], where[order], position[order]
                cuts = np.searchsorted(where, np.arange(fragments + 1))
                rows = []
                for f in np.flatnonzero(np.diff(cuts)):
                    own, place = np.unique(owner[cuts[f] : cuts[f + 1]], return_inverse=True)
                    rows.append((int(f), values[cuts[f] : cuts[f + 1]].tobytes(), _small(np.diff(place, prepend=0)), _small(position[cuts[f] : cuts[f + 1]]), names[own].tobytes(), n[own].astype(np.int32).tobytes()))
                kinds = (pa.int32(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], kind.names)
        X.forget()
        trim()

    return df.mapInArrow(work, kind)


def _pairs(postings: DataFrame, percent: int, crowd: int) -> DataFrame:
    """kind 0: pairs a < b, how many shingles they share in a fragment, how many of these may be the first that they share,
    and their sizes. kind 1: shingle, class, size (as n) and position (as firsts) of crowded shingles."""
    kind = schema("kind int, a long, b long, n long, firsts long, size_a int, size_b int")

    def near(i, j, size, position):
        """If the shingle is the first that two sets share, they can't share more than what follows it in either."""
        both = size[i] + size[j]
        least = -(-percent * both // (100 + percent))
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        return fits, fits & (size[i] - position[i] >= least) & (size[j] - position[j] >= least)

    def work(table: pa.Table) -> pa.Table:
        trim()
        read = lambda name, t: [np.frombuffer(v.as_py(), t) for v in table.column(name)]
        classes, sizes = read("classes", np.int64), read("sizes", np.int32)
        places = [np.cumsum(_unpacked(v.as_py())) for v in table.column("places")]
        shingles, position = np.concatenate(read("shingles", _U)), np.concatenate([_unpacked(v.as_py()) for v in table.column("positions")]).astype(np.int64)
        names = np.concatenate([c[p] for c, p in zip(classes, places)])
        size = np.concatenate([s[p] for s, p in zip(sizes, places)]).astype(np.int64)
        order = np.lexsort((names, shingles))
        shingles, names, size, position = shingles[order], names[order], size[order], position[order]
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (names[1:] != names[:-1])
        shingles, names, size, position = shingles[new], names[new], size[new], position[new]
        begin = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
        many = np.diff(np.r_[begin, len(shingles)])
        run = np.repeat(np.arange(len(begin)), many)
        crowded = many[run] > crowd
        left, right, firsts = [], [], []  # rows of pairs
        small = np.flatnonzero((many[run] > 1) & ~crowded)
        for step in range(1, crowd):
            i = small[small + step < len(run)]
            small = i = i[run[i] == run[i + step]]
            if not len(i):
                break
            fits, first = near(i, i + step, size, position)
            left.append(i[fits])
            right.append(i[fits] + step)
            firsts.append(first[fits])
        # A crowd's head is the class in which the shingle comes earliest: the one with the fewest shingles of its own.
        i = np.flatnonzero(crowded)
        ranked = i[np.lexsort((names[i], position[i], run[i]))]
        heads = np.zeros(len(begin), np.int64)
        heads[run[ranked[::-1]]] = ranked[::-1]
        head = heads[run[i]]
        first = near(head, i, size, position)[1] & (head != i)
        left.append(np.minimum(head, i)[first])
        right.append(np.maximum(head, i)[first])
        firsts.append(np.ones(int(first.sum()), bool))
        left, right, firsts = np.concatenate(left), np.concatenate(right), np.concatenate(firsts)
        order = np.lexsort((names[right], names[left]))
        left, right, firsts = left[order], right[order], firsts[order]
        a, b = names[left], names[right]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.r_[at, len(a)])
        starts = np.add.reduceat(firsts.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        columns = (
            np.r_[np.zeros(len(at), np.int32), np.ones(len(i), np.int32)].astype(np.int32),
            np.r_[a[at], shingles[i].view(np.int64)],
            np.r_[b[at], names[i]],
            np.r_[shared, size[i]].astype(np.int64),
            np.r_[starts, position[i]].astype(np.int64),
            np.r_[size[left[at]], size[i]].astype(np.int32),
            np.r_[size[right[at]], size[i]].astype(np.int32),
        )
        return pa.table(dict(zip(kind.names, columns)))

    return postings.groupBy("fragment").applyInArrow(work, kind)


def _verified(df: DataFrame, pairs: DataFrame, k: int, percent: int, segments: int) -> DataFrame:
    """The pairs whose sets are similar enough, as a table: partial overlaps by fragment, summed per pair."""
    bitmap, bits = bloom(pairs.select("a").union(pairs.select("b")).distinct(), BLOOM)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    kind = schema("class long, segment int, size long, part binary")

    def cut(batches):
        holding("jaccard", X.forget)
        for batch in batches:
            trim()
            for piece in X.pieces(batch, "text"):
                values, ends = _sets(piece, k)
                names, _ = _digests(values, ends)
                take = in_bloom(shared.value, bits, names.view(_U)) & (np.diff(ends) > 0)
                rows, seen = [], set()
                for i in np.flatnonzero(take):
                    if names[i] in seen:
                        continue
                    seen.add(names[i])
                    own = values[ends[i] : ends[i + 1]]  # in ascending order
                    at = np.searchsorted(own >> _U(32), (np.arange(1, segments, dtype=_U) << _U(32)) // _U(segments))
                    for s, part in enumerate(np.split(own, at)):
                        rows.append((int(names[i]), s, len(own), part.tobytes()))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], kind.names)
        X.forget()
        trim()

    # One shuffle by class and segment serves the aggregate and both joins.
    sets = df.mapInArrow(cut, kind).groupBy("class", "segment").agg(F.first("size").alias("size"), F.first("part").alias("part"))
    one, two = (sets.select(F.col("class").alias(c), "segment", F.col("size").alias(f"size_{c}"), F.col("part").alias(f"part_{c}")) for c in "ab")

    def count(batches):
        for batch in batches:
            both = zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist())
            same = [len(np.intersect1d(np.frombuffer(a, _U), np.frombuffer(b, _U), assume_unique=True)) for a, b in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "size_a", "size_b")), pa.array(same, pa.int64())], ["a", "b", "size_a", "size_b", "same"])

    dealt = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    partial = dealt.join(two, ["b", "segment"]).join(one, ["a", "segment"]).select("a", "b", "size_a", "size_b", "part_a", "part_b")
    partial = partial.mapInArrow(count, schema("a long, b long, size_a long, size_b long, same long"))
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("same").alias("same"))
    return written(summed.where(100 * F.col("same") >= percent * (F.col("size_a") + F.col("size_b") - F.col("same"))).select("a", "b"), "links")


def _dealt(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of classes of each shingle, dealt out by blocks x and y of them, so that no task gets all pairs
    of a shingle."""
    blocks = named.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    named = named.join(blocks, "shingle").withColumn("own", F.expr("pmod(class, blocks)")).withColumn("facing", F.explode(F.expr("sequence(0L, blocks - 1)")))
    one = named.withColumnsRenamed({"own": "x", "facing": "y"})
    two = named.withColumnsRenamed({"own": "y", "facing": "x"})
    return one.drop("blocks"), two.drop("blocks")


def _crowd_pairs(one: DataFrame, two: DataFrame, keys: list[str], percent: int, condition: str) -> DataFrame:
    """Pairs a < b of classes that share a crowded shingle and meet the condition, as far as size and position allow."""
    two = two.select(*keys, *(F.col(c).alias(f"{c}_b") for c in two.columns if c not in keys))
    least = f"ceil({percent} * (size + size_b) / (100 + {percent}))"
    # The longer of two signatures is folded to the length of the other; sizes that far apart are out already, all others are folded once.
    folded = "IF(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (x, y) -> x ^ y), {x})"
    one_bits, two_bits = folded.format(x="bits", y="bits_b"), folded.format(x="bits_b", y="bits")
    apart = f"aggregate(zip_with({one_bits}, {two_bits}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = f"class < class_b AND ({condition}) AND 100 * least(size, size_b) >= {percent} * greatest(size, size_b) AND size - position >= {least} AND size_b - position_b >= {least}"
    # What two similar sets share is `least` and more, so they differ in at most this many shingles.
    return one.join(two, keys).where(near).where(f"{apart} <= size + size_b - 2 * {least}").select(F.col("class").alias("a"), F.col("class_b").alias("b")).distinct()


def _links(df: DataFrame, k: int, percent: int, crowd: int, fragment_shingles: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(id, n, class, other) for each row of df (id, text), and links (a, b): all of them, or as many as make the components."""
    batch_rows(df.sparkSession)
    members, parts = _scan(df, k)
    total = members.agg(F.sum("n")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, -(-total // (4 * fragment_shingles)))
    found = written(_pairs(_postings(df, _levels(parts, total), fragments, k, percent), percent, crowd), "pairs")
    pairs = found.where("kind = 0").groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts")).where("firsts > 0")
    # What two sets share is what their prefixes share and at most what is left of the one whose prefix ends first. Crowded
    # shingles that both may have aren't all in the counts.
    crowds = written(found.where("kind = 1").groupBy("b").agg(F.count(F.lit(1)).alias("k")), "crowds")
    for c in "ab":
        pairs = pairs.join(crowds.select(F.col("b").alias(c), F.col("k").alias(f"k_{c}")), c, "left")
    least = f"ceil(({percent} * (size_a + size_b)) / (100 + {percent}))"
    some = "n + least(coalesce(k_a, 0), coalesce(k_b, 0))"
    pairs = written(pairs.where(f"{some} + ceil({percent} * greatest(size_a, size_b) / 100) - 1 >= {least}").select("a", "b"), "pairs")
    links = _verified(df, pairs, k, percent, SEGMENTS)
    crowded = found.where("kind = 1")
    if crowded.isEmpty():
        return members, links
    named = crowded.select(F.col("a").alias("shingle"), F.col("b").alias("class"), F.col("n").alias("size"), F.col("firsts").alias("position"))
    signed = members.select("class", "bits").join(crowds.select(F.col("b").alias("class")), "class", "left_semi").groupBy("class").agg(F.first("bits").alias("bits"))
    named = named.join(signed, "class")
    if whole:
        more = _crowd_pairs(*_dealt(named), ["shingle", "x", "y"], percent, "true")
    else:
        labels = components(links)
        named = named.join(labels, named["class"] == labels["node"], "left").withColumn("label", F.coalesce("label", "class"))
        named = written(named.select("shingle", "class", "size", "position", "bits", "label"), "crowds")
        mixed = named.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("shingle")
        named = named.join(mixed, "shingle", "left_semi")
        more = _crowd_pairs(named, named, ["shingle"], percent, "label != label_b")
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return members, links
    links = links.union(_verified(df, more, k, percent, SEGMENTS))
    dropped(df.sparkSession, found, pairs, more)
    return members, links


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, crowd: int = CROWD, fragment_shingles: int = FRAGMENT_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(id, n, class, other) for each row of df, and every link (a, b), a < b, between classes of different sets, once."""
    return _links(columns(df, **{id_col: "long", text_col: "string"}).toDF("id", "text"), k, percent, crowd, fragment_shingles, True)


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """A row for each row of df: its id, `n_shingles` and `component_id`, the smallest id that links lead to."""
    df = columns(df, **{id_col: "long", text_col: "string"}).toDF("id", "text")
    members, links = _links(df, k, percent, crowd, FRAGMENT_SHINGLES, False)
    labels = components(links).toDF("class", "label")
    labelled = members.where("n > 0 AND id IS NOT NULL").groupBy("class", "other").agg(F.min("id").alias("first"))
    # A class without links is its own component.
    labelled = labelled.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    labelled = written(labelled, "classes")
    lowest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    named = labelled.join(lowest, "label").select(F.col("class").alias("c1"), F.col("other").alias("c2"), "component")
    out = members.join(named, (F.col("class") == F.col("c1")) & (F.col("other") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
