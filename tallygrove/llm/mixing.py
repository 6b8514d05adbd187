"""Mixing sources to target weights: tokens packed into fixed blocks, multinomial counts per shard, blocks joined by index.

The words of a source's documents form one stream, cut into blocks of `block` words. Output shards have a fixed number of slots;
each shard draws how many of them each source gets. A source's slots are numbered through all shards, and a number is mapped to a
block by a pseudorandom permutation of the source's blocks, another one each time the source is run through again. The draws of
all shards together miss the wanted totals by a little; numbers beyond a source's total are handed to sources that got too few,
and a source's last slot is cut, so each source gives just the rounded target of words.

Positions come from lanes (ranges of a hash of document id and text, about LANE words each), and lanes and shards are summed in
groups of GROUP, so no source, however large, meets in one task. Everything is seeded, so reruns agree. Rows with the same id, text
and source are alike and may change places. A document without words is in no block. The sources' names are held by the driver and sent to each
task: at most MOST_SOURCES, and more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import columns, schema, written
from .textcols import mix as spread

BLOCK, SLOTS = 256, 1024
LANE, GROUP = 1 << 16, 1024
MOST_SOURCES = 100_000
WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), Fraction(3, 2), 2
_U = np.uint64


class Source(NamedTuple):
    name: str | None
    size: int
    target: Fraction
    #: Blocks of the source, slots that it gets, and words that the last of these takes.
    blocks: int
    slots: int
    last: int


class Mix(NamedTuple):
    #: doc_id, source, size, number (of the source), source_size, target, start (in the source's stream), and text if asked for.
    documents: DataFrame
    #: shard, position, number, source, epoch, block, n_words, pieces (doc_id, start, at, begin, n, words if asked for).
    sequences: DataFrame


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most_times: int = MOST_TIMES) -> list[Fraction]:
    """What each source should give: the share of all sizes by weight; who would give over most_times its size gives just that, and
    the others share the excess, until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [Fraction(0)] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weight[i] for i in open_)
        above = {i for i in open_ if level * weight[i] > most_times * sizes[i]}
        for i in above or open_:
            out[i] = Fraction(most_times * sizes[i]) if above else level * weight[i]
        if not above:
            break
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def _keys(seed: int, *parts: np.ndarray) -> np.ndarray:
    key = spread(np.asarray([seed], np.int64).view(_U))
    for part in parts:
        key = spread(key ^ spread(np.asarray(part).astype(_U) + _U(0x9E3779B97F4A7C15)))
    return key


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 takes each index: four Feistel rounds over the next power of four, walked on
    until the result is below n. One permutation for each n and key; `back` takes it the other way."""
    n = np.asarray(n, np.int64)
    half = np.maximum(1, (np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1] + 1) // 2).astype(_U)
    mask = (_U(1) << half) - _U(1)
    out = np.array(index).astype(_U)
    rounds = [spread(key + _U(i + 1)) for i in range(4)]
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for k in reversed(rounds) if back else rounds:
            if back:
                left, right = right ^ (spread(left ^ k[todo]) & m), left
            else:
                left, right = right, left ^ (spread(right ^ k[todo]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(_U)]
    return out.astype(np.int64)


def sources(sized: DataFrame, block: int, seed: int, weights: tuple[int, ...], share: Fraction, most_times: int) -> list[Source]:
    """The sources of documents with sizes, by code point, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    out = []
    for i, (r, target) in enumerate(zip(rows, targets([r.size for r in rows], weights, share, most_times))):
        wanted, blocks = int(target + Fraction(1, 2)), -(-r.size // block)
        if not wanted:
            out.append(Source(r.source, r.size, target, blocks, 0, 0))
            continue
        epochs, rest = divmod(wanted, r.size)
        slots, last = epochs * blocks, block
        if rest:
            short = r.size - (blocks - 1) * block
            ends = int(permuted(np.array([blocks - 1]), np.array([blocks]), _keys(seed, [i], [epochs]), back=True)[0])

            def words(m: int) -> int:
                return m * block - (block - short if ends < m else 0)

            more = -(-rest // block)
            more += words(more) < rest
            slots, last = slots + more, rest - words(more - 1)
        out.append(Source(r.source, r.size, target, blocks, slots, last))
    return out


def _before(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """rows (one for each key and order) with `before`, the sum of size over the key's rows of a smaller order."""
    grouped = rows.withColumn("_group", F.expr(f"{order} div {GROUP}"))
    sums = grouped.groupBy(key, "_group").agg(F.sum(size).alias("_size"))
    ahead = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = sums.select(key, "_group", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    own = grouped.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return own.join(total, [key, "_group"]).withColumn("before", F.col("_ahead") + F.col("_within")).drop("_group", "_ahead", "_within")


def _placed(sized: DataFrame, found: list[Source]) -> DataFrame:
    """The documents with their place in the stream of their source."""
    spark: SparkSession = sized.sparkSession
    rows = [(i, s.name, s.size, float(s.target), max(1, -(-s.size // LANE))) for i, s in enumerate(found)]
    known = spark.createDataFrame(rows, schema("number int, name string, source_size long, target double, lanes long"))
    named = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "inner").drop("name")
    dealt = named.withColumn("lane", F.expr("pmod(xxhash64(doc_id, tie), lanes)"))
    lanes = _before(dealt.groupBy("number", "lane").agg(F.sum("size").alias("lane_size")), "number", "lane", "lane_size").select("number", "lane", "before")
    in_lane = Window.partitionBy("number", "lane").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("size").over(in_lane), F.lit(0)))
    return own.join(lanes, ["number", "lane"]).withColumn("start", F.col("before") + F.col("_own")).drop("lane", "lanes", "tie", "before", "_own")


def _blocks(placed: DataFrame, block: int, words: bool) -> DataFrame:
    """number, block, pieces: what each block of a source's stream is made of, in order."""
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    first = F.greatest("start", F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    fields = [(first - F.col("block") * block).alias("at"), F.col("doc_id"), F.col("start"), (first - F.col("start")).alias("begin"), (end - first).alias("n")]
    if words:
        own = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
        fields.append(F.slice(own, (first - F.col("start") + 1).cast("int"), (end - first).cast("int")).alias("words"))
    return parts.select("number", "block", F.struct(*fields).alias("piece")).groupBy("number", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))


def _draws(spark: SparkSession, found: list[Source], slots: int, seed: int) -> DataFrame:
    """shard, number, n, local: how many slots of a shard each source gets, and how many of the shard's come before."""
    total = sum(s.slots for s in found)
    shards = -(-total // slots)
    chances = np.array([s.slots for s in found], np.float64)
    kind = schema("shard long, number int, n long, local long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                n = rng.multinomial(min(slots, total - shard * slots), chances / chances.sum())
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), shard), pa.int64()), pa.array(has, pa.int32()), pa.array(n[has], pa.int64()), pa.array((np.cumsum(n) - n)[has], pa.int64())], kind.names)

    return spark.range(0, shards, 1, max(1, -(-shards // 256))).mapInArrow(work, kind)


def _slots(draws: DataFrame, found: list[Source], block: int, slots: int, seed: int) -> DataFrame:
    """shard, position, number, epoch, block, most: which block each slot shows, and how many of its words at most."""
    got = {r.number: r.n for r in draws.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    drawn = np.array([got.get(i, 0) for i in range(len(found))], np.int64)
    wanted, blocks, last = (np.array([getattr(s, x) for s in found], np.int64) for x in ("slots", "blocks", "last"))
    over, under = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    over_before, under_ends = np.cumsum(over) - over, np.cumsum(under)
    total = int(wanted.sum())
    kind = schema("shard long, position int, number int, epoch int, block long, most long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, number, n, local, before = (batch.column(i).to_numpy() for i in range(5))
            of = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            source, nth, shard, place = number[of].astype(np.int64), before[of] + step, shard[of], local[of] + step
            # Numbers beyond what a source should give go to those that were drawn too seldom.
            spare = nth >= wanted[source]
            rank = over_before[source[spare]] + nth[spare] - wanted[source[spare]]
            to = np.searchsorted(under_ends, rank, "right")
            source[spare], nth[spare] = to, drawn[to] + rank - (under_ends - under)[to]
            epoch, index = nth // blocks[source], nth % blocks[source]
            shown = permuted(index, blocks[source], _keys(seed, source, epoch))
            position = permuted(place, np.minimum(slots, total - shard * slots), _keys(seed + 1, shard))
            most = np.where(nth == wanted[source] - 1, last[source], block)
            yield pa.RecordBatch.from_arrays([pa.array(a, f) for a, f in zip((shard, position, source, epoch, shown, most), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], kind.names)

    return _before(draws, "number", "shard", "n").select("shard", "number", "n", "local", "before").mapInArrow(work, kind)


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 3, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most_times: int = MOST_TIMES, words: bool = True) -> Mix:
    """The mix of documents (doc_id, source, text), as blocks in shards, and the documents with their sizes and targets.

    Sources weigh `weights` in turn by code point, null last, and share `share` times all words; a source gives at most most_times
    its words. Null texts have none. Without `words` no text is moved.
    """
    spark: SparkSession = docs.sparkSession
    own = columns(docs, doc_id="long", source="string", text="string")
    sized = own.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *(["text"] if words else []))
    sized = written(sized, "sized-documents")
    found = sources(sized, block, seed, weights, share, most_times)
    placed = written(_placed(sized, found), "placed-documents")
    draws = written(_draws(spark, found, slots, seed), "draws")
    # Spark takes the slots to be as few as the draws that they come from; neither side is to be sent whole to every task.
    shown = _slots(draws, found, block, slots, seed).join(_blocks(placed, block, words).hint("merge"), ["number", "block"])
    cut = F.filter("pieces", lambda p: p["at"] < F.col("most"))
    pieces = F.transform(cut, lambda p: p.withField("n", F.least(p["n"], F.col("most") - p["at"])))
    if words:
        pieces = F.transform(pieces, lambda p: p.withField("words", F.slice(p["words"], 1, p["n"].cast("int"))))
    names = spark.createDataFrame([(i, s.name) for i, s in enumerate(found)], schema("number int, source string"))
    out = shown.withColumn("pieces", pieces).join(F.broadcast(names), "number")
    n = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return Mix(placed, out.select("shard", "position", "number", "source", "epoch", "block", n.alias("n_words"), "pieces"))


def taken(mixed: Mix) -> DataFrame:
    """The documents with `taken`, the words that the mix takes of each, repeats counted."""
    pieces = mixed.sequences.select("number", F.explode("pieces").alias("p")).groupBy("number", F.col("p.start").alias("start")).agg(F.sum("p.n").alias("taken"))
    has = mixed.documents.where("size > 0").join(pieces, ["number", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    empty = mixed.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return has.unionByName(empty)
