"""Removal of repeated byte strings, by prefix-free parsing of all documents.

Every 50-byte string has a trigger: the place in it where the rolling hash of 20 bytes is least (the leftmost such). The
strings of a document that share a trigger form a phrase of 50 bytes and more; a phrase depends on its bytes alone, so equal
passages are parsed alike wherever they stand, and phrases overlap just so much that every string lies in one of them.

1. Dictionary. Phrases go, packed, to fragments by a hash of their triggers. Equal phrases fall together with the smallest
   id that has them: in any later document all their strings go. What a task itself sees to be later than another document of
   its own goes no further, so a passage that many documents share is a row or a few for each task. Repetitive text is done
   with here. A task deals what it holds of many segments at once.
2. Suffix array of the dictionary. Strings of different phrases can be equal only if their triggers are. For triggers with more
   than one phrase the phrases' bytes (each phrase once, where it is first) go to fragments, and each fragment orders the
   suffixes that begin its strings, but for strings whose hash no other one has, to a depth of 50 bytes by doubling: ranks of 8 bytes, of 16, of 32, of 50. Neighbours of
   one rank are equal strings, byte by byte; the smallest id of each rank stands for it.
3. Combination. The parse tells where each phrase stands; the ranks' smallest ids go from the phrases to the documents, by id
   and digest of the text, and covered bytes are removed.

No suffix array of the parse is built: it would order phrases by what follows them, which matters only to strings that run
over several phrases, and these phrases overlap so that none of 50 bytes does. Phrases are told apart by 96 bits of
rolling hashes, as the parsing does with its fingerprints; strings by their bytes. What is broadcast is a Bloom filter of the
phrases to be ordered, of at most `BLOOM` bits; what it lets through wrongly is only compared in vain.

Defined results: a null text is empty; a text of under 50 bytes has no string and stays whole; a row with a null id stays
whole and counts for nothing; rows with one id count as one document, so none makes the other's bytes go, and each keeps its
own places if their texts differ (told apart by 64-bit digests); a very long text is parsed in segments that overlap by 49
bytes; other columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as X
from .bloom import bloom, in_bloom
from .shared import batch_rows, columns, freed, holding, schema, trim, written

LENGTH, TRIGGER = 50, 20
BLOOM = 1 << 27
#: Bytes of text whose phrases make a fragment of the dictionary, and of phrases that make one of the suffix array.
FRAGMENT_BYTES, ORDERED_BYTES = 8 << 20, 1 << 20
LEAST_FRAGMENTS = 32
#: A segment's arrays take about a hundred times its bytes; of this size most of them stay in a core's own cache, so tasks side by
#: side don't wait for memory.
SEGMENT_BYTES = 1 << 16
#: Phrases, and bytes of phrases, that a task holds before it deals them to fragments. A row for each fragment and segment would
#: make rows grow with the square of the input.
HELD_PHRASES, HELD_BYTES = 1 << 19, 16 << 20
SEEN_BITS = 17
#: Slots of the strings' hashes in a fragment at most.
SLOT_BITS = 23
_PLACE_BITS = 24
_U = np.uint64
_32, _48 = _U((1 << 32) - 1), _U((1 << 48) - 1)


def _segments(batch: pa.RecordBatch, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, where each text begins in them (one entry more), rows of the texts, and the place of the first byte in its text: many
    short texts at once, or a part of a long one with the length - 1 bytes that follow it."""
    data, at = X.utf8(batch.column(1))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        own = data[at[begin] : at[end]]
        if len(own) <= most + length - 1:
            yield own, at[begin : end + 1] - at[begin], np.arange(begin, end), 0
        else:
            for place in range(0, len(own) - length + 1, most):
                part = own[place : place + most + length - 1]
                yield part, np.array([0, len(part)]), np.array([begin]), place
        begin = end


def _span_lengths(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    prefix = X.prefix_hash(data)
    begins = np.arange(max(0, len(data) - size + 1))
    return prefix, X.span_hash(prefix, begins, begins + size)


def _phrases(data: np.ndarray, at: np.ndarray, length: int):
    """Trigger hash, phrase hash, document, first string's place in the document and number of strings, for each phrase;
    and the prefix hash of all bytes."""
    none = np.zeros(0, np.int64)
    prefix, rolled = _span_lengths(data, TRIGGER)
    windows = len(data) - length + 1
    if windows <= 0:
        return none.view(_U), none.view(_U), none, none, none, prefix
    reach = length - TRIGGER + 1
    # Least hash of each window of `reach` places, leftmost first: minima over doubled widths.
    key = (rolled >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(rolled), dtype=_U)
    # A segment has under 2**24 bytes, so places have bits of their own; the hash keeps the other 40.
    width, least = 1, key
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    trigger = (least[:windows] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    size = np.diff(at)
    count = np.maximum(size - length + 1, 0)  # strings of each document
    owner = np.repeat(np.arange(len(size)), count)
    starts = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(starts):
        return none.view(_U), none.view(_U), none, none, none, prefix
    own = trigger[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.r_[first, len(starts)])
    begin = starts[first]
    where = own[first]
    phrase = X.span_hash(prefix, begin, begin + strings - 1 + length)
    phrase = X.mix(phrase + (where - begin).astype(_U) * _U(2654435761))
    return rolled[where], phrase, owner[first], begin - at[owner[first]], strings, prefix


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """By a hash of the hashes: triggers are least ones, so most of them are small."""
    return ((X.mix(hashes) >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)


_compressor = zstandard.ZstdCompressor(level=1)  # one for all rows: to make one takes longer than to use it


def _pressed(data: bytes) -> bytes:
    return _compressor.compress(data)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers that differ little from one to the next, packed."""
    return _pressed(np.diff(numbers, prepend=0).astype("<i8").tobytes())


def _numbers(column) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(v.as_py()), "<i8")) for v in column])


KIND = "fragment int, low binary, high binary, places binary, docs binary, digests binary, begins binary, strings binary, bytes binary"


def _row(fragment: int, owner: np.ndarray, ids: np.ndarray, digests: np.ndarray, begin: np.ndarray, strings: np.ndarray, trigger=None, phrase=None, text: bytes | None = None) -> tuple:
    """Phrases, packed: hashes, documents' places in a list with ids and digests, places of the first strings, numbers of strings."""
    docs, place = np.unique(owner, return_inverse=True)
    hashes = (None,) * 2
    if trigger is not None:  # 48 bits of either
        hashes = ((trigger & _32).astype(np.uint32).tobytes() + (phrase & _32).astype(np.uint32).tobytes(), ((trigger & _48) >> _U(32)).astype(np.uint16).tobytes() + ((phrase & _48) >> _U(32)).astype(np.uint16).tobytes())
    return (fragment, *hashes, _small(place), _small(ids[docs]), digests[docs].tobytes(), _small(begin), _small(strings), text)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [c.split()[0] for c in KIND.split(", ")])


def _unpacked(table: pa.Table, name: str) -> np.ndarray:
    """Ids (docs) or digests of a fragment's phrases."""
    read = (lambda v: _numbers([v])) if name == "docs" else (lambda v: np.frombuffer(v.as_py(), np.int64))
    return np.concatenate([read(d)[_numbers([p])] for p, d in zip(table.column("places"), table.column(name))])


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Triggers and phrases, 48 bits of either."""
    low, high = ([np.frombuffer(v.as_py(), kind).reshape(2, -1) for v in table.column(name)] for name, kind in (("low", np.uint32), ("high", np.uint16)))
    both = np.concatenate(low, axis=1).astype(_U) | np.concatenate(high, axis=1).astype(_U) << _U(32)
    return both[0], both[1]


def _key(trigger: np.ndarray, phrase: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Stands for a phrase in a document."""
    return X.mix((trigger & _48) + X.mix((phrase & _48) + X.mix(ids.astype(np.int64).view(_U) + _U(1))))


def _least(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the number of its group of equal keys, and the smallest id of the group."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.zeros(len(ids), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    group = np.cumsum(new)
    least = ids[order][np.r_[0, np.flatnonzero(new)]] if len(ids) else ids
    out = np.empty(len(ids), np.int64)
    out[order] = group
    return out, least[out] if len(ids) else ids


class _Seen:
    """Phrases of a task with the smallest id met, in a table of fixed size in which later ones take the places of earlier ones."""

    def __init__(self) -> None:
        self.keys, self.ids = np.zeros(1 << SEEN_BITS, _U), np.zeros(1 << SEEN_BITS, np.int64)

    def later(self, trigger: np.ndarray, phrase: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which phrases also stand in a document of a smaller id that the task has met."""
        key = X.mix(trigger + X.mix((phrase & _48) + _U(1)))
        _, least = _least([key], ids)
        slot = (key >> _U(64 - SEEN_BITS)).astype(np.int64)
        known = self.keys[slot] == key
        out = (ids > least) | (known & (ids > self.ids[slot]))
        put = ~out
        self.keys[slot[put]], self.ids[slot[put]] = key[put], ids[put]
        return out


class _Held:
    """Phrases of many segments: their documents as places in one list of ids and digests, and columns of any kind."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.batch, self.docs, self.known, self.parts, self.size = None, [], 0, [], 0

    def add(self, size: int, ids: np.ndarray, digests: np.ndarray, owner: np.ndarray, *columns: np.ndarray) -> bool:
        """Whether it is time to take them."""
        if ids is not self.batch:
            self.known += len(self.batch) if self.batch is not None else 0
            self.batch = ids
            self.docs.append((ids.copy(), digests.copy()))  # copies, so that no batch's text is kept
        self.parts.append((owner + self.known, *columns))
        self.size += size
        return self.size >= self.most

    def take(self) -> tuple:
        """ids, digests, owner and the columns of all that is held, which is let go."""
        out = *(np.concatenate(x) for x in zip(*self.docs)), *(np.concatenate(x) for x in zip(*self.parts))
        self.clear()
        return out


def _dealt(where: np.ndarray, fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each fragment that has phrases, and their places."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(fragments + 1))
    for f in np.flatnonzero(np.diff(cuts)):
        yield int(f), order[cuts[f] : cuts[f + 1]]


def _in_batches(rows: Iterator[tuple], most: int = 512) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, most)):
        yield _packed(some)


def _runs(owner: np.ndarray, begin: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of a document that follow one another as one run."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + strings[:-1])
    at = np.flatnonzero(new)
    return owner[at], begin[at], np.add.reduceat(strings, at) if len(at) else strings


def _shared(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places in starts whose string may begin at another one too. Equal strings have one hash, so those whose hash's slot holds no
    other are like none; they needn't be ordered."""
    bits = min(SLOT_BITS, len(starts).bit_length() + 3)
    slot = (X.mix(X.span_hash(X.prefix_hash(data), starts, starts + length)) >> _U(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


def _ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank of each string of this length that begins at starts, by doubling: the order of the suffixes to that depth."""
    size = 1
    while 2 * size <= min(8, length):
        size *= 2
    word = np.zeros(len(data) - size + 1, _U)
    for i in range(size):
        word = word << _U(8) | data[i : len(data) - size + 1 + i]
    while True:
        # Ranks at all places where a string of the present size begins that is part of one of the strings.
        inside = np.zeros(len(word) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + length - size + 1, -1)
        places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        rank = np.zeros(len(word), _U)
        rank[places] = np.unique(word[places], return_inverse=True)[1]
        if size == length:
            return rank[starts].astype(np.int64)
        step = min(size, length - size)
        word = rank[: len(rank) - step] << _U(32) | rank[step:]
        size += step


def repeated(df: DataFrame, id_col: str, text_col: str, length: int, segment: int = SEGMENT_BYTES) -> DataFrame:
    """id, digest of the text, place of a first byte and number of consecutive strings from there that also start in a document
    with a smaller id. df has the id, the text and its digest."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, min(1 << 20, -(-size // FRAGMENT_BYTES)))
    kind = schema(KIND)

    def phrases(batches):
        """For each segment: ids and digests of the batch, the phrases of rows with an id, and the segment's bytes with their texts' begins."""
        for batch in batches:
            ids = batch.column(0)
            valid, ids, digests = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(2).to_numpy()
            for data, at, rows, place in _segments(batch, length, segment):
                trigger, phrase, owner, begin, strings, _ = _phrases(data, at, length)
                keep = valid[rows[owner]]
                yield ids, digests, (trigger[keep], phrase[keep], rows[owner[keep]], begin[keep] + place, strings[keep]), data, at[owner[keep]] + begin[keep]
            trim()

    def parse(batches):
        holding("repeats", X.forget)
        seen = _Seen()
        known, held = _Held(HELD_PHRASES // 8), _Held(HELD_PHRASES)

        def passed():  # any fragment will do: these are only passed on
            ids, digests, owner, begin, strings = known.take()
            yield _row(int(ids[owner[0]]) % fragments, owner, ids, digests, begin, strings)

        def dealt():
            ids, digests, owner, trigger, phrase, begin, strings = held.take()
            for f, i in _dealt(_fragment(trigger & _48, fragments), fragments):
                yield _row(f, owner[i], ids, digests, begin[i], strings[i], trigger[i], phrase[i])

        for ids, digests, (trigger, phrase, owner, begin, strings), _, _ in phrases(batches):
            if not len(trigger):
                continue
            later = seen.later(trigger, phrase, ids[owner])
            if later.any():
                own, first, many = _runs(owner[later], begin[later], strings[later])
                if known.add(len(own), ids, digests, own, first, many):
                    yield from _in_batches(passed())
            if not later.all() and held.add(len(later) - later.sum(), ids, digests, *(x[~later] for x in (owner, trigger, phrase, begin, strings))):
                yield from _in_batches(dealt())
        if known.size:
            yield from _in_batches(passed())
        if held.size:
            yield from _in_batches(dealt())

    found_kind = schema("kind int, id long, digest long, place long, n long")

    def found_rows(kinds, ids, digests, place, n) -> pa.Table:
        return pa.table(dict(zip(found_kind.names, (np.asarray(kinds, np.int32), ids, digests, place, n))))

    def dictionary(table: pa.Table) -> pa.Table:
        trim()
        known = table.filter(table.column("low").is_null())
        table = table.filter(table.column("low").is_valid())
        out = []
        if known.num_rows:
            place = _numbers(known.column("begins"))
            out.append(found_rows(np.zeros(len(place)), _unpacked(known, "docs"), _unpacked(known, "digests"), place, _numbers(known.column("strings"))))
        if table.num_rows:
            (trigger, phrase), ids = _hashes(table), _unpacked(table, "docs")
            group, least = _least([trigger, phrase], ids)
            later = least < ids
            out.append(found_rows(np.zeros(later.sum()), ids[later], _unpacked(table, "digests")[later], _numbers(table.column("begins"))[later], _numbers(table.column("strings"))[later]))
            # A trigger is mixed if it has several phrases that are not all first in one document.
            first = np.unique(group, return_index=True)[1]
            trigger, phrase, least = trigger[first], phrase[first], least[first]
            run, low = _least([trigger], least)
            high = np.full(int(run.max()) + 1, np.iinfo(np.int64).min)
            np.maximum.at(high, run, least)
            mixed = low < high[run]
            mixed = np.unique(_key(trigger[mixed], phrase[mixed], least[mixed])).view(np.int64)
            none = np.zeros(len(mixed), np.int64)
            out.append(found_rows(np.ones(len(mixed)), none, none, mixed, none))
        return pa.concat_tables(out)

    found = written(df.mapInArrow(parse, kind).groupBy("fragment").applyInArrow(dictionary, found_kind), "phrases")
    whole = found.where("kind = 0").select("id", "digest", "place", "n")
    mixed = found.where("kind = 1").select("place")
    bitmap, bits = bloom(mixed, BLOOM)
    freed(spark)
    shared = spark.sparkContext.broadcast(bitmap)
    ordered = max(LEAST_FRAGMENTS, min(1 << 20, -(-mixed.count() * (length + 16) // ORDERED_BYTES)))

    def dictionary_bytes(batches):
        holding("repeats", X.forget)
        held = _Held(HELD_BYTES)

        def dealt():
            ids, digests, owner, where, begin, strings, texts = held.take()
            for f, i in _dealt(where, ordered):
                yield _row(f, owner[i], ids, digests, begin[i], strings[i], text=_pressed(b"".join(texts[i].tolist())))

        for ids, digests, (trigger, phrase, owner, begin, strings), data, at in phrases(batches):
            keep = np.flatnonzero(in_bloom(shared.value, bits, _key(trigger, phrase, ids[owner])))
            if not len(keep):
                continue
            owner, begin, strings, at = (x[keep] for x in (owner, begin, strings, at))
            ends, raw = at + strings + length - 1, data.tobytes()
            texts = np.empty(len(keep), object)
            texts[:] = [raw[a:e] for a, e in zip(at.tolist(), ends.tolist())]
            if held.add(int((ends - at).sum()), ids, digests, owner, _fragment(trigger[keep] & _48, ordered), begin, strings, texts):
                yield from _in_batches(dealt())
        if held.size:
            yield from _in_batches(dealt())

    def order(table: pa.Table) -> pa.Table:
        trim()
        ids, digests = _unpacked(table, "docs"), _unpacked(table, "digests")
        begin, strings = _numbers(table.column("begins")), _numbers(table.column("strings"))
        data = np.frombuffer(b"".join([zstandard.decompress(t.as_py()) for t in table.column("bytes")]), np.uint8)
        at = np.cumsum(strings + length - 1) - (strings + length - 1)
        owner = np.repeat(np.arange(len(ids)), strings)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        some = _shared(data, at[owner] + inner, length)
        owner, inner = owner[some], inner[some]
        if not len(owner):
            return pa.table({name: pa.array([], pa.int64()) for name in ("id", "digest", "place", "n")})
        ranks = _ranks(data, at[owner] + inner, length)
        least = np.full(int(ranks.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, ranks, ids[owner])
        later = least[ranks] < ids[owner]
        owner, place, n = _runs(owner[later], (begin[owner] + inner)[later], np.ones(later.sum(), np.int64))
        return pa.table({"id": ids[owner], "digest": digests[owner], "place": place, "n": n})

    parts = df.mapInArrow(dictionary_bytes, kind).groupBy("fragment").applyInArrow(order, schema("id long, digest long, place long, n long"))
    return whole.union(parts)


REMOVED = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, segment: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each row of df: its id, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept`, the bytes left."""
    if length < TRIGGER:
        raise ValueError(f"strings of {TRIGGER} bytes and more")
    batch_rows(df.sparkSession, 250)
    picked = columns(df, **{id_col: "long", text_col: "string"}).withColumn("_digest", F.xxhash64(text_col))
    starts = repeated(picked, id_col, text_col, length, segment).groupBy("id", "digest").agg(F.collect_list("place").alias("_places"), F.collect_list("n").alias("_many"))
    joined = picked.join(starts, (F.col(id_col) == F.col("id")) & (F.col("_digest") == F.col("digest")), "left").select(id_col, text_col, "_places", "_many")
    kind = schema(f"{id_col} long, {REMOVED}")

    def work(batches):
        for batch in batches:
            rows = []
            for text, places, many in zip(*batch.columns[1:]):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not places.is_valid:
                    rows.append((len(data), 0, 0, data))
                    continue
                places, many = places.values.to_numpy(), many.values.to_numpy()
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + many - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], kind.names)
            trim()

    return joined.mapInArrow(work, kind)
