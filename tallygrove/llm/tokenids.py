"""Token ids of whole texts in a binary format: range-coded frames in ascending id order, and reading them back.

The texts are dealt by ranges of their id and sorted; each task encodes its texts with the `tokenizers` library and writes
frames of whole documents (one that is longer than FRAME_IDS has a frame alone, coded in parts of that size). A frame's row in the Parquet table that serves as
container has the coded ids, the documents' ids and their lengths in the frame. Where a document begins in the whole
sequence follows from the frames' sizes alone.

The library is called on whole texts, or, for a file whose normaliser and splits are those of `_splits_at_spaces`, on distinct
units: there white space never enters a token and always ends a word, and a word's ids don't depend on its neighbours. A run of
ASCII letters or marks goes to the library's merges as what its normaliser and pre-tokeniser would make of it, as does a word
of Latin letters with marks behind, in the byte alphabet. Any other word goes to the whole tokeniser, and a text with
characters on which numpy and the library could differ, or with what may be a special token, goes there whole. Units are told
apart by 64-bit hashes: among the two million that are remembered a collision has a probability of one in ten million.

Defined results: a null or empty text has the end id alone; null ids come first; rows that repeat an id follow one another
in the order of their ids' bytes; other columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from . import textcols as X
from .shared import batch_rows, columns, holding, schema, written

END_ID = 1
RANGE_BYTES = 8 << 20
FRAME_IDS = rangecoder.LANES * rangecoder.BLOCK
MOST_FRAMES = 500_000
MOST_UNITS = 2_000_000
FRAME = "frame long, first long, n_ids long, doc_ids binary, nulls binary, lengths binary, crc long, payload array<binary>"
_MARKS = ".,;:!?|*#%$&()[]{}\"/-"
_CORE = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_MARKS)}]*)")
# What a byte is: white space, an ASCII letter, a mark that stands for itself in the byte alphabet and begins no contraction, other.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[*range(48, 58), ord("'")]] = _OTHER
_KINDS[X.SPACES] = _SPACE


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


_ALPHABET = _byte_alphabet()


#: The normaliser and the splits of tokeniser files whose texts may be encoded word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# End of fixed values.


def _splits_at_spaces(path: str) -> bool:
    """If words of the tokeniser in this file can be encoded one by one, and letters with marks by its merges alone; texts go whole
    to a tokeniser of any other kind."""
    import json

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    return held.get("normalizer") == _NORMALIZER and held.get("pre_tokenizer") == _SPLITS and held.get("model", {}).get("type") == "BPE" and all(t.get("special") for t in held.get("added_tokens", []))


class _Table:
    """Numbers 0, 1, ... of 64-bit keys, by open addressing in arrays; a lookup of many keys takes a few steps for all of them."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that aren't there."""
        slots = self._slots(keys)
        out = self.numbers[slots]
        open_ = np.flatnonzero((self.keys[slots] != keys) & (out >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            now = slots[open_]
            out[open_] = self.numbers[now]
            open_ = open_[(self.keys[now] != keys[open_]) & (out[open_] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Different keys that aren't there get the next numbers."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > 1 << self.bits:
            held = self.numbers >= 0
            keys, numbers = np.append(self.keys[held], keys), np.append(self.numbers[held], numbers)
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.numbers[slots] < 0
            self.numbers[slots[free]], self.keys[slots[free]] = numbers[free], keys[free]
            # Of several keys for one free slot the last one has it.
            rest = np.flatnonzero(self.numbers[slots] != numbers)
            keys, numbers, slots = keys[rest], numbers[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """ids of texts as little-endian 16-bit integers; remembers a bounded number of units.

    Texts are cut at ASCII white space, and words of ASCII letters and marks into runs of either, as the pre-tokeniser does. A unit
    is known by the 64-bit hash of its bytes in lower case; of known units only numbers are kept, in arrays, and a batch is
    looked up and put together without a Python object for each word.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.plain = _splits_at_spaces(path)
        self.clear()

    def clear(self) -> None:
        self.known = _Table()
        self.begins, self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def _raw(self, texts: list[str]) -> list[bytes]:
        if _tokenizer(self.path).get_vocab_size() > rangecoder.MOST_ID + 1:
            raise ValueError("ids of this tokeniser don't fit into 16 bits")
        return [np.array(e.ids, "<u2").tobytes() for e in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]

    def _learn(self, units: list[tuple[bytes, bool]]) -> tuple[list[int], list[int]]:
        """All ids of the units, and how many each has. A unit comes with whether it is anything but a run of ASCII letters or marks."""
        merges = _tokenizer(self.path).model.tokenize
        ids: list[int] = []
        sizes, whole = [], []
        for unit, odd in units:
            before = len(ids)
            if not odd:
                ids += [t.id for t in merges(unit.decode("ascii"))]
            elif m := _CORE.fullmatch(unit.decode()):
                ids += [t.id for t in merges(m[1].lower().encode().decode("latin-1").translate(_ALPHABET))]
                if m[2]:
                    ids += [t.id for t in merges(m[2])]
            else:
                whole.append((len(sizes), unit.decode()))
            sizes.append(len(ids) - before)
        if not whole:
            return ids, sizes
        at = np.cumsum(sizes)
        out, done = [], 0
        for (i, _), found in zip(whole, self._raw([text for _, text in whole])):
            some = np.frombuffer(found, "<u2").tolist()
            out += ids[done : at[i]] + some
            done, sizes[i] = at[i], len(some)
        return out + ids[done:], sizes

    def _numbers(self, keys: np.ndarray, unit) -> np.ndarray:
        """The number of each unit; unit(i) gives the bytes of the i-th and whether it is odd."""
        if self.known.count > MOST_UNITS:
            self.clear()
        out = self.known.find(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            names, first, place = np.unique(keys[missing], return_index=True, return_inverse=True)
            ids, sizes = self._learn([unit(i) for i in missing[first].tolist()])
            sizes = np.array(sizes, np.int32)
            out[missing] = self.known.count + place
            self.known.add(names)
            self.begins = np.append(self.begins, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32))
            self.sizes = np.append(self.sizes, sizes)
            self.flat = np.append(self.flat, np.array(ids, np.uint16))
        return out

    def _piece(self, column: pa.Array) -> list[bytes]:
        data, at = X.utf8(column)
        kinds = _KINDS[data]
        begins, ends, _ = X.words(data, at, X.SPACES)
        # Bytes of words that hold anything but ASCII letters and marks.
        others = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == _OTHER, out=others[1:])
        odd_words = others[ends] > others[begins]
        step = np.zeros(len(data) + 1, np.int8)
        step[begins[odd_words]] = 1
        step[ends[odd_words]] -= 1
        odd = np.cumsum(step, dtype=np.int8)[:-1].view(bool)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kinds[1:] != kinds[:-1]) & ~odd[1:]
        cut[begins] = cut[ends] = True
        cut[:-1] &= kinds != _SPACE
        begins = np.flatnonzero(cut[:-1])
        cut[:-1] |= kinds == _SPACE
        cut[at] = True
        edges = np.flatnonzero(cut)
        ends = edges[np.searchsorted(edges, begins, "right")]
        low = X.LOWER[data]
        prefix = X.prefix_hash(low)
        lowered = low.tobytes()
        numbers = self._numbers(X.span_hash(prefix, begins, ends), lambda i: (lowered[begins[i] : ends[i]], odd[begins[i]]))
        sizes = self.sizes[numbers].astype(np.int64)
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = self.flat[np.repeat(self.begins[numbers] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[np.searchsorted(begins, at)]
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        doubtful = (data >= 0x1C) & (data <= 0x1F)
        doubtful[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        for i in np.unique(np.searchsorted(at, np.flatnonzero(doubtful), "right") - 1).tolist():
            out[i] = self._raw([column[i].as_py()])[0]
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        if not self.plain:
            return self._raw([text or "" for text in column.to_pylist()])
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        return [ids for piece in X.pieces(batch, "text") for ids in self._piece(piece.column(0))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder."""
    return _encoders.setdefault(path, Encoder(path))


def _frame(number: int, docs: list[tuple]) -> tuple:
    """A row: docs has each document's id and its token ids as bytes."""
    data = np.frombuffer(b"".join(d[1] for d in docs), "<u2")
    names = np.array([0 if d[0] is None else d[0] for d in docs], "<i8").tobytes()
    nulls = np.array([d[0] is None for d in docs], bool).tobytes()
    lengths = np.array([len(d[1]) // 2 for d in docs], "<i8").tobytes()
    parts = [rangecoder.encode(data[i : i + FRAME_IDS]) for i in range(0, len(data), FRAME_IDS)]
    return number, None if docs[0][0] is None else int(docs[0][0]), len(data), names, nulls, lengths, zlib.crc32(names + nulls + lengths), parts


def write(df: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the frames of df's texts, as a Parquet table at path (else in the shared folder), and returns that table."""
    spark = df.sparkSession
    batch_rows(spark, 500)
    picked = columns(df, **{id_col: "long", text_col: "string"})
    size = int(picked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // RANGE_BYTES)))
    kind = schema(FRAME)
    end = int(end_id).to_bytes(2, "little")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()))

    def row(values: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], kind.names)

    def work(batches):
        holding("tokenids", _encoders.clear)
        ready, held, number = [], 0, 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(batch.column(1))):
                ids += end
                if ready and held + len(ids) // 2 > FRAME_IDS:
                    yield row(_frame(number, ready))
                    ready, held, number = [], 0, number + 1
                ready.append((name, ids))
                held += len(ids) // 2
        if ready:
            yield row(_frame(number, ready))

    dealt = picked.repartitionByRange(n, id_col).sortWithinPartitions(id_col, text_col)
    return written(dealt.mapInArrow(work, kind), "token-ids", "uncompressed", path)


def read(frames: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row for each document: id, `start` (ids before it), `n_tokens`, `ids_crc32` of its ids as little-endian 32-bit
    integers, and those as `ids` if asked for. Every block's checksum is compared.

    A frame has megabytes, so run this within shared.arrow_rows(spark, 1) where memory is short."""
    # One row for each frame, that is for millions of ids, comes together here.
    order = Window.orderBy(F.col("first").asc_nulls_first(), "frame")
    starts = frames.select("first", "frame", "n_ids").withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids"))
    starts = starts.select(F.col("first").alias("f"), F.col("frame").alias("g"), "start")
    # Three numbers a frame: broadcast, so that the frames stay where they are, up to a counted number.
    if frames.select("frame").limit(MOST_FRAMES + 1).count() <= MOST_FRAMES:
        starts = F.broadcast(starts)
    placed = frames.join(starts, frames["first"].eqNullSafe(F.col("f")) & (frames["frame"] == F.col("g")))
    placed = placed.select("start", "n_ids", "doc_ids", "nulls", "lengths", "crc", "payload")
    kind = schema(f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)

    def work(batches):
        for batch in batches:
            for start, total, names, nulls, lengths, crc, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if zlib.crc32(names + nulls + lengths) != crc:
                    raise ValueError("the index of a frame is damaged")
                lengths = np.frombuffer(lengths, "<i8")
                ids = np.concatenate([rangecoder.decode(part).astype("<u4") for part in parts])
                if len(ids) != total or lengths.sum() != total:
                    raise ValueError("a frame has lost ids")
                at = np.cumsum(lengths) - lengths
                for i in range(0, len(lengths), 2000):
                    own = slice(i, i + 2000)
                    data = [ids[b : b + m].tobytes() for b, m in zip(at[own], lengths[own])]
                    out = [
                        pa.array(np.frombuffer(names, "<i8")[own], mask=np.frombuffer(nulls, bool)[own]),
                        pa.array(start + at[own]),
                        pa.array(lengths[own]),
                        pa.array([zlib.crc32(x) for x in data], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.binary())] * with_ids, kind.names)

    return placed.mapInArrow(work, kind)
