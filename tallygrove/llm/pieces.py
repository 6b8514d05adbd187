"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text, with a space put before it and spaces written as U+2581, is cut into pieces of the model so that the sum of their
scores is greatest (the unigram criterion; a model file of another kind gives its pieces and scores too). A character that
no piece holds counts ten less than the least score and becomes its bytes. Sums that are equal are told apart by a small
second term that depends on where in a word the cuts lie, so the parts of a text agree on one of them.

No piece goes on from another character into U+2581, so such places are cut in every segmentation, and what lies between two
of them, a word, is looked up or solved alone. A text of more than `chunk` characters is dealt out: for each chunk a
matrix over boundary states (how far the piece across a boundary reaches beyond it) holds the best sums from each state at
its begin to each state at its end; matrices are combined by the associative max-plus product, FAN neighbours to a task, then
the products of these, up to the whole text; the states at the boundaries follow on the way down, again FAN to a task; once
all are known, each chunk is traced back by itself.

Defined results: a null or empty text has no ids and decodes to an empty text; U+2581 itself decodes to a space; null ids
stay; repeated rows are answered one by one; other columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_rows, columns, holding, schema, trim, written

SPACE = "▁"
CHUNK = 65_536
#: Neighbouring chunks, or products of chunks, that one task combines.
FAN = 256
MOST_WORDS = 400_000
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
NEVER = -(1 << 62)
#: Model files mark pieces that are not to be chosen with a score far below all others. Such a piece is out, but a single
#: character keeps its piece, at the score of one without any.
LEAST_SCORE = -1e6
_SHIFT = 30
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_FORCED = re.compile(f"(?<=[^{SPACE}]){SPACE}")
#: The second term of a cut, by its place in its word; a word's begin has none.
_CUTS = [0, *(int(x) for x in np.random.default_rng(7).integers(1, 1 << 14, 4095))]


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            found = [dict(_fields(value)) for number, value in _fields(file.read()) if number == 1]
        self.texts = [p[1].decode() for p in found]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in found]
        kinds = [p.get(3, NORMAL) for p in found]
        used = [k in (NORMAL, USER_DEFINED) and s > LEAST_SCORE for k, s in zip(kinds, scores)]
        # Scores to a 64th; whole numbers, as those of merge models, stay exact.
        whole = all(float(s).is_integer() for s, u in zip(scores, used) if u)
        exact = [round(s * (1 if whole else 64)) for s in scores]
        self.scores = {t: e << _SHIFT for t, e, u in zip(self.texts, exact, used) if u}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k in (NORMAL, USER_DEFINED) and (used[i] or len(t) == 1)}
        self.bytes = {int(t[3:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == BYTE}
        self.values = [t.replace(SPACE, " ").encode() if k in (NORMAL, USER_DEFINED) else bytes([int(t[3:-1], 16)]) if k == BYTE else b"" for t, k in zip(self.texts, kinds)]
        self.unknown = (min(e for e, u in zip(exact, used) if u) - (10 if whole else 640)) << _SHIFT
        self.longest = max(map(len, self.scores))
        if any(_FORCED.search(t) for t in self.scores):
            raise ValueError("a piece goes on into the next word")
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}  # the same by words without the space before them
        # Scores by piece, 0 for the mere beginning of one; a score of 0 itself stands as 1, which no shifted score is.
        self.begun: dict[str, int] = {}
        for piece, score in self.scores.items():
            for n in range(1, len(piece)):
                self.begun.setdefault(piece[:n], 0)
            self.begun[piece] = score or 1

    # Sums: `forward` from one place to all later ones, `backward` from all earlier ones to one place.

    def forward(self, s: str, begin: int, limit: int, places: list[int]) -> tuple[list[int], list[int]]:
        """Best sums from begin to each place of s over pieces that begin before limit, and where their last piece begins."""
        best, back = [NEVER] * (len(s) + 1), [-1] * (len(s) + 1)
        best[begin] = 0
        get, longest, size = self.scores.get, self.longest, len(s)
        for i in range(begin, limit):
            here = best[i]
            if here == NEVER:
                continue
            for j in range(i + 1, min(i + longest, size) + 1):
                score = get(s[i:j])
                if score is None:
                    if j > i + 1:
                        continue
                    score = self.unknown
                total = here + score - _CUTS[places[j]]
                if total > best[j]:
                    best[j], back[j] = total, i
        return best, back

    def backward(self, s: str, end: int, places: list[int]) -> list[int]:
        best = [NEVER] * (end + 1)
        best[end] = 0
        for i in range(end - 1, -1, -1):
            for j in range(i + 1, min(i + self.longest, end) + 1):
                score = self.scores.get(s[i:j])
                if score is None:
                    if j > i + 1:
                        continue
                    score = self.unknown
                if best[j] > NEVER:
                    best[i] = max(best[i], best[j] + score - _CUTS[places[j]])
        return best

    def traced(self, s: str, back: list[int], begin: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > begin:
            cuts.append(back[cuts[-1]])
        out: list[int] = []
        for j, i in zip(cuts[-2::-1], cuts[:0:-1]):
            piece = self.ids.get(s[i:j])
            out += [piece] if piece is not None else [self.bytes[b] for b in s[i:j].encode("utf-8", "surrogatepass")]
        return out

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers: forward() and traced() for a word by itself."""
        size = len(word)
        if size > 64:
            _, back = self.forward(word, 0, size, places(word, 0))
            return np.array(self.traced(word, back, 0, size), "<u4").tobytes()
        best, back = [0] + [NEVER] * size, [0] * (size + 1)
        get, cuts = self.begun.get, _CUTS
        for i in range(size):
            here = best[i]
            if here == NEVER:
                continue
            for j in range(i + 1, size + 1):
                score = get(word[i:j])
                if score is None:  # no piece begins like this
                    if j > i + 1:
                        break
                    score = self.unknown
                elif score == 0:  # only the beginning of one
                    if j > i + 1:
                        continue
                    score = self.unknown
                elif score == 1:
                    score = 0
                total = here + score - cuts[j]
                if total > best[j]:
                    best[j], back[j] = total, i
        out: list[int] = []
        end = size
        while end:
            begin = back[end]
            piece = self.ids.get(word[begin:end])
            if piece is None:
                out += [self.bytes[b] for b in reversed(word[begin:end].encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece)
            end = begin
        out.reverse()
        return array("I", out).tobytes() if _LITTLE else np.array(out, "<u4").tobytes()

    def forget(self) -> None:
        """Lets go of the words. A task calls it at its end: the worker may then wait long, or serve something else."""
        self.words.clear()
        self.plain.clear()
        trim()

    def known(self, word: str) -> bytes:
        """word(), remembered."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > MOST_WORDS:
                self.words.clear()
            found = self.word(word)
            if len(word) <= 64:
                self.words[word] = found
        return found

    def encode(self, normal: str) -> bytes:
        return b"".join(map(self.known, _WORD.findall(normal)))

    def encode_text(self, text: str | None) -> bytes:
        """encode() of the normalised text. Where single spaces part the words, the words are looked up without them."""
        if not text:
            return b""
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self.encode(normalised(text))
        parts = text.split(" ")
        found = list(map(self.plain.get, parts))
        if None in found:
            if len(self.plain) > MOST_WORDS:
                self.plain.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    ids = self.plain.get(part)
                    if ids is None:
                        ids = self.word(SPACE + part)
                        if len(part) <= 63:
                            self.plain[part] = ids
                    found[i] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        values = self.values
        data = b"".join([values[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")

    def transfer(self, s: str, n: int, place: int) -> np.ndarray:
        """The matrix of the chunk s[:n], where s goes on beyond it and s[0] has this place in its word."""
        k = self.longest
        out = np.full((k, k), NEVER, np.int64)
        at = places(s, place)
        forced = [m.start() for m in _FORCED.finditer(s, 0, n)]

        def ends(best):
            return [best[n + m] if n + m < len(best) else NEVER for m in range(k)]

        if forced:
            first, last = forced[0], forced[-1]
            head = self.backward(s, first, at)
            tail, _ = self.forward(s[last:], 0, n - last, at[last:])
            tail = [tail[n - last + m] if n - last + m < len(tail) else NEVER for m in range(k)]
            for i in range(min(k, first + 1)):
                for m in range(k):
                    if head[i] > NEVER and tail[m] > NEVER:
                        out[i, m] = head[i] + tail[m]  # what lies between is the same for all
            return out
        for i in range(k):
            if i >= n:
                out[i, i - n] = 0
            else:
                out[i] = ends(self.forward(s, i, n, at)[0])
        return out

    def trace(self, s: str, n: int, place: int, begin: int, end: int) -> bytes:
        """The ids of the pieces that begin in the chunk, between its known boundary states."""
        if begin >= n:
            return b""
        at = places(s, place)
        forced = [m.start() for m in _FORCED.finditer(s, 0, n)]
        if not forced:
            _, back = self.forward(s, begin, n, at)
            return np.array(self.traced(s, back, begin, n + end), "<u4").tobytes()
        first, last = forced[0], forced[-1]
        _, back = self.forward(s[:first], begin, first, at)
        head = self.traced(s[:first], back, begin, first)
        _, back = self.forward(s[last:], 0, n - last, at[last:])
        tail = self.traced(s[last:], back, 0, n - last + end)
        return np.array(head, "<u4").tobytes() + self.encode(s[first:last]) + np.array(tail, "<u4").tobytes()


def places(s: str, place: int) -> list[int]:
    """The place in its word of each cut in s, up to the end."""
    out, before = [], SPACE
    for i, c in enumerate(s):
        if c == SPACE and before != SPACE and i:
            place = 0
        out.append(place if place < 4096 else 1 + place % 4095)
        place, before = place + 1, c
    out.append(place if place < 4096 else 1 + place % 4095)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, with NEVER as no path. Sums are taken relative to the greatest, so that they stay small."""
    both = a[:, :, None] + b[None, :, :]
    both = np.where((a[:, :, None] == NEVER) | (b[None, :, :] == NEVER), NEVER, both).max(axis=1)
    top = both.max()
    return np.where(both == NEVER, NEVER, both - top) if top > NEVER else both


def states(matrices: list[np.ndarray], begin: int = 0, end: int = 0) -> list[int]:
    """The state at every boundary on the best way from one state to another."""
    now = np.full((1, len(matrices[0])), NEVER, np.int64)
    now[0, begin] = 0
    ahead = [now]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    out = [end]
    for before, m in zip(ahead[-2::-1], matrices[::-1]):
        ways = np.where((before[0] == NEVER) | (m[:, out[-1]] == NEVER), NEVER, before[0] + m[:, out[-1]])
        out.append(int(ways.argmax()))
    return out[::-1]


@lru_cache(2)
def _loaded(path: str) -> Model:
    return Model(path)


def load(path: str) -> Model:
    holding("pieces", _loaded.cache_clear)
    return _loaded(path)


def normalised(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _combined(matrices: DataFrame, levels: int, fan: int) -> DataFrame:
    """key, chunk, begin, end: the states about each chunk of matrices (key, chunk, matrix), by a scan of so many levels.

    Up: the product of every `fan` neighbours, level by level. Down: the states about a product are those about its first and last
    part, and the ones between follow from the parts. Only `fan` matrices of one text meet in a task.
    """

    def square(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.int64).reshape(int(np.sqrt(len(raw) // 8)), -1)

    def up(table: pa.Table) -> pa.Table:
        parts = [square(m) for m in table.sort_by("chunk").column("matrix").to_pylist()]
        out = parts[0]
        for m in parts[1:]:
            out = product(out, m)
        return pa.table({"key": table.column("key")[:1], "chunk": pa.array([table.column("chunk")[0].as_py() // fan], pa.int32()), "matrix": pa.array([out.tobytes()], pa.binary())})

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        begin, end = table.column("begin")[0].as_py(), table.column("end")[0].as_py()
        way = states([square(m) for m in table.column("matrix").to_pylist()], begin, end)
        return pa.table({"key": table.column("key"), "chunk": table.column("chunk"), "begin": pa.array(way[:-1], pa.int32()), "end": pa.array(way[1:], pa.int32())})

    over = F.expr(f"chunk div {fan}").cast("int")
    stages = [matrices]
    for _ in range(levels - 1):
        stages.append(written(stages[-1].groupBy("key", over).applyInArrow(up, schema("key long, chunk int, matrix binary")), "chunk-products"))
    known = stages[-1].select("key", F.lit(0).alias("whole"), F.lit(0).alias("begin"), F.lit(0).alias("end")).distinct()
    for level in reversed(stages):
        ahead = level.withColumn("whole", over).join(known, ["key", "whole"])
        known = ahead.groupBy("key", "whole").applyInArrow(down, schema("key long, chunk int, begin int, end int")).withColumnRenamed("chunk", "whole")
    return known.withColumnRenamed("whole", "chunk")


def _long(df: DataFrame, model_path: str, chunk: int, fan: int) -> DataFrame:
    """Ids of the texts of more than chunk characters, chunk by chunk."""
    kind = schema("key long, id long, chunk int, n int, place int, s string")

    def deal(batches):
        model, number = load(model_path), 0
        task = TaskContext.get().partitionId() << 33
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                normal = normalised(text)
                if len(normal) <= chunk:
                    continue
                number += 1
                rows, word = [], 0
                for c, at in enumerate(range(0, len(normal), chunk)):
                    # Where the word that goes on here begins: the last such place up to here, however many chunks ago.
                    for m in _FORCED.finditer(normal, max(0, at - chunk + 1), at + 1):
                        word = m.start()
                    rows.append((task + number, name, c, min(chunk, len(normal) - at), at - word, normal[at : at + chunk + model.longest - 1]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], kind.names)

    dealt = written(df.mapInArrow(deal, kind), "chunks")
    spread = dealt.repartition("key", "chunk")

    def matrices(batches):
        model = load(model_path)
        for batch in batches:
            found = [model.transfer(s, n, place).tobytes() for s, n, place in zip(*(batch.column(c).to_pylist() for c in ("s", "n", "place")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["key", "chunk", "matrix"])

    last = dealt.agg(F.max("chunk")).first()[0]
    levels = 1
    while last is not None and last >= fan**levels:
        levels += 1
    found = spread.mapInArrow(matrices, schema("key long, chunk int, matrix binary"))
    known = _combined(written(found, "chunk-matrices") if levels > 1 else found, levels, fan)

    def trace(batches):
        model = load(model_path)
        for batch in batches:
            found = [model.trace(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("s", "n", "place", "begin", "end")))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "id", "chunk")] + [pa.array(found, pa.binary())], ["key", "id", "chunk", "ids"])
        model.forget()

    traced = spread.join(known, ["key", "chunk"]).select("key", "id", "chunk", "s", "n", "place", "begin", "end").mapInArrow(trace, schema("key long, id long, chunk int, ids binary"))
    whole = traced.groupBy("key").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    # Joined as text at once: adding one part after the other would copy all before it each time.
    return whole.select("id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """A row for each row of df: its id and `ids`, little-endian 32-bit integers in a binary."""
    batch_rows(df.sparkSession)
    picked = columns(df, **{id_col: "long", text_col: "string"})

    def work(batches):
        model = load(model_path)
        for batch in batches:
            names, found = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or len(text) < chunk:
                    names.append(name)
                    found.append(model.encode_text(text))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], [id_col, "ids"])
            trim()
        model.forget()

    short = picked.mapInArrow(work, schema(f"{id_col} long, ids binary"))
    long = picked.where(F.length(text_col) >= chunk)
    return short.unionByName(_long(long, model_path, chunk, fan).withColumnRenamed("id", id_col))


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of df: its id, its ids and the `text` that they stand for."""
    batch_rows(df.sparkSession)

    def work(batches):
        model = load(model_path)
        for batch in batches:
            texts = [model.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, ids_col, "text"])
            trim()

    picked = columns(df, **{id_col: "long", ids_col: "binary"})
    return picked.mapInArrow(work, schema(f"{id_col} long, {ids_col} binary, text string"))
