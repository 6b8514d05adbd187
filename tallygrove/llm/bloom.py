"""Bloom filters of a bounded size over hashes in a table, built on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textcols as X
from .shared import dropped, merged, schema, written

_U = np.uint64
#: Parts of the bitmap, each merged by itself.
PARTS = 16


def bloom(hashes: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """A bitmap in which two bits stand for each value of the one column (64-bit hashes), and its number of bits, at most `most`."""
    bits = 1 << 16
    count = hashes.count()
    while bits < min(most, 16 * count):
        bits *= 2
    kind = schema("part int, at int, data binary")

    def work(batches):
        out, task = np.zeros(bits // 8, np.uint8), TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(0).to_numpy().view(_U)
            for at in ((values % _U(bits)).astype(np.int64), (X.mix(values) % _U(bits)).astype(np.int64)):
                np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = [zstandard.compress(p.tobytes(), 1) for p in np.split(out, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array(packed, pa.binary())], kind.names)

    def either(packed: list[bytes]) -> bytes:
        out = np.zeros(bits // 8 // PARTS, np.uint8)
        for part in packed:
            out |= np.frombuffer(zstandard.decompress(part), np.uint8)
        return zstandard.compress(out.tobytes(), 1)

    made = written(hashes.mapInArrow(work, kind), "bloom-parts")
    rows = sorted(merged(made, either).collect(), key=lambda r: r.part)
    dropped(hashes.sparkSession, made)
    bitmap = np.frombuffer(b"".join(zstandard.decompress(bytes(r.data)) for r in rows), np.uint8) if rows else np.zeros(bits // 8, np.uint8)
    return bitmap, bits


def in_bloom(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    def has(at):
        at = at.astype(np.int64)
        return (bitmap[at >> 3] >> (7 - (at & 7))) & 1 > 0

    return has(hashes % _U(bits)) & has(X.mix(hashes) % _U(bits))
