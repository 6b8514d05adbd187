"""Language identification: multinomial naive Bayes over hashed character n-grams.

A matrix of log-probabilities, one row for each hash bucket and one column for each language, is fitted on the executors,
broadcast (its size is buckets x languages x 4 bytes) and applied to batches of documents with numpy.

The fit takes labelled rows up to about `fit_rows`: with more than that, those whose hashed id falls under the
corresponding fraction. Every text is scored whole.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn
from. Ties go to the language that sorts first. Null ids stay; repeated rows are answered one by one; rows with a null
language teach nothing; other columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batch_rows, columns, holding, schema, trim
from .textcols import mix

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
FIT_ROWS = 20_000
PIECE_CHARS = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))


def _grams(texts: list[str], buckets: int):
    """For every order, the bucket of each n-gram within a text; and how many characters come before each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled = codes + np.uint64(1)
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(1) if len(rolled) else rolled
        if order in ORDERS:
            yield order, (mix(rolled + np.uint64(order << 40)) % np.uint64(buckets)).astype(np.int64), ends


def _parts(texts: list[str | None]):
    """The texts in lower case, in lists of about PIECE_CHARS characters, as (number of the text, sign, part). A longer text comes in
    parts that overlap by what the longest n-gram reaches into the next one; the overlap, counted twice, comes once with a minus."""
    out, size, reach = [], 0, max(ORDERS) - 1
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for begin in range(0, max(1, len(text)), PIECE_CHARS):
            end = begin + PIECE_CHARS
            out.append((i, 1, text[begin : end + reach]))
            if end < len(text):
                out.append((i, -1, text[end : end + reach]))
            size += min(PIECE_CHARS, len(text) - begin)
            if size >= PIECE_CHARS:
                yield out
                out, size = [], 0
    if out:
        yield out


def _counts(texts: list[str], buckets: int) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for every in _parts(texts):
        for sign in (1, -1):
            some = [part for _, s, part in every if s == sign]
            for order, grams, ends in _grams(some, buckets):
                begins = np.arange(len(grams))
                inside = np.ones(len(grams), bool)
                for back in range(1, order):  # an n-gram that reaches into the next text is none
                    cut = ends[1:-1] - back
                    inside[cut[(cut >= 0) & (cut < len(grams))]] = False
                total += sign * np.bincount(grams[begins[inside]], minlength=buckets)
    return total


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", learn: Column | None = None, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """The model of the rows of df that `learn` admits and whose label isn't null."""
    batch_rows(df.sparkSession)
    rows = df if learn is None else df.where(learn)
    rows = columns(rows, **{id_col: "long", text_col: "string", label_col: "string"}).where(F.col(label_col).isNotNull())
    known = rows.select(id_col).count()
    if known > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1_000_000)) < int(1_000_000 * fit_rows / known))

    def count(batches):
        holding("langid", lambda: None)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(label, []).append(text)
            for label, texts in by.items():
                totals[label] = totals.get(label, 0) + _counts(texts, buckets)
        if totals:
            packed = [zstandard.compress(v.tobytes(), 1) for v in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(packed, pa.binary())], ["label", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(v.as_py()), np.int64) for v in table.column("counts"))
        return pa.table({"label": table.column("label").slice(0, 1).cast(pa.string()), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    kind = schema("label string, counts binary")
    found = rows.select(text_col, label_col).mapInArrow(count, kind).groupBy("label").applyInArrow(add, kind).collect()
    found = sorted((r.label, np.frombuffer(zstandard.decompress(bytes(r.counts)), np.int64)) for r in found)
    if not found:
        return Model()
    table = np.stack([c for _, c in found], axis=1).astype(np.float64) + SMOOTHING
    return Model([label for label, _ in found], (np.log(table) - np.log(table.sum(axis=0))).astype(np.float32))


def _score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    total = np.zeros((len(texts), len(model.languages)))
    for every in _parts(texts):
        some = [part for _, _, part in every]
        sums = np.zeros((len(some), len(model.languages)))
        for order, grams, ends in _grams(some, len(model.weights)):
            # Sums over a text's n-grams as differences of running sums; those that reach into the next text stay out.
            running = np.zeros((len(grams) + 1, len(model.languages)))
            np.cumsum(model.weights[grams], axis=0, out=running[1:], dtype=np.float64)
            begin = np.minimum(ends[:-1], len(grams))
            sums += running[np.maximum(np.minimum(ends[1:] - order + 1, len(grams)), begin)] - running[begin]
        np.add.at(total, [i for i, _, _ in every], sums * np.array([sign for _, sign, _ in every])[:, None])
    labels, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if model.languages and text and _LETTER.search(text.lower()):
            top = int(total[i].argmax())
            labels[i], best[i] = model.languages[top], 1 / np.exp(total[i] - total[i, top]).sum()
    return labels, best


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of df: its id, the columns in `keep`, `lang_pred` and `score`, the posterior probability."""
    spark = df.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = df.select(df[id_col].cast("long").alias(id_col), df[text_col].cast("string").alias("_text"), *keep)
    kind = T.StructType([f for f in picked.schema.fields if f.name != "_text"] + schema("lang_pred string, score double").fields)

    def work(batches):
        holding("langid", lambda: None)
        for batch in batches:
            labels, best = _score(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(labels, pa.string()), pa.array(best, pa.float64())], kind.names)
            trim()

    return picked.mapInArrow(work, kind)
