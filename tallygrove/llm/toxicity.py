"""Toxicity: a logistic classifier over hashed words and beginnings of words, whose scores don't
depend on which group a text names.

Every labelled text that holds an identity term is swapped: all places of the term get another term of its set, once for each
other one, and the mean square of what that does to the text's score, over these texts, is added to the loss. Terms that no
labelled text holds have no swapped texts; what their features (shared with other words) add to a text is held down instead. A
neutral mention of a group thus moves the score little, even if the labels say otherwise.

The fit takes up to about `fit_rows` labelled rows (those with the smallest hashed ids); each is read whole. A fifth of them set the threshold instead of the weights. The model is
one weight per bucket, broadcast at a fixed size; scoring runs in numpy over batches.

Defined results: a null or empty text has the score of a text without words; without labelled rows of both kinds every
score is 0; null labels and ids teach nothing; null ids stay; repeated rows are answered one by one; other columns are left
behind; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcols as X
from .shared import batch_rows, columns, schema

BUCKETS = 1 << 18
FIT_ROWS = 8_000
STEPS = 60
RIDGE = 1e-3
#: Besides whole words, their first so many bytes: words that share a stem share a feature.
STEMS = (4, 6)
#: A bucket needs so many labelled texts to get a weight.
LEAST_TEXTS = 3
COUNTERFACTUAL = 1.0
#: At that weight, a mean square change of scores of 1 costs as much as a mean log loss of half this.
SWAP_COST = 20.0

#: Sets of terms that may stand for one another, in English, German, French and Spanish.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hinduisten", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("homosexuels", "hétérosexuels", "lesbiennes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("homosexuales", "heterosexuales", "lesbianas"),
)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    fitted: bool = True

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return _sigmoid(sums + self.bias) if self.fitted else np.zeros(len(sums))


def _word_buckets(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of buckets for each word (its own, then those of its beginnings), the words' hashes, and how many words come before each text."""
    data = X.LOWER[data]
    begins, ends, before = X.words(data, at, X.MARKS)
    prefix = X.prefix_hash(data)
    found = [X.span_hash(prefix, begins, ends)]
    for stem in STEMS:
        cut = X.span_hash(prefix, begins, np.minimum(begins + stem, ends)) + np.uint64(stem)
        found.append(np.where(ends - begins > stem, cut, found[0]))
    return (np.stack(found, axis=1) % np.uint64(buckets)).astype(np.int64), found[0], before


def _features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets of words, and how many come before each text."""
    found, _, before = _word_buckets(data, at, buckets)
    return X.distinct_in_documents(found.ravel(), before * found.shape[1])


def _terms(sets, buckets: int) -> list[tuple[int, np.uint64, np.ndarray]]:
    """(set, hash, buckets) of every term, in order."""
    out = []
    for s, terms in enumerate(sets):
        for term in terms:
            rows, hashes, _ = _word_buckets(*X.utf8(pa.array([term])), buckets)
            if len(hashes) != 1:
                raise ValueError(f"an identity term is one word: {term}")
            out.append((s, hashes[0], np.unique(rows)))
    return out


def _swaps(data: np.ndarray, at: np.ndarray, buckets: int, terms) -> list[list[int]]:
    """For each text, its swaps one after the other: the term's number, how many buckets come and go, these buckets.

    A swap puts another term of the set at every place of a term; its buckets are those of the text so made.
    """
    rows, hashes, before = _word_buckets(data, at, buckets)
    named = np.array([h for _, h, _ in terms], np.uint64)
    hit = np.isin(hashes, named)
    out: list[list[int]] = [[] for _ in before[1:]]
    for text in np.unique(np.searchsorted(before, np.flatnonzero(hit), "right") - 1):
        own, said = rows[before[text] : before[text + 1]], hashes[before[text] : before[text + 1]]
        whole = np.unique(own)
        for i, (group, name, _) in enumerate(terms):
            if not (places := said == name).any():
                continue
            rest = np.unique(own[~places])
            for j, (other, _, new) in enumerate(terms):
                if other == group and j != i:
                    made = np.union1d(rest, new)
                    come, go = np.setdiff1d(made, whole), np.setdiff1d(whole, made)
                    out[text] += [i, len(come), len(go), *come.tolist(), *go.tolist()]
    return out


def _unpacked(packed) -> list[tuple[int, list[int], list[int]]]:
    out, at, packed = [], 0, [int(v) for v in packed]
    while at < len(packed):
        i, come, go = packed[at : at + 3]
        out.append((i, packed[at + 3 : at + 3 + come], packed[at + 3 + come : at + 3 + come + go]))
        at += 3 + come + go
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: list[np.ndarray], labels: np.ndarray, swapped: list, buckets: int, sets, ridge: float, counterfactual: float, steps: int) -> Model:
    """Accelerated gradient descent on log loss (both labels weighing the same) + ridge + squared changes of scores by swaps.

    Features count by the inverse fourth root of how common they are, so that rare words weigh more.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(buckets, np.float32), 0.0, False)
    n = len(rows)
    have = np.bincount(np.concatenate(rows), minlength=buckets)
    used = np.flatnonzero(have >= LEAST_TEXTS)
    if not len(used):
        used = np.flatnonzero(have)
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    flat = place[np.concatenate(rows)]
    owner = np.repeat(np.arange(n), [len(r) for r in rows])[flat >= 0]
    flat = flat[flat >= 0]
    d = len(used)
    scale = (have[used].min() / have[used]) ** 0.25
    value = scale[flat]
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))

    # One row a swap: which text, its share (texts count alike, and so do the swaps of one), +1 for a bucket that comes, -1 for one that goes.
    swaps = [(text, 1 / len(some), *swap) for text, packed in enumerate(swapped) if (some := _unpacked(packed)) for swap in some]
    of_text = np.array([s[0] for s in swaps], np.int64)
    part = counterfactual * SWAP_COST * np.array([s[1] for s in swaps]) / max(len(np.unique(of_text)), 1)
    row, spot, sign = _sparse([(s[3], s[4]) for s in swaps], place)
    # Terms without a text: what one adds to a text's sum.
    held = {s[2] for s in swaps}
    lone_row, lone_spot, _ = _sparse([(b.tolist(), []) for i, (_, _, b) in enumerate(_terms(sets, buckets)) if i not in held], place)
    lone = int(lone_row.max()) + 1 if len(lone_row) else 0

    def loss(w, bias):
        z = np.bincount(owner, w[flat] * value, n) + bias
        added = np.bincount(lone_row, (w * scale)[lone_spot], lone)
        p, q = _sigmoid(z[of_text]), _sigmoid(z[of_text] + np.bincount(row, sign * (w * scale)[spot], len(swaps)))
        moved = part @ (q - p) ** 2 if len(swaps) else 0.0
        return share @ (np.logaddexp(0, z) - labels * z) + ridge / 2 * (w @ w) + moved / 2 + counterfactual * (added @ added) / 2, z, added, p, q

    w, bias, ahead, ahead_bias, t, curve = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0, 1.0
    for _ in range(steps):
        now, z, added, p, q = loss(ahead, ahead_bias)
        pull = part * (q - p)
        error = (_sigmoid(z) - labels) * share + np.bincount(of_text, pull * (q * (1 - q) - p * (1 - p)), n)
        slope = np.bincount(flat, error[owner] * value, d) + ridge * ahead
        slope += scale * np.bincount(spot, sign * (pull * q * (1 - q))[row], d) + scale * np.bincount(lone_spot, counterfactual * added[lone_row], d)
        slope_bias = error.sum()
        for _ in range(30):
            new, new_bias = ahead - slope / curve, ahead_bias - slope_bias / curve
            if loss(new, new_bias)[0] <= now - (slope @ slope + slope_bias**2) / (2 * curve) + 1e-12:
                break
            curve *= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t, curve = new, new_bias, t_next, curve * 0.9
    weights = np.zeros(buckets, np.float32)
    weights[used] = w * scale
    return Model(weights, float(bias))


def _sparse(changes: list[tuple[list[int], list[int]]], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and sign of every bucket that comes or goes and has a weight."""
    cells = [(r, place[b], mark) for r, both in enumerate(changes) for some, mark in zip(both, (1.0, -1.0)) for b in some if place[b] >= 0]
    return np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64), np.array([c[2] for c in cells], np.float64)


def _calibrated(model: Model, rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model with its bias moved so that a score of 0.5 parts rows it wasn't trained on with the best F1 measure."""
    if not model.fitted or not labels.sum():
        return model
    sums = np.array([model.weights[r].sum(dtype=np.float64) for r in rows]) + model.bias
    order = np.argsort(-sums, kind="stable")
    right = np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(rows) + 1) + labels.sum())
    best = int(f1.argmax())
    cut = (sums[order[best]] + (sums[order[best + 1]] if best + 1 < len(rows) else sums[order[best]] - 1)) / 2
    return Model(model.weights, model.bias - float(cut))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, sets=IDENTITY_SETS, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> Model:
    """The model of the rows of df whose id has a label in `labels` and that `learn` (an expression over the id) admits."""
    batch_rows(df.sparkSession)
    known = columns(labels, **{id_col: "long", label_col: "int"}).dropna()
    if learn is not None:
        known = known.where(learn)
    # The sample is bounded, so it fits a broadcast; ties in the hash go by id.
    known = known.groupBy(id_col).agg(F.max(label_col).alias(label_col)).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    rows = columns(df, **{id_col: "long", text_col: "string"}).join(F.broadcast(known), id_col).select(id_col, text_col, label_col)

    terms = _terms(sets, buckets)

    def work(batches):
        for batch in batches:
            for piece in X.pieces(batch, text_col):
                data, at = X.utf8(piece.column(1))
                values, ends = _features(data, at, buckets)
                packed = [values[b:e].astype(np.int32).tobytes() for b, e in zip(ends, ends[1:])]
                swaps = [np.array(some, np.int32).tobytes() for some in _swaps(data, at, buckets, terms)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(packed, pa.binary()), pa.array(swaps, pa.binary())], [id_col, label_col, "buckets", "swaps"])

    found = rows.mapInArrow(work, schema(f"{id_col} long, {label_col} int, buckets binary, swaps binary")).collect()
    found = sorted((zlib.crc32(str(r[0]).encode()[::-1]), r[0], bytes(r[2]), float(r[1] > 0), bytes(r[3])) for r in found)
    features, marks, swapped = [np.frombuffer(r[2], np.int32) for r in found], np.array([r[3] for r in found]), [np.frombuffer(r[4], np.int32) for r in found]
    aside = np.arange(len(found)) % 5 == 4
    if len(np.unique(marks[~aside])) < 2:
        return _train(features, marks, swapped, buckets, sets, ridge, counterfactual, steps)
    learnt = np.flatnonzero(~aside)
    model = _train([features[i] for i in learnt], marks[learnt], [swapped[i] for i in learnt], buckets, sets, ridge, counterfactual, steps)
    return _calibrated(model, [f for f, a in zip(features, aside) if a], marks[aside])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: its id, `score` between 0 and 1, and `predicted`, 1 from a score of 0.5 on."""
    spark = df.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            for piece in X.pieces(batch, text_col):
                values, ends = _features(*X.utf8(piece.column(1)), len(model.weights))
                running = np.zeros(len(values) + 1)
                np.cumsum(model.weights[values], out=running[1:], dtype=np.float64)
                score = model.scores(running[ends[1:]] - running[ends[:-1]])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    picked = columns(df, **{id_col: "long", text_col: "string"})
    return picked.mapInArrow(work, schema(f"{id_col} long, score double, predicted int"))
