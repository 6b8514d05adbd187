"""Swaps against texts that are really swapped, and what the fit learns from."""

import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallygrove.llm import textcols, toxicity
from tallygrove.llm.queries import QUERIES

BUCKETS = 1 << 18


def features(text):
    return set(toxicity._features(*textcols.utf8(pa.array([text])), BUCKETS)[0].tolist())


def swapped_texts(text):
    """(term, the text with another term at all its places), by replacing words in the text."""
    out = []
    for terms in toxicity.IDENTITY_SETS:
        for term in terms:
            # A word is a run of a-z, 0-9 and other than ASCII characters.
            pattern = re.compile(f"(?<![A-Za-z0-9\u0080-\U0010ffff]){term}(?![A-Za-z0-9\u0080-\U0010ffff])", re.I | re.A)
            if pattern.search(text):
                out += [(term, pattern.sub(other, text)) for other in terms if other != term]
    return out


@pytest.mark.parametrize(
    "text",
    [
        "Muslims and muslims met; black cats, blacksmiths and a black-and-white film.",
        "Die Männer und die Frauen der Stadt, Männerchor, Flüchtlinge.",
        "Les femmes, les étrangers et les réfugiés; femmes",
        "Las niñas y los niños; inmigrantes, cristianos",
        "women women men",
        "nobody is named here",
        "",
    ],
)
def test_swaps_are_those_of_swapped_texts(text):
    terms = toxicity._terms(toxicity.IDENTITY_SETS, BUCKETS)
    names = [t for some in toxicity.IDENTITY_SETS for t in some]
    asked = ["before men", text, None, "after"]
    got = toxicity._unpacked(toxicity._swaps(*textcols.utf8(pa.array(asked)), BUCKETS, terms)[1])
    own = features(text)
    expected = [(names.index(term), sorted(features(new) - own), sorted(own - features(new))) for term, new in swapped_texts(text)]
    assert sorted((i, sorted(come), sorted(go)) for i, come, go in got) == sorted(expected)


def corpus(spark, seed=1):
    """Labels that name one group of each set in toxic texts only."""
    rng = random.Random(seed)
    fill, rows = [f"word{i}" for i in range(60)], []
    for i in range(600):
        words = rng.sample(fill, 8)
        if i % 3 == 0:
            words += ["awful"] * (rng.random() < 0.7) + [rng.choice(("muslims", "ausländer", "étrangers", "judíos"))] * (rng.random() < 0.8)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")


def test_scores_of_swapped_texts_move_less(spark):
    rows, docs, labels = corpus(spark)
    pairs = [(text, new) for _, text, _ in rows for _, new in swapped_texts(text)]
    asked = spark.createDataFrame([(2 * i + k, t) for i, both in enumerate(pairs) for k, t in enumerate(both)], "doc_id long, text string")

    def moves(weight):
        model = toxicity.fit(docs, labels, counterfactual=weight)
        got = {r.doc_id: r.score for r in toxicity.predict(asked, model).collect()}
        return np.array([got[2 * i] - got[2 * i + 1] for i in range(len(pairs))]), model

    free, _ = moves(0.0)
    held, model = moves(toxicity.COUNTERFACTUAL)
    assert (held @ held) < 0.1 * (free @ free)
    # What is toxic for another word than the group's is still found.
    said = spark.createDataFrame([(1, "word1 awful word2"), (2, "word1 word2")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.predict(said, model).collect()}
    assert score[1] > 0.5 > score[2]


def test_held_out_labels_teach_nothing(spark, data, tmp_path):
    """The query's scores are the same when all labels of held-out rows are the other way round."""
    for name in ("documents", "labels"):
        shutil.copy(f"{data}/{name}.parquet", tmp_path)
    before = {r.doc_id: (r.held_out, r.score) for r in QUERIES["op4_toxicity"](spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    turned = [(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels]
    assert any(t[2] != r.toxic for t, r in zip(turned, labels))
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/turned")
    (tmp_path / "labels.parquet").unlink()
    (tmp_path / "turned").rename(tmp_path / "labels.parquet")
    after = {r.doc_id: (r.held_out, r.score) for r in QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()}
    assert after == before and any(held for held, _ in before.values())
