"""Batches of passages: each embedded once, a failed one alone again."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tallygrove import storage
from tallygrove.functions import vectors as V
from tallygrove.operators import embedding


class Recording(V.HashEmbedder):
    """Leaves a file for each text it embeds; fails on a text that `fails` names while the file "broken" is there."""

    def __init__(self, folder, fails, size=8):
        super().__init__(size)
        self.folder, self.fails = str(folder), fails

    def passages(self, texts):
        texts = list(texts)
        if Path(self.folder, "broken").exists() and self.fails in texts:
            raise RuntimeError("no model")
        for text in texts:
            with open(f"{self.folder}/{hashlib.md5(text.encode()).hexdigest()}", "a") as seen:
                seen.write("x")
        return super().passages(texts)


def test_failed_batches_run_again_alone(spark, tmp_path):
    texts = [f"passage number {w} of many" for w in "abcdefghijklmnopqrstuvwxyz"] + [""]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(100, None), (None, "a passage of no posting")]
    df = spark.createDataFrame(rows, "job_id long, content string")
    (tmp_path / "broken").touch()
    model, path = Recording(tmp_path, texts[3]), storage.new_path(spark, "embedding")
    with pytest.raises(RuntimeError, match="batches to be embedded again: \\[\\d\\]"):
        embedding.attached(df, model, path, 5)
    before = Counter({p.name: len(p.read_text()) for p in tmp_path.iterdir()})
    done = [storage.done(spark, f"{path}/vectors/{i}") is not None for i in range(6)]
    assert done.count(False) == 1
    written = {bytes(r.key) for i in range(6) if done[i] for r in storage.done(spark, f"{path}/vectors/{i}")[0].collect()}
    (tmp_path / "broken").unlink()
    got = embedding.attached(df, model, path, 5).collect()
    # Rows stay as they are, equal texts have equal vectors, which are those of the model.
    assert sorted(((r.job_id is None, r.job_id, r.content) for r in got), key=str) == sorted(((i is None, i, t) for i, t in rows), key=str)
    for r in got:
        assert r.embedding is None if r.content is None else np.allclose(r.embedding, model.vector(r.content))
    # What was written before the fault was not embedded again.
    for text in {t for _, t in rows if t is not None}:
        digest = hashlib.md5(text.encode()).hexdigest()
        times = len(Path(tmp_path, digest).read_text())
        if hashlib.sha256(f"{model.name}\0{text}".encode()).digest() in written:
            assert times == before[digest] == 1
        else:
            assert times >= 1
    # A third call reads.
    again = Counter({p.name: len(p.read_text()) for p in tmp_path.iterdir()})
    assert embedding.vectors(df, model, path, 5).count() == len({t for _, t in rows if t is not None})
    assert again == Counter({p.name: len(p.read_text()) for p in tmp_path.iterdir()})


def test_no_contents(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "job_id long, content string")
    for some in (df, df.limit(0)):
        got = embedding.attached(some, Recording(tmp_path, ""), storage.new_path(spark, "embedding"), 5)
        assert [r.embedding for r in got.collect()] == [None] * some.count()


def test_checked_embedder():
    class Model(V.HashEmbedder):
        def vector(self, text):
            return [3.0, 4.0] if text.startswith("ask: ") else [0.0, 0.0] if not text else [5.0, 0.0]

    model = V.CheckedEmbedder(Model(), 2, "ask: ")
    assert model.query("x") == pytest.approx([0.6, 0.8]) and model.passages(["x", ""]) == [[1.0, 0.0], [0.0, 0.0]] and model.passages([]) == []
    with pytest.raises(ValueError, match="2 numbers, 3"):
        V.CheckedEmbedder(Model(), 3).passages(["x"])
