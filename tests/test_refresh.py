"""Bucketed tables, kept template counts and the refresh: changes against plain dictionaries, untouched files, resumed runs."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrove import storage
from tallygrove.functions import vectors as V
from tallygrove.operators import buckets, index, ingest, refresh, templates

NOW = dt.datetime(2024, 5, 1)
KIND = "k long, v string, tags array<string>"


def rows_of(table):
    return sorted((r.k, r.v) for r in buckets.read(table).collect())


def test_changes_touch_only_their_buckets(spark):
    table = buckets.create(spark, storage.new_path(spark, "t"), spark.createDataFrame([(i, str(i), [str(i)]) for i in range(100)], KIND), ("k",), 16)
    before = table.state()
    counts = buckets.upsert(table, spark.createDataFrame([(3, "3", ["3"]), (7, "x", ["7"]), (500, "new", None), (None, "no key", None)], KIND))
    assert counts == {"inserted": 1, "updated": 1, "unchanged": 1}
    after = table.state()
    moved = {b for b in after.files if after.files[b] != before.files.get(b)}
    expected = {r[0] for r in spark.createDataFrame([(7,), (500,)], "k long").select(table.bucket()).collect()}
    assert moved == expected and after.rows == 101
    assert rows_of(table) == sorted([(i, "x" if i == 7 else str(i)) for i in range(100)] + [(500, "new")])
    # The old version's files are still there for its readers.
    assert buckets.read(table, state=before).count() == 100
    # Nothing differs, nothing is touched.
    assert buckets.upsert(table, spark.createDataFrame([(7, "x", ["7"])], KIND))["unchanged"] == 1 and table.state().files == after.files


def test_a_change_with_a_tag_is_made_once_and_dead_files_do_not_count(spark):
    table = buckets.create(spark, storage.new_path(spark, "t"), spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", None)], KIND), ("k",), 4)
    buckets.read(table).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.path}/files/run=dead")
    new = spark.createDataFrame([(1, "z", None)], KIND)
    first = buckets.change(table, new, spark.createDataFrame([(2,)], "k long"), tag="one")
    assert rows_of(table) == [(1, "z")]
    buckets.change(table, spark.createDataFrame([(9, "q", None)], KIND), tag="one")
    assert table.state() == first and first.tags == {"one"} and rows_of(table) == [(1, "z")]
    buckets.change(table, keys=new.select("k"))
    assert rows_of(table) == [] and table.state().rows == 0
    with pytest.raises(ValueError):
        buckets.create(spark, table.path, new, ("k",))
    with pytest.raises(Exception):
        buckets._publish(table, table.state())


def test_template_counts_equal_a_recount(spark):
    rng = random.Random(4)
    said = ["paragraph number %d " % i + "with words enough to be counted as a long one here" for i in range(6)]
    kept = templates.opened(spark, storage.new_path(spark, "templates"), number=4)
    docs: dict = {}

    def made(some):
        return spark.createDataFrame([(i, t) for i, t in some.items()], "id long, description string")

    for step in range(3):
        new = {i: "\n\n".join(rng.choices(said, k=rng.randint(0, 3)) + ["short"]) for i in rng.sample(range(30), 12)}
        new[40 + step] = None
        gone = rng.sample(range(30), 5)
        before = count(docs)
        crossing = templates.change(kept, made(new), spark.createDataFrame([(i,) for i in gone], "id long"), least=4, tag=f"s{step}")
        docs.update(new)
        docs = {i: t for i, t in docs.items() if i not in gone}
        assert Counter({bytes(r.key): r.n for r in buckets.read(kept.counts).collect()}) == hashed(spark, count(docs))
        expected = {k for k in said if (before[k] >= 4) != (count(docs)[k] >= 4)}
        held = {bytes(r.key) for r in crossing.collect()}
        assert held == set(hashed(spark, Counter(expected)))
        assert {r.id for r in templates.crossed(kept, crossing).collect()} == {i for i, t in docs.items() if t and expected & set(t.split("\n\n"))}
        again = templates.change(kept, made(new), spark.createDataFrame([(i,) for i in gone], "id long"), least=4, tag=f"s{step}")
        assert {bytes(r.key) for r in again.collect()} == held
        assert Counter({bytes(r.key): r.n for r in buckets.read(kept.counts).collect()}) == hashed(spark, count(docs))


def count(docs):
    return Counter(p for t in docs.values() if t for p in set(t.split("\n\n")) if len(p.split()) >= 12)


def hashed(spark, counts):
    import hashlib

    return Counter({hashlib.md5(p.encode()).digest(): n for p, n in counts.items()})


SHARED = "This very same paragraph of more than twelve words stands in a number of postings of ours."


def posting(i, text, title="Software Engineer", url=None):
    return (f"p{i}", title, "Acme", "board", url or f"https://x.example/{i}", text, False)


STAGED = "source_job_id string, title string, company string, source string, url string, description string, is_remote boolean"


def status(method, url):
    return 404 if url.endswith("/13") else 200


class Counting(V.HashEmbedder):
    """Fails where a text holds this word, so that a run can be broken within its index."""

    fails = ""

    def passages(self, texts):
        texts = list(texts)
        if self.fails and any(self.fails in t for t in texts):
            raise RuntimeError("no model")
        return super().passages(texts)


def feed(spark, rows, quota=False, asked=None):
    def fetch(known):
        if asked is not None:
            asked.append(1)
        return spark.createDataFrame(rows, STAGED), quota

    return fetch


def broken(known):
    raise OSError("no net")


def contents(store):
    chunks = sorted((r.job_id, r.chunk_index, r.content) for r in buckets.read(store.chunks).collect())
    return chunks, sorted((r.job_id, r.content_hash, r.n_chunks) for r in buckets.read(store.vectors).collect())


def test_refresh_resumes_to_the_same_tables(spark):
    body = " ".join(["Kafka and Python on Kubernetes."] * 12)
    first = [posting(i, f"{body} It is number {i}.\n\n{SHARED}") for i in range(2)] + [posting(13, body), ("", *posting(60, body)[1:])]
    second = [posting(i, f"{body} It is number {i}.\n\n{SHARED}") for i in range(1, 4)] + [posting(1, "twice", "Senior Engineer")]
    store = refresh.opened(spark, storage.new_path(spark, "store"), 4)
    asked = []
    embedder = Counting(16)
    sources = [("a", feed(spark, first, asked=asked)), ("b", broken), ("c", feed(spark, [posting(50, body)], True)), ("d", feed(spark, second))]
    embedder.fails = "number 1"
    said = refresh.refresh(store, "r1", sources, status, NOW, embedder, least=3)
    assert "no model" in said["index"]["error"] and said["sources"] == {"a": 4, "c": 1} and said["quota_exceeded"] and "no net" in said["failed"]["b"]
    assert (said["scraped"], said["saved"], said["skipped"]) == (4, 3, 1)
    with pytest.raises(ValueError, match="r1"):
        refresh.refresh(store, "r2", [], status, NOW)
    embedder.fails = ""
    said = refresh.refresh(refresh.opened(spark, store.path, 4), "r1", sources, status, NOW, embedder, least=3)
    assert said["index"]["embedded"] == 3 and said["saved"] == 3 and len(asked) == 1
    assert refresh.refresh(store, "r1", sources, status, NOW, embedder, least=3) == said
    stored = {r.source_job_id: r for r in buckets.read(store.listings).collect()}
    assert sorted(stored) == ["p0", "p1", "p50"] and sorted(r.id for r in stored.values()) == [1, 2, 3] and {"python", "kafka"} <= {s.lower() for s in stored["p0"].required_skills}
    # The shared paragraph becomes a template with the third and fourth posting: the passages of the first two change as well.
    assert any(SHARED in c for _, _, c in contents(store)[0])
    said = refresh.refresh(store, "r2", [("d", feed(spark, second))], status, NOW, embedder, least=3)
    assert (said["saved"], said["index"]["cut"], said["index"]["embedded"]) == (2, 4, 4)
    chunks, vectors = contents(store)
    assert not any(SHARED in c for _, _, c in chunks)
    whole = index.build(buckets.read(store.listings), embedder, least=3, now=NOW)
    assert chunks == sorted((r.job_id, r.chunk_index, r.content) for r in whole.chunks.collect())
    assert vectors == sorted((r.job_id, r.content_hash, r.n_chunks) for r in whole.vectors.collect())
    said = refresh.refresh(store, "r3", [("d", feed(spark, second))], status, NOW, embedder, least=3)
    assert (said["scraped"], said["saved"], said["reparsed"], said["index"]["cut"]) == (0, 0, 0, 0) and contents(store) == (chunks, vectors)


def test_seeded_postings_are_indexed_by_the_first_run(spark):
    store = refresh.opened(spark, storage.new_path(spark, "store"), 2)
    old = spark.createDataFrame([(7, *posting(1, "Some text.")), (8, *posting("synthetic-1", None))], "id long, " + STAGED).withColumn("source_job_id", F.regexp_replace("source_job_id", "^psyn", "syn")).withColumn("other", F.lit(1))
    refresh.seeded(store, old)
    said = refresh.refresh(store, "r", [("a", feed(spark, [posting(2, "More.")]))], status, NOW, V.HashEmbedder(8))
    assert said["saved"] == 1 and said["reparsed"] == 3 and said["index"]["cut"] == 2
    assert {r.source_job_id: r.id for r in buckets.read(store.listings).collect()} == {"p1": 7, "synthetic-1": 8, "p2": 9}


def test_new_ids_reach_wide_rows_of_every_range(spark):
    # Wide rows and their counts are ranges of different sizes, which adaptive execution merges differently.
    wide = spark.range(8000).select(F.format_string("%05d", "id").alias("k"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "").alias("text"))
    out = storage.written(ingest.with_ids(wide, 10, ["k"]), "numbered")
    assert sorted((r.k, r.id) for r in out.collect()) == [(f"{i:05d}", 11 + i) for i in range(8000)]
