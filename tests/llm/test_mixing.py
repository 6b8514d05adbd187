"""The mix against what it promises: targets, whole streams, permutations, shards."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import mixing
from tallygrove.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_targets():
    # 450 words: 5/8 of them are over 200, then 2/3 and 1/3 of the 250 that are left.
    assert mixing.targets([100, 100, 100]) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for sizes in ([1, 2, 3, 4, 5, 6, 7], [7] * 20, [1000, 1, 1, 1], [3, 0, 9]):
        got = mixing.targets(sizes)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(0 <= t <= 2 * s for t, s in zip(got, sizes))
        # All below their bound have one level.
        assert len({t / mixing.WEIGHTS[i % 3] for i, (t, s) in enumerate(zip(got, sizes)) if t < 2 * s}) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000])
def test_permutations(n):
    index = np.arange(n)
    one, other = (mixing.permuted(index, np.full(n, n), np.repeat(mixing._keys(3, [5], [e]), n)) for e in (0, 1))
    assert sorted(one) == sorted(other) == list(range(n))
    assert (mixing.permuted(one, np.full(n, n), np.repeat(mixing._keys(3, [5], [0]), n), back=True) == index).all()
    if n > 100:
        assert (one != other).mean() > 0.9 and abs(np.corrcoef(index, one)[0, 1]) < 0.2


TEXTS = [(i, f"s{i % 7}" if i % 11 else None, " ".join(f"w{i}_{j}" for j in range(i * 37 % 301))) for i in range(120)]
TEXTS += [(500, "s1", None), (None, "s1", "no id here"), (501, "s1", ""), (502, "", "in a source without a name"), (7, "s0", "the same"), (7, "s0", "the same"), (503, "s2", "\n".join(f"l{j}" for j in range(5000)))]


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame([(*t, 0.5, "x", "y") for t in TEXTS], "doc_id long, source string, text string, size double, start string, number string")
    return mixing.mix(df.repartition(5), block=16, slots=50)


def test_every_target_is_met(mixed):
    rows = mixing.taken(mixed).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, len(words(t))) for i, s, t in TEXTS)
    sizes, got, want = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        want[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [want[s] for s in order] == [float(t) for t in mixing.targets([sizes[s] for s in order])]
    assert all(abs(got[s] - want[s]) <= 0.5 for s in order)


def test_blocks_hold_the_documents_words(mixed):
    rows = mixed.sequences.collect()
    assert len({(r.shard, r.position) for r in rows}) == len(rows) and {r.position for r in rows if r.shard == 0} == set(range(50))
    whole = {}
    for r in rows:
        at = 0
        for p in r.pieces:
            texts = [words(t) for i, s, t in TEXTS if i == p.doc_id and s == r.source]
            assert p["at"] == at and any(t[p.begin : p.begin + p.n] == p.words for t in texts) and len(p.words) == p.n
            at += p.n
        assert at == r.n_words <= 16
        whole.setdefault((r.source, r.epoch), []).append(r)
    # In an epoch no block comes twice, and a source's epochs before the last are complete.
    for (source, epoch), found in whole.items():
        assert len({r.block for r in found}) == len(found)
        if (source, epoch + 1) in whole:
            assert sum(r.n_words for r in found) == sum(len(words(t)) for _, s, t in TEXTS if s == source)


def test_shards_are_drawn(mixed):
    """Each shard has its own counts, near the share of each source."""
    counts = defaultdict(Counter)
    for r in mixed.sequences.select("shard", "source").collect():
        counts[r.shard][r.source] += 1
    total = sum((c for c in counts.values()), Counter())
    assert len({tuple(sorted(map(str, c.items()))) for c in counts.values()}) > len(counts) // 2
    n, share = sum(total.values()), total["s2"] / sum(total.values())
    full = [c["s2"] for c in counts.values() if sum(c.values()) == 50]
    assert n > 1000 and abs(np.mean(full) - 50 * share) < 4 * np.sqrt(50 * share * (1 - share) / len(full))
    assert 0.4 < np.var(full) / (50 * share * (1 - share)) < 2


def test_reruns_agree_whatever_the_partitions(spark, mixed):
    df = spark.createDataFrame(TEXTS, "doc_id long, source string, text string")
    again = mixing.mix(df.coalesce(1), block=16, slots=50, words=False)
    order = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, mixing.taken(again).select(order).collect())) == sorted(map(repr, mixing.taken(mixed).select(order).collect()))


def test_empty_and_wordless_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    wordless = mixing.mix(spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string"))
    assert [(r.doc_id, r.taken, r.target) for r in mixing.taken(wordless).orderBy("doc_id").collect()] == [(1, 0, 0.0), (2, 0, 0.0)] and wordless.sequences.count() == 0
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_source_mix"](spark, str(tmp_path)).count() == 0


def test_query(spark, data):
    rows = QUERIES["op12_source_mix"](spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").withColumn("source", F.coalesce("source", F.lit("~null"))).collect()}
    by = defaultdict(Counter)
    for r in rows:
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        by[docs[r.doc_id].source] += Counter(size=r.size, taken=r.taken)
        by[docs[r.doc_id].source]["target"] = r.target
        by[docs[r.doc_id].source]["all"] = r.source_size
    assert len(rows) == len(docs) and all(b["size"] == b["all"] and abs(b["taken"] - b["target"]) <= 0.5 for b in by.values())
