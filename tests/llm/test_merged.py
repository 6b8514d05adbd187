"""Parts that many tasks make are summed in rounds of a few, and Bloom filters hold what is put in."""

import numpy as np
import pytest

from tallygrove.llm import bloom, shared


@pytest.mark.parametrize("tasks", [0, 1, 8, 9, 70, 600])
def test_rounds_of_few(spark, tasks):
    rows = [(p, t, bytes([t % 251, p])) for t in range(tasks) for p in range(3) if (t + p) % 5]
    seen = spark.sparkContext.accumulator(0)

    def join(data):
        seen.add(len(data) > shared.FAN)
        return b"".join(sorted(data))

    got = {r.part: bytes(r.data) for r in shared.merged(spark.createDataFrame(rows, "part int, at int, data binary"), join).collect()}
    assert {p: sorted(d[i : i + 2] for i in range(0, len(d), 2)) for p, d in got.items()} == {p: sorted(d for q, _, d in rows if q == p) for p in {q for q, _, _ in rows}}
    assert seen.value == 0


def test_bloom_of_many_tasks(spark):
    values = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(40)
    bitmap, bits = bloom.bloom(df, 1 << 20)
    assert bloom.in_bloom(bitmap, bits, values.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-(2**62), 2**62, 5000)
    assert bloom.in_bloom(bitmap, bits, others.view(np.uint64)).mean() < 0.05
    assert not bloom.bloom(df.limit(0), 1 << 20)[0].any()
