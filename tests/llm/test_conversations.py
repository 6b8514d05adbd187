"""Repair of conversations against a search through all edits, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import conversations
from tallygrove.llm.queries import QUERIES

KIND = "conv_id long, turn long, role string, text string, there string, place string, fault string"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """rows: (role, text) in order. Every sequence of edits with at most two insertions ahead of each row and at the end."""
    seen, options = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        must = not bare or (role, text) in seen
        late = 1 if not must and bare[-1] not in ".!?" else 0
        seen.add((role, text))
        own = [("D", 3, [])]
        if not must:
            own += [("K", late, [(role, text)]), ("R", 2 + late, [("user", text)]), ("R", 2 + late, [("assistant", text)])]
        options.append(own)
    added = [("", 0, []), *[("I", 2, [(r, "")]) for r in ("user", "assistant")], *[("II", 4, [(r, ""), (q, "")]) for r, q in (("user", "assistant"), ("assistant", "user"))]]
    best = None
    steps = [x for own in options for x in (added, own)] + [added]
    for chosen in itertools.product(*steps):
        out = [t for c in chosen for t in c[2]]
        if GOOD.fullmatch("".join(r[:1] or " " for r, _ in out)):
            found = (sum(c[1] for c in chosen), "".join(c[0] for c in chosen), out)
            best = min(best, found) if best else found
    return best


def repaired(spark, named):
    df = spark.createDataFrame([(c, i, r, t, "x", "y", "z") for c, rows in named.items() for i, (r, t) in enumerate(rows)], KIND)
    return {r.conv_id: (r.cost, r.audit, [(t.role, t.text) for t in r.repaired]) for r in conversations.repair(df).collect()}


def test_cheapest_edits(spark):
    rng = random.Random(5)
    texts = ["One.", "Two?", "three", "  ", "", "Four! \n", "five\t", "Six. x"]
    named = {c: [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts)) for _ in range(rng.randint(1, 4))] for c in range(120)}
    got = repaired(spark, named)
    for c, rows in named.items():
        assert got[c] == plain_repair(rows), rows


def test_odd_rows(spark):
    text = "a long one. " * 20_000
    rows = [
        (1, None, "user", "No number."), (1, 5, "assistant", text), (1, 9, "user", None),
        (2, 1, None, "No role."),
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."),
        (3, -(2**63), "user", "A."), (3, 2**63 - 1, "assistant", "B."),
        (4, 1, "user", "Same."), (4, 1, "user", "Same."), (4, 1, "assistant", "Same."), (4, None, "system", "First."),
    ]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)).collect()}
    assert (got[1].audit, got[1].gaps, got[1].blank) == ("KKD", 3, 1) and got[1].repaired[1].text == text
    assert (got[2].audit, got[2].cost, got[2].illegal) == ("D", 3, 0)
    assert (got[None].audit, got[None].cost) == ("KK", 0)
    assert got[3].gaps is None and got[3].audit == "KK"
    # By role at an equal number: system without a number, assistant, user, user.
    assert (got[4].audit, got[4].duplicate, got[4].illegal, got[4].gaps) == ("KIKKDI", 1, 2, 0)


def test_long_conversation(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = conversations.repair(df).first()
    assert (got.cost, got.audit, len(got.repaired)) == (0, "K" * n, n)


def test_no_turns(spark, tmp_path):
    df = spark.createDataFrame([], KIND)
    assert conversations.repair(df).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_every_conversation_comes_back(spark, tmp_path):
    """The ids whose only row the damage drops have zeros and the hash of nothing."""
    import zlib

    gone = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    assert gone
    spark.createDataFrame([(i, 0, "user", "Hello there.", "x", "y", "z") for i in range(200)], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(200))
    for i in gone:
        assert got[i][1:8] == (0, 0, 0, 0, 0, 0, "") and got[i].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert {(got[i].cost, got[i].audit) for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 > 4} == {(2, "KI")}


def test_native(spark, data):
    """No Python worker, one exchange."""
    plan = QUERIES["op13_conversation_repair"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("rows", [[("system", "Only.")], [("assistant", "Only.")], [("user", "Q."), ("user", "R.")], [("user", "Q."), ("system", "S."), ("assistant", "A.")]])
def test_named_cases(spark, rows):
    assert repaired(spark, {1: rows})[1] == plain_repair(rows)
