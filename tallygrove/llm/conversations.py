"""Repair of the structure of conversations: faults of turns from windows, the cheapest edits from a fold over sorted turns.

A conversation is well formed if the initials of its roles are an optional s and then one or more times ua, or if it is empty.
Turns are kept (cost 0), get the role user or assistant (2) or are deleted (3); empty turns of user or assistant are inserted
anywhere (2). Blank and duplicate turns have to be deleted; a truncated turn that stays costs 1 more. Among the cheapest edits
those are taken whose initials (D, I, K, R) in order are least as ASCII.

Everything is a DataFrame expression. One shuffle by conversation serves the windows and the grouping; `aggregate` then carries
four (cost, edits) structs, one for each role that the turns so far may end in, through native `least`. Two edits of one cost
and end can't be a beginning of each other (each letter more costs), so the least beginning always belongs to the least whole.

Null roles and texts count as one space: such texts are blank, and such roles can't be kept. Turns with a null number come first;
equal numbers are ordered by role, then text. All turns with a null conversation id form one conversation. `gaps` is null where
it is beyond a long. A conversation is one row, as a document is: its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any edits cost: the cost of an end that no edits reach.
NEVER = 1 << 60
WHITE = r" \u0009\u000A\u000B\u000C\u000D"
#: How the fold writes edits. Letters keep the order D, I, K, R of what they stand for; the second of a pair is about an assistant.
#: The same beginning leads to the same role, so at the first difference both letters of a pair never meet.
AUDIT_FROM, AUDIT_TO = "JS", "IR"
ENDS = ("none", "s", "u", "a")


def _state(cost: Column, edits: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), edits.alias("edits"))


def _more(state: Column, cost: Column | int, letters: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["edits"], F.lit(letters)))


def _start() -> Column:
    never = _state(F.lit(NEVER), F.lit(""))
    return F.struct(_state(F.lit(0), F.lit("")).alias("none"), *[never.alias(e) for e in ENDS[1:]])


def _turned(now: Column, turn: Column) -> Column:
    """The four states after one more turn."""
    never = _state(F.lit(NEVER), F.lit(""))
    stays, extra = turn["stays"], F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def keeps(initial: str, state: Column) -> Column:
        return F.when(stays & (turn["initial"] == initial), state).otherwise(never)

    def if_stays(state: Column) -> Column:
        return F.when(stays, state).otherwise(never)

    before_user = F.least(now["none"], now["s"], now["a"])
    user = now["u"]
    return F.struct(
        _more(now["none"], DELETE, "D").alias("none"),
        F.least(_more(now["s"], DELETE, "D"), keeps("s", _more(now["none"], extra, "K"))).alias("s"),
        F.least(
            _more(user, DELETE, "D"),
            keeps("u", _more(before_user, extra, "K")),
            keeps("u", _more(user, extra + INSERT, "JK")),
            if_stays(_more(before_user, extra + REROLE, "R")),
            if_stays(_more(user, extra + INSERT + REROLE, "JR")),
        ).alias("u"),
        F.least(
            _more(now["a"], DELETE, "D"),
            keeps("a", _more(user, extra, "K")),
            keeps("a", _more(before_user, extra + INSERT, "IK")),
            if_stays(_more(user, extra + REROLE, "S")),
            if_stays(_more(before_user, extra + INSERT + REROLE, "IS")),
        ).alias("a"),
    )


def _ended(now: Column) -> Column:
    return F.least(now["none"], now["a"], _more(now["u"], INSERT, "J"), _more(now["s"], 2 * INSERT, "IJ"))


def _repaired(edits: Column, turns: Column) -> Column:
    """The turns after the edits, as an array of (role, text)."""

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    empty = F.array().cast("array<struct<role:string,text:string>>")
    user, assistant, nothing = F.lit("user"), F.lit("assistant"), F.lit("")

    def edited(part: Column, old: Column) -> Column:
        ahead = F.when(part.startswith("I"), F.array(turn(user, nothing))).when(part.startswith("J"), F.array(turn(assistant, nothing))).otherwise(empty)
        own = (
            F.when(part.endswith("K"), F.array(turn(old["role"], old["text"])))
            .when(part.endswith("R"), F.array(turn(user, old["text"])))
            .when(part.endswith("S"), F.array(turn(assistant, old["text"])))
            .otherwise(empty)
        )
        return F.concat(ahead, own)

    parts = F.regexp_extract_all(edits, F.lit("([IJ]*[DKRS])"), 1)
    tail = F.transform(F.regexp_extract_all(F.regexp_extract(edits, "([IJ]*)$", 1), F.lit("([IJ])"), 1), lambda c: turn(F.when(c == "I", user).otherwise(assistant), nothing))
    return F.concat(F.flatten(F.zip_with(parts, turns, edited)), tail)


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    `present` (a condition over turns) marks the rows that are really there: others only say that their conversation exists.
    A conversation without a turn has zeros, an empty audit and no repaired turns.
    """
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    marked = turns.select("conv_id", "turn", "role", "text", there.alias("there"))
    rows = columns(marked, conv_id=turns.schema["conv_id"].dataType.simpleString(), turn="long", role="string", text="string", there="boolean")
    known = rows.select(
        "conv_id",
        "there",
        *[F.when(F.col("there"), c).alias(name) for name, c in (("turn", F.col("turn")), ("role", F.coalesce("role", F.lit(" "))), ("text", F.coalesce("text", F.lit(" "))))],
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    last = F.substring(F.expr(f"rtrim('{WHITE}', text)"), -1, 1)
    initial = F.substring("role", 1, 1)
    faulty = (
        known.withColumn("place", F.row_number().over(in_order))
        .withColumn("before", F.lag(initial).over(in_order))
        .withColumn("nth", F.row_number().over(alike))
        .withColumn("last", last)
        .withColumn("fault", F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise(""))
        .withColumn("illegal", F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au"))
    )
    turn = F.struct("place", "turn", "role", "text", "fault", "illegal")
    grouped = faulty.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), turn))).alias("turns"))

    def faults(kind: str) -> Column:
        return F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long").alias(kind)

    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    plain = F.transform("turns", lambda t: F.struct(F.substring(t["role"], 1, 1).alias("initial"), (~t["fault"].isin("blank", "duplicate")).alias("stays"), (t["fault"] == "truncated").alias("truncated")))
    folded = grouped.withColumn("numbers", numbers).withColumn("best", F.aggregate(plain, _start(), _turned, _ended))
    span = F.expr("try_subtract(try_add(try_subtract(array_max(numbers), array_min(numbers)), 1L), cast(size(array_distinct(numbers)) AS BIGINT))")
    return folded.select(
        "conv_id",
        F.when(F.size("numbers") == 0, F.lit(0).cast("long")).otherwise(span).alias("gaps"),
        *[faults(kind) for kind in ("blank", "duplicate", "truncated")],
        F.size(F.filter("turns", lambda t: t["illegal"])).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"),
        F.translate("best.edits", AUDIT_FROM, AUDIT_TO).alias("audit"),
        _repaired(F.col("best.edits"), F.col("turns")).alias("repaired"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row (`there` is false), 1 empties its text, 2 takes its
    full stops, 3 repeats it, 4 makes its role user. Nulls are one space, but a null turn or conversation id stays null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    known = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = known.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("_copy", "times")
