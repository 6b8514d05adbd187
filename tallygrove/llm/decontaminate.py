"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of an item (or all words of a shorter one); its set is that of its word shingles, three words
each (a window of fewer words is one shingle). A document holds a window only if it holds every shingle of it, so a prefix of
one shingle is necessary; shingles are ordered by rarity over all documents, and each window is joined on its rarest one. A
window with a shingle that no document has is out at once. The place of the match gives the place where the window would
begin; the length and place bounds turn down what would stick out of the document, and the words themselves are compared at
last, so a hit is exact.

The documents' words are split once, into a table of the shared folder. What goes through the joins is a shingle's 64-bit hash,
its row and its place, never a document's words; for the comparison the words of the rows that have candidates are joined
once. Shingles of windows, and the numbers of rows with candidates, are broadcast as longs and only up to `broadcast_rows` of
them, which is counted; beyond that the same joins go by shuffle.

Defined results: a null or empty text, or one without words, has no words, no hits and no items; an item without words has
no window; repeated items (one id or several) and repeated documents are answered each by itself; null ids stay (a null item
id is counted as the text `null`); other columns are left behind; empty tables give empty tables or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WINDOW = 13
SHINGLE = 3
BROADCAST_ROWS = 500_000
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z in lower case; runs of digits, a-z and characters beyond ASCII."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, SMALL), MARKS, -1), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Every distinct window with the ids of the items it comes from."""
    found = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.expr(f"sequence(1, greatest(1, size(ws) - {window - 1}))")
    found = found.select("item", "ws", F.explode(starts).alias("start")).select("item", F.expr(f"slice(ws, start, {window})").alias("window"))
    return found.groupBy("window").agg(F.collect_set("item").alias("items"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _shingles(words_col: str, sizes: list[int]) -> Column:
    """Structs of place, size and hash of every shingle of these sizes."""

    def of(size: int) -> str:
        parts = ", ".join(f"{words_col}[i + {k}]" for k in range(size))
        every = f"transform(sequence(0, size({words_col}) - {size}), i -> struct(i AS place, {size} AS size, xxhash64({size}, {parts}) AS shingle))"
        return f"CASE WHEN size({words_col}) >= {size} THEN {every} ELSE array() END"

    return F.expr(f"concat({', '.join(map(of, sizes))})" if len(sizes) > 1 else of(sizes[0]))


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: its id, the columns in `keep`, `n_words`, `spans` (the windows' places and lengths), `n_hit` and `items`."""
    kept = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.monotonically_increasing_id().alias("_row"), words(F.col(text_col)).alias("_words"))
    kept = written(kept.withColumn("n_words", F.size("_words").cast("long")), "words")
    windows = item_windows(items, item_col, item_text_col, window).withColumn("len", F.size("window"))
    windows = written(windows.select(F.monotonically_increasing_id().alias("number"), "window", "items", "len"), "windows")

    # Of each window the shingles of its own size: three words, or all of a window of fewer.
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    own = windows.select("number", "len", F.explode(_shingles("window", sizes)).alias("s")).where(f"s.size = least(len, {SHINGLE})")
    own = own.select("number", "len", F.col("s.place").alias("at"), "s.shingle")
    here = kept.select("_row", "n_words", F.explode(_shingles("_words", sizes)).alias("s")).select("_row", "n_words", "s.place", "s.shingle")
    here = written(here.join(_small(own.select("shingle").distinct(), broadcast_rows), "shingle", "left_semi"), "shingles")

    # Rarity over all documents; each window's rarest shingle.
    counts = here.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "shingle", "left").groupBy("number", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("rare"))
    prefix = rarest.where("rare.n > 0").select("number", "len", "rare.shingle", "rare.at")

    # Candidates by the prefix; then the bounds; then the words themselves.
    found = here.join(prefix, "shingle").select("_row", "n_words", "number", "len", (F.col("place") - F.col("at")).alias("start"))
    found = written(found.where("start >= 0 AND start + len <= n_words").select("_row", "number", "start"), "candidates")
    texts = kept.select("_row", "_words").join(_small(found.select("_row").distinct(), broadcast_rows), "_row", "left_semi")
    held = texts.join(found.groupBy("_row").agg(F.collect_list(F.struct("number", "start")).alias("c")), "_row")
    held = held.select("_row", F.explode(F.expr("transform(c, x -> struct(x.number, x.start, slice(_words, x.start + 1, WIDTH) AS ws))".replace("WIDTH", str(window)))).alias("c"))
    hits = held.select("_row", "c.*").join(windows, "number").where("slice(ws, 1, len) = window")
    hits = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.withColumn("n_hit", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))").cast("long"))

    out = kept.select(id_col, *keep, "_row", "n_words").join(hits, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(id_col, *keep, "n_words", "spans", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def contaminated() -> Column:
    """A twentieth of a document's words is hit, or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
