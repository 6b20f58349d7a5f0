"""Benchmark decontamination: a hash set of the benchmark's 13-word windows against every window of the text.

Only DataFrame functions are used. Words are runs of ASCII letters, digits and non-ASCII
characters, A-Z lower-cased. Each item gives its windows of 13 words; an item of 1 to 12 words is
one window. The distinct windows are counted first: up to ``BROADCAST_WINDOWS`` (some 100 MB) the
set is broadcast and the text isn't shuffled; beyond, windows and text are joined by a shuffle on
the hash. A hash match is verified on the words themselves.

Null and empty texts have no words and no hits. Each row is judged by itself: a row is known by
a digest of its id and text, so rows without an id, and rows that repeat an id with another text, don't
share hits or verdicts. Null and wordless items give no window; items that repeat an id unite. Empty tables
give no rows or no hits. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

WINDOW = 13
BROADCAST_WINDOWS = 1_000_000
SALTS = 16
#: A document is contaminated if at least one word in so many is hit.
ONE_WORD_IN = 20

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; A-Z is lower-cased when the whole text is cut, as no separator is a letter."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, size, hash, window``: one row for each distinct window of each item."""
    cut = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = cut.select("item", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("size"))
    at = cut.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    window = F.slice("w", F.col("at"), F.col("size"))
    return at.select("item", "size", F.xxhash64(window).alias("hash"), F.array_join(window, " ").alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, at, size, window``: where the documents' words equal a window (``at`` counts words from 0)."""
    known = materialise(windows.select("size", "hash", "window").distinct())
    n = known.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()  # 13 sizes at most
    side = F.broadcast(known) if n[0] <= BROADCAST_WINDOWS else known.hint("merge")
    sizes = F.array(*map(F.lit, n[1])).cast("array<int>")
    cut = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # One pass for all sizes: a row for each size that the text is long enough for, then one for each place.
    cut = cut.select("id", "w", F.explode(F.filter(sizes, lambda k: k <= F.size("w"))).alias("size"))
    at = cut.select("id", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    at = at.select("id", "at", "size", F.slice("w", F.col("at") + 1, F.col("size")).alias("part"))
    at = at.select("id", "at", "size", "part", F.xxhash64("part").alias("hash"))
    return at.join(side, ["size", "hash"]).where(F.array_join("part", " ") == F.col("window")).select("id", "at", "size", "window")


def _row(id_col: str, text_col: str) -> Column:
    """What tells a row from others with another id or text."""
    text = lambda c, none: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(none))
    return F.sha2(F.concat(text(id_col, "-"), F.lit(" "), text(text_col, "")), 256)


def _found(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """``id, n_hit, n_items, items`` of the rows (``id, text``) that have a hit."""
    windows = benchmark_windows(items, item_col, item_text_col)
    hits = materialise(window_hits(docs, windows, "id", "text"))
    spot = hits.select("id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    n_hit = spot.groupBy("id").agg(F.count("*").alias("n_hit"))
    # A window that many documents share is dealt out over SALTS keys before the join with its items.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    items_of = windows.select("window", F.col("item").cast("string").alias("item")).distinct().select("*", salts)
    held = hits.select("id", "window").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    named = held.join(items_of, ["window", "salt"]).select("id", "item").distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count("item").alias("n_items"))
    return n_hit.join(named, "id")


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Add the counts, ``items`` and ``contaminated`` to rows with ``_row, n_words``."""
    out = rows.join(found, F.col("_row") == F.col("id"), "left").drop("id")
    for c, none in (("n_hit", F.lit(0)), ("n_items", F.lit(0)), ("items", F.lit(""))):
        out = out.withColumn(c, F.coalesce(c, none))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_WORD_IN * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id, n_words, n_hit, n_items, items`` (sorted, comma-joined) and ``contaminated``."""
    row = _row(id_col, text_col)
    found = _found(docs.select(row.alias("id"), F.col(f"`{text_col}`").alias("text")), items, item_col, item_text_col)
    sizes = docs.select(F.col(f"`{id_col}`").alias("_id"), row.alias("_row"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    return _judged(sizes, found).select(F.col("_id").alias("id"), "n_words", "n_hit", "n_items", "items", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Remove the contaminated rows; the others stay as they are."""
    own, row = unused("_row", docs.columns), _row(id_col, text_col)
    text = F.col(f"`{text_col}`").alias("text")
    found = _found(docs.select(row.alias("id"), text), items, item_col, item_text_col)
    sizes = docs.select(row.alias("_row"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    bad = _judged(sizes, found).where("contaminated").select(F.col("_row").alias(own)).distinct()
    return docs.join(bad, row == F.col(own), "left_anti")
