"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, and a window is the set of its
shingles with their places.  A text can only hold a window if it holds every one of
its shingles, so one necessary shingle, the rarest in the corpus, is joined to the text
first (containment 1 leaves a prefix of one).  Its place gives where the window would
start; starts before the text or ends beyond it are ruled out, and the remaining
candidates are verified shingle by shingle at their places, over the window's words.

Texts are read in place and never shuffled: what leaves a task are the shingles that
some item has, as (document, place, shingle).  Only DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import whole_text
from riskframe.operators.ordered import materialize

#: Fixed value: what lies between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a window, and in a shingle.
WINDOW, SHINGLE = 10, 3
#: Item shingles up to this count are sent to all tasks; beyond it they are shuffled.
BROADCAST_SHINGLES = 500_000

WORDS = "array<string>"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BETWEEN), "")


def _shingles(list_col: str, size: int) -> Column:
    """Rows (w0, w1, ...) of consecutive words; the last ones have nulls behind them."""
    n = F.size(list_col)
    return F.arrays_zip(*[F.slice(list_col, i + 1, n).alias(f"w{i}") for i in range(size)])


def _joined(row: str, size: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"{row}.w{i}") for i in range(size)])


def windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, their shingles, their items): distinct windows ``wid, length, size``,
    rows ``wid, size, place, shingle`` and rows ``wid, item``."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(whole_text(text_col)).alias("w"))
    rows = rows.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = rows.select("item", "w", F.explode(starts).alias("s"))
    cut = materialize(cut.select("item", F.array_join(F.slice("w", F.col("s"), window), " ").alias("text")).distinct())
    kinds = materialize(cut.select("text").distinct().withColumn("wid", F.monotonically_increasing_id()))
    kinds = kinds.withColumn("w", F.split("text", " ")).withColumn("length", F.size("w")).withColumn("size", F.least(F.size("w"), F.lit(shingle)))
    places = F.posexplode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1))
    parts = kinds.select("wid", "w", "size", places.alias("place", "at"))
    parts = parts.select("wid", "size", "place", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("shingle"))
    return kinds.select("wid", "length", "size"), parts, cut.join(kinds.select("text", "wid"), "text").select("wid", "item")


def matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """(id, th, n_words, pos, sid): where texts have shingles of items, once each.
    ``few``: the shingles may be sent to all tasks."""
    found = None
    for size in sizes:
        # Only narrow columns go along with each exploded row.  An outer explode infers no
        # filter on the array's size, which would split each text once more.
        rows = docs.select("id", "th", F.coalesce(F.size("w"), F.lit(0)).alias("n_words"), _shingles("w", size).alias("part"))
        rows = rows.select("id", "th", "n_words", F.posexplode_outer("part").alias("pos", "row"))
        rows = rows.where(F.col("pos") <= F.col("n_words") - size)
        rows = rows.withColumn("h", F.xxhash64(*[F.col(f"row.w{i}") for i in range(size)]))
        of_size = shingles.where(F.col("size") == size).select("sid", "h", "shingle")
        of_size = F.broadcast(of_size) if few else of_size
        # Texts are compared where hashes meet, not for every row as a join key would be.
        same = F.nullif(_joined("row", size), F.col("shingle")).isNull()
        hit = rows.join(of_size, "h").where(same).select("id", "th", "n_words", "pos", "sid")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def occurrences(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES,
) -> tuple[DataFrame, DataFrame]:
    """(occurrences, items of windows).  An occurrence is ``id, th, start, length, wid``: the
    document's words from ``start`` (0-based) are the window ``wid``; ``th`` hashes the text,
    so that rows which repeat an id with another text stay apart."""
    cut, parts, of_items = windows(items, item_col, item_text_col, window, shingle)
    hashed = F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(i)) for i in range(shingle)])
    kinds = parts.select("size", "shingle").distinct()
    # A short shingle has fewer columns, and a null adds nothing to the hash.
    kinds = materialize(kinds.select(F.monotonically_increasing_id().alias("sid"), "size", "shingle", hashed.alias("h")))
    sizes = [r["size"] for r in kinds.select("size").distinct().orderBy("size").collect()]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    if not sizes:
        none = F.lit(0)
        return rows.select("id", "th", none.alias("start"), none.alias("length"), none.cast("long").alias("wid")).where(F.lit(False)), of_items
    few = kinds.count() <= broadcast_shingles
    parts = parts.join(kinds.drop("h"), ["size", "shingle"]).select("wid", "place", "sid")

    found = materialize(matches(rows, kinds, sizes, few))

    # Rarity order: a window whose rarest shingle occurs nowhere can't occur.
    seen = found.groupBy("sid").agg(F.count("*").alias("times"))
    rare = parts.join(seen, "sid", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), F.col("place"), F.col("sid"))).alias("first"), F.count("*").alias("n_parts"))
    prefix = rare.where("first.times > 0").join(cut.select("wid", "length"), "wid")
    prefix = prefix.select(F.col("first.sid").alias("sid"), F.col("first.place").alias("place"), "wid", "length", "n_parts")
    start = F.col("pos") - F.col("place")
    within = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    candidates = found.join(prefix, "sid").where(within).select("id", "th", start.alias("start"), "length", "wid", "n_parts")

    wanted = candidates.join(parts, "wid").select("*", (F.col("start") + F.col("place")).alias("pos"))
    same = [wanted[c].eqNullSafe(found[c]) for c in ("id", "th", "pos", "sid")]
    verified = wanted.join(found, same[0] & same[1] & same[2] & same[3], "left_semi")
    verified = verified.groupBy("id", "th", "start", "length", "wid").agg(F.count("*").alias("n"), F.max("n_parts").alias("n_parts"))
    return verified.where("n = n_parts").drop("n", "n_parts"), of_items


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window) and ``items``: the ids, as text and in byte order, of items with an occurring window.

    A null text has no words, an empty one neither; texts and items of any length are read
    whole.  An item of fewer than ``window`` words, but not none, is one window.  Windows
    that several items share are searched once; equal item ids count once; a null item id
    reads as ''.  Rows that repeat an id and text each get the same result.  An empty
    table of documents gives an empty result, one of items leaves all words clean.
    Other columns are ignored."""
    found, of_items = occurrences(docs, items, id_col, text_col, item_col, item_text_col, window, shingle, broadcast_shingles)
    found = materialize(found)
    # Words covered: of each start the longest window counts what no earlier one has reached.
    doc = Window.partitionBy("id", "th").orderBy("start")
    reach = F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    per_start = found.groupBy("id", "th", "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    new = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce("reach", F.lit(0))), F.lit(0))
    hit = per_start.withColumn("reach", reach).groupBy("id", "th").agg(F.sum(new).alias("n_hit"))
    held = found.join(of_items, "wid").select("id", "th", "item").distinct()
    held = held.groupBy("id", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.size(words(whole_text(text_col))).cast("long").alias("n_words"))
    for result in (hit, held):
        result = result.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), result.columns[-1])
        rows = rows.join(result, rows["id"].eqNullSafe(result["r_id"]) & (rows["th"] == result["r_th"]), "left").drop("r_id", "r_th")
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr(f"cast(array() as {WORDS})")).alias("items"))
