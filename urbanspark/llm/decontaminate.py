"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words,
but not none, is one window. Words are runs of digits, a-z and non-ASCII characters
after A-Z are lower-cased. For containment of a whole window every one of its words is
necessary, so its prefix is one word: the window's rarest in the corpus, counted over all
documents. Document words are joined with those rarest words only; the place of the word
in its window and both text ends bound where the window could lie, the second rarest word
must stand at its own place, and then all words there are compared with the window's.

While the windows are few enough to be broadcast, a text's words stay beside each of its
places through the join, so a place is verified where it is met and only true hits leave
the task. More windows are joined by shuffle: places first, then the texts of the places
that are left.

Rows: one for each row of the documents, judged by (id, hash of the text), so rows with a
null or repeated id keep hits of their own. Null and empty texts have no words and no
hits. Repeated items count once by item_id; an item without words or with null text is
never found; a null item_id counts as one item and adds nothing to the digest. An empty
benchmark leaves every document clean, an empty documents table gives an empty result.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.session import broadcast_if_small, checkpointed, is_small
from urbanspark.llm import rowkeys

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to this many are broadcast (about 500 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """The words, found by splitting: extraction by pattern copies the text once a word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Plain lower() is the same, and faster, where every character is ASCII.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.array_remove(F.split(low, GAP), "")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, win), win the words of one window."""
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("s")
    return words.select("item_id", "w", size.alias("n"), starts).select("item_id", F.slice("w", F.col("s"), F.col("n")).alias("win")).distinct()


def _anchored(docs: DataFrame, windows: DataFrame, bound: int) -> DataFrame:
    """Each window with its rarest word and that word's place, counted from 0, and its second rarest."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    # explode_outer, as for explode a filter on the array's size is added below, which finds all words twice.
    seen = docs.select(F.explode_outer(words_of(F.col("text"))).alias("word"))
    rarity = checkpointed(seen.join(broadcast_if_small(vocabulary, 5 * bound), "word").groupBy("word").agg(F.count("*").alias("f")))
    placed = windows.select("item_id", "win", F.posexplode("win").alias("off", "word"))
    # A window with a word that no document has is found nowhere.
    found = placed.join(broadcast_if_small(rarity, 5 * bound), "word", "left").select("item_id", "win", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word", "off").alias("r"))
    ranked = found.groupBy("item_id", "win").agg(F.array_sort(F.collect_list("r")).alias("r")).where("r[0].f > 0")
    second = F.coalesce(F.get("r", 1), F.get("r", 0))
    return ranked.select("item_id", "win", F.col("r")[0]["word"].alias("word"), F.col("r")[0]["off"].alias("off"), second["word"].alias("word2"), second["off"].alias("off2"))


def hits(rows: DataFrame, items: DataFrame, *, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key, start, size, item_id): every occurrence of a window in the keyed ``rows``, start from 0."""
    windows = checkpointed(windows_of(items, window))
    anchored = checkpointed(_anchored(rows, windows, broadcast_windows))
    small = is_small(anchored, broadcast_windows)

    texts = rows.select(F.col(rowkeys.KEY).alias("key"), words_of(F.col("text")).alias("w"))
    start, size = F.col("p") - F.col("off"), F.size("win")
    inside = (start >= 0) & (start + size <= F.col("n"))
    stands = (F.get("w", start + F.col("off2")) == F.col("word2")) & (F.slice("w", start + 1, size) == F.col("win"))
    if small:
        placed = texts.select("key", "w", F.size("w").alias("n"), F.posexplode_outer("w").alias("p", "word"))
        true = placed.join(F.broadcast(anchored), "word").where(inside & stands)
    else:
        placed = texts.select("key", F.size("w").alias("n"), F.posexplode_outer("w").alias("p", "word"))
        met = placed.join(anchored, "word").where(inside).drop("word")
        again = rows.select(F.col(rowkeys.KEY).alias("key"), "text").dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("w"))
        # Key fields are never null here but for the id, which a null-safe comparison meets.
        true = met.withColumnRenamed("key", "__k").join(again, F.col("__k").eqNullSafe(F.col("key"))).where(stands)
    return checkpointed(true.select("key", start.alias("start"), size.alias("size"), "item_id").distinct())


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    rows = rowkeys.keyed(docs)
    found = hits(rows, items, window=window, broadcast_windows=broadcast_windows)
    covered = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    ids = F.col("item_id").cast("string").alias("i")
    named = found.select("key", ids).distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("ids"))
    named = named.withColumnRenamed("key", "__named")
    per_key = checkpointed(covered.join(named, covered["key"].eqNullSafe(named["__named"])).select(F.col("key").alias("__hit"), "n_hit", "n_items", "ids"))
    counted = rows.select("doc_id", rowkeys.KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(broadcast_if_small(per_key, BROADCAST_WINDOWS), counted[rowkeys.KEY].eqNullSafe(per_key["__hit"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_words", count("n_hit"), count("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


@rowkeys.apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go; the rest stay with all their columns.

    Rows are judged by (doc_id, hash of the text), so a null or repeated id takes no other
    text with it. Null, empty and blank texts stay. An empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = rowkeys.keyed(docs)
    return rowkeys.without(rows, hits(rows, items).select("key")).select(*docs.columns)
