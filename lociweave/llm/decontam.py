"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents, in DataFrame functions only.

An item's windows are its runs of `window` words (an item of fewer words is one window). Words are ordered by how
often they occur in the documents; a window can only occur where its rarest word, its prefix, does. Documents' words
are joined with the prefixes, cut by length and position (the window must fit around the word), and what is left is
compared word by word with the document. Windows with a word that no document has are dropped at once.

Null texts have no words; repeated rows of documents each give a row; repeated items count once; items whose item_id
is null make words hit but are not named; empty tables give empty results or no hits; columns beyond those named are
ignored. The prefix table is broadcast only if it has at most `broadcast_rows` rows; larger ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import materialize

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of at most `window` short words each: some 20 MB at most.
BROADCAST_ROWS = 60_000
#: Stands behind each document's words, so that every document gives a row; no word has a space.
END = " "


def words(text: str) -> Column:
    """The words of a text column; only A-Z are lower-cased."""
    col = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))
    return F.array_remove(F.split(lowered, GAPS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, window_id, and the window's words."""
    own = items.select(F.col("item_id").cast("string").alias("item"), F.xxhash64("item_id", "text").alias("version"), words("text").alias("w")).distinct()
    own = own.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = own.select("item", "version", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("s"))
    return starts.select("item", F.struct("item", "version", "s").alias("window_id"), F.slice("w", F.col("s") + 1, F.col("n")).alias("window"))


def prefixes(windows: DataFrame, docs: DataFrame, broadcast_rows: int) -> DataFrame:
    """Each window that may occur, with its rarest word and that word's place in it."""
    tokens = windows.select("item", "window_id", "window", F.posexplode("window").alias("place", "word"))
    vocabulary = tokens.select("word").distinct()
    small = vocabulary.count() <= broadcast_rows
    found = docs.select(F.explode(words("text")).alias("word"))
    if small:
        found = found.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    else:
        found = found.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    rarity = tokens.join(found, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rarity.groupBy("window_id").agg(F.min(F.struct("n", "word", "place")).alias("b"), F.first("item").alias("item"), F.first("window").alias("window"))
    return best.where("b.n > 0").select("item", "window", F.col("b.word").alias("word"), F.col("b.place").alias("place"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = materialize(item_windows(items, window), "windows")
    table = materialize(prefixes(windows, docs, broadcast_rows), "prefixes")
    end = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("item"), F.array(F.lit(END)).alias("window"), F.lit(END).alias("word"), F.lit(0).alias("place"))
    table = table.unionByName(end)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("mark"), words("text").alias("w"))
    keyed = keyed.select("doc_id", "mark", F.array_append("w", END).alias("w"))
    n = F.size("window")
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + n <= F.size("w"))
    if table.count() <= broadcast_rows:
        at = keyed.select("doc_id", "mark", "w", F.posexplode("w").alias("at", "word"))
        hits = at.join(F.broadcast(table), "word").where(fits)
        hits = hits.where(F.slice("w", start + 1, n) == F.col("window"))
    else:
        at = keyed.select("doc_id", "mark", F.size("w").alias("size"), F.posexplode("w").alias("at", "word"))
        near = at.join(table, "word").where((start >= 0) & (start + n <= F.col("size"))).drop("word", "size")
        hits = near.join(keyed.dropDuplicates(["doc_id", "mark"]).withColumnsRenamed({"doc_id": "d", "mark": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
        hits = hits.where(F.slice("w", start + 1, n) == F.col("window"))
    is_end = F.element_at("window", 1) == END
    rows = hits.select("doc_id", "mark", start.alias("start"), n.alias("n"), "item", is_end.alias("is_end"))
    spans = F.collect_set(F.when(~F.col("is_end"), F.struct("start", "n")))
    grouped = rows.groupBy("doc_id", "mark").agg(spans.alias("spans"), F.collect_set("item").alias("items"), F.max(F.when(F.col("is_end"), F.col("start"))).alias("n_words"), F.count_if("is_end").alias("times"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    out = grouped.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one"),
    )
    return out.drop("one")


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs.

    Rows are known by their doc_id and text, null or not: repeated rows go or stay together, null and empty texts stay.
    """
    found = decontaminate(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), items, window)
    key = next(f"key{k}" for k in range(len(docs.columns) + 1) if f"key{k}" not in docs.columns)
    hit = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(hit, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
