"""Benchmark decontamination as a prefix-filtered set join of documents with item windows.

Every window of an item is a shingle of consecutive words. Ordered by how rare its words are in the
whole corpus, a window can only occur where its rarest word does: that word is its prefix token.
Document positions join windows on the prefix token; the token's place in the window gives the only
possible start (positional bound), the document's word count bounds it (length bound), and an exact
comparison of the words at that start decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import drop_written, row_key, without_rows, written
from speechframe.llm.words import WordBitmap, words

#: Rows of the window table up to which it is broadcast (some 300 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """The distinct windows of all items: window array<string>, item_ids array<string> (as strings, distinct)."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(size), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def corpus_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the vocabulary (column word) occurs in all documents; 0 where it does not."""
    bitmap = WordBitmap(vocabulary, "word")
    found = docs.select(words(F.col("text")).alias("w")).select(F.explode(F.filter("w", bitmap.has)).alias("word"))
    return vocabulary.join(found.groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_windows(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Each window under its rarest word: word, at (its place in the window), window, item_ids."""
    windows = written(item_windows(items, size), "windows")
    counts = corpus_counts(docs, windows.select(F.explode("window").alias("word")).distinct())
    places = windows.select("window", "item_ids", F.posexplode("window").alias("at", "word"))
    rarest = places.join(counts, "word").groupBy("window").agg(F.min(F.struct("n", "word", "at")).alias("r"), F.first("item_ids").alias("item_ids"))
    out = written(rarest.select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "window", "item_ids"), "prefixes")
    drop_written(windows)
    return out


def _hit_words(spans):
    """Words under the union of (start, end) spans: a fold over the spans in order."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside an occurring window), spans (start, end in words), item_ids.

    An item of fewer than size words, but not none, is one window. Null texts and item texts have no
    words; null item ids mark words but are not listed; repeated item ids count once; repeated
    document rows each get a row; empty tables give no windows or no rows. Other columns are ignored.
    """
    prefixes = prefix_windows(docs, items, size)
    bitmap = WordBitmap(prefixes, "word")
    split = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("w"))
    reach = size - 1
    context = lambda i: F.struct(
        i.alias("at"), F.get("w", i).alias("word"), F.least(i, F.lit(reach)).alias("before"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("around")
    )
    # one row for the document itself, whose word no window has, then one for each place of a prefix token
    itself = F.struct(F.lit(-1).alias("at"), F.concat(F.lit("\0"), F.col("row").cast("string")).alias("word"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("around"))
    places = F.when(F.size("w") > 0, F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: bitmap.has(F.get("w", i)))).otherwise(F.array().cast("array<int>"))
    split = split.withColumn("places", places)
    candidates = split.select("doc_id", "row", F.size("w").alias("n_words"), F.inline(F.concat(F.array(itself), F.transform("places", context))))
    table = prefixes.select("word", F.col("at").alias("in_window"), "window", "item_ids")
    if prefixes.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    start = F.col("at") - F.col("in_window")
    exact = (start >= 0) & (start + F.size("window") <= F.col("n_words")) & (F.slice("around", F.greatest(F.col("before") - F.col("in_window") + 1, F.lit(1)), F.size("window")) == F.col("window"))
    joined = candidates.join(table, "word", "left").where((F.col("at") < 0) | exact)
    span = F.when(F.col("at") >= 0, F.struct(start.alias("start"), (start + F.size("window")).alias("end")))
    grouped = joined.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("at") < 0).cast("int").alias("copies"), F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    out = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), _hit_words(F.col("spans")).alias("n_hit"), F.array_sort("spans").alias("spans"), "item_ids", "row")


def digest(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    found = contamination(docs, items, size)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs without the rows in which a window of an item occurs; all their columns stay."""
    return without_rows(docs, written(contamination(docs, items, size).where("n_hit > 0").select("doc_id", "row"), "contaminated"))
