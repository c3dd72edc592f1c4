"""Benchmark decontamination: DataFrame functions only.

The distinct word windows of the benchmark are a broadcast hash set. A window hangs
under its longest word, its anchor, which is rare in most texts: a document word that
is no anchor costs one lookup, and only where an anchor stands is the window around it
built and compared with the benchmark's, word by word. One pass over the documents
finds the hits; what is then grouped by document are the hits and one row of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.staging import ascii_lower, carried, staged, text_or_empty, unpacked

WINDOW = 13
BROADCAST_WINDOWS = 500_000  # about 100 bytes each
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # digits, a-z and all beyond ASCII
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words joined by a space, anchor, its place, size, item ids.

    Items of fewer words than ``window``, but not none, are one window.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("w"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return (
        each.groupBy("w")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("anchor", longest)
        .select(
            "anchor",
            (F.array_position("w", F.col("anchor")) - 1).cast("int").alias("place"),
            F.size("w").alias("size"),
            F.concat_ws(" ", "w").alias("window_text"),
            "items",
        )
    )


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row with n_words per document, and one per occurrence of a window."""
    keyed = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_text"),
        words_of(F.col("text")).alias("w"),
    )
    # Element 0 stands for the document itself, so that it is kept without any hit.
    each = keyed.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    start = (F.col("pos") - F.col("place")).alias("start")
    met = each.join(F.broadcast(windows), F.col("word") == F.col("anchor"), "left").filter(
        "pos = 0 or (anchor is not null and pos > place and pos - place + size - 1 <= size(w))"
    )
    same = F.concat_ws(" ", F.slice("w", F.greatest(start, F.lit(1)), F.greatest("size", F.lit(0)))) == F.col("window_text")
    return met.filter((F.col("pos") == 0) | same).select(
        "doc_id",
        "_text",
        F.when(F.col("pos") == 0, F.size("w")).alias("n_words"),
        F.when(F.col("pos") > 0, F.struct(start, "size")).alias("hit"),
        F.when(F.col("pos") > 0, F.col("items")).alias("items"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted), hits, contaminated.

    A document word inside any occurrence of a window is hit; hits are the occurrences,
    (start, size), start from 1. Contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Null text has no words. Null doc_ids are kept. Rows with the same doc_id and text
    give one result row each. A null item_id counts in n_hit but is no item. Either
    table may be empty, and other columns are ignored. A benchmark with more windows
    than ``BROADCAST_WINDOWS`` is taken in blocks of that size, one pass each.
    """
    windows = staged(benchmark_windows(benchmark, window), "windows")
    blocks = max(1, -(-windows.count() // BROADCAST_WINDOWS))
    rows = None
    for b in range(blocks):
        block = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window_text"), F.lit(blocks)) == b)
        found = _hits(docs, block) if b == 0 else _hits(docs, block).filter("hit is not null")
        rows = found if rows is None else rows.unionByName(found)
    # Occurrences sorted by start; (end, covered) goes over them.
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["size"] - 1).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - 1 - F.greatest(a["end"], h["start"] - 1))).alias("n"),
        ),
    )["n"]
    return (
        rows.groupBy("doc_id", "_text")
        .agg(
            F.max("n_words").cast("bigint").alias("n_words"),
            F.count("n_words").alias("_copies"),
            F.collect_set("hit").alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
        )
        .withColumn("n_hit", covered.cast("bigint"))
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select("doc_id", "n_words", "n_hit", "item_ids", "hits", "contaminated", "_text")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark holds; same columns.

    mode "documents" leaves out contaminated documents. mode "spans" keeps every
    document and takes its hit words out, each with the characters up to the next word.
    """
    found = find_contamination(docs, benchmark, window).withColumnsRenamed({"doc_id": "__found", "_text": "__found_text"})
    rows = carried(docs)
    same_row = F.col("__id").eqNullSafe(F.col("__found")) & (F.col("__text") == F.col("__found_text"))
    if mode == "documents":
        bad = found.filter("contaminated").select("__found", "__found_text").distinct()
        return unpacked(rows.join(bad, same_row, "left_anti"), docs)
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    hit = found.filter("n_hit > 0").select("__found", "__found_text", "hits").dropDuplicates(["__found", "__found_text"])
    text = F.col("__row.text")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    parts = rows.join(hit, same_row, "left").withColumns({
        "__words": F.regexp_extract_all(text, F.lit(_WORD_ANY_CASE), F.lit(0)),
        "__gaps": F.split(text, _WORD_ANY_CASE, -1),
        "__places": places,
    })
    kept = F.transform(
        "__words", lambda w, i: F.when(F.array_contains("__places", i + 1), "").otherwise(F.concat(w, F.get("__gaps", i + 1)))
    )
    cleaned = F.concat(F.get("__gaps", F.lit(0)), F.array_join(kept, ""))
    return unpacked(parts, docs, text=F.when(F.col("hits").isNull(), text).otherwise(cleaned))
