"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `window` consecutive words. Each document keeps, for every window, the smallest of the hashes of the
k-grams in it (the leftmost of equal ones), so a document and a benchmark item that share a window share a kept
fingerprint: with w = window - k + 1 hashes a window, every shared span of w + k - 1 = window words is found. Matches of
fingerprints say which documents can have a window at all; in these alone, the words around each match are taken, and all
windows over them are compared word by word. Items of fewer words than a window are looked for in the documents that
have one of their first words.

Defined results: a null or wordless text has no words and no hits; an item of fewer than `window` words is one window of
its own length; null or wordless items match nothing; equal items all count; repeated rows each get their row; empty
tables give empty or all-clean results; null ids are ids like others; texts of any length are read whole. Only the named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, few, materialize, rows_with_key

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is the upper part of a long, its place in the text the lower part.
PLACE_BITS = 31
HASH_MASK = (1 << (63 - PLACE_BITS)) - 1
PLACE_MASK = (1 << PLACE_BITS) - 1
#: Windows of the benchmark up to which they are broadcast (some 100 bytes each); beyond it the joins shuffle.
BROADCAST_WINDOWS = 200_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_BREAK), "")


def _places(n: Column, length: int) -> Column:
    """0 .. n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def fingerprints(ws: Column, window: int, k: int) -> Column:
    """Kept fingerprints of an array of words: fingerprint << PLACE_BITS | place, each once."""
    hashed = lambda w: F.transform(_places(F.size(w), k), lambda i: F.shiftleft(F.xxhash64(F.slice(w, i + 1, k)).bitwiseAND(HASH_MASK), PLACE_BITS).bitwiseOR(i.cast("long")))
    return let(hashed(ws), lambda h: F.array_distinct(F.transform(_places(F.size(h), window - k + 1), lambda i: F.array_min(F.slice(h, i + 1, window - k + 1)))))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (win) of the items, with the ids (as strings) of the items that have them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws"))
    wins = let(F.col("ws"), lambda w: F.when(F.size(w) >= window, F.transform(_places(F.size(w), window), lambda i: F.slice(w, i + 1, window))).otherwise(F.array(w)))
    return items.filter(F.size("ws") > 0).select("item", F.explode(wins).alias("win")).groupBy("win").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))


def _hits(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, k: int, broadcast_windows: int) -> DataFrame | None:
    """(id, text_key, at, n, items) for each window of a document that is one of the benchmark; None without windows."""
    wins = materialize(benchmark_windows(benchmark, item_col, item_text, window), "benchmark-windows")
    sizes = {r["n"]: r["count"] for r in wins.groupBy(F.size("win").alias("n")).count().collect()}
    small = sum(sizes.values()) <= broadcast_windows
    near = F.broadcast if small else (lambda df: df)
    kept = wins.filter(F.size("win") == window).select(F.explode(fingerprints(F.col("win"), window, k)).alias("f")).select(F.shiftright("f", PLACE_BITS).alias("fp")).distinct()
    firsts = wins.filter(F.size("win") < window).select(F.xxhash64(F.col("win")[0]).alias("fp")).distinct()
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("ws"))
    # which documents can have a window: their fingerprints (or words) alone are joined
    asked = []
    if window in sizes:
        asked.append(docs.select("id", "text_key", F.explode(fingerprints(F.col("ws"), window, k)).alias("f")).select("id", "text_key", F.shiftright("f", PLACE_BITS).alias("fp")).join(near(kept), "fp"))
    if any(n < window for n in sizes):
        asked.append(docs.select("id", "text_key", F.explode(F.array_distinct("ws")).alias("w")).select("id", "text_key", F.xxhash64("w").alias("fp")).join(near(firsts), "fp"))
    if not asked:
        return None
    some = asked[0].select("id", "text_key")
    for more in asked[1:]:
        some = some.unionByName(more.select("id", "text_key"))
    some = materialize(some.distinct(), "benchmark-candidates")
    docs = docs.join(few(some), docs["id"].eqNullSafe(some["id"]) & (docs["text_key"] == some["text_key"]), "left_semi")
    found = []
    if window in sizes:
        before, span = window - k, 2 * window - k
        around = lambda w, f: F.struct(F.shiftright(f, PLACE_BITS).alias("fp"), F.greatest(f.bitwiseAND(PLACE_MASK).cast("int") - before, F.lit(0)).alias("at"), F.slice(w, F.greatest(f.bitwiseAND(PLACE_MASK).cast("int") - before, F.lit(0)) + 1, F.lit(span) - F.greatest(F.lit(before) - f.bitwiseAND(PLACE_MASK).cast("int"), F.lit(0))).alias("ctx"))
        hits = docs.select("id", "text_key", F.explode(let(F.col("ws"), lambda w: F.transform(fingerprints(w, window, k), lambda f: around(w, f)))).alias("m")).select("id", "text_key", "m.*")
        hits = hits.join(near(kept), "fp")
        spread = F.explode(F.transform(_places(F.size("ctx"), window), lambda i: F.struct((F.col("at") + i).alias("at"), F.slice("ctx", i + 1, window).alias("win"))))
        found.append(hits.select("id", "text_key", spread.alias("m")).select("id", "text_key", "m.*"))
    for n in sorted(x for x in sizes if x < window):
        all_of = F.explode(let(F.col("ws"), lambda w: F.transform(_places(F.size(w), n), lambda i: F.struct(i.alias("at"), F.slice(w, i + 1, n).alias("win")))))
        found.append(docs.select("id", "text_key", all_of.alias("m")).select("id", "text_key", "m.*"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.join(near(wins), "win").select("id", "text_key", "at", F.size("win").alias("n"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit (words covered by benchmark windows), items (sorted item ids)."""
    rows = _hits(documents, benchmark, id_col, text_col, item_col, item_text, window, k, broadcast_windows)
    base = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if rows is None:
        return base.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    per_doc = rows.groupBy("id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda m: F.sequence(m["at"], m["at"] + m["n"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    per_doc = per_doc.withColumnsRenamed({"id": "hit_id", "text_key": "hit_key"})
    joined = base.join(per_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without a hit, with all their columns. Ids may be null or repeat: the text's hash decides with them."""
    rows = _hits(documents, benchmark, id_col, text_col, item_col, item_text, window, k, broadcast_windows)
    if rows is None:
        return documents
    bad = rows.select("id", "text_key").distinct()
    whole = rows_with_key(documents, id_col, text_col)
    return whole.join(bad, whole["id"].eqNullSafe(bad["id"]) & (whole["text_key"] == bad["text_key"]), "left_anti").select("row.*")
