"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ten consecutive words. Each side keeps, of every window's six 5-gram hashes, the smallest; equal windows
keep equal hashes, so joining these fingerprints finds every document with a shared window. The hits are then extended
to all windows around them, and those are compared as text, so hash collisions change nothing.

Edge cases: null or empty texts have no words and are clean; items of fewer than ten words are one window of their own
length; items without words and rows with a null item_id never match; repeated rows with one doc_id share its decision;
documents with a null doc_id come back as clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, words

WINDOW, GRAM = 10, 5


def _grams(hashes: Column, k: int) -> Column:
    at = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, id_col: str) -> DataFrame:
    df = df.select(id_col, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    return df.select(id_col, "h", _grams(F.col("h"), GRAM).alias("g"))


def _fingerprints(hashed: DataFrame, id_col: str, short: list[int]) -> DataFrame:
    """Distinct winnowed hashes of each text, and its n-gram hashes for the lengths of short items; null for a text without any.

    `explode_outer`, because for `explode` the optimiser adds a filter on the array's size and pushes it below the hashes,
    whose expressions it then nests: work that grows with the square of a text's length.
    """
    span = WINDOW - GRAM + 1
    least = lambda i: F.least(*[F.get("g", i + j) for j in range(span)])
    mins = F.when(F.size("g") >= span, F.transform(F.sequence(F.lit(0), F.size("g") - span), least)).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(id_col, F.explode_outer(F.array_distinct(F.concat(mins, *[_grams(F.col("h"), m) for m in short]))).alias("fp"))


def _spans(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, start, n, span) for the listed starts of each text."""
    span = lambda s: F.struct(s.alias("start"), F.when(F.size("words") >= s + n, F.concat_ws(" ", F.slice("words", s + 1, n))).alias("span"))
    return df.select(id_col, F.explode(F.transform("starts", span)).alias("x")).select(id_col, "x.start", F.lit(n).alias("n"), "x.span").where("span is not null")


def _all_starts(n: int) -> Column:
    return F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Returns (occurrences, items): (id, start, n) of every occurrence, and the distinct (id, item)."""
    bench = cut(benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).where("item is not null and size(words) > 0").distinct(), "bench")
    short = sorted(r[0] for r in bench.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most nine lengths
    long = bench.where(F.size("words") >= WINDOW)
    winnowed = _fingerprints(_hashed(long, "item"), "item", []).select("fp").distinct()
    exact = bench.where(F.size("words") < WINDOW).select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("fp"), "item").limit(0).select("fp")
    for m in short:
        exact = exact.union(bench.where(F.size("words") == m).select(F.explode(_grams(F.transform("words", lambda w: F.xxhash64(w)), m)).alias("fp")))
    winnowed, exact = cut(winnowed, "winnowed"), cut(exact.distinct(), "short")
    windows = _spans(long.withColumn("starts", _all_starts(WINDOW)), "item", WINDOW)
    for m in short:
        windows = windows.union(_spans(bench.where(F.size("words") == m).withColumn("starts", F.array(F.lit(0))), "item", m))
    windows = cut(windows.select("span", "n", "item").distinct(), "windows")

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    tokens = lambda d: d.select("id", words(F.col("text")).alias("words"))
    found = _fingerprints(_hashed(tokens(base), "id"), "id", short).join(winnowed.union(exact).distinct() if short else winnowed, "fp", "left_semi").select("id").distinct()
    found = cut(found, "found")  # its size is known then: few ids are broadcast, and no text is shuffled
    near = cut(tokens(base.join(found, "id", "left_semi")), "near")

    hits = _hashed(near, "id").select("id", F.size("h").alias("len"), F.posexplode_outer("g").alias("pos", "fp")).join(winnowed, "fp", "left_semi")
    starts = hits.where(F.col("len") >= WINDOW).select("id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (WINDOW - GRAM)), F.least(F.col("pos"), F.col("len") - WINDOW))).alias("start"))
    spans = _spans(near.join(starts.groupBy("id").agg(F.collect_set("start").alias("starts")), "id"), "id", WINDOW)
    for m in short:
        at = _hashed(near, "id").select("id", "h").select("id", F.posexplode_outer(_grams(F.col("h"), m)).alias("start", "fp")).join(exact, "fp", "left_semi")
        spans = spans.union(_spans(near.join(at.groupBy("id").agg(F.collect_set("start").alias("starts")), "id"), "id", m))
    texts = windows.select("span", "n").distinct()
    occurrences = cut(spans.join(texts, ["span", "n"], "left_semi").distinct(), "occurrences")
    items = occurrences.select("id", "span", "n").distinct().join(windows, ["span", "n"]).select("id", "item").distinct()
    return occurrences.select("id", "start", "n"), items


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    occurrences, items = decontaminate(docs, benchmark)
    covered = F.array_distinct(F.flatten(F.transform("at", lambda o: F.sequence(o["start"], o["start"] + o["n"] - 1))))
    hit = occurrences.groupBy("id").agg(F.collect_set(F.struct("start", "n")).alias("at")).select("id", F.size(covered).cast("bigint").alias("n_hit"))
    named = items.groupBy("id").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("names"))
    named = named.select("id", F.size("names").cast("bigint").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    facts = cut(hit.join(named, "id"), "contaminated").withColumnRenamed("id", "doc_id")
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return counted.join(facts, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
