"""Quality rules with cross-document line frequency: lines that too many documents of a host hold are removed.

One pass over the texts counts words, symbols and repetitions and hashes the normalised lines of each document (ends
stripped, A-Z in lower case, runs of blanks one space, digits 0). The distinct documents of each (host, line) are counted;
lines held by more than `most` documents of their host are removed wherever that host shows them, and a document that then
has less than `share` percent of its words left is rejected as depleted. Lines under `least` characters are never counted.

Counts are combined before the shuffle; the join of a document's lines with the lines over the limit is salted, so that a
line which a third of all documents hold is spread over `SALTS` tasks. Nothing is collected.

Edge cases: a null text has no words and fails the base rules; a null host is a host of its own; rows that repeat a doc_id
are one document of the count, and rows with a null doc_id one for each different text; equal rows get equal verdicts; ids
keep all 64 bits beside nulls; an empty table gives an empty one; other columns stay in `cleaned` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import LOWER, UPPER, cut, fresh

SYMBOLS, BLANKS, SALTS = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
#: A document fails with fewer words, or with more than this percentage of them in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
_FOLD = {ord(c): ord(d) for c, d in zip(UPPER + "123456789", LOWER + "0" * 9, strict=True)}


def normalised(line: str) -> str:
    """The line as it is counted: ASCII blanks are one space each run and none at the ends, A-Z lower case, digits 0."""
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass").translate(_FOLD)


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(found) < WINDOW + 1:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    n = len(known)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]  # of two, then three: exact for any number of words
    _, which, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    hit = np.zeros(len(found), bool)
    for j in range(WINDOW):
        hit[starts + j] = True
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated windows)."""
    text = text or ""
    found = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(found), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(found)


def line_keys(text: str | None, least: int) -> tuple[list[int], list[int]]:
    """Hashes of the distinct normalised lines of `least` characters or more, and the words that the document has in each."""
    held: dict[int, int] = {}
    for line in (text or "").split("\n"):
        key = normalised(line)
        if len(key) >= least:
            h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)
            held[h] = held.get(h, 0) + key.count(" ") + 1
    return list(held), list(held.values())


def mark(id_col: str, host_col: str, text_col: str) -> Column:
    """What tells rows apart: equal marks have equal ids, hosts and texts."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part(id_col), part(host_col), part(text_col)).cast("binary"))


SIGNALS = "doc string, mark string, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, keys array<long>, sizes array<long>"


def _signals(rows: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for start in range(0, len(some), 200):
                part = some.iloc[start : start + 200]
                out = [(d, m, h, *base_counts(t), *line_keys(t, least)) for d, m, h, t in zip(part["doc"], part["mark"], part["host"], part["text"], strict=True)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    return rows.mapInPandas(run, SIGNALS)


def judged(docs: DataFrame, most: int = 10, share: int = 50, least: int = 10, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(verdicts, gone): one row per document with counts and verdict, and the lines (mark, key) that it loses.

    `doc` is the id as a string, null where the id is.
    """
    named = docs.select(F.col(id_col).cast("string").alias("doc"), mark(id_col, host_col, text_col).alias("mark"),
                        F.coalesce(F.concat(F.lit("+"), F.col(host_col).cast("string")), F.lit("-")).alias("host"), F.col(text_col).alias("text"))
    signals = cut(_signals(named, least), "signals")
    zipped = F.explode(F.arrays_zip("keys", "sizes"))
    lines = signals.select("doc", "mark", "host", zipped.alias("l")).select("doc", "mark", "host", F.col("l.keys").alias("key"), F.col("l.sizes").alias("size"))
    held = lines.select("host", "key", F.coalesce(F.concat(F.lit("+"), "doc"), F.col("mark")).alias("doc")).distinct()
    over = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most)
    over = cut(over.select("host", "key"), "over").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int"))
    gone = cut(salted.join(over, ["host", "key", "salt"], "left_semi").select("mark", "key", "size").distinct(), "gone")
    lost = gone.groupBy("mark").agg(F.sum("size").alias("n_removed_words"), F.count(F.lit(1)).alias("n_removed_lines"))
    out = signals.drop("keys", "sizes", "host").join(lost, "mark", "left").na.fill(0, ["n_removed_words", "n_removed_lines"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < share * F.col("n_words")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}), gone


def cleaned(docs: DataFrame, most: int = 10, share: int = 50, least: int = 10, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of the documents that pass, their texts without the lines over the limit."""
    verdicts, gone = judged(docs, most, share, least, id_col, host_col, text_col)
    m, lost, clean = fresh("_mark", docs), fresh("_lost", docs), fresh("_clean", docs)
    passed = verdicts.where("kept").select(F.col("mark").alias(m)).distinct()
    lists = gone.groupBy(F.col("mark").alias(m)).agg(F.collect_list("key").alias(lost))  # at most the lines of one text

    @F.pandas_udf("string")
    def without(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(text: str | None, drop: object) -> str | None:
            if text is None or drop is None:
                return text
            drop = set(map(int, drop))
            return "\n".join(x for x in text.split("\n") if not drop.intersection(line_keys(x, least)[0]))

        return pd.Series([one(t, k) for t, k in zip(texts, keys, strict=True)], dtype=object)

    out = docs.withColumn(m, mark(id_col, host_col, text_col)).join(passed, m, "left_semi").join(lists, m, "left")
    out = out.withColumn(clean, without(F.col(text_col), F.col(lost)))
    return out.select(*[F.col(clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    verdicts, _ = judged(docs)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return verdicts.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *columns)


_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), unnest(range(i, i + 3)) AS t(p) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w),
n AS (SELECT doc_id, source, line, translate(regexp_replace(trim(line, {_ENDS}), '[\x20\x09-\x0D]+', ' ', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS key FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n WHERE key <> '' GROUP BY doc_id),
big AS (SELECT source, key FROM n WHERE length(key) >= 10 GROUP BY source, key HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, sum(len(string_split(key, ' '))) AS n FROM n WHERE (source, key) IN (SELECT (source, key) FROM big) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - gone) >= 50 * n_words AS kept FROM f"""
