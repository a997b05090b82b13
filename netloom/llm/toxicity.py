"""Toxicity with noisy-channel deobfuscation.

A character trigram model and the VOCABULARY most frequent words are counted over all documents. Spans that look disguised
(leetspeak inside words, letters spaced out one by one, letters repeated three times or more) become lattices of possible
characters, where a separator may be a word boundary or nothing and a sign at an edge may be nothing, and Viterbi decoding
under that model restores the likeliest words, in time linear in the text's length. Restored texts are scored by a lexicon
of words and word beginnings learned from a bounded sample of labelled rows (`sample`, smallest hashes first; crc32(doc_id
as text) mod 4 is not 2), combined by a logistic model fitted on the other half of that sample.

Edge cases: null and empty texts score as texts without any lexicon entry; if there are no labels or one class, the score
is the constant rate; conflicting labels of one doc_id all count; a null doc_id is not held out and never learned from;
repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, discard
from netloom.llm.langid import held_out
from netloom.llm.linear import Logistic, sigmoid

#: What a disguised character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c"}
SIGNS = re.escape("".join(LEET))
# Possessive repeats, and looks behind wherever a search could start inside a run: each takes time linear in the text.
SPACED = re.compile(rf"(?<![^\W_])[a-z{SIGNS}](?:[ \t._-]++[a-z{SIGNS}]){{2,}}(?![^\W_])")
MIXED = re.compile(rf"(?<![^\W_])[a-z{SIGNS}]++")
INSIDE = re.compile(rf"[a-z][{SIGNS}]++[a-z]|(?<![{SIGNS}])[{SIGNS}]++[a-z]{{2}}")
LETTERS, THRICE = re.compile(r"(?<![a-z])[a-z]++"), re.compile(r"([a-z])\1\1")
#: Signs that are as likely plain punctuation before or after a word; others are dropped there at the cost DROPPED.
BEFORE, AFTER, DROPPED = "(*", "!(*+|", -3.0
VOCABULARY, UNKNOWN = 50_000, -4.0
RUNS = re.compile(r"([^ \t._-])(?:[ \t._-]*+\1)*+")
WORD = re.compile(r"[^\W\d_]+")
A = 27
CODES = np.array([b - 96 if 97 <= b <= 122 else 0 for b in range(256)], np.int32)


def letter_counts(texts: pd.Series) -> np.ndarray:
    """Counts of letter trigrams; 0 is the edge of a word, and texts are padded by edges."""
    total = np.zeros(A**3, np.int64)
    for t in texts:
        if t:
            c = CODES[np.frombuffer(f"  {t.lower()}  ".encode("utf-8", "replace"), np.uint8)]
            total += np.bincount(c[:-2] * A * A + c[1:-1] * A + c[2:], minlength=A**3)
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (27, 27, 27) of a letter after two others, from the counts of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((letter_counts(rows["text"]) for rows in batches), np.zeros(A**3, np.int64))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some.astype(np.int32), "n": total[some]})

    rows = docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 27**3
    counts = np.zeros(A**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    three = counts.reshape(A, A, A)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + A)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


def vocabulary(docs: DataFrame) -> dict[str, float]:
    """Log probabilities of the most frequent words, and None for their beginnings."""
    found = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) between 1 and 24").groupBy("w").count()
    top = found.orderBy(F.desc("count"), "w").limit(VOCABULARY).collect()
    total = sum(r["count"] for r in top)
    out = dict.fromkeys(r["w"][:i] for r in top for i in range(1, len(r["w"])))
    return out | {r["w"]: float(np.log(r["count"] / total)) for r in top}


def viterbi(span: str, lm: list, words: dict[str, float] | None = None, twice: float = -1.0, join: float = -2.0) -> str:
    """The likeliest words behind a span. A separator becomes a space or nothing (at the cost `join` if it is wider than
    others); of a run of one letter one or two stay; signs are replaced, and may vanish at the edges. A word counts as itself
    if it is one of `words`, else by its letters."""
    words = words or {}

    def ended(score: float, begun: float, word: str | None) -> float:
        return score if not words or word == "" else max(score + UNKNOWN, begun + known) if word and (known := words[word]) is not None else score + UNKNOWN

    # State: the last two letters and the word so far, or None if no known word begins so. Value: score, text, score where the word began.
    # The text is a chain of its pieces, last first, so that a step takes the same time at any length.
    best: dict[tuple, tuple[float, tuple, float]] = {(0, 0, ""): (0.0, (), 0.0)}
    gaps = [len(g) for g in re.findall(r"[ \t._-]+", span)]
    least, end = min(gaps, default=0), 0
    for m in RUNS.finditer(span):
        ch, gap, end = m.group(1), m.start() - end, m.end()
        inner = [len(g) for g in re.findall(r"[ \t._-]+", m.group(0))]
        n = len(m.group(0)) - sum(inner)
        cost = join if gap > least else 0.0
        options = []
        for c in [ch] if ch.isalpha() else LEET.get(ch, ""):
            options += [(c, 0.0)] if n == 1 else [(c, 0.0), (c + c, twice if n > 2 else 0.0)] + ([(c + " " + c, 0.0)] if inner else [])
        if not ch.isalpha() and (m.start() == 0 or end == len(span)):
            options.append(("", 0.0 if ch in (BEFORE if m.start() == 0 else AFTER) else DROPPED))
        options = options or [("", 0.0)]
        if gap:
            options = [(t, s + cost) for t, s in options] + [(" " + t, s) for t, s in options if t]
        after: dict[tuple, tuple[float, tuple, float]] = {}
        for (x, y, word), (score, done, begun) in best.items():
            for text, cost in options:
                # `cost` counts for known words too
                s, st, w, start = score + cost, (x, y), word, begun + cost
                for c in text:
                    k = 0 if c == " " else ord(c) - 96
                    s += lm[st[0]][st[1]][k]
                    st = (st[1], k)
                    if k:
                        w = w + c if w is not None and w + c in words else None
                    else:
                        start = s = ended(s, start, w)
                        w = ""
                key = (*st, w)
                if key not in after or s > after[key][0]:
                    after[key] = (s, (text, done), start)
        best = after
    final = lambda x: (ended(x[1][0] + lm[x[0][0]][x[0][1]][0], x[1][2], x[0][2]), x[0][0], x[0][1], x[0][2] or "")
    chain, pieces = max(best.items(), key=final)[1][1], []
    while chain:
        pieces.append(chain[0])
        chain = chain[1]
    return "".join(reversed(pieces))


def restorer(lm: np.ndarray, words: dict[str, float] | None = None):  # noqa: ANN201
    """text -> text with its disguised spans decoded."""
    table = lm.tolist()
    decode = lru_cache(200_000)(lambda span: viterbi(span, table, words))
    swap = lambda m: decode(m.group(0)) if any(c.isalpha() for c in m.group(0)) else m.group(0)

    def restore(text: str | None) -> str:
        t = (text or "").lower()
        t = SPACED.sub(lambda m: swap(m) + " ", t)
        t = MIXED.sub(lambda m: swap(m) if INSIDE.search(m.group(0)) else m.group(0), t)
        return LETTERS.sub(lambda m: swap(m) if THRICE.search(m.group(0)) else m.group(0), t)

    return restore


def entries(text: str) -> set[str]:
    """Words, and beginnings of four and five letters marked by a dash."""
    found = set(WORD.findall(text))
    return found | {w[:4] + "-" for w in found if len(w) > 4} | {w[:5] + "-" for w in found if len(w) > 5}


def _facts(found: set[str], lexicon: dict[str, float]) -> list[float]:
    hits = sorted((v for v in map(lexicon.get, found) if v is not None), reverse=True)
    return [hits[0] if hits else 0.0, sum(hits[:3]), min(len(hits), 8), float(bool(hits))]


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, sample: int = 8000, least: int = 4, words: dict[str, float] | None = None) -> tuple[dict[str, float], Logistic]:
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    rank = F.xxhash64("doc_id")
    some = F.broadcast(known.orderBy(rank, "doc_id", "y").limit(sample))  # `sample` rows at most
    half = F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text").join(some, "doc_id").orderBy(rank, "doc_id", "y", F.xxhash64("text")).limit(sample)  # where doc_ids repeat
    rows = cut(rows.withColumn("half", half).repartition(32, "doc_id"), "sample")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorer(lm, words)
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                found = sorted(entries(restore(t)))
                yield pd.DataFrame({"e": found, "y": np.full(len(found), y, np.int32)})

    totals = {r["y"]: r["count"] for r in rows.where("half = 0").groupBy("y").count().collect()}
    counts = rows.where("half = 0").mapInPandas(listed, "e string, y int").groupBy("e").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).where(F.col("bad") >= least)
    bad, good = totals.get(1, 0), totals.get(0, 0)
    odds = lambda r: float(np.log((r["bad"] + 0.5) / (bad + 1)) - np.log((r["n"] - r["bad"] + 0.5) / (good + 1)))
    # At most the entries that `least` of the sample's toxic rows share.
    lexicon = {r["e"]: v for r in counts.toLocalIterator() if (v := odds(r)) > 2.5}

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorer(lm, words)
        for b in batches:
            yield pd.DataFrame({"x": [_facts(entries(restore(t)), lexicon) for t in b["text"]], "y": b["y"]})

    got = rows.where("half = 1").mapInPandas(facts, "x array<double>, y int").toPandas()
    discard(rows)
    return lexicon, Logistic().fit(np.array(list(got["x"]), float).reshape(-1, 4), got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    lm, words = language_model(docs), vocabulary(docs)
    lexicon, model = train(docs, labels, lm, sample, words=words)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore = restorer(lm, words)
        for texts in batches:
            x = np.array([_facts(entries(restore(t)), lexicon) for t in texts], float).reshape(len(texts), 4)
            yield pd.Series(sigmoid(model.logit(x)))

    rated = F.pandas_udf(rate, "double")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rated("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
