"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary model on hashed byte 1-3-gram counts of the lower-cased letters predicts
each bit. Decoding takes the language of least logistic loss over the bits, weighted by each bit's accuracy in training.
The models learn from a bounded sample (`sample` rows, dealt evenly over the languages, smallest hashes of doc_id first) of
documents with a language whose crc32(doc_id as text) mod 4 is not 2. Of more than `sample` languages the rarest are not learned.

Edge cases: null texts and texts without a letter are `und` with score 0; if nothing can be learned all are `und`; ties go
to the alphabetically first language; repeated rows are predicted alike; a null doc_id is not held out and never learned
from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.linear import bit_models

DIM = 2048
#: ASCII that is no letter counts as a space.
CLEAN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(text: str | None) -> np.ndarray:
    """Length-one vector of square roots of hashed n-gram counts over the whole text."""
    a = CLEAN[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(263) + a[2:]
    mix = lambda x, salt: ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(21)
    counts = np.bincount(mix(a, 1), minlength=DIM) + np.bincount(mix(two, 7919), minlength=DIM) + np.bincount(mix(three, 104729), minlength=DIM)
    out = np.sqrt(counts).astype(np.float32)
    return out / max(1e-9, float(np.sqrt(out @ out)))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) of -1 and 1: the best spread of some random codes; no bit is the same for all."""
    bits = max(7, int(np.ceil(6 * np.log2(max(n, 2)))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], (n, bits))
        flat = np.abs(code.sum(axis=0)) == n
        code[0, flat] *= -1
        apart = ((code[:, None] != code[None]).sum(axis=2) + bits * np.eye(n)).min()
        if apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        self.names = sorted(set(langs))
        if self.names:
            self.code = codewords(len(self.names))
            targets = self.code[[self.names.index(v) for v in langs]]
            _, own, counts = np.unique(langs, return_inverse=True, return_counts=True)
            weight = 1 / counts[own] / len(counts)  # every language weighs the same
            self.w = bit_models(x, targets, weight)
            right = weight @ ((np.c_[x, np.ones(len(x), x.dtype)] @ self.w) * targets > 0)
            self.trust = np.clip(np.log((right + 0.01) / (1.01 - right)), 0.01, None)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, its share of the decoding, and whether the runner-up is close."""
        margin = np.c_[x, np.ones(len(x), x.dtype)] @ self.w
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ (self.trust / self.trust.sum())
        p = np.exp(-loss * len(self.trust))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(p, axis=1)
        close = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0) < 0.2
        return np.array(self.names, object)[best], p[np.arange(len(p)), best], close


def train(docs: DataFrame, sample: int = 4000) -> Model:
    """Learn from `sample` rows at most, dealt evenly over the languages, however rare one is; a language's rows of smallest hash go first."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    each = max(1, sample // max(1, len(counts)))
    # A row's chance lets about four times as many through as are taken; only those are ranked.
    below = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4.0 * (each + 4) / n))]) if counts else F.create_map().cast("map<string,double>")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    picked = known.where(chance < below[F.col("lang")]).select("doc_id", "lang", "text", F.row_number().over(first).alias("r")).where(F.col("r") <= each)

    def view(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "lang": rows["lang"], "x": [features(t).tobytes() for t in rows["text"]]})

    got = picked.select("doc_id", "lang", "text").mapInPandas(view, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang", "x"], ignore_index=True)
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]) if len(got) else np.empty((0, DIM), np.float32)
    return Model(x, got["lang"].to_numpy())


def predict(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs, sample)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def guess(text: pd.Series) -> pd.DataFrame:
        lang, score, close = np.full(len(text), "und", object), np.zeros(len(text)), np.ones(len(text), bool)
        has = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in text], bool)
        if has.any() and model.names:
            lang[has], score[has], close[has] = model.predict(np.stack([features(t) for t in text[has]]))
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": close})

    out = docs.select("doc_id", "text").withColumn("g", guess("text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"), F.col("g.ambiguous").alias("ambiguous"))
