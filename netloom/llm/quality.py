"""Co-training quality classifier over two views of a document: its text and its metadata.

Each view has a logistic model. They start from a bounded sample of labelled rows (`labelled`, smallest hashes first); in
each round a view labels, of all unlabelled rows, those of which it is surest for the other view's next Newton steps, more
of them from round to round; Spark takes the sums over the table. Each view is then calibrated on labelled rows held back from fitting, and a logistic model over both calibrated views
scores all documents.

Edge cases: null and empty texts, languages and sources have defined features and get a score; with no labels or one class
the score is the constant rate; conflicting labels of one doc_id all count; repeated rows are scored alike; rows without a
doc_id are scored, never learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, discard
from netloom.llm.linear import Logistic, sigmoid

SYMBOLS = [ord(c) for c in "#$%&*@^~<>{}[]=+\\/_"]
META = 48


def text_view(text: str | None) -> list[float]:
    """Shares of kinds of characters and words over the whole text."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    found = text.split()
    m = max(1, len(found))
    counts = Counter(found)
    share = lambda which: float(raw[which].sum()) / n
    upper, lower = share(slice(65, 91)), share(slice(97, 123))
    return [
        np.log1p(len(text)), upper, lower, upper / (upper + lower + 1e-3), share(slice(48, 58)), share(SYMBOLS), share([33]), share([124]), share([44, 46]), share([10]), share(slice(128, 256)),
        len(counts) / m, max(counts.values(), default=0) / m, sum(1 for a, b in zip(found, found[1:], strict=False) if a == b) / m,
        sum(map(len, counts)) / max(1, len(counts)), sum(v for w, v in counts.items() if len(w) <= 3) / m, np.log1p(m), float(m < 5),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    out = [0.0] * META
    out[zlib.crc32(f"s{source}".encode()) % 32] = 1.0
    out[32 + zlib.crc32(f"l{lang}".encode()) % 12] = 1.0
    size = 0.0 if n_chars is None or pd.isna(n_chars) else float(np.log1p(max(n_chars, 0)))
    out[44:48] = [size, size * size, float(source is None), float(lang is None)]
    return out


def _views(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    none = lambda v: None if v is None or v != v else v
    text = np.array([text_view(none(t)) for t in rows["text"]], float).reshape(len(rows), -1)
    meta = np.array([meta_view(none(a), none(b), c) for a, b, c in zip(rows["lang"], rows["source"], rows["n_chars"], strict=True)], float).reshape(len(rows), -1)
    return text, meta


def _standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), (x - mean) / sd]


def _sums(rows: DataFrame, cells: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (a, b) of what `of` makes of a batch, `cells` numbers. Partitions add up first; sums of decimals are exact in any order."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells)
        for batch in batches:
            total += of(*(np.stack([np.frombuffer(v, np.float32) for v in batch[c]]).astype(float) for c in "ab")) if len(batch) else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "v": total[at]})

    found = rows.select("a", "b").mapInPandas(add, "cell int, v double").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,10)")).cast("double").alias("v")).collect()
    out = np.zeros(cells)
    for r in found:
        out[r["cell"]] = r["v"]
    return out


#: Cells of the histograms in which the surest rows are counted, over logits from -LOGIT to LOGIT.
BINS, LOGIT = 4096, 12.0


class Model:
    """Chances of the combined views, and how many pseudo-labels each view gave the other in each round: (round, text to metadata, metadata to text)."""

    def __init__(self, chance: Callable[[np.ndarray, np.ndarray], np.ndarray], exchanged: list[tuple[int, int, int]]) -> None:
        self.chance, self.exchanged = chance, exchanged

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.chance(a, b)


def _edges(counts: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """(l, h): cells up to l hold the lowest rows, at most `low` of them and one cell at least; cells from h on the highest."""
    up, down = np.cumsum(counts), np.cumsum(counts[::-1])
    first = int(np.argmax(counts > 0)) if counts.any() else -1
    last = len(counts) - 1 - int(np.argmax(counts[::-1] > 0)) if counts.any() else len(counts)
    return max(int((up <= low).sum()) - 1, first), min(len(counts) - int((down <= high).sum()), last)


def fit(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, rest: DataFrame, rounds: int = 3, steps: int = 3, grow: float = 0.15, pull: float = 2.0) -> Model:
    """Co-train on labelled views x and all unlabelled rows of `rest`.

    In round r each view's model, calibrated on labelled rows held back, labels the rows it is surest of for the other view: of
    each class the share r x `grow` of the rows that the class should have by the labels. A histogram of all rows, summed by
    Spark, says how sure that is. The other view then takes `steps` Newton steps over labelled and pseudo-labelled rows; a
    pseudo-labelled one weighs (2 p - 1)^2, so a view that knows little teaches little, and less where together they would
    outweigh the labelled rows `pull` times. A view keeps what it was taught only if it then fits the rows held back no worse.
    """
    held = np.arange(len(y)) % 4 == 3
    train = [v[~held] for v in x]
    first = [Logistic().fit(v, y[~held]) for v in train]
    scale = [(m.mean, np.where(m.sd > 1e-6, m.sd, 1.0)) for m in first]  # a feature that no labelled row has keeps its own scale
    w = [m.w for m in first]
    calibrated = lambda w: [Logistic().fit((_standard(v[held], *s) @ t).clip(-LOGIT, LOGIT)[:, None], y[held]) for v, s, t in zip(x, scale, w, strict=True)]

    def loss(w: list[np.ndarray]) -> list[float]:
        """Of each calibrated view on the labelled rows held back."""
        out = []
        for v, s, t, c in zip(x, scale, w, calibrated(w), strict=True):
            p = sigmoid(c.logit((_standard(v[held], *s) @ t).clip(-LOGIT, LOGIT)[:, None])).clip(1e-9, 1 - 1e-9)
            out.append(float(-np.where(y[held] > 0, np.log(p), np.log(1 - p)).sum()))
        return out

    both_classes = 0 < y[~held].sum() < (~held).sum()
    sizes, rate, exchanged = [len(v) for v in w], float(y.mean()) if len(y) else 0.5, []
    for turn in range(1, rounds + 1 if both_classes else 1):
        teachers = [(v.copy(), c) for v, c in zip(w, calibrated(w), strict=True)]

        def said(a: np.ndarray, b: np.ndarray, by: list[tuple[np.ndarray, Logistic]] = teachers) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
            """Standardised rows, the cells of each view's score, and its calibrated chances."""
            z = [_standard(v, *s) for v, s in zip((a, b), scale, strict=True)]
            raw = [(v @ t).clip(-LOGIT, LOGIT) for v, (t, _) in zip(z, by, strict=True)]
            cells = [((r + LOGIT) * (BINS / (2 * LOGIT))).astype(int).clip(0, BINS - 1) for r in raw]
            return z, cells, [sigmoid(c.logit(r[:, None])) for r, (_, c) in zip(raw, by, strict=True)]

        counts = _sums(rest, 2 * BINS, lambda a, b, f=said: np.concatenate([np.bincount(c, minlength=BINS) for c in f(a, b)[1]]).astype(float))
        n = counts[:BINS].sum() * min(1.0, turn * grow)
        edges = [_edges(c, n * (1 - rate), n * rate) for c in (counts[:BINS], counts[BINS:])]

        def taught(a: np.ndarray, b: np.ndarray, f: Callable = said, edges: list[tuple[int, int]] = edges) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """For each view the rows (standardised, label, weight) that the other view is surest of."""
            z, cells, p = f(a, b)
            sure = [(c <= e[0]) | (c >= e[1]) for c, e in zip(cells, edges, strict=True)]
            return [(z[i][sure[1 - i]], (cells[1 - i][sure[1 - i]] >= edges[1 - i][1]).astype(float), (2 * p[1 - i][sure[1 - i]] - 1) ** 2) for i in (0, 1)]

        told = _sums(rest, 4, lambda a, b, t=taught: np.array([f(k) for _, _, k in t(a, b) for f in (len, np.sum)], float))
        exchanged.append((turn, int(told[2]), int(told[0])))
        share = [min(1.0, pull * len(train[0]) / max(1e-9, c)) for c in (told[1], told[3])]
        before, losses = [v.copy() for v in w], loss(w)
        for _ in range(steps):
            now = [v.copy() for v in w]

            def slopes(a: np.ndarray, b: np.ndarray, t: Callable = taught, now: list[np.ndarray] = now) -> np.ndarray:
                """Gradient and Hessian of both views, end to end."""
                out = []
                for (z, k, weight), v in zip(t(a, b), now, strict=True):
                    p = sigmoid(z @ v)
                    out += [z.T @ (weight * (p - k)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()]
                return np.concatenate(out)

            found = _sums(rest, sum(d + d * d for d in sizes), slopes)
            for i, d in enumerate(sizes):
                mine, found = found[: d + d * d] * share[i], found[d + d * d :]
                z = _standard(train[i], *scale[i])
                p = sigmoid(z @ w[i])
                ridge = np.r_[1e-6, np.ones(d - 1)]
                slope = z.T @ (p - y[~held]) + mine[:d] + ridge * w[i]
                curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + mine[d:].reshape(d, d) + np.diag(ridge)
                step = np.linalg.solve(curve, slope)
                w[i] = w[i] - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w = [old if was < now else new for old, new, was, now in zip(before, w, losses, loss(w), strict=True)]
    logits = lambda a, b: np.c_[_standard(a, *scale[0]) @ w[0], _standard(b, *scale[1]) @ w[1]].clip(-LOGIT, LOGIT)
    one, two = calibrated(w)
    views = lambda a, b: np.c_[one.logit(logits(a, b)[:, [0]]), two.logit(logits(a, b)[:, [1]])]
    last = Logistic().fit(views(x[0][held], x[1][held]), y[held])
    return Model(lambda a, b: sigmoid(last.logit(views(a, b))), exchanged)


def train(docs: DataFrame, labels: DataFrame, labelled: int = 8000, **how: float) -> Model:
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("y"))
    rank = F.xxhash64("doc_id")

    def view(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a, b = (v.astype(np.float32) for v in _views(rows))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "a": [v.tobytes() for v in a], "b": [v.tobytes() for v in b]})

    seen = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    views = cut(seen.mapInPandas(view, "doc_id long, a binary, b binary"), "views")
    some = known.orderBy(rank, "doc_id", "y").limit(labelled)
    got = views.join(F.broadcast(some), "doc_id").orderBy(rank, "doc_id", "y", F.xxhash64("a", "b")).limit(labelled).toPandas()  # `some` has `labelled` rows at most
    rest = cut(views.join(known, "doc_id", "left_anti").select("a", "b"), "unlabelled")
    discard(views)
    arrays = tuple(np.array([np.frombuffer(v, np.float32) for v in got[c]], float).reshape(-1, w) for c, w in zip("ab", (len(text_view("")), META), strict=True))
    mixed = np.random.default_rng(5).permutation(len(got))
    model = fit(tuple(v[mixed] for v in arrays), got["y"].to_numpy(float)[mixed], rest, **how)
    discard(rest)
    return model


def scored(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """All columns of docs (a `quality_score` of its own makes way) and quality_score, the chance of quality 1."""
    docs = docs.drop("quality_score")
    model = train(docs, labels, **how)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(model(*_views(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars}))))

    return docs.withColumn("quality_score", score("text", "lang", "source", F.col("n_chars").cast("double")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, keep of each document."""
    return scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("keep"))
