"""Vector code compression: product quantisation in exact integers, nearest entries by segment-mean lower bounds.

Components become floor(1024 x); a vector is cut into equal parts, each with a codebook of its own. A block of a part is
described by its mean and by the norm of what is left of it. For two blocks of b components, b times the squared difference
of the means plus the squared difference of these norms never exceeds their squared distance. The bounds go from coarse to
fine: one block a part, then two, then four, and so on; at each level the entry that looks best is measured, and those whose
bound, less an allowance for rounding, is over the least distance so far fall out. What survives gets its exact integer
distance, so the result is that of a full search.

A round is one pass over all vectors: tasks assign parts and emit exact sums for each part and entry, which are added up
after a shuffle. Only the codebooks travel to and from the driver: entries x dimensions integers, however many vectors.

Edge cases: vectors that are null or hold null or non-finite components are dropped; vectors of other lengths are filled with
zeros up to the longest, whose length is filled up to a multiple of the parts; empty vectors count as zeros; with fewer
vectors than entries all of them make a codebook; rows with a null vec_id come last when the first are taken, repeated
ids go by their vectors, and each row gets its own code; components beyond 2**24 after scaling take slower arithmetic of
unbounded integers, and errors beyond 64 bits come as the largest; an empty table gives an empty one; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut

SCALE, LIMIT, LARGEST = 1024, 1 << 24, (1 << 63) - 1
CHUNK = 1024


def kept(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    unfit = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), unfit))


def _whole(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def integers(vectors: pd.Series, dims: int, large: bool) -> np.ndarray:
    """(rows, dims) of floor(1024 x), filled with zeros."""
    if large:
        out = np.full((len(vectors), dims), 0, object)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = [_whole(float(x)) for x in v]
        return out
    held = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        held[i, : len(v)] = v
    return np.floor(held * SCALE).astype(np.int64)


class Codebook:
    """The entries of one part (entries x size), with block means and residual norms at each level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.levels = [] if entries.dtype == object else [np.hstack(self.blocks(entries, n)) for n in self.shapes(entries.shape[1])]

    @staticmethod
    def shapes(size: int) -> list[int]:
        """Numbers of blocks: 1, 2, 4, ... while blocks keep four components or more, and one in any case."""
        return [n for n in (1, 2, 4, 8, 16, 32, 64) if size % n == 0 and (size // n > 3 or n == 1 < size)]

    @staticmethod
    def blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Means, scaled by the root of the block's size, and residual norms: (rows, n) each."""
        parts = x.reshape(len(x), n, -1).astype(np.float64)
        mean = parts.mean(axis=2)
        return mean * math.sqrt(parts.shape[2]), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of rows of q to the entries `at`, in integers."""
        gap = q - self.entries[at]
        return (gap * gap).sum(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and its squared distance."""
        found = [self._nearest(q[i : i + CHUNK]) for i in range(0, len(q), CHUNK)]
        empty = np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found] or [empty]), np.concatenate([f[1] for f in found] or [empty])

    def _nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))
        if not self.levels:  # unbounded integers, or parts of one component: every entry is compared
            every = [self.exact(q, np.full(len(q), e)) for e in range(len(self.entries))]
            best = np.array([min(range(len(every)), key=lambda e: every[e][i]) for i in rows], np.int64)  # noqa: B023
            return best, np.array([every[e][i] for e, i in zip(best, rows, strict=True)], q.dtype)
        most = np.full(len(q), LARGEST)
        alive = np.ones((len(q), len(self.entries)), bool)
        for n, theirs in zip(self.shapes(q.shape[1]), self.levels, strict=True):
            mine = np.hstack(self.blocks(q, n))
            own, other = (mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)
            bound = own[:, None] + other - 2 * (mine @ theirs.T)
            most = np.minimum(most, self.exact(q, np.where(alive, bound, np.inf).argmin(axis=1)))
            # What rounding may add to a bound is far below a thousand-millionth of the squares it comes from.
            alive &= bound <= (most + 1e-9 * (own + other.max()) + 1e-6)[:, None]
        i, e = np.nonzero(alive)
        far = self.exact(q[i], e)
        starts = np.searchsorted(i, rows)
        least = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == least[i])  # pairs go by row, then entry: the first hit of a row is the lowest index
        return e[hit[np.searchsorted(i[hit], rows)]], least


def assign(vectors: pd.Series, books: list[Codebook], dims: int, large: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The integers of the vectors, and for each part the entries and squared distances."""
    x, size = integers(vectors, dims, large), dims // len(books)
    found = [b.nearest(x[:, p * size : (p + 1) * size]) if size else (np.zeros(len(x), np.int64),) * 2 for p, b in enumerate(books)]
    return x, [f[0] for f in found], [f[1] for f in found]


def _sums(rows: DataFrame, vector: str, books: list[Codebook], dims: int, large: bool) -> pd.DataFrame:
    """(part, entry, held, sums) over all vectors: as many rows as the codebooks have entries, at most."""
    size = dims // len(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.full(b.entries.shape, 0, b.entries.dtype) for b in books]
        for some in batches:
            x, codes, _ = assign(some[vector], books, dims, large)
            for p, code in enumerate(codes):
                np.add.at(held[p], code, 1)
                np.add.at(sums[p], code, x[:, p * size : (p + 1) * size])
        out = [(p, e, int(held[p][e]), ",".join(map(str, sums[p][e]))) for p in range(len(books)) for e in np.flatnonzero(held[p])]
        yield pd.DataFrame(out, columns=["part", "entry", "held", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total: dict[tuple[int, int], list[int]] = {}
        for part, entry, held, sums in rows[["part", "entry", "held", "sums"]].itertuples(index=False):
            new = [held, *map(int, sums.split(","))]
            old = total.get((part, entry))
            total[part, entry] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
        return pd.DataFrame([(*k, v[0], ",".join(map(str, v[1:]))) for k, v in total.items()], columns=["part", "entry", "held", "sums"])

    shape = "part int, entry int, held long, sums string"
    partial = rows.select(vector).mapInPandas(run, shape)  # a row an entry and task
    return partial.groupBy("part", F.pmod("entry", F.lit(16))).applyInPandas(added, shape).toPandas()


def trained(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list[Codebook], int, bool]:
    """The codebooks after `rounds` rounds from the vectors of the smallest keys, the dimensions, and whether integers are large."""
    double = F.col(vector).cast("array<double>")
    facts = rows.agg(F.max(F.size(vector)).alias("dims"), F.max(F.array_max(F.transform(double, F.abs))).alias("most")).first()
    dims = -(-(facts["dims"] or 0) // parts) * parts
    large = (facts["most"] or 0) * SCALE >= LIMIT
    first = rows.select(key, double.alias("v")).orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).collect()
    x, size = integers(pd.Series([r["v"] for r in first], dtype=object), dims, large), dims // parts
    books = [Codebook(x[:, p * size : (p + 1) * size]) for p in range(parts)]
    for _ in range(rounds if size and len(first) else 0):
        new = [b.entries.copy() for b in books]
        for part, entry, held, sums in _sums(rows, vector, books, dims, large).itertuples(index=False):
            new[part][entry] = [int(s) // held for s in sums.split(",")]
        books = [Codebook(e) for e in new]
    return books, dims, large


def compressed(rows: DataFrame, books: list[Codebook], dims: int, large: bool, vector: str = "embedding") -> DataFrame:
    """rows without the vector, with `code` and `error`."""
    others = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            _, codes, errors = assign(some[vector], books, dims, large)
            total = [min(sum(map(int, e)), LARGEST) for e in zip(*errors, strict=True)]
            text = ["".join(f"{int(c):02x}" for c in row) for row in zip(*codes, strict=True)]
            yield pd.DataFrame({"held": some["held"], "code": text, "error": np.array(total, np.int64)})

    # The other columns travel as one JSON-free struct beside the code: pandas never sees their nulls.
    packed = rows.select(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("held"), vector)
    shape = rows.select(*others).schema
    out = packed.mapInPandas(run, "held string, code string, error long")
    return out.select(F.from_json("held", shape).alias("held"), "code", "error").select("held.*", "code", "error")


def text_of(books: list[Codebook]) -> str:
    return ",".join(str(x) for b in books for entry in b.entries for x in entry)


def digest(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row."""
    fit = kept(rows.select(key, label, vector), vector)
    books, dims, large = trained(fit, vector, key)
    coded = cut(compressed(fit, books, dims, large, vector), "codes")
    total = coded.groupBy(F.col(label).alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(total, coded[label].eqNullSafe(total["_label"]))
    return out.select(key, "code", "error", "label_error", F.lit(hashlib.sha256(text_of(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Four rounds as common tables: `c` the codebooks, `a` the assignments."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c), e := e)) AS best
  FROM q JOIN c{r} USING (part) GROUP BY vec_id, part)"""
    move = """s{r} AS (SELECT part, best.e AS e, pos, floor(sum(q[pos]) / count(*)) AS x FROM a{p} JOIN q USING (vec_id, part), unnest(range(1, len(q) + 1)) AS t(pos) GROUP BY ALL),
c{r} AS MATERIALIZED (SELECT part, e, coalesce(m.c, c{p}.c) AS c FROM c{p} LEFT JOIN (SELECT part, e, list(x ORDER BY pos) AS c FROM s{r} GROUP BY part, e) AS m USING (part, e))"""
    rounds = ",\n".join(f"{near.format(r=r)},\n{move.format(r=r + 1, p=r)}" for r in range(4))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS q FROM v, range(0, 4) AS t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q AS c FROM q QUALIFY e < 256),
{rounds},
{near.format(r=4)},
book AS (SELECT sha256(string_agg(CAST(CAST(c[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c4, unnest(range(1, len(c) + 1)) AS t(pos)),
done AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 JOIN v USING (vec_id) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done, book"""


ORACLE_SQL = _sql()
