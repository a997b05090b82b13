"""Approximate nearest neighbours by shifted space-filling curves.

Each ordering projects the unit vectors onto a few of a set of orthogonal random directions, levels each projection by its
quantiles, shifts them and lines all vectors up along a Hilbert curve. Directions' quantiles and the bounds that part each
curve into `cells` key ranges are fitted on a bounded sample (`sample` vectors, smallest hashes of the id first); every
vector is indexed. A query meets the cells in a window of `reach` cells on either side of its own in each ordering. There it is
scored on byte codes; the best of all windows merge and are reranked by exact cosine in double precision.

Candidates of a cell are dealt into blocks of about CELL_ROWS and the queries into blocks of about QUERY_ROWS, from counts,
so that both sides of a group are bounded at every size, copies of one vector included.

The window is a share of the curve. The test vectors have no structure (64 independent directions, fifth neighbour at a
cosine near 0.35), so no index prunes much at a recall of 0.9: with these settings a query meets about 0.65 of all
vectors. `reach` = cells scans all and is exact.

Edge cases: vectors that are null, zero, of another length than most or hold null or non-finite components take no part;
with fewer candidates than k all are returned; ties go to the smaller id; extra columns are ignored; repeated ids of a
query are one query (its first vector) and rows with its own id are never its candidates; rows with null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, discard

BITS = 10
#: Queries and candidates that meet in one group, about.
QUERY_ROWS, CELL_ROWS = 4096, 4096
#: Vectors a cell holds on average at least: small tables have fewer cells and are searched whole.
LEAST_ROWS = 64


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) below 2**bits, by the transposed-axes method."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in rows])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed bytes and one factor a vector: for windows only, the last ranking is exact."""
    factor = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / factor[:, None]).astype(np.int8), factor.astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    found = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    sizes = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return found.join(F.broadcast(sizes.select("d")), F.size("v") == F.col("d"), "left_semi")


def _axes(d: int, orderings: int, dims: int, seed: int) -> np.ndarray:
    """(orderings, d, dims): columns of random orthogonal bases, so that together the orderings cover all directions."""
    rng, each = np.random.default_rng(seed), max(1, d // dims)
    bases = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-orderings // each))]
    return np.stack([bases[o // each][:, o % each * dims :][:, :dims] for o in range(orderings)])


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", orderings: int = 16, dims: int = 4, cells: int = 64, reach: int = 2, sample: int = 10_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    base = cut(usable(vectors, id_col, vec_col), "vectors")
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toPandas()["v"]
    fitted = _unit(some) if len(some) else np.eye(1)
    d = fitted.shape[1]
    dims, more = min(dims, d), 8 * k
    cells = max(1, min(cells, base.count() // LEAST_ROWS))
    axes, shifts = _axes(d, orderings, dims, seed), np.random.default_rng(seed + 1).random((orderings, dims))
    levels = [np.quantile(fitted @ axes[o], np.linspace(0, 1, 257), axis=0) for o in range(orderings)]

    def curve(unit: np.ndarray, o: int) -> np.ndarray:
        at = unit @ axes[o]
        level = np.stack([np.interp(at[:, i], levels[o][:, i], np.linspace(0, 1, 257)) for i in range(dims)], axis=1)
        return hilbert_keys(np.clip((level + shifts[o]) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))

    bounds = [np.quantile(curve(fitted, o), np.linspace(0, 1, cells + 1)[1:-1]) for o in range(orderings)]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), 2000):
                some = rows.iloc[start : start + 2000]
                unit = _unit(some["v"])
                code, factor = _codes(unit)
                code = [c.tobytes() for c in code]
                for o in range(orderings):
                    yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(), "code": code, "factor": factor, "o": np.int32(o), "cell": np.searchsorted(bounds[o], curve(unit, o)).astype(np.int32)})

    dealt = cut(base.mapInPandas(placed, "vec_id long, code binary, factor float, o int, cell int"), "cells")
    asking = dealt.where(F.col("vec_id") % every == 0).dropDuplicates(["o", "vec_id"])
    low = F.greatest(F.lit(0), F.least(F.col("cell") - reach, F.lit(cells - 1 - 2 * reach)))
    asked = asking.select("o", F.explode(F.sequence(low, F.least(F.lit(cells - 1), low + 2 * reach))).alias("cell"), F.col("vec_id").alias("qid"), F.col("code").alias("qcode"), F.col("factor").alias("qfactor"))
    blocks = lambda rows, size, name: rows.groupBy("o", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    shape = cut(blocks(dealt, CELL_ROWS, "cs").join(blocks(asked, QUERY_ROWS, "qs"), ["o", "cell"]), "blocks")  # orderings * cells rows at most
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(F.broadcast(shape), ["o", "cell"]).select("o", "cell", "vec_id", "code", "factor", block("vec_id", "cs").alias("cb"), every_block("qs").alias("qb"))
    right = asked.join(F.broadcast(shape), ["o", "cell"]).select("o", "cell", "qid", "qcode", "qfactor", block("qid", "qs").alias("qb"), every_block("cs").alias("cb"))

    def score(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "near": np.empty(0)})
        candidates = candidates.sort_values("vec_id")
        stack = lambda codes, factors: np.stack([np.frombuffer(c, np.int8) for c in codes]).astype(np.float32) * factors.to_numpy()[:, None]
        ids, x = candidates["vec_id"].to_numpy(), stack(candidates["code"], candidates["factor"])
        out = []
        for start in range(0, len(queries), 512):
            some = queries.iloc[start : start + 512]
            qid = some["qid"].to_numpy()
            near = np.round(stack(some["qcode"], some["qfactor"]) @ x.T, 6)
            near[qid[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-near, axis=1, kind="stable")[:, :more]
            found = pd.DataFrame({"query_id": np.repeat(qid, top.shape[1]), "vec_id": ids[top].ravel(), "near": np.take_along_axis(near, top, 1).ravel().astype(float)})
            out.append(found[np.isfinite(found["near"])].drop_duplicates(["query_id", "vec_id"]))
        return pd.concat(out)

    keys = ["o", "cell", "cb", "qb"]
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in keys], "qid", "qcode", "qfactor")
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(score, "query_id long, vec_id long, near double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    best = merged.selectExpr("query_id", "vec_id", "row_number() over (partition by query_id order by near desc, vec_id) as r").where(F.col("r") <= more)
    best = cut(best.select("query_id", "vec_id"), "best")
    discard(dealt, shape)
    own = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                q, v = (np.stack([np.asarray(x, np.float64) for x in rows[c]]) for c in ("q", "v"))
                q, v = (m / np.abs(m).max(axis=1, keepdims=True) for m in (q, v))
                dot = lambda x, y: (x * y).sum(axis=1)
                yield rows[["query_id", "vec_id"]].assign(score=dot(q, v) / np.sqrt(dot(q, q) * dot(v, v)))

    pairs = best.join(own, "query_id").join(base.dropDuplicates(["vec_id"]).toDF("vec_id", "v"), "vec_id").mapInPandas(exact, "query_id long, vec_id long, score double")
    # Cosines that differ by rounding only are ties.
    ranked = pairs.selectExpr("query_id", "cast(row_number() over (partition by query_id order by round(score, 12) desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
