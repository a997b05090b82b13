"""N-gram Jaccard self-join with PartEnum signatures: exact links at a Jaccard threshold, as components.

Sets are distinct word shingles, held as 64-bit hashes. A set signs for its own size band and, where a set of the next
band can still be near enough, for that too: the hashed feature domain is dealt into groups of parts, and subsets of the
parts of a group are enumerated, so that linked sets share a signature (see `signatures`). The number of parts and the
subsets' size are parameters; two parts with subsets of one made the fewest signatures on the test tables, and as few
candidates as three with subsets of two.

Equal sets collapse to one representative before they meet. Members of one signature bucket are compared with one hub,
the member that meets others most often. Of what is then still in different components, pairs that share a signature
are compared as well if their rarest elements meet: a set's prefix holds its n - ceil(t n) + 1 rarest elements, so linked
pairs always share one and no link is lost, while otherwise different texts around one common passage do not meet.

Edge cases: null, empty or blank texts have an empty set and link with nothing; repeated rows with one doc_id link by
that id; rows with a null doc_id come back with a null component, and other ids keep all 64 bits beside them; equal texts
are ties, their smallest id stands for them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import cut, discard

#: Odd multipliers of the 64-bit mixing steps (fixed values).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int, seen: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence, where there are fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and [ \\t-\\r] only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = out * M1 + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


#: What `_subsets` has found, by its arguments. A plain dict: a caching wrapper would travel to the workers by name.
_KNOWN: dict[tuple[int, int], tuple[list[list[int]], np.ndarray]] = {}


def _subsets(parts: int, spare: int) -> tuple[list[list[int]], np.ndarray]:
    """The subsets of parts - spare parts, and for each bit pattern of such subsets how many parts must differ to spoil them all."""
    if (parts, spare) in _KNOWN:
        return _KNOWN[parts, spare]
    chosen = [list(c) for c in itertools.combinations(range(parts), parts - spare)]
    cost = np.zeros(1 << len(chosen), np.int64)
    for pattern in range(1, len(cost)):
        held = [set(c) for b, c in enumerate(chosen) if pattern >> b & 1]
        cost[pattern] = next(m for m in range(1, parts + 1) if any(all(c & set(x) for c in held) for x in itertools.combinations(range(parts), m)))
    _KNOWN[parts, spare] = chosen, cost
    return chosen, cost


def signatures(x: np.ndarray, num: int, den: int, parts: int = 2, spare: int = 1, ratio: float = 2.0) -> np.ndarray:
    """PartEnum signatures of a sorted distinct set for J >= num/den.

    Two linked sets of n and m elements differ in k = (n + m)(1 - J)/(1 + J) elements at most, taken at the largest m of
    the band. The domain is dealt into groups of `parts` parts, whose subsets of parts - spare parts are signed. To spoil
    all signed subsets of a group some number of its parts must differ; where these numbers come to more than k over all
    groups, one signed subset is equal in both sets.

    A set signs those subsets that hold `least` elements or more: the highest number for which that sum still exceeds k.
    Of two linked sets, that of the higher number signs an equal subset, and the other signs it too, since its own number
    is lower. So the guarantee stands, while subsets of few elements, which other sets share by chance, are seldom signed.
    """
    n, out = len(x), []
    if not n:
        return np.empty(0, np.int64)
    base = math.log(ratio)
    own = int(math.floor(math.log(n) / base + 1e-9))
    spread = _mix(x + np.uint64(1))
    chosen, cost = _subsets(parts, spare)
    for band in (own, own + 1):
        low, high = math.exp(base * band) * (1 - 1e-6), math.exp(base * (band + 1)) * (1 + 1e-6)
        if band > own and n * den < num * low:
            continue  # no set of that band is near enough in size
        most = 2 * int(high) * (den - num) // (den + num)
        k = (n + min(int(high), n * den // num)) * (den - num) // (den + num)
        if k == 0:
            continue  # only equal sets link, and those have been collapsed
        groups = -(-(most + 1) // (spare + 1))
        part = (((x * M1) >> np.uint64(33)) % np.uint64(parts * groups)).astype(np.int64)
        sums = np.zeros(parts * groups, np.uint64)
        np.add.at(sums, part, spread)
        sums, counts = sums.reshape(groups, parts), np.bincount(part, minlength=parts * groups).reshape(groups, parts)
        if parts - spare == 1:
            least = np.sort(counts, axis=None)[-1 - k]
        else:
            sums = np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1)
            counts = np.stack([counts[:, c].sum(axis=1) for c in chosen], axis=1)
            spoil = lambda t: cost[((counts >= t) << np.arange(len(chosen))).sum(axis=1)].sum()  # noqa: B023, E731
            least = next(t for t in np.unique(counts)[::-1] if spoil(t) > k)
        place = (np.uint64(band) << np.uint64(40)) + np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
        out.append(_mix(sums + _mix(place + M1) + counts.astype(np.uint64) * M2)[counts >= least])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable. Min labels with pointer jumping."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left")
        step = cut(step.select("id", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label")), "step")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        after = step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
        after = cut(after, "labels")
        moved = after.where("was != label").limit(1).count()
        discard(labels, step)
        if not moved:
            discard(edges)
            out = after.select("id", F.col("label").alias("component"))
            out.cut_path = after.cut_path
            return out
        labels = after.select("id", "label")
        labels.cut_path = after.cut_path


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, partners: int = 256) -> DataFrame:
    """The pairs (a, b) whose shingle sets have den * |intersection| >= num * |union|.

    The partners of each a are dealt into groups of about `partners`, each with its own copy of a, so a group is bounded.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / partners).alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    wanted = dealt.select(F.col("b").alias("id"), "a", "salt").union(dealt.select(F.col("a").alias("id"), "a", "salt").distinct())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, last = _WordHashes(), (None, None, b"")
        for rows in batches:
            out = []
            for i, t in zip(rows["id"], rows["text"], strict=True):
                if (i, t) != last[:2]:
                    last = (i, t, shingle_hashes(t, k, seen).tobytes())
                out.append(last[2])
            yield pd.DataFrame({"a": rows["a"], "salt": rows["salt"], "id": rows["id"], "s": out})

    held = texts.join(wanted, "id").mapInPandas(sets, "a long, salt long, id long, s binary")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        hub, found = int(rows["a"].iloc[0]), set()
        own = rows["id"] == hub
        for x in (np.frombuffer(s, np.uint64) for s in rows["s"][own].unique() if len(s)):
            for i, s in zip(rows["id"][~own], rows["s"][~own], strict=True):
                y = np.frombuffer(s, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if len(y) and den * both >= num * (len(x) + len(y) - both):
                    found.add(i)
        return pd.DataFrame({"a": np.full(len(found), hub, np.int64), "b": np.array(sorted(found), np.int64)})

    return held.groupBy("a", "salt").applyInPandas(linked, "a long, b long")


def _among(rows: DataFrame, ids: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows whose id is one of `ids`. Others leave before the join by a table of bits of a fixed size, so that their texts are not shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    found = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}L) % 64 as int))")).alias("mask")).toPandas()  # `bits` / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.where(held(place)).join(ids.select("id").distinct(), "id", "left_semi")


def _rare_pairs(members: DataFrame, texts: DataFrame, k: int, num: int, den: int, cells: int = 1 << 18) -> DataFrame:
    """Pairs (a, b) of members (id, sig, c) that share a signature, lie in different components c and whose rarest elements
    meet. A set's prefix holds its n - ceil(t n) + 1 rarest elements; linked sets share one of those, so no link is lost.

    Elements go by the count of their cell, of `cells` cells of the hashed domain filled by all members, then by hash: any
    order that all sets follow keeps the guarantee. The table of cells has a fixed size, so tasks can hold it. At the
    first element both sets hold, what is left of either bounds the intersection.
    """
    chosen = cut(_among(texts, members), "chosen")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = _WordHashes(), np.zeros(cells, np.int64)
        for rows in batches:
            for t in rows["text"]:
                np.add.at(total, (shingle_hashes(t, k, seen) % np.uint64(cells)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "held": total[at]})

    counts = chosen.select("text").mapInPandas(count, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).toPandas()  # `cells` rows at most
    order = np.zeros(cells, np.int64)
    order[counts["cell"].to_numpy(np.int64)] = counts["held"].to_numpy(np.int64)
    shared = members.sparkSession.sparkContext.broadcast(order)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _WordHashes()
        for rows in batches:
            out = [np.empty((0, 4), np.int64)]
            for i, t in zip(rows["id"], rows["text"], strict=True):
                x = shingle_hashes(t, k, seen)
                n = len(x)
                first = np.lexsort((x, shared.value[(x % np.uint64(cells)).astype(np.int64)]))[: n + 1 + -n * num // den]
                out.append(np.column_stack([np.full(len(first), i), np.full(len(first), n), x[first].view(np.int64), np.arange(len(first))]))
            yield pd.DataFrame(np.concatenate(out), columns=["id", "n", "e", "before"])

    found = chosen.mapInPandas(rarest, "id long, n long, e long, before long").join(members.select("id", "c").distinct(), "id")
    found = cut(found, "prefixes")
    open_e = found.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("e")
    prefix = cut(found.join(open_e, "e", "left_semi"), "prefix")
    a, b = prefix.select("id", "n", "e", "before", "c").toDF("a", "n", "e", "pa", "ca"), prefix.select("id", "n", "e", "before", "c").toDF("b", "m", "e", "pb", "cb")
    met = a.join(b, "e").where("a < b and ca != cb").where(f"least(n, m) * {den} >= greatest(n, m) * {num}")
    met = cut(met.where(f"least(n - pa, m - pb) * {den + num} >= {num} * (n + m)").select("a", "b").distinct(), "rare")
    held = cut(members.groupBy("id").agg(F.collect_set("sig").alias("sigs")), "held")  # as many as one set signs
    both = met.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")
    pairs = cut(both.where(F.arrays_overlap("sa", "sb")).select("a", "b"), "cross")
    discard(chosen, found, prefix, met, held)
    return pairs


def similar_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = rows.where("id is not null")
    shape = "named boolean, id long, n long, key string, mark long, sigs array<bigint>"

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, done = _WordHashes(), set()  # marks of one partition: equal sets sign once
        for rows in batches:
            for start in range(0, len(rows), 500):
                some, out = rows.iloc[start : start + 500], []
                for named, i, t in zip(some["named"], some["id"], some["text"], strict=True):
                    x = shingle_hashes(t, k, seen)
                    key = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                    mark = int.from_bytes(key[:8], "little", signed=True)
                    new = named and mark not in done
                    if new:
                        done.add(mark)
                    out.append((named, i, len(x), key.hex(), mark, signatures(x, num, den) if new else x[:0].view(np.int64)))
                yield pd.DataFrame(out, columns=["named", "id", "n", "key", "mark", "sigs"])

    # A null doc_id travels as 0 with a flag: beside a null, pandas would hold 64-bit ids as rounded floats.
    flagged = rows.select(F.col("id").isNotNull().alias("named"), F.coalesce("id", F.lit(0)).alias("id"), "text")
    wide = cut(flagged.mapInPandas(signed, shape), "signed")
    sets = cut(wide.drop("sigs"), "keys")
    classes = cut(sets.where("named and n > 0").groupBy("key", "mark", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("held")), "classes")

    # Signatures are dealt once: a join with the shared ones would shuffle all of them again.
    signs = wide.select("mark", F.explode("sigs").alias("sig"))
    by_sig, by_mark = Window.partitionBy("sig"), Window.partitionBy("mark")
    shared = signs.select("sig", "mark", F.min("mark").over(by_sig).alias("lo"), F.max("mark").over(by_sig).alias("hi")).where("lo != hi")
    met = cut(shared.select("sig", "mark").distinct().withColumn("size", F.count(F.lit(1)).over(by_sig)), "met")
    discard(wide)
    # From here on classes go by their smallest doc_id. Sets that share a mark by chance both stand for it.
    weighed = met.select("sig", "mark", F.sum("size").over(by_mark).alias("weight"))
    buckets = cut(weighed.join(classes, "mark").select("sig", F.col("rep").alias("id"), "n", "weight"), "buckets")
    # The member that meets others most often is compared with all of its bucket: of near copies that is often the original.
    hub = F.max(F.struct("weight", F.negative("id").alias("last"), "n")).over(by_sig)
    near = f"least(n, m) * {den} >= greatest(n, m) * {num}"
    star = buckets.select("id", "n", hub.alias("hub")).selectExpr("-hub.last as a", "hub.n as m", "id as b", "n").where("a != b").where(near)
    star = cut(star.select("a", "b").distinct(), "star")
    pool = cut(_among(texts, buckets), "pool")
    links = cut(_verified(star, pool, k, num, den), "links")
    comps = components(links)
    # Members of a bucket that are not in one component yet are compared across components, but for the pairs done above.
    member = cut(buckets.join(comps, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("c")), "members")
    open_sigs = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi and m > 2").select("sig")
    opened = cut(member.join(open_sigs, "sig", "left_semi"), "open")
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = _rare_pairs(opened, pool, k, num, den)
    found = cut(_verified(cross.join(done, ["a", "b"], "left_anti"), pool, k, num, den), "links")
    comps = components(links.union(found))

    reach = classes.join(comps, classes["rep"] == comps["id"], "left").select("key", F.coalesce("component", "rep").alias("component"), "held", "rep")
    # Classes of one document are their own answer; the rest are joined by key.
    reach = cut(reach.where("held > 1 or component != rep"), "reach")
    discard(met, buckets, star, pool, links, member, opened, cross, found, comps, classes)
    out = sets.join(reach.select("key", "component"), "key", "left")
    ids = F.when(F.col("named"), F.col("id"))
    return out.select(ids.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("named") & (F.col("n") > 0), F.coalesce("component", "id")).otherwise(ids).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The columns of docs, with one document of each component: that with the smallest doc_id."""
    found = similar_components(docs, k, num, den)
    gone = cut(found.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti")
