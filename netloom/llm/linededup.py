"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased; keys under `min_len` code
points never count. The state is three tables: postings (key, doc_id), references (key, refs, owner), where owner is
the smallest doc_id holding the key, and one cuckoo filter for each shard of the keys that two documents or more hold.
A line goes if its key has an owner other than its own document. Filters only save exact lookups: what passes them is
looked up in the reference table, so false positives change nothing. Filters of `broadcast_bytes` or less together are
broadcast; larger ones stay where they are, and the keys are dealt to their shard in blocks of bounded size.

Edge cases: a null or empty text is one empty line; null doc_ids hold no keys and lose nothing; rows that repeat a doc_id
count as one document; an empty table gives empty results; extra columns of any name
stay in `dedup_lines` and are ignored elsewhere; of equal lines in one document all stay or all go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import LOWER, UPPER, ascii_lower, cut, fresh

BLANK = " \t\n\x0b\x0c\r"
LOWER_ASCII = str.maketrans(UPPER, LOWER)
SLOTS = 4
#: Shared keys a shard is made for; at twice as many on average the keys are dealt anew. LAYERS is how many updates a table stacks up before it is written whole.
SHARD_KEYS, LAYERS = 200_000, 8


class CuckooFilter:
    """16-bit fingerprints in buckets of four; 0 marks a free slot. Insertion works on whole arrays of hashes."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        size = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.6 + 1))))
        self.table = np.zeros((size, SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # mixed, as all hashes of a shard have one remainder
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        h = h ^ (h >> np.uint64(33))
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (at ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def insert(self, hashes: np.ndarray, kicks: int = 500) -> None:
        mark, at, _ = self._places(hashes)
        rng = np.random.default_rng(0)
        for turn in range(kicks):
            if not len(mark):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            alone = np.r_[True, at[1:] != at[:-1]]  # one newcomer a bucket and turn
            m, a = mark[alone], at[alone]
            free = self.table[a] == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), rng.integers(0, SLOTS, len(a)))
            out = self.table[a, slot].copy()
            self.table[a, slot] = m
            kicked = out != 0
            wait_m, wait_a = mark[~alone], at[~alone]
            if turn % 2 == 0:
                wait_a = self._other(wait_a, wait_m)
            mark, at = np.r_[out[kicked], wait_m], np.r_[self._other(a[kicked], out[kicked]), wait_a]
        grown = len(mark)
        raise OverflowError(f"{grown} keys found no slot; give the filter more capacity")

    def delete(self, hashes: np.ndarray) -> None:
        for m, a, b in zip(*self._places(hashes), strict=True):
            for place in (a, b):
                if len(slot := np.flatnonzero(self.table[place] == m)):
                    self.table[place, slot[0]] = 0
                    break

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)


def _line_keys(text: Column, min_len: int) -> Column:
    """The text's distinct keys that count, as md5 in hex."""
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    return F.array_distinct(F.transform(F.filter(keys, lambda x: F.char_length(x) >= min_len), lambda x: F.md5(x)))


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard's keys."""
    capacity = len(rows)
    while True:
        made = CuckooFilter(capacity)
        try:
            made.insert(rows["h"].to_numpy())
        except OverflowError:
            capacity *= 2
        else:
            return pd.DataFrame({"shard": rows["shard"].iloc[:1], "filter": [made.table.tobytes()]})


def _loaded(blob: bytes) -> CuckooFilter:
    return CuckooFilter(0, np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())


def _turned(stored: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its keys came and went; null if they do not fit."""
    gone, come = (moves["h"][moves["come"] == x].to_numpy() for x in (False, True))
    made = _loaded(stored["filter"].iloc[0]) if len(stored) else CuckooFilter(len(come))
    made.delete(gone)
    fits = np.count_nonzero(made.table) + len(come) <= 0.9 * made.table.size
    try:
        if fits:
            made.insert(come)
    except OverflowError:
        fits = False
    return pd.DataFrame({"shard": moves["shard"].iloc[:1], "filter": [made.table.tobytes() if fits else None]})


def _passed(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    return asked[_loaded(stored["filter"].iloc[0]).contains(asked["h"].to_numpy())] if len(stored) and len(asked) else asked.iloc[:0]


def _postings(docs: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    lines = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return lines.select("doc_id", F.explode(_line_keys(F.col("text"), min_len)).alias("key"))


def _shared(postings: DataFrame) -> DataFrame:
    refs = postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    return refs.where("owner != last").select("key", F.xxhash64("key").alias("h"), "refs", "owner")


def _shard(shards: int) -> Column:
    return F.pmod("h", F.lit(shards)).cast("int").alias("shard")


@dataclass
class LineIndex:
    """The tables of the state. `insert` and `delete` return a new index; both are exact inverses of each other. They make
    counts and filters anew only in the shards they touch; the postings are written whole."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    layers: int = 0

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 10, shards: int | None = None, once: bool = False) -> LineIndex:
        """`once`: no two rows share a doc_id, or the counts are not used; else repeated rows are made one before they count."""
        postings = _postings(docs, id_col, text_col, min_len)
        return cls._of(postings if once else postings.distinct(), shards)

    @classmethod
    def _of(cls, postings: DataFrame, shards: int | None) -> LineIndex:
        shared = cut(_shared(postings), "refs")
        shards = shards or max(1, -(-shared.count() // SHARD_KEYS))
        sharded = shared.select(_shard(shards), "h")
        filters = cut(sharded.groupBy("shard").applyInPandas(_filled, "shard int, filter binary"), "cuckoo")
        return cls(postings, shared, filters, shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 10) -> LineIndex:
        """Rows whose (key, doc_id) is there already change nothing."""
        more = cut(_postings(docs, id_col, text_col, min_len).distinct(), "more")
        fresh = more.join(self.postings, ["doc_id", "key"], "left_anti")
        return self._updated(cut(self.postings.union(more).distinct(), "postings"), fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forget these documents: counts drop, owners pass to the next smallest doc_id."""
        gone = doc_ids.select("doc_id").distinct()
        return self._updated(cut(self.postings.join(gone, "doc_id", "left_anti"), "postings"), self.postings.join(gone, "doc_id", "left_semi"))

    def _updated(self, postings: DataFrame, changed: DataFrame) -> LineIndex:
        keys = cut(changed.select("key").distinct(), "changed")
        now = cut(_shared(postings.join(keys, "key", "left_semi")), "now")
        was = self.refs.join(keys, "key", "left_semi")
        touched = keys.select(F.xxhash64("key").alias("h")).select(_shard(self.shards)).distinct()
        # Stored counts of the touched shards, without the keys that changed, and those as they are now.
        mine = self.refs.withColumn("shard", _shard(self.shards)).join(F.broadcast(touched), "shard", "left_semi").join(keys, "key", "left_anti")
        made = cut(mine.select(*now.columns).union(now), "refs")
        rest = self.refs.withColumn("shard", _shard(self.shards)).join(F.broadcast(touched), "shard", "left_anti")
        refs = rest.select(*now.columns).union(made)
        come = now.join(was, "key", "left_anti").select(_shard(self.shards), "h", F.lit(True).alias("come"))
        gone = was.join(now, "key", "left_anti").select(_shard(self.shards), "h", F.lit(False).alias("come"))
        moves = cut(come.union(gone), "moves")
        moved = F.broadcast(moves.select("shard").distinct())
        stored = self.filters.join(moved, "shard", "left_semi")
        turned = cut(stored.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(_turned, "shard int, filter binary"), "turned")
        full = F.broadcast(turned.where("filter is null").select("shard"))
        again = made.select(_shard(self.shards), "h").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_filled, "shard int, filter binary")
        filters = self.filters.join(moved, "shard", "left_anti").union(turned.where("filter is not null")).union(cut(again, "cuckoo"))
        layers = self.layers + 1
        if layers == LAYERS:
            refs, filters, layers = cut(refs, "refs"), cut(filters, "cuckoo"), 0
        if refs.count() > 2 * SHARD_KEYS * self.shards:
            return LineIndex._of(postings, None)
        return LineIndex(postings, refs, filters, self.shards, layers)

    def losses(self, broadcast_bytes: int = 64 << 20) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses."""
        asked = self.postings.select("doc_id", "key", F.xxhash64("key").alias("h"))
        size = self.filters.select(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        asked = self._broadcast_probe(asked) if size <= broadcast_bytes else self._dealt_probe(asked)
        lost = asked.select("doc_id", "key").join(self.refs.select("key", "owner"), "key").where("doc_id != owner")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def _broadcast_probe(self, asked: DataFrame) -> DataFrame:
        loaded = self.filters.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.toLocalIterator()})
        shards = self.shards

        @F.pandas_udf("boolean")
        def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            made = {k: CuckooFilter(0, np.frombuffer(v, np.uint16).reshape(-1, SLOTS)) for k, v in loaded.value.items()}
            for hashes in batches:
                h = hashes.to_numpy()
                shard, keep = h % shards, np.zeros(len(h), bool)
                for k, f in made.items():
                    keep[own] = f.contains(h[own]) if len(own := np.flatnonzero(shard == k)) else False
                yield pd.Series(keep)

        return asked.where(maybe("h"))

    def _dealt_probe(self, asked: DataFrame, block_keys: int = SHARD_KEYS) -> DataFrame:
        """Each shard's filter meets its keys in blocks of about `block_keys`, however often one key is held."""
        asked = asked.withColumn("shard", _shard(self.shards))
        blocks = cut(asked.groupBy("shard").count().selectExpr("shard", f"cast(ceil(count / {block_keys}) as int) as blocks"), "blocks")
        dealt = asked.join(F.broadcast(blocks), "shard").withColumn("block", F.expr("cast(pmod(xxhash64(doc_id, key), blocks) as int)")).drop("blocks")
        filters = self.filters.join(F.broadcast(blocks), "shard").selectExpr("shard", "explode(sequence(0, blocks - 1)) as block", "filter")
        return dealt.groupBy("shard", "block").cogroup(filters.groupBy("shard", "block")).applyInPandas(_passed, dealt.schema)


def _kept(text: str | None, keys: list[str] | None, min_len: int) -> tuple[str, int]:
    lines = (text or "").split("\n")
    gone = set(keys)
    key = lambda x: x.strip(BLANK).translate(LOWER_ASCII)
    kept = [x for x in lines if len(k := key(x)) < min_len or hashlib.md5(k.encode()).hexdigest() not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_len: int = 10, index: LineIndex | None = None) -> DataFrame:
    """All columns of `docs`, with `text` reduced to the lines that stay, and `n_lines`, `n_dropped` (in place of such columns of the input)."""
    index = index or LineIndex.build(docs, min_len=min_len, once=True)  # only whether a line is shared counts here
    held, made = fresh("lost_keys", docs), fresh("stripped", docs)
    both = docs.join(index.losses().withColumnRenamed("keys", held), "doc_id", "left")
    lines = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.length(lines) - F.length(F.replace(lines, F.lit("\n"))) + 1).cast("bigint")

    @F.pandas_udf("text string, n long")
    def strip(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_kept(t, k, min_len) if k is not None and len(k) else (t, 0) for t, k in zip(text, keys, strict=True)], columns=["text", "n"])

    cols = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    out = both.withColumn(made, strip("text", held))
    return out.select(*cols, F.col(f"{made}.text").alias("text"), n_lines.alias("n_lines"), F.col(f"{made}.n").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
