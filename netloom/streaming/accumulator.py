"""The IO accumulator as one stateful operator: it counts on-time and late packets of all series apart, closes buckets and drops nothing.

A bucket closes once the newest packet is past its end by the grace. A packet is late where its bucket lies before that of the
first packet, or of the newest earlier one less the grace: it counts in its own bucket, on an axis of its own. Time from the
first bucket up to the last closed one is covered, so that an empty bucket is a measured zero. A row with `end` closes the
source: everything up to the newest packet's bucket is given out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Fixed values in microseconds.
WIDTH_US, GRACE_US = 100_000, 500_000
RAW = "source string, kind string, series string, bucket_us bigint, until_us bigint, packets bigint, bytes bigint, agg_count bigint, agg_sum string, agg_min string, agg_max string"
SUMS = ["packets", "bytes", "n", "sum", "min", "max"]


def added(a: list | None, b: list) -> list:
    """Two sums of one bucket."""
    if a is None:
        return b
    known = lambda x, y, f: y if x is None else x if y is None else f(x, y)
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], known(a[4], b[4], min), known(a[5], b[5], max)]


class Accumulator(StatefulProcessor):
    """State of a source: its first bucket, newest time, up to where it has closed, and the sums of open buckets."""

    def __init__(self, series: list[str], width_us: int, grace_us: int) -> None:
        self.series, self.width, self.grace = series, width_us, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("open", "held string")

    def _sums(self, rows: pd.DataFrame, which: pd.Series) -> dict[tuple[int, int], list]:
        out: dict[tuple[int, int], list] = {}
        for i in range(len(self.series)):
            for bucket, some in rows[which & rows[f"p{i}"]].groupby("bucket"):
                values = [int(v) for v in some["value"] if v]
                out[int(bucket), i] = [len(some), int(some["bytes"].sum()), len(values), sum(values), min(values, default=None), max(values, default=None)]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("ordinal")
        ending, batch = bool(batch["end"].any()), batch[~batch["end"]]
        at = json.loads(self.held.get()[0]) if self.held.exists() else None
        out: list[tuple] = []
        if len(batch):
            at = at or {"first": int(batch["ts_us"].iloc[0]) // self.width, "newest": int(batch["ts_us"].iloc[0]), "closed": None, "open": []}
            before = batch["ts_us"].cummax().shift(fill_value=at["newest"]).clip(lower=at["newest"])
            batch = batch.assign(bucket=batch["ts_us"] // self.width)
            late = batch["bucket"] < ((before - self.grace) // self.width).clip(lower=at["first"])
            at["newest"] = max(at["newest"], int(batch["ts_us"].max()))
            open_sums = {(b, i): s for b, i, s in at["open"]}
            for k, s in self._sums(batch, ~late).items():
                open_sums[k] = added(open_sums.get(k), s)
            at["open"] = [(*k, s) for k, s in open_sums.items()]
            out += [(key[0], "late", self.series[i], b * self.width, (b + 1) * self.width, *self._told(s)) for (b, i), s in self._sums(batch, late).items()]
        if at is not None:
            edge = at["newest"] // self.width + 1 if ending else max((at["newest"] - self.grace) // self.width, at["first"])
            out += [(key[0], "bucket", self.series[i], b * self.width, (b + 1) * self.width, *self._told(s)) for b, i, s in at["open"] if b < edge]
            start = at["first"] if at["closed"] is None else at["closed"]
            if edge > start:
                out.append((key[0], "covered", None, start * self.width, edge * self.width, None, None, None, None, None, None))
            at.update(closed=max(edge, start), open=[x for x in at["open"] if x[0] >= edge])
            self.held.update((json.dumps(at),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RAW.split(", ")]).astype({c: "Int64" for c in ("packets", "bytes", "agg_count")})

    @staticmethod
    def _told(s: list) -> tuple:
        text = lambda x: None if x is None else str(x)
        return s[0], s[1], s[2], text(s[3] if s[2] else None), text(s[4]), text(s[5])

    def close(self) -> None:
        pass


def accumulate(packets: DataFrame, series: dict[str, Column], source: str = "source", value: Column | None = None, end: Column | None = None, width_us: int = WIDTH_US, grace_us: int = GRACE_US) -> DataFrame:
    """(source, kind, series, bucket_us, until_us, packets, bytes, agg_count, agg_sum, agg_min, agg_max) of a stream of packets (source, ordinal, ts_us, bytes).

    kind: `bucket` on-time sums, given out once a bucket is closed; `late` sums of late packets, to be added to those of their
    bucket; `covered` a span that has been watched. A bucket without rows in a covered span is zero.
    """
    v = F.lit(None).cast("string") if value is None else value.cast("string")
    flags = [F.coalesce(p, F.lit(False)).alias(f"p{i}") for i, p in enumerate(series.values())]
    over = F.lit(False) if end is None else F.coalesce(end, F.lit(False))
    rows = packets.select(F.col(source).cast("string").alias("source"), "ordinal", F.coalesce("ts_us", F.lit(0)).alias("ts_us"), F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("bytes"), v.alias("value"), over.alias("end"), *flags)
    machine = Accumulator(list(series), width_us, grace_us)
    out = rows.groupBy("source").transformWithStateInPandas(machine, StructType.fromDDL(RAW), "Append", "None")
    return out.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("agg_sum", "agg_min", "agg_max")})


def totals(given: DataFrame) -> DataFrame:
    """(series, bucket_us, packets, bytes, agg_count, agg_sum, agg_min, agg_max, late_packets, late_bytes) over all sources, as `operators.series.io_series` gives."""
    on_time, late = F.col("kind") == "bucket", F.col("kind") == "late"
    each = lambda which, c: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0)).cast("bigint")
    return given.where(on_time | late).groupBy("series", "bucket_us").agg(
        each(on_time, "packets").alias("packets"), each(on_time, "bytes").alias("bytes"), each(on_time, "agg_count").alias("agg_count"), F.sum(F.when(on_time, F.col("agg_sum"))).cast("decimal(38,0)").alias("agg_sum"),
        F.min(F.when(on_time, F.col("agg_min"))).alias("agg_min"), F.max(F.when(on_time, F.col("agg_max"))).alias("agg_max"), each(late, "packets").alias("late_packets"), each(late, "bytes").alias("late_bytes"))
