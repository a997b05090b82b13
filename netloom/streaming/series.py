"""Streaming forms: `late_split` marks late packets and drops none; `buckets` counts windows and, as Spark does, drops what comes after the grace, so chain it after the split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late_split(packets: DataFrame, source: str, width_us: int, grace_us: int) -> DataFrame:
    """packets (source, ordinal, ts_us, bytes) with `late`, as series.late_split, over micro-batches. State: first and newest time of a source."""

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ordinal")
        first, newest = state.get if state.exists else (int(rows["ts_us"].iloc[0]), None)
        before = rows["ts_us"].cummax().shift(fill_value=newest if newest is not None else first)
        before = before if newest is None else before.clip(lower=newest)
        floor = ((before - grace_us) // width_us).clip(lower=first // width_us)
        top = int(rows["ts_us"].max())
        state.update((first, top if newest is None else max(top, newest)))
        yield rows.assign(late=rows["ts_us"] // width_us < floor)

    cols = packets.select(source, "ordinal", "ts_us", "bytes")
    kind = cols.schema[source].dataType.simpleString()
    return cols.groupBy(source).applyInPandasWithState(mark, f"`{source}` {kind}, ordinal long, ts_us long, bytes long, late boolean", "first long, newest long", "append", GroupStateTimeout.NoTimeout)


def buckets(packets: DataFrame, width: str, grace: str, *keys: str) -> DataFrame:
    """Packets and bytes of each tumbling window, given out once the newest time has passed its end by the grace."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", grace)
    out = timed.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    return out.select(*keys, F.unix_micros("w.start").alias("bucket_us"), "packets", "bytes")
