"""Ordered per-key state: window forms where they are exact, one bounded-memory fold where they are not."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order. Rows without a key are dealt by their order, so that they fill no single task."""
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return rows.repartition(F.when(lost, F.xxhash64(*order)).otherwise(F.xxhash64(*keys))).sortWithinPartitions(*keys, *order)


def _values(column: pa.Array) -> list:
    """Exact Python values; numbers without a null, which are most, by way of numpy."""
    plain = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def fold(
    rows: DataFrame, key: str | list[str], order: list[str], new: Callable[[], object], step: Callable[[object, dict], object], result: str, kind: str, reads: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """rows with `result` = step(state, row), rows of a key in order.

    Batches stream through and only the present key's state is held. The state sees the columns `reads` (all, if None) as
    exact Python values; the batches themselves are passed on untouched. Rows with a null key are kept with a null result.
    With `keep` only those columns are passed on, and no others than these, the key, the order and what is read are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    seen = list(dict.fromkeys([*keys, *(rows.columns if reads is None else reads)]))
    kept = rows.columns if keep is None else keep
    rows = rows if keep is None else rows.select(*dict.fromkeys([*seen, *order, *keep]))
    schema = StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL(f"`{result}` {kind}").fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, state = None, None
        for batch in batches:
            out = []
            for values in zip(*map(_values, batch.select(seen).columns), strict=True):
                at = values[: len(keys)]
                if None in at:
                    out.append(None)
                    continue
                row = dict(zip(seen, values, strict=True))
                if at != present:
                    present, state = at, new()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*(batch if keep is None else batch.select(keep)).columns, pa.array(out, arrow.field(len(arrow) - 1).type)], names=schema.names)

    return _in_order(rows, keys, order).mapInArrow(run, schema)


def unfold(
    rows: DataFrame, key: str | list[str], order: list[str], new: Callable[[], object], step: Callable[[object, dict], list[dict]], done: Callable[[object], list[dict]], schema: str
) -> DataFrame:
    """The rows that step(state, row) gives for each row of a key in order, and done(state) behind its last. Rows with a null key give none."""
    keys = [key] if isinstance(key, str) else key
    shape = StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                at = tuple(row[k] for k in keys)
                if None in at:
                    continue
                if at != present:
                    if present is not None:
                        out += done(state)
                    present, state = at, new()
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if present is not None:
            yield pa.RecordBatch.from_pylist(done(state), arrow)

    return _in_order(rows, keys, order).mapInArrow(run, shape)


def paced(packets: DataFrame, key: str, per_window: int, window_us: int) -> DataFrame:
    """packets with `admitted`: at least window / per_window lies between admitted packets of a key. For displays, never before an aggregate."""
    gap = window_us // per_window

    def step(state: dict, row: dict) -> bool:
        ok = "last" not in state or row["ts_us"] - state["last"] >= gap
        if ok:
            state["last"] = row["ts_us"]
        return ok

    return fold(packets, key, ["ts_us", "ordinal"], dict, step, "admitted", "boolean", ["ts_us"])


def handshake_rtt(packets: DataFrame, key: str, syn: Column, syn_ack: Column) -> DataFrame:
    """(key, rtt_us): from the last SYN before the key's last answered SYN-ACK."""
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    timed = packets.withColumn("_rtt", F.when(syn_ack, F.col("ts_us") - F.last(F.when(syn, F.col("ts_us")), ignorenulls=True).over(w)))
    return timed.groupBy(key).agg(F.max_by("_rtt", F.when(F.col("_rtt").isNotNull(), F.col("ordinal"))).alias("rtt_us"))


def sticky(packets: DataFrame, key: str, label: Column, fallback: Column, name: str = "app_now") -> DataFrame:
    """packets with the newest label of their key so far, else the fallback."""
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return packets.withColumn(name, F.coalesce(F.last(label, ignorenulls=True).over(w), fallback))


def zero_window_spans(samples: DataFrame, key: str) -> DataFrame:
    """(key, outbound, from_us, to_us, open): spans in which a side advertises a window of zero.

    samples: key, index, ts_us, outbound, win, rst. A zero holds until that side's next advertisement that is none; resets
    advertise nothing; a gap of the index ends a span at the last sample before it, and one still open runs to the newest.
    """
    order = Window.partitionBy(key).orderBy("index")
    runs = samples.withColumn("_run", F.sum(F.coalesce((F.col("index") != F.lag("index").over(order) + 1).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(key, "_run")
    runs = runs.withColumns({"_end": F.max(F.struct("index", "ts_us")).over(whole), "_last": F.max("index").over(Window.partitionBy(key))})
    own = Window.partitionBy(key, "_run", "outbound").orderBy("index")
    later = own.rowsBetween(1, Window.unboundedFollowing)
    said = runs.where(~F.col("rst")).withColumn("_zero", F.col("win") == 0)
    said = said.withColumns({"_new": F.col("_zero") & ~F.coalesce(F.lag("_zero").over(own), F.lit(False)), "_until": F.min(F.when(~F.col("_zero"), F.struct("index", "ts_us"))).over(later)})
    still = F.col("_until").isNull() & (F.col("_end.index") == F.col("_last"))
    return said.where("_new").select(key, "outbound", F.col("ts_us").alias("from_us"), F.coalesce("_until.ts_us", "_end.ts_us").alias("to_us"), still.alias("open"))


def islands(rows: DataFrame, key: str, index: str) -> DataFrame:
    """(key, line, first, last, points): runs of consecutive indexes."""
    w = Window.partitionBy(key).orderBy(index)
    runs = rows.select(key, index).distinct().withColumn("_i", F.col(index) - F.row_number().over(w))
    out = runs.groupBy(key, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("points"))
    return out.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy("first"))).drop("_i")


def history(series: DataFrame, key: str, at: str, value: str, n: int = 60) -> DataFrame:
    """rows with the last n values of their key, oldest first."""
    return series.withColumn("history", F.collect_list(value).over(Window.partitionBy(key).orderBy(at).rowsBetween(1 - n, 0)))


def throughput(samples: DataFrame, key: str, bin_us: int, from_us: int | None = None, to_us: int | None = None, most: int = 200) -> DataFrame:
    """(key, bin_us, outbound_bytes, inbound_bytes): payload each way in every bin that the samples cover whole, zeros included.

    samples: key, index, ts_us, outbound, bytes, syn, rst, fin. The first bin is whole if the flow is held from its SYN, the
    last one if it has ended: by a reset, or by a FIN each way. from_us, to_us: the range that is looked at; without both,
    a flow keeps the newest `most` bins, so that one long open does not grow without bound.
    """
    at = lambda c: F.floor(c / F.lit(bin_us)).cast("bigint")
    out = F.col("outbound")
    spans = samples.groupBy(key).agg(
        F.min_by(F.struct("index", "syn", "ts_us"), "index").alias("h"), F.max("ts_us").alias("z"), F.min("ts_us").alias("a"),
        (F.bool_or("rst") | F.bool_or(F.col("fin") & out) & F.bool_or(F.col("fin") & ~out)).alias("ended"))
    first = F.when((F.col("h.index") == 0) & F.col("h.syn"), at(F.col("a"))).otherwise(F.ceil(F.col("a") / F.lit(bin_us)).cast("bigint"))
    last = at(F.col("z")) - F.when(F.col("ended"), 0).otherwise(1)
    first = F.greatest(first, at(F.lit(from_us))) if from_us is not None else F.greatest(first, last - (most - 1)) if to_us is None else first
    last = F.least(last, F.ceil(F.lit(to_us) / F.lit(bin_us)).cast("bigint") - 1) if to_us is not None else last
    spine = spans.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("_b"))
    each = lambda which: F.sum(F.when(which, F.col("bytes")).otherwise(0))
    sums = samples.where("bytes > 0").groupBy(key, at(F.col("ts_us")).alias("_b")).agg(each(out).alias("o"), each(~out).alias("i"))
    return spine.join(sums, [key, "_b"], "left").select(key, (F.col("_b") * bin_us).alias("bin_us"), F.coalesce("o", F.lit(0)).alias("outbound_bytes"), F.coalesce("i", F.lit(0)).alias("inbound_bytes"))


def covered(series: DataFrame, width_us: int) -> DataFrame:
    """All buckets of each series from its first to its last; those without a packet count zero."""
    spine = series.groupBy("series").agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("b")).select("series", F.explode(F.sequence("a", "b", F.lit(width_us))).alias("bucket_us"))
    return spine.join(series.select("series", "bucket_us", "packets", "bytes"), ["series", "bucket_us"], "left").na.fill(0, ["packets", "bytes"])


def ended(packets: DataFrame, key: str, rst: Column, fin: Column) -> DataFrame:
    """(key, ended): a reset, or a FIN each way."""
    return packets.groupBy(key).agg((F.bool_or(rst) | F.bool_or(fin & F.col("outbound")) & F.bool_or(fin & ~F.col("outbound"))).alias("ended"))


def findings(marked: DataFrame, flow: str = "flow", order: str = "idx") -> DataFrame:
    """Retransmissions (warning) and each flow's first reset (note), from segments marked by `tcp.retransmits`."""
    first = F.row_number().over(Window.partitionBy(flow, "rst").orderBy(order)) == 1
    hits = F.array_compact(F.array(F.when(F.col("retransmit"), F.struct(F.lit("retransmission").alias("code"), F.lit("warning").alias("severity"))), F.when(F.col("rst") & F.col("_first"), F.struct(F.lit("connection-reset").alias("code"), F.lit("note").alias("severity")))))
    return marked.withColumn("_first", first).select("*", F.explode(hits).alias("_f")).select(*marked.columns, "_f.*")
