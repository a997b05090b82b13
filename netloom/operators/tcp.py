"""Ordered TCP operators: native windows, and a fold for round trips."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.folds import fold

HALF, WHOLE = 1 << 31, 1 << 32


def retransmits(segments: DataFrame, flow: str = "flow", order: str = "idx", side: str = "outbound", size: str = "len") -> DataFrame:
    """segments with `retransmit`. Only segments with payload count, each direction for itself: sequence numbers are unwrapped
    by signed 32-bit steps, and a segment that does not pass the highest number so far is sent again."""
    # Dealt by flow alone, which serves the windows of both directions and any group by flow that comes after.
    rows = segments.repartition(flow).withColumn("_data", F.col(size) > 0)
    w = Window.partitionBy(flow, side, "_data").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.pmod(F.col("seq") - F.lag("seq").over(w) + HALF, F.lit(WHOLE)) - HALF
    out = rows.withColumn("_step", F.coalesce(step, F.lit(0))).withColumn("_at", F.sum("_step").over(so_far))
    highest = F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("retransmit", F.col("_data") & F.coalesce(F.col("_at") <= highest, F.lit(False))).drop("_step", "_at", "_data")


def loss_percent(marked: DataFrame, flow: str = "flow", size: str = "len") -> DataFrame:
    """Retransmissions among segments with payload, in percent; 0 without any."""
    sums = marked.groupBy(flow).agg(F.count_if(F.col(size) > 0).alias("segments"), F.count_if("retransmit").alias("retransmits"))
    return sums.withColumn("loss", F.when(F.col("segments") > 0, F.least(F.lit(100.0), F.col("retransmits") * 100.0 / F.col("segments"))).otherwise(0.0))


def first_reset(segments: DataFrame, flow: str = "flow", order: str = "idx") -> DataFrame:
    """Per flow: whether it was reset, and the bytes up to and with the first reset."""
    w = Window.partitionBy(flow).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("rst").cast("int")).over(w), F.lit(0)) == 0
    return segments.withColumn("_b", before).groupBy(flow).agg(F.max("rst").alias("reset"), F.sum(F.when(F.col("_b"), F.col("bytes")).otherwise(0)).alias("bytes_until"))


def turns(pieces: DataFrame, stream: str, order: str, side: str, size: str) -> DataFrame:
    """Follow-stream turns: runs of one side, with their start offset among that side's bytes."""
    w = Window.partitionBy(stream).orderBy(order)
    start = F.coalesce(F.sum(size).over(Window.partitionBy(stream, side).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.coalesce((F.col(side) != F.lag(side).over(w)).cast("int"), F.lit(1))
    runs = pieces.withColumns({"_s": start, "_f": fresh}).withColumn("turn", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(stream, "turn", side).agg(F.min("_s").alias("start"), F.sum(size).alias("length"))


#: Fixed value: the largest window shift that counts.
MAX_SHIFT = 14


def scaled_windows(samples: DataFrame, key: str) -> DataFrame:
    """samples (key, index, outbound, syn, ack, win, wscale) with `window` and `scaled`.

    Scaling holds once each side's first SYN was seen, one of them with an ACK and both with the option; a SYN's own window
    is never scaled. Shifts above MAX_SHIFT count as that.
    """
    so_far = Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda side: F.first(F.when(F.col("syn") & (F.col("outbound") == F.lit(side)), F.struct("ack", F.least(F.col("wscale"), F.lit(MAX_SHIFT)).alias("shift"))), ignorenulls=True).over(so_far)
    seen = samples.withColumns({"_l": first(True), "_r": first(False)})
    agreed = F.coalesce((F.col("_l.ack") != F.col("_r.ack")) & F.col("_l.shift").isNotNull() & F.col("_r.shift").isNotNull() & ~F.col("syn"), F.lit(False))
    shift = F.when(F.col("outbound"), F.col("_l.shift")).otherwise(F.col("_r.shift"))
    factor = F.element_at(F.array(*[F.lit(1 << i) for i in range(MAX_SHIFT + 1)]), F.coalesce(shift, F.lit(0)) + 1)
    return seen.withColumns({"scaled": agreed, "window": F.when(agreed, F.col("win") * factor).otherwise(F.col("win"))}).drop("_l", "_r")


#: Fixed value: segments of a direction that wait for their ACK.
MAX_OUTSTANDING = 256


def ack_rtts(samples: DataFrame, key: str) -> DataFrame:
    """samples (key, index, ts_us, outbound, seq, ack, has_ack, len, retransmit) with `rtt_us`, else null.

    An ACK answers all data of the other side that it covers; the newest of it gives the round trip. After a retransmission
    no ACK of bytes from there on can be told apart, so what was sent from there on is forgotten (Karn's rule). At most
    MAX_OUTSTANDING segments a direction wait, the oldest go first. Sequence numbers compare by signed 32-bit distance.
    """
    passed = lambda a, b: 0 < (a - b) % WHOLE < HALF

    def step(waiting: dict[bool, deque], row: dict) -> int | None:
        own, peer, sent = waiting[bool(row["outbound"])], waiting[not row["outbound"]], None
        while row["has_ack"] and peer and not passed(peer[0][0], int(row["ack"])):
            sent = peer.popleft()[1]
        if row["len"] > 0 and row["retransmit"]:
            while own and passed(own[-1][0], int(row["seq"])):
                own.pop()
        elif row["len"] > 0:
            own.append(((int(row["seq"]) + int(row["len"])) % WHOLE, row["ts_us"]))
        return None if sent is None else max(0, int(row["ts_us"] - sent))

    return fold(samples, key, ["index"], lambda: {side: deque(maxlen=MAX_OUTSTANDING) for side in (True, False)}, step, "rtt_us", "long", ["ts_us", "outbound", "seq", "ack", "has_ack", "len", "retransmit"])


def ladder(samples: DataFrame, key: str, notable: Column, drawn: int = 4, most: int = 200) -> DataFrame:
    """(key, place, kind, at, segments, rows, out_data, out_bytes, out_acks, in_data, in_bytes, in_acks, span_us): a flow's rows.

    samples: key, index, ts_us, outbound, len. Notable segments and the first payload of each side are arrows; other
    segments between them are arrows too, or one `run` where more than `drawn`. A `gap` stands where indexes are missing
    (`segments` of them). Beyond `most` rows a flow keeps the first and last half; the middle is one `elided` row.
    """
    order = Window.partitionBy(key).orderBy("index")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = (F.col("len") > 0) & (F.row_number().over(Window.partitionBy(key, "outbound", F.col("len") > 0).orderBy("index")) == 1)
    s = samples.withColumns({"_hit": F.coalesce(notable, F.lit(False)) | opening, "_gap": F.coalesce(F.col("index") - F.lag("index").over(order) - 1, F.lit(0))})
    fresh = F.col("_hit") | F.coalesce(F.lag("_hit").over(order), F.lit(True)) | (F.col("_gap") > 0)
    s = s.withColumn("_run", F.sum(fresh.cast("int")).over(so_far))
    s = s.withColumn("_long", F.count(F.lit(1)).over(Window.partitionBy(key, "_run")) > drawn)
    each = lambda which, what=1: F.sum(F.when(which, what).otherwise(0)).cast("bigint")
    out, data = F.col("outbound"), F.col("len") > 0
    rows = s.groupBy(key, "_run", "_long", F.when(~F.col("_long"), F.col("index")).alias("_own")).agg(
        F.min("index").cast("bigint").alias("at"), F.count(F.lit(1)).alias("segments"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
        each(out & data).alias("out_data"), each(out, F.col("len")).alias("out_bytes"), each(out & ~data).alias("out_acks"),
        each(~out & data).alias("in_data"), each(~out, F.col("len")).alias("in_bytes"), each(~out & ~data).alias("in_acks"))
    rows = rows.withColumn("kind", F.when(F.col("_long"), "run").otherwise("arrow")).drop("_run", "_long", "_own")
    gaps = s.where("_gap > 0").select(key, F.col("index").cast("bigint").alias("at"), F.col("_gap").cast("bigint").alias("segments"), F.lit("gap").alias("kind"))
    rows = rows.unionByName(gaps, allowMissingColumns=True)
    half = most // 2
    placed = rows.withColumns({"_p": F.row_number().over(Window.partitionBy(key).orderBy("at", F.col("kind") != "gap")), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    middle = (F.col("_n") > most) & (F.col("_p") > half) & (F.col("_p") <= F.col("_n") - half)
    place = F.when(middle, half + 1).when((F.col("_n") > most) & (F.col("_p") > half), F.col("_p") - F.col("_n") + most + 1).otherwise(F.col("_p"))
    placed = placed.withColumns({"_middle": middle, "place": place.cast("int"), "segments": F.when(middle & (F.col("kind") == "gap"), 0).otherwise(F.col("segments"))})
    sums = ["segments", "span_us", "out_data", "out_bytes", "out_acks", "in_data", "in_bytes", "in_acks"]
    whole = placed.groupBy(key, "place", "_middle").agg(F.first("kind").alias("kind"), F.min("at").alias("at"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums])
    blank = lambda c: F.when(~F.col("_middle"), F.col(c)).alias(c)
    return whole.select(key, "place", F.when(F.col("_middle"), "elided").otherwise(F.col("kind")).alias("kind"), "at", "rows", "segments", *[blank(c) for c in sums[1:]])
