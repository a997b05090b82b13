"""Table views: searches, sorts, newest-first pages, point caps and drill-downs, as predicates and top-k orders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.network import csv_cell

#: Widths of a series in ms, widths of throughput bins in ms, points and bins of a chart, samples of a page.
INTERVALS_MS = (100, 1000, 10_000, 60_000)
BIN_STEPS_MS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 30_000, 60_000, 120_000, 300_000, 600_000, 1_800_000, 3_600_000)
MAX_POINTS, MAX_BINS, PAGE = 2000, 200, 3072


def in_time(rows: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """Rows of the half-open range."""
    return rows.where((F.col("ts_us") >= from_us) & (F.col("ts_us") < to_us))


def search(text: str, folded: Iterable[str], exact: Iterable[str]) -> Column:
    """Whether any column holds the text: `folded` ones in any case, `exact` ones as written. An empty text is everywhere."""
    hits = [F.contains(F.lower(c), F.lit(text.lower())) for c in folded] + [F.contains(F.col(c), F.lit(text)) for c in exact]
    out = F.lit(text == "")
    for h in hits:
        out = out | F.coalesce(h, F.lit(False))
    return out


def packets_found(rows: DataFrame, text: str, layer: int = 0) -> DataFrame:
    """Protocol and summary in any case, addresses as written; layer 0 is all layers."""
    found = rows.where(search(text, ("protocol", "summary"), ("src", "dst")))
    return found if layer == 0 else found.where(F.col("layer") == layer)


def connections_found(rows: DataFrame, text: str, tab: str = "ALL") -> DataFrame:
    """Tabs: ALL, TCP and UDP by transport, others by the application's name."""
    found = rows.where(search(text, ("protocol", "process", "remote_host"), ("remote_addr", "local_addr")))
    if tab == "ALL":
        return found
    return found.where(F.col("transport") == tab if tab in ("TCP", "UDP") else F.contains(F.upper("app"), F.lit(tab)))


def hosts_found(rows: DataFrame, text: str, columns: Iterable[str]) -> DataFrame:
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def host_table(rows: DataFrame, sort: str = "bytes", descending: bool = True, most: int | None = None) -> DataFrame:
    """Hosts with `place`, their row in the table; ties keep the order of the host's name.

    All hosts in one order are one task; with `most` the first rows are found on all tasks, and only those are numbered.
    """
    value = {"bytes": F.col("bytes_rx") + F.col("bytes_tx"), "packets": F.col("packets_rx") + F.col("packets_tx"), "duration": F.coalesce("duration_us", F.lit(0)), "name": F.col("host")}.get(sort, F.col(sort))
    by = (value.desc() if descending else value.asc(), F.col("host"))
    shown = rows if most is None else rows.orderBy(*by).limit(most)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(*by)))


def newest(rows: DataFrame, n: int = 100) -> DataFrame:
    return rows.orderBy(F.desc("ts_us"), F.desc("ordinal")).limit(n)


def newest_points(series: DataFrame, n: int = MAX_POINTS) -> DataFrame:
    """At most n points of each series, the newest."""
    w = Window.partitionBy("series").orderBy(F.desc("bucket_us"))
    return series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def finest_interval_ms(from_ms: int, to_ms: int) -> int:
    """The finest interval that keeps a window within MAX_POINTS points."""
    points = lambda i: -(-to_ms // i) - from_ms // i
    return next((i for i in INTERVALS_MS if points(i) <= MAX_POINTS), INTERVALS_MS[-1])


def finest_bin_us(span_us: int) -> int:
    """The finest bin that keeps a window within MAX_BINS bins."""
    return next((s * 1000 for s in BIN_STEPS_MS if span_us / (s * 1000) <= MAX_BINS), BIN_STEPS_MS[-1] * 1000)


def sample_page(samples: DataFrame, key: str, from_index: int, n: int = PAGE) -> DataFrame:
    """Per key the next n samples from an index on, with `more`, whether others follow, and `dropped_older`, how many before it are gone."""
    w = Window.partitionBy(key).orderBy("index")
    whole = Window.partitionBy(key)
    held = samples.where(F.col("index") >= from_index)
    held = held.withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole), "dropped_older": F.min("index").over(whole) - from_index})
    return held.where(F.col("_r") <= n).withColumn("more", F.col("_n") > n).drop("_r", "_n")


def retained(samples: DataFrame, key: str, newest_n: int = 4096, head: int = 16) -> DataFrame:
    """What a ring keeps of each key: the first `head` samples and the newest ones."""
    up, down = Window.partitionBy(key).orderBy("index"), Window.partitionBy(key).orderBy(F.desc("index"))
    return samples.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)}).where((F.col("_a") <= head) | (F.col("_z") <= newest_n)).drop("_a", "_z")


def held_values(points: DataFrame, key: str, from_us: int, to_us: int) -> DataFrame:
    """Points whose value holds at some time of a range: from the point until the next of its key."""
    until = F.lead("ts_us").over(Window.partitionBy(key).orderBy("ts_us", "ordinal"))
    return points.withColumn("until_us", until).where((F.col("ts_us") < to_us) & (F.coalesce(F.col("until_us"), F.lit(2**62)) > from_us))


def drilled(packets: DataFrame, series: Column, bucket_us: int, width_us: int) -> DataFrame:
    """The packets behind one point of a series."""
    return in_time(packets, bucket_us, bucket_us + width_us).where(series)


def most_specific_field(fields: DataFrame, offset: int) -> DataFrame:
    """Per frame the field that covers a byte: leaves before groups, then the shortest, then the first."""
    w = Window.partitionBy("frame").orderBy("is_group", "size", "position")
    covering = fields.where((F.col("at") <= offset) & (F.col("at") + F.col("size") > offset))
    return covering.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: The columns of exported connections, and no others.
CSV_HEADER = ("Protocol", "Local", "Remote", "Process", "PID", "RX Bytes", "TX Bytes", "Status")


def connections_csv(rows: DataFrame, observed: int) -> DataFrame:
    """(line, text): how many rows of how many observed, the header, one line a row in the order of `place`.

    rows: place, protocol, local_addr, local_port, remote_addr, remote_port, process, pid, rx_bytes, tx_bytes, status. What else
    they hold is never written. Text cells are quoted and kept from running as formulas; numbers stay as they are.
    """
    at = lambda side: csv_cell(F.concat(F.col(f"{side}_addr"), F.lit(":"), F.col(f"{side}_port").cast("string")))
    number = lambda c: F.col(c).cast("string")
    cells = [csv_cell(F.col("protocol")), at("local"), at("remote"), csv_cell(F.col("process")), number("pid"), number("rx_bytes"), number("tx_bytes"), csv_cell(F.col("status"))]
    lines = rows.select(F.col("place").cast("long").alias("line"), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells]).alias("text"))
    shown = lines.agg(F.format_string(f"# showing %d of {observed} observed", F.count(F.lit(1))).alias("text"))
    head = shown.select(F.lit(-2).cast("long").alias("line"), "text")
    names = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("line"), F.lit(",".join(CSV_HEADER)).alias("text"))
    return head.unionByName(names).unionByName(lines)


def evicted(flows: DataFrame, key: str, now_us: int, idle_us: Column, most: int = 10_000) -> DataFrame:
    """(key, reason) of flows (key, last_us) that a table of `most` flows lets go at now_us: `idle` beyond their idle time, and
    of the others the least recently seen beyond `most` (`capacity`; of ties the larger key goes). For live tables only."""
    idle = now_us - F.col("last_us") > idle_us
    live = flows.where(~idle).select(key, "last_us")
    kept = live.orderBy(F.desc("last_us"), key).limit(most).select(key)
    over = live.join(kept, key, "left_anti").select(key, F.lit("capacity").alias("reason"))
    return flows.where(idle).select(key, F.lit("idle").alias("reason")).union(over)


#: Fixed value: the last hop that a trace tries.
MAX_HOP = 30


def traces_complete(hops: DataFrame, key: str) -> DataFrame:
    """(key, complete) of hops (key, hop, ip, remote): the remote address answered, or a hop of MAX_HOP or more was tried."""
    return hops.groupBy(key).agg(F.bool_or(F.coalesce(F.col("ip") == F.col("remote"), F.lit(False)) | (F.col("hop") >= MAX_HOP)).alias("complete"))


def packets_json(packets: DataFrame, order: str) -> DataFrame:
    """(order, json): every packet as a JSON object with all its fields, nulls kept; written as text, one line a packet."""
    return packets.select(order, F.to_json(F.struct(*packets.columns), {"ignoreNullFields": "false"}).alias("json"))
