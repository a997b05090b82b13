"""Flow, endpoint, protocol and service-time roll-ups. All aggregate map-side before their one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flows(packets: DataFrame, *keys: str) -> DataFrame:
    """Bytes and packets each way, first and last time."""
    each = lambda out, what: F.coalesce(F.sum(F.when(F.col("outbound") == F.lit(out), what)), F.lit(0)).cast("bigint")
    return packets.groupBy(*keys).agg(
        each(True, F.col("bytes")).alias("bytes_tx"), each(False, F.col("bytes")).alias("bytes_rx"), each(True, F.lit(1)).alias("packets_tx"), each(False, F.lit(1)).alias("packets_rx"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def hierarchy(packets: DataFrame, levels: list[str]) -> DataFrame:
    """Bytes and packets of every prefix of the levels; deeper levels are null and `depth` says how many count."""
    out = packets.rollup(*levels).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.grouping_id().alias("_g"))
    depth = sum(((1 - F.getbit("_g", F.lit(i))) for i in range(len(levels))), F.lit(0))
    return out.withColumn("depth", depth.cast("int")).drop("_g")


def protocol_hierarchy(packets: DataFrame, app: str = "app_now") -> DataFrame:
    """(depth, path, bytes, packets): every prefix of Ethernet, IP, transport and application.

    packets: proto, bytes, src_port, dst_port and the application of their flow by then. TCP and UDP count if they have ports,
    with their application ('Unknown' without one); ICMP (1 and 58) and others have none. All links count as Ethernet.
    """
    ported = F.col("proto").isin(6, 17)
    transport = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").when(F.col("proto").isin(1, 58), "ICMP").otherwise("Other")
    path = F.concat(F.array(F.lit("Ethernet"), F.lit("IP"), transport), F.when(ported, F.array(F.coalesce(F.col(app), F.lit("Unknown")))).otherwise(F.array().cast("array<string>")))
    counted = packets.where(F.col("proto").isNotNull() & (~ported | F.col("src_port").isNotNull() & F.col("dst_port").isNotNull()))
    leaves = counted.groupBy(path.alias("_p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"))  # few: prefixes are counted from these
    each = leaves.select("bytes", "packets", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.slice("_p", 1, n))).alias("_q"))
    return each.groupBy(F.size("_q").alias("depth"), F.array_join("_q", "/").alias("path")).agg(F.sum("bytes").cast("bigint").alias("bytes"), F.sum("packets").alias("packets"))


def transport_shares(hierarchy_rows: DataFrame) -> DataFrame:
    """(name, bytes, packets, percent of IP) of each transport, the largest first."""
    ip = F.broadcast(hierarchy_rows.where("depth = 2").agg(F.sum("bytes").alias("_ip")))  # one row
    rows = hierarchy_rows.where("depth = 3").select(F.substring_index("path", "/", -1).alias("name"), "bytes", "packets").crossJoin(ip)
    return rows.select("name", "bytes", "packets", F.when(F.col("_ip") > 0, F.col("bytes") * 100.0 / F.col("_ip")).otherwise(0.0).alias("percent")).orderBy(F.desc("bytes"), "name")


def shares(packets: DataFrame, key: str) -> DataFrame:
    totals = packets.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    everything = totals.agg(F.sum("bytes").alias("_all"))  # one row
    return totals.crossJoin(F.broadcast(everything)).select(key, "bytes", "packets", (F.col("bytes") * 100.0 / F.col("_all")).alias("percent"))


def top_n(packets: DataFrame, key: str, n: int) -> DataFrame:
    return packets.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), key).limit(n)


def keyset_page(packets: DataFrame, after: tuple[int, int], n: int = 200) -> DataFrame:
    """The next page in the order of (ts_us, ordinal)."""
    ts, i = after
    return packets.where((F.col("ts_us") > ts) | (F.col("ts_us") == ts) & (F.col("ordinal") > i)).orderBy("ts_us", "ordinal").limit(n)


def sessions(packets: DataFrame, key: str, idle_us: int | Column) -> DataFrame:
    """packets with `instance`: a new one starts after more than `idle_us` without a packet of the key."""
    w = Window.partitionBy(key).orderBy("ts_us", "ordinal")
    fresh = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) > idle_us).cast("int"), F.lit(1))
    return packets.withColumn("_new", fresh).withColumn("instance", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def match_fifo(packets: DataFrame, key: str, request: Column, response: Column) -> DataFrame:
    """First in, first out: a response answers its key's oldest open request; without one it answers nothing.

    Returns (key, n, req_ordinal, resp_ordinal, service_us) per request. One shuffle: with s the running count of requests
    less responses, a response finds no open request where -s reaches a new height above 0. The n-th request meets the
    n-th response that finds one. Time that runs backwards counts as 0.
    """
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.where(request | response).select(key, "ordinal", "ts_us", F.coalesce(request, F.lit(False)).alias("_req"))
    rows = rows.withColumn("_s", F.sum(F.when(F.col("_req"), 1).otherwise(-1)).over(w))
    rows = rows.withColumn("_lost", ~F.col("_req") & (-F.col("_s") > F.greatest(F.lit(0), F.coalesce(F.max(-F.col("_s")).over(before), F.lit(0)))))
    n = F.when(F.col("_req"), F.count_if("_req").over(w)).otherwise(F.count_if(~F.col("_req") & ~F.col("_lost")).over(w))
    met = rows.where("not _lost").withColumn("n", n.cast("int")).groupBy(key, "n").agg(
        F.max(F.when(F.col("_req"), F.struct("ordinal", "ts_us"))).alias("q"), F.max(F.when(~F.col("_req"), F.struct("ordinal", "ts_us"))).alias("r"))
    return met.select(key, "n", F.col("q.ordinal").alias("req_ordinal"), F.col("r.ordinal").alias("resp_ordinal"), F.when(F.col("r").isNotNull(), F.greatest(F.lit(0), F.col("r.ts_us") - F.col("q.ts_us"))).alias("service_us"))


def last_samples(matched: DataFrame, key: str, n: int = 1024) -> DataFrame:
    """matched with `recent`: whether the answer is among its key's last n, which percentiles are taken over."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("resp_ordinal")))
    return matched.withColumn("recent", F.col("service_us").isNotNull() & (newest <= n))


def service_times(matched: DataFrame, key: str, samples: int = 1024) -> DataFrame:
    """Answered, unanswered, least and most of all answers; nearest-rank percentiles over a key's last `samples` answers."""
    recent = last_samples(matched, key, samples)
    of_key = Window.partitionBy(key, "recent")
    ranked = recent.withColumns({"_r": F.row_number().over(of_key.orderBy("service_us", "req_ordinal")), "_n": F.count(F.lit(1)).over(of_key)})
    at = lambda q: F.max(F.when(F.col("recent") & (F.col("_r") == F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(q) / 100))), F.col("service_us")))
    return ranked.groupBy(key).agg(F.count("service_us").alias("answered"), F.count_if(F.col("service_us").isNull()).alias("unanswered"), F.min("service_us").alias("min_us"), F.max("service_us").alias("max_us"), at(50).alias("p50_us"), at(95).alias("p95_us"))
