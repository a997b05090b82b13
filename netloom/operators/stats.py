"""Counters and rates of flows, layers and captures; each is one aggregate with map-side sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(packets: DataFrame, local: list[str] | None = None) -> DataFrame:
    """packets (src, src_port, dst, dst_port) with local_addr, local_port, remote_addr, remote_port, outbound.

    The side on the list of local addresses is local, the source first; without a list the smaller of (address, port) is.
    Packets between two others belong to no flow and go, as do those without ports.
    """
    ends = packets.where("src_port is not null and dst_port is not null")
    if local:
        ends = ends.where(F.col("src").isin(*local) | F.col("dst").isin(*local)).withColumn("outbound", F.col("src").isin(*local))
    else:
        ends = ends.withColumn("outbound", (F.col("src") < F.col("dst")) | (F.col("src") == F.col("dst")) & (F.col("src_port") <= F.col("dst_port")))
    pick = lambda a, b: F.when(F.col("outbound"), F.col(a)).otherwise(F.col(b))
    return ends.withColumns({"local_addr": pick("src", "dst"), "local_port": pick("src_port", "dst_port"), "remote_addr": pick("dst", "src"), "remote_port": pick("dst_port", "src_port")})


def flow_facts(packets: DataFrame, key: str, instance: str = "instance") -> DataFrame:
    """(key, instances, established, label): how often the tuple came anew, whether its last ACK or reset leaves it up, its first label."""
    turn = F.when(F.col("rst"), 0).when(F.col("ack"), 1)
    return packets.groupBy(key).agg(
        F.countDistinct(instance).alias("instances"), (F.coalesce(F.max_by(turn, F.when(turn.isNotNull(), F.col("ordinal"))), F.lit(0)) == 1).alias("established"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ordinal"))).alias("label"))


def freshest(packets: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): the newest label that is not null."""
    return packets.groupBy(key).agg(F.max_by(label, F.when(F.col(label).isNotNull(), F.col("ordinal"))).alias(label))


def endpoints(packets: DataFrame, host: str, flow: str) -> DataFrame:
    """Bytes and packets each way, flows, first and last time of each host."""
    each = lambda out, what: F.coalesce(F.sum(F.when(F.col("outbound") == F.lit(out), what)), F.lit(0)).cast("bigint")
    return packets.groupBy(host).agg(
        each(True, F.col("bytes")).alias("bytes_tx"), each(False, F.col("bytes")).alias("bytes_rx"), each(True, F.lit(1)).alias("packets_tx"), each(False, F.lit(1)).alias("packets_rx"),
        F.countDistinct(flow).alias("flow_count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def layers(flows: DataFrame) -> DataFrame:
    """(layer, bytes, packets, active, loss) of the layers 3, 4 and 7. flows: bytes, packets, active, loss, app; layer 7 holds those of a known app."""
    known = F.col("app").isNotNull()

    def one(layer: int, which: Column) -> Column:
        total = lambda c: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0)).cast("bigint")
        return F.struct(F.lit(layer).alias("layer"), total("bytes").alias("bytes"), total("packets").alias("packets"), F.count_if(which & F.col("active")).alias("active"), F.coalesce(F.avg(F.when(which, F.col("loss"))), F.lit(0.0)).alias("loss"))

    return flows.agg(F.array(one(3, F.lit(True)), one(4, F.lit(True)), one(7, known)).alias("l")).select(F.explode("l").alias("l")).select("l.*")


def mean_error(layer_rows: DataFrame) -> DataFrame:
    """(error, healthy) over the layers that are measured."""
    error = F.coalesce(F.avg(F.when(F.col("layer").isin(3, 4, 7), F.col("loss"))), F.lit(0.0))
    return layer_rows.agg(error.alias("error")).withColumn("healthy", F.col("error") < 0.2)


def rates(packets: DataFrame, key: str, tick_us: int = 1_000_000) -> DataFrame:
    """(key, tick_us, rx_rate, tx_rate): bytes a second of each tick."""
    tick = (F.floor(F.col("ts_us") / F.lit(tick_us)) * tick_us).cast("bigint")
    each = lambda out: F.sum(F.when(F.col("outbound") == F.lit(out), F.col("bytes")).otherwise(0)) / F.lit(max(tick_us, 1000) / 1e6)
    return packets.groupBy(key, tick.alias("tick_us")).agg(each(False).alias("rx_rate"), each(True).alias("tx_rate"))


def series_rate(series: DataFrame, width_us: int) -> DataFrame:
    """series with packets and bits a second."""
    seconds = F.lit(width_us / 1e6)
    return series.withColumns({"packet_rate": F.col("packets") / seconds, "bit_rate": F.col("bytes") * 8 / seconds})


def runs(samples: DataFrame, key: str, interesting: Column) -> DataFrame:
    """(key, run, segments, and for each side data segments, bytes and pure ACKs): stretches between interesting samples."""
    w = Window.partitionBy(key).orderBy("index")
    marked = samples.withColumn("_i", interesting).withColumn("run", F.sum(F.col("_i").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    plain, out, data = marked.where("not _i"), F.col("outbound"), F.col("bytes") > 0
    sides = []
    for name, side in (("out", out), ("in", ~out)):
        sides += [F.count_if(side & data).alias(f"{name}_data"), F.sum(F.when(side, F.col("bytes")).otherwise(0)).alias(f"{name}_bytes"), F.count_if(side & ~data).alias(f"{name}_acks")]
    return plain.groupBy(key, "run").agg(F.count(F.lit(1)).alias("segments"), *sides)


def drop_totals(polls: DataFrame) -> DataFrame:
    """(dropped, if_dropped) of a process: the last poll of each handle, added up. polls: handle, ordinal, dropped, if_dropped."""
    last = polls.groupBy("handle").agg(F.max_by(F.struct("dropped", "if_dropped"), "ordinal").alias("x"))
    total = lambda c: F.coalesce(F.sum(f"x.{c}"), F.lit(0)).cast("bigint").alias(c)
    return last.agg(total("dropped"), total("if_dropped"))


def capture_counters(packets: DataFrame) -> DataFrame:
    """(received, bytes, unparseable, unsupported, truncated) from decoded headers."""
    return packets.agg(
        F.count(F.lit(1)).alias("received"), F.coalesce(F.sum("wire_len"), F.lit(0)).alias("bytes"), F.count_if(F.col("parse_status") == "malformed").alias("unparseable"),
        F.count_if(F.col("parse_status") == "unsupported").alias("unsupported"), F.count_if(F.col("cap_len") < F.col("wire_len")).alias("truncated"))


def time_range(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(key).agg(F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"))


def attributed(hosts: DataFrame, flows: DataFrame, processes: DataFrame) -> DataFrame:
    """hosts (host) with pid and process of their most recently active flow; 0 and 'unknown' without any. flows: host, local_port, last_us; processes: local_port, pid, process."""
    owned = flows.join(processes, "local_port").groupBy("host").agg(F.max_by(F.struct("pid", "process"), F.struct("last_us", "local_port", "pid")).alias("p"))
    return hosts.join(owned, "host", "left").select("host", F.coalesce("p.pid", F.lit(0)).alias("pid"), F.coalesce("p.process", F.lit("unknown")).alias("process"))


def response_links(rows: DataFrame) -> DataFrame:
    """(response, request): rows that answer another row which is held."""
    return rows.where("response_to is not null").select(F.col("ordinal").alias("response"), F.col("response_to").alias("request")).join(rows.select(F.col("ordinal").alias("request")), "request").select("response", "request")


def enriched(rows: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of their key's newest facts, where those have a value."""
    new = facts.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"_new_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def problem_findings(packets: DataFrame, unanswered: DataFrame) -> DataFrame:
    """(code, severity, flow, ordinal, target): malformed frames and unanswered requests; the target is the frame, else the flow."""
    frame = packets.where("parse_status = 'malformed'").select(F.lit("malformed-frame").alias("code"), "flow", "ordinal")
    asked = unanswered.select(F.lit("unanswered-request").alias("code"), "flow", "ordinal")
    target = F.coalesce(F.concat(F.lit("frame:"), F.col("ordinal").cast("string")), F.concat(F.lit("flow:"), F.col("flow").cast("string")))
    return frame.union(asked).select("code", F.lit("warning").alias("severity"), "flow", "ordinal", target.alias("target"))
