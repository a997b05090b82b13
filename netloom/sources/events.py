"""Recorded agent events: one JSON object a line, `type` and a payload, read with explicit schemas and checked.

A line is `bad`, and kept, where its payload or a required field is absent, a value is of the wrong kind, or a count is below
0. A field that is there with null counts as there. Unknown names of a closed set become 'unknown'; unknown fields are
ignored. Payloads that are lists give one row an entry, with its `place`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of values besides Spark's own: unsigned 64-bit counts, and JSON that is passed on as text.
KINDS = {"u64": "decimal(20,0)", "json": "string"}
_RATES = "rxSpeed double!, txSpeed double!"
_BYTES = "rxBytesTotal u64!, txBytesTotal u64!"
_TOTALS = f"{_BYTES}, rxPacketsTotal u64!, txPacketsTotal u64!, {_RATES}, flowCount u64!, firstSeenMs u64!, lastSeenMs u64!"
#: Of each event type the name of its payload (none where fields stand beside `type`; [] for lists) and its fields; `!` marks required ones.
EVENTS: dict[str, tuple[str, str]] = {
    "agent_status": ("status", "interface string!, capturing boolean!, mode string!, replaySource string, directionAttributionUnavailable boolean!"),
    "capture_config": ("config", "filter string!, snaplen bigint!"),
    "capture_config_error": ("", "message string!"),
    "capture_file_error": ("", "message string!"),
    "capture_file_status": ("status", "writing boolean!, path string, bytesWritten u64!, backpressureDrops u64!"),
    "capture_stats": ("stats", "received u64!, dropped u64!, ifDropped u64!, relayLaggedEvents u64!, unparseableFrames u64!, totalConnectionsObserved u64!, "
                      "capacityEvictions u64!, idleEvictions u64!, observedNameEvictions u64"),
    "connection_closed": ("", "id string!"),
    "connection_update": ("connection", "id string!, protocol string!, appLayerProtocol string!, transportProtocol string!, osiStack string!, localAddr string!, localPort int!, "
                          f"remoteAddr string!, remotePort int!, processName string!, pid bigint!, {_RATES}, {_BYTES}, latencyMs double, packetLoss double!, status string!, "
                          "encryption string!, sparkline array<bigint>!, ja3Fingerprint string, ja3Label string"),
    "conversation_update": ("conversations[]", f"localAddr string!, remoteAddr string!, {_TOTALS}, durationMs u64!, processName string!, pid bigint!, ja3Label string"),
    "decryption_status": ("status", "connectionId string!, direction string!, status string!, reason string!"),
    "endpoint_update": ("endpoints[]", f"host string!, {_TOTALS}, processName string!, pid bigint!, ja3Label string, observedName string"),
    "finding": ("finding", "id string!, timestamp string!, severity string!, code string!, summary string!, frameId string, flowId string"),
    "interface_changed": ("interface", "name string!"),
    "interface_error": ("", "message string!"),
    "interface_list": ("interfaces[]", "name string!, addresses array<string>!"),
    "io_buckets": ("", "revision bigint!, epoch string!, bucketMs bigint!, coveredFromMs bigint, coveredToMs bigint, notObserved json!, loss json!, series json!"),
    "io_series_status": ("", "revision bigint!, requestId string, epoch string!, replayWaiting boolean!, series json!"),
    "layer_update": ("layers[]", f"layer int!, {_RATES}, rxPacketsPerSec double!, txPacketsPerSec double!, totalBytes u64!, errorRate double!, activeSockets bigint!, sparkline array<bigint>!"),
    "packet": ("packet", "id string!, timestamp string!, relativeTimeMs u64!, layer int!, protocol string!, src string!, dst string!, length bigint!, summary string!, hexDump string!, "
               "headerHexDump string!, fields array<struct<path:string,label:string,group:string,type:string,value:string,region:string,offset:int,len:int>>!"),
    "protocol_hierarchy_update": ("hierarchy", "name string!, bytes u64!, packets u64!, children json"),
    "service_time_update": ("summaries[]", "protocol string!, answered u64!, unanswered u64!, untracked u64!, minUs u64, maxUs u64, sampleCount u64!, medianUs u64, p95Us u64"),
    "system_stats": ("stats", "hostname string!, interfaceName string!, ipAddress string!, rxTotalMbps double!, txTotalMbps double!, rxPpsTotal double!, txPpsTotal double!, totalPacketsCaptured u64!"),
    "traceroute_hop": ("hop", "targetIp string!, hopNumber int!, hopIp string, rttMs double"),
}
#: Names of closed sets.
CLOSED = {
    "connection_update.status": ("ESTABLISHED", "SYN_SENT", "TIME_WAIT", "CLOSE_WAIT"),
    "finding.severity": ("error", "warning", "note", "chat"),
    "finding.code": ("retransmission", "connection-reset", "malformed-frame", "unanswered-request"),
}
Shape = list[tuple[str, str, bool]]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of recorded files as `value`; files split at any size."""
    return spark.read.text(path)


def fields_of(kind: str) -> Shape:
    """(name, Spark type, required) of an event's fields."""
    out, depth, text = [], 0, ""
    for c in EVENTS[kind][1] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, of = text.strip().rstrip("!").split()
            out.append((name, KINDS.get(of, of), text.strip().endswith("!")))
            text = ""
        else:
            text += c
    return out


def parsed(text: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The events of one type: its fields, `place` in a list (else 0), and `bad`. Lines of other types are left out."""
    payload, many = EVENTS[kind][0].removesuffix("[]"), EVENTS[kind][0].endswith("[]")
    rows = text.where(F.get_json_object(column, "$.type") == kind)
    held = F.get_json_object(column, f"$.{payload}") if payload else F.col(column)
    if many:  # a line without its list is one bad row, an empty list none
        items = F.coalesce(F.from_json(held, "array<string>"), F.array(F.lit(None).cast("string")))
        rows = rows.select(F.posexplode(items).alias("place", "held"))
    else:
        rows = rows.select(F.lit(0).alias("place"), held.alias("held"))
    shape = fields_of(kind)
    keys, bad = F.json_object_keys("held"), F.lit(False)
    said = rows.select("place", "held", keys.alias("keys"), F.from_json("held", ", ".join(f"`{n}` {t}" for n, t, _ in shape)).alias("e"))
    for name, of, needed in shape:
        value, raw = F.col("e")[name], F.get_json_object("held", f"$.{name}")
        bad = bad | (raw.isNotNull() & value.isNull())
        if needed:
            bad = bad | ~F.coalesce(F.array_contains("keys", name), F.lit(False))
        if of in ("int", "bigint", KINDS["u64"]):
            bad = bad | F.coalesce(value < 0, F.lit(False))
    return said.select(*[_closed(kind, name, F.col("e")[name]).alias(name) for name, _, _ in shape], "place", bad.alias("bad"))


def _closed(kind: str, name: str, value: Column) -> Column:
    known = CLOSED.get(f"{kind}.{name}")
    return F.when(value.isNull() | value.isin(*known), value).otherwise("unknown") if known else value


def written(rows: DataFrame, kind: str) -> DataFrame:
    """rows as lines of their event type, one row a line; fields without a value are left out."""
    payload = EVENTS[kind][0].removesuffix("[]")
    body = F.struct(*rows.columns)
    inner = [F.array(body).alias(payload)] if EVENTS[kind][0].endswith("[]") else [body.alias(payload)] if payload else [F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *inner)).alias("value"))
