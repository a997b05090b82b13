"""Exact values through folds, recorded events, and connection ids."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from netloom.functions import network as net
from netloom.operators import folds, tcp, transactions
from netloom.sources import events

BIG = 2**60 + 1


def test_folds_keep_every_bit_and_rows_without_a_key(spark):
    rows = [(1, 10, BIG, None, 0.5), (1, 20, None, "x", None), (None, 5, BIG + 1, "y", None), (2, 30, BIG + 2, None, float("nan")), (None, 6, None, None, None)]
    df = spark.createDataFrame(rows, "flow long, ordinal long, wide long, name string, ratio double").withColumns({"ts_us": F.col("ordinal"), "at": F.timestamp_micros("ordinal"), "dec": F.col("wide").cast("decimal(38,0)")})
    out = {r["ordinal"]: r for r in folds.paced(df, "flow", 1, 15).collect()}
    assert {k: r["wide"] for k, r in out.items()} == {10: BIG, 20: None, 5: BIG + 1, 30: BIG + 2, 6: None}
    assert {k: r["admitted"] for k, r in out.items()} == {10: True, 20: False, 5: None, 30: True, 6: None}
    assert out[5]["name"] == "y" and int(out[30]["dec"]) == BIG + 2 and out[30]["ratio"] != out[30]["ratio"]
    held = folds.fold(df, ["flow"], ["ordinal"], list, lambda seen, row: seen.append(row["wide"]) or list(seen), "seen", "array<bigint>", ["wide"])
    assert {r["ordinal"]: r["seen"] for r in held.collect()} == {10: [BIG], 20: [BIG, None], 5: None, 30: [BIG + 2], 6: None}
    total = folds.unfold(df, "flow", ["ordinal"], dict, lambda s, r: s.update(n=s.get("n", 0) + 1, flow=r["flow"]) or [], lambda s: [{"flow": s["flow"], "n": s["n"]}], "flow long, n int")
    assert sorted(map(tuple, total.collect())) == [(1, 2), (2, 1)]
    assert folds.paced(df.limit(0), "flow", 1, 15).count() == 0


def test_round_trips_keep_other_columns(spark):
    rows = [(1, 1, 100, True, 5, 0, False, 10, False, BIG), (1, 2, 350, False, 0, 15, True, 0, False, None)]
    df = spark.createDataFrame(rows, "flow long, index long, ts_us long, outbound boolean, seq long, ack long, has_ack boolean, len long, retransmit boolean, wide long")
    assert {r["index"]: (r["rtt_us"], r["wide"]) for r in tcp.ack_rtts(df, "flow").collect()} == {1: (None, BIG), 2: (250, None)}


def test_requests_expire_in_sweeps_after_the_match(spark):
    """An answer at 5.1 s still counts if no sweep came between 5 and 5.1 s; another flow's packet at 5.05 s makes one."""
    ask = lambda flow, ordinal, ts, query=True: ("a", flow, ordinal, ts, query, 7, "x.example" if query else "X.example", query)
    kinds = "source string, flow long, ordinal long, ts_us long, outbound boolean, id long, name string, is_query boolean"
    said = lambda rows: {r["ordinal"]: (r["t"]["event"], r["t"]["service_us"]) for r in transactions.dns(transactions.sweep_clock(spark.createDataFrame(rows, kinds))).collect()}
    late = [ask(1, 1, 0), ask(1, 3, 5_100_000, False)]
    assert said(late) == {1: ("request", None), 3: ("answered", 5_100_000)}
    assert said([*late, ask(2, 2, 5_050_000)])[3] == ("unmatched", None)
    assert said([*late, ask(2, 2, 400_000)])[3] == ("answered", 5_100_000)
    big = spark.createDataFrame([("a", 1, BIG, 0, True, None), ("a", 1, BIG + 1, 9, False, 100), ("a", 1, BIG + 2, 20, False, 200)], "source string, flow long, ordinal long, ts_us long, outbound boolean, status int")
    assert [tuple(r["t"]) for r in transactions.http(big).orderBy("ordinal").collect()] == [("request", None, None), ("informational", None, None), ("answered", BIG, 20)]


def test_unanswered_queries_with_and_without_an_answer(spark):
    rows = [(1, 1, 0, True, 7, "a", True), (1, 2, 10, True, 8, "b", True), (1, 3, 20, False, 8, "B", False), (2, 4, 9_000_000, True, 7, "a", True)]
    tracked = transactions.dns(spark.createDataFrame(rows, "flow long, ordinal long, ts_us long, outbound boolean, id long, name string, is_query boolean"))
    assert [r["ordinal"] for r in transactions.unanswered(tracked).collect()] == [1]


CONNECTION = {"id": "Tcp-10.0.0.1:40000-93.184.0.1:80", "protocol": "HTTP", "appLayerProtocol": "HTTP", "transportProtocol": "TCP", "osiStack": "L4", "localAddr": "10.0.0.1", "localPort": 40000, "remoteAddr": "93.184.0.1",
              "remotePort": 80, "processName": "unknown", "pid": 0, "rxSpeed": 0.0, "txSpeed": 80.9, "rxBytesTotal": 2**64 - 1, "txBytesTotal": 243, "packetLoss": 0.0, "status": "ESTABLISHED", "encryption": "None", "sparkline": []}
HOST = {"host": "10.0.0.53", "rxBytesTotal": 87, "txBytesTotal": 71, "rxPacketsTotal": 1, "txPacketsTotal": 1, "rxSpeed": 0.0, "txSpeed": 0.0, "flowCount": 1, "firstSeenMs": 0, "lastSeenMs": 50, "processName": "unknown", "pid": 0}
RECORDED = [
    {"type": "connection_update", "connection": CONNECTION}, {"type": "connection_closed", "id": "Tcp-1"},
    {"type": "finding", "finding": {"id": "finding-1-0", "timestamp": "1791149114626", "severity": "warning", "code": "unanswered-request", "summary": "none", "frameId": "pkt-1", "flowId": "Udp-1"}},
    {"type": "packet", "packet": {"id": "pkt-1", "timestamp": "1790276979000", "relativeTimeMs": 2007, "layer": 7, "protocol": "TCP", "src": "a:80", "dst": "b:1", "length": 292, "summary": "s", "hexDump": "48", "headerHexDump": "aa",
                                  "fields": [{"path": "eth", "label": "Ethernet II", "type": "group", "region": "header", "offset": 0, "len": 14}, {"path": "tcp.seq", "label": "n", "type": "uint", "value": 6, "region": "header", "offset": 1, "len": 4}]}},
    {"type": "endpoint_update", "endpoints": [HOST, HOST | {"observedName": "example.com"}]}, {"type": "capture_config", "config": {"filter": None, "snaplen": 65535}},
    {"type": "service_time_update", "summaries": [{"protocol": "DNS", "answered": 0, "unanswered": 1, "untracked": 0, "sampleCount": 0}]},
    {"type": "io_buckets", "revision": 1, "epoch": "f1", "bucketMs": 100, "coveredFromMs": 1, "coveredToMs": 2, "notObserved": [], "loss": {"kernelDropped": 0}, "series": [{"id": "all", "buckets": [[1, 4, 192]]}]},
]


def test_recorded_lines_are_good(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in RECORDED], "value string")
    for kind, rows in (("connection_update", 1), ("connection_closed", 1), ("finding", 1), ("packet", 1), ("endpoint_update", 2), ("capture_config", 1), ("service_time_update", 1), ("io_buckets", 1)):
        got = events.parsed(df, kind).collect()
        assert len(got) == rows and not any(r["bad"] for r in got), kind
    assert int(events.parsed(df, "connection_update").first()["rxBytesTotal"]) == 2**64 - 1
    packet = events.parsed(df, "packet").first()
    assert packet["timestamp"] == "1790276979000" and [(f["path"], f["value"]) for f in packet["fields"]] == [("eth", None), ("tcp.seq", "6")]
    assert [r["observedName"] for r in events.parsed(df, "endpoint_update").orderBy("place").collect()] == [None, "example.com"]


@pytest.mark.parametrize("change", [{"localPort": "x"}, {"txBytesTotal": -1}, {"pid": ...}, {"sparkline": 3}])
def test_lines_with_a_fault_are_bad(spark, change):
    broken = {k: v for k, v in (CONNECTION | change).items() if v is not ...}
    df = spark.createDataFrame([(json.dumps({"type": "connection_update", "connection": broken}),), (json.dumps({"type": "connection_update"}),), ("no json",), (None,)], "value string")
    assert [r["bad"] for r in events.parsed(df, "connection_update").collect()] == [True, True]
    lists = spark.createDataFrame([('{"type":"endpoint_update"}',), ('{"type":"endpoint_update","endpoints":[]}',)], "value string")
    assert [r["bad"] for r in events.parsed(lists, "endpoint_update").collect()] == [True]


def test_written_events_are_read_back(spark):
    rows = spark.createDataFrame([("c1", "x")], "id string, code string")
    assert json.loads(events.written(rows.select("id"), "connection_closed").first()[0]) == {"type": "connection_closed", "id": "c1"}
    assert json.loads(events.written(rows, "finding").first()[0]) == {"type": "finding", "finding": {"id": "c1", "code": "x"}}


def test_connection_ids_and_their_strict_inverse(spark):
    good = ["Tcp-10.0.0.1:40000-93.184.0.1:80", "Tcp-2001:db8::1:443-fe80::1:2:0", "Tcp-::1:1-::ffff:1.2.3.4:65535", "Tcp-::1:1-1:0:2:3:4:5:6:7:9", "Tcp-1:2:3:4:5:6:7:8:1-::9:0", "Tcp-1:0:0:2::3:1-::1:2"]
    bad = ["tcp:1.1.1.1:1-2.2.2.2:2", "Udp-1.1.1.1:1-2.2.2.2:2", "Tcp-01.1.1.1:1-2.2.2.2:2", "Tcp-1.1.1.1:01-2.2.2.2:2", "Tcp-1.1.1.1:1-2.2.2.2:65536", "Tcp-2001:DB8::1:443-::1:2", "Tcp-0:0:0:0:0:0:0:1:1-::1:2",
           "Tcp-1:0:0:2:0:0:0:3:1-::1:2x", "Tcp-2001:0db8::1:1-::1:2", "Tcp-1.1.1.1:1-2.2.2.2", "", "Tcp-::ffff:102:304:1-::1:2", "Tcp-1::2::3:1-::1:2", "Tcp-1::2:0:0:0:3:1-::1:2", "Tcp-:1:1-::1:2"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "id string").withColumn("p", net.connection_parts(F.col("id")))
    got = {r["id"]: r["p"] for r in df.collect()}
    assert all(got[x] is None for x in [*bad, None])
    p = got["Tcp-2001:db8::1:443-fe80::1:2:0"]
    assert (p["local_addr"], p["local_port"], p["remote_addr"], p["remote_port"]) == ("2001:db8::1", 443, "fe80::1:2", 0)
    again = df.where("p is not null").select("id", net.connection_id(F.col("p.proto"), F.col("p.local_addr"), F.col("p.local_port"), F.col("p.remote_addr"), F.col("p.remote_port")).alias("again"))
    assert {r["id"] for r in again.collect() if r["id"] == r["again"]} == set(good)
    assert all(got[x] is not None for x in good)
