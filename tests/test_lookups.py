"""Lookups, labels and the messages that the tracker takes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from netloom.functions import network as net
from netloom.functions import payloads
from netloom.operators import lookups, transactions
from netloom.plans import traffic
from tests.test_payloads import hello, query, response


def test_socket_listings(spark):
    lines = ["COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME", "Safari 1234 j 45u IPv4 0x1 0t0 TCP 10.0.0.1:51000->9.9.9.9:443 (ESTABLISHED)", "sshd 7 r 3u IPv6 0x2 0t0 TCP *:22 (LISTEN)", "a 1 b", "x y z 1 2 3 4 5 h:80", "new 99 j 1u IPv4 0x1 0t0 TCP [::1]:51000->x", "big 5 j 1u IPv4 0x1 0t0 TCP h:70000"]
    got = lookups.processes(spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string")).collect()
    assert {(r["local_port"], r["pid"], r["process"]) for r in got} == {(51000, 99, "new"), (22, 7, "sshd")}


@pytest.mark.parametrize("mac,want", [("00:1b-2c:aa:bb:cc", "001B2C"), ("001b2caabbcc", "001B2C"), ("01:1b:2c:aa:bb:cc", None), ("02:1b:2c:aa:bb:cc", None), ("00:00:00:00:00:00", None), ("00:1b:2c", None), (None, None), ("zz1b2caabbcc", None)])
def test_mac_prefixes(spark, mac, want):
    assert spark.createDataFrame([(mac,)], "m string").select(net.mac_prefix(F.col("m"))).first()[0] == want


@pytest.mark.parametrize("first,last,want", [("10.0.0.0", "10.255.255.255", "10.0.0.0/8"), ("8.0.0.0", "9.255.255.255", None), ("1.2.3.4", "1.2.3.4", "1.2.3.4/32"), ("1.2.3.4", "1.2.3.6", None), ("1.2.3.5", "1.2.3.6", None), ("1.2.3.4", "1.2.3.3", None), ("x", "1.2.3.4", None), ("0.0.0.0", "255.255.255.255", None)])
def test_ranges_as_blocks(spark, first, last, want):
    assert spark.createDataFrame([(first, last)], "a string, b string").select(net.range_cidr(F.col("a"), F.col("b"))).first()[0] == want


def test_labels(spark):
    rows = [(1, hello(b"a.b"), "ClientHello (SNI: a.b)"), (2, b"\x16\x03\x03\x00\x02\x02\x00", "ServerHello"), (3, b"GET /x#y?z HTTP/1.1\r\n", "HTTP GET /x"), (4, b"HTTP/1.1 404 Not Found\r\n", "HTTP 404 Not Found"), (5, b"HTTP/1.1 404\r\n", "HTTP 404"), (6, b"data", None),
            (7, "GET /é HTTP/1.1\n".encode(), "HTTP GET /\\u{e9}"), (8, b"GET /" + b"a" * 100 + b" x\n", "HTTP GET /" + "a" * 54)]
    df = spark.createDataFrame([(n, d) for n, d, _ in rows], "n int, payload binary").withColumn("app", payloads.decoded(F.col("payload"), F.lit(True), F.lit(1), F.lit(2)))
    assert {r["n"]: r["l"] for r in df.select("n", net.sample_label(F.col("app"), F.col("payload")).alias("l")).collect()} == {n: w for n, _, w in rows}


def test_the_cache_and_its_log(spark):
    kind = "key string, record string, expires_ms long, place long"
    cache = spark.createDataFrame([("10.0.0.0/8", "a", 100, 0), ("x.example", None, 5, 1)], kind)
    after = lookups.cached(cache, spark.createDataFrame([("x.example", "b", 200, 0), ("1.0.0.0/8", "c", 50, 1), ("1.0.0.0/8", "d", 60, 2)], kind))
    assert sorted(map(tuple, after.collect())) == [("1.0.0.0/8", "d", 60, 1), ("10.0.0.0/8", "a", 100, 0), ("x.example", "b", 200, 1)]
    assert {r["key"] for r in lookups.fresh(after, 100).collect()} == {"x.example"}
    log = spark.createDataFrame([(0,), (lookups.DAY_MS,)], "at_ms long")
    assert lookups.pruned(log, 31 * lookups.DAY_MS).count() == 1
    assert lookups.fingerprints(spark.createDataFrame([("x",), ("y",)], "ja3 string"), spark.createDataFrame([("x", "curl")], "ja3 string, label string")).where("ja3_label = 'curl'").count() == 1


def test_only_unicast_dns_over_udp_is_matched(spark):
    rows = [("a", 1, 0, True, 40000, 53, 17, query(7, "x.y")), ("a", 2, 10, False, 40000, 53, 17, response(7, "X.y", [])), ("b", 3, 0, True, 40000, 53, 6, b"\0\x15" + query(7, "x.y")), ("c", 4, 0, True, 5353, 5353, 17, query(7, "x.y")), ("d", 5, 0, False, 53, 40000, 17, query(8, "x.y")), ("d", 6, 9, True, 53, 40000, 17, response(8, "x.y", []))]
    df = spark.createDataFrame(rows, "flow string, ordinal long, ts_us long, outbound boolean, local_port int, remote_port int, proto int, payload binary")
    sender, receiver = (F.when(F.col("outbound"), F.col(a)).otherwise(F.col(b)) for a, b in (("local_port", "remote_port"), ("remote_port", "local_port")))
    df = df.withColumn("app_data", payloads.decoded(F.col("payload"), F.col("proto") == 6, sender, receiver))
    got = transactions.dns(transactions.dns_messages(df)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["t"]["event"]) for r in got] == [(1, "request"), (2, "answered"), (5, "request"), (6, "answered")]
    web = spark.createDataFrame([("a", 1, 0, True, False, b"GET / x\n"), ("a", 2, 1, True, True, b"GET / x\n"), ("a", 3, 2, False, False, b"HTTP/1.1 200\r\n")], "flow string, ordinal long, ts_us long, outbound boolean, retransmit boolean, payload binary")
    web = web.withColumn("app_data", payloads.decoded(F.col("payload"), F.lit(True), F.lit(1), F.lit(2)))
    assert [(r["ordinal"], r["t"]["event"]) for r in transactions.http(transactions.http_messages(web)).orderBy("ordinal").collect()] == [(1, "request"), (3, "answered")]


def test_matched_dns_equals_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["ordinal"]: (r["event"], r["request"], r["service_us"]) for r in traffic.matched_dns(spark, sf).collect()}
    rows = [r for r in traffic.read_packets(spark, sf).orderBy("ordinal").collect()]
    swept, pending, answered, want = {}, {}, {}, {}
    for r in rows:
        flow, now = r["flow"], r["ts_us"] // 1_000_000
        source = (flow % 20000 + 40000) % 4
        before = swept.get(source)
        if before is None or now - before >= transactions.SWEEP_US:
            swept[source] = now
        if r["app"] not in ("view", "purchase"):
            continue
        for k in [k for k, (sent, _) in pending.items() if k[0] == flow and before is not None and before - sent >= transactions.DNS_TIMEOUT_US]:
            del pending[k]
        for k in [k for k, at in answered.items() if k[0] == flow and now - at >= transactions.DNS_TIMEOUT_US]:
            del answered[k]
        key = (flow, r["k"])
        if r["app"] == "view":
            if key in pending:
                want[r["ordinal"]] = ("retransmitted", None, None)
            else:
                answered.pop(key, None)
                pending[key] = (now, r["ordinal"])
                want[r["ordinal"]] = ("request", None, None)
        elif key in pending:
            sent, request = pending.pop(key)
            answered[key] = now
            want[r["ordinal"]] = ("answered", request, now - sent)
        else:
            want[r["ordinal"]] = ("duplicate" if key in answered else "unmatched", None, None)
    assert got == want and len(want) > 300
