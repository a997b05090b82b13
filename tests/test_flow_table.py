"""The flow table: idle times by status, batch against a plain loop, stream against batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from netloom.streaming import flows

KIND = "flow string, ordinal long, ts_us long, outbound boolean, bytes long, tcp boolean, syn boolean, ack boolean, fin boolean, rst boolean, seq long, size long, app string, port_app string, ja3 string"
MS = 1000


def packet(flow, n, ms, outbound=True, tcp=True, flags="", seq=None, size=0, app=None, ja3=None, port=None):
    return (flow, n, ms * MS, outbound, 100 + n, tcp, "S" in flags, "A" in flags, "F" in flags, "R" in flags, seq, size, app, port, ja3)


@pytest.mark.parametrize("flags,tcp,idle", [("S", True, 30_000), ("A", True, 1_800_000), ("AF", True, 120_000), ("AR", True, 120_000), ("", True, 120_000), ("", False, 60_000)])
def test_idle_times_follow_the_status(spark, flags, tcp, idle):
    rows = [packet("a", 1, 5, tcp=tcp, flags=flags), packet("a", 2, 5 + idle, tcp=tcp, flags=flags), packet("a", 3, 6 + 2 * idle, tcp=tcp, flags=flags)]
    got = flows.instances(spark.createDataFrame(rows, KIND)).orderBy("first_us").collect()
    assert [(g["packets"], g["closed"]) for g in got] == [(2, True), (1, False)]


def test_an_instance_says_what_it_saw(spark):
    rows = [packet("a", 1, 0, flags="S", seq=4294967295), packet("a", 2, 30, False, flags="SA", seq=9), packet("a", 3, 40, flags="A", seq=0, size=10, app="HTTPS/TLS", ja3="x"), packet("a", 4, 50, flags="A", seq=0, size=10),
            packet("a", 5, 60, False, flags="A", seq=10, size=5, app="HTTPS/TLS", ja3="y"), packet("b", 6, 0, tcp=False, port="DNS"), packet(None, 7, 0)]
    got = {g["flow"]: g for g in flows.rates(flows.instances(spark.createDataFrame(rows, KIND))).collect()}
    a = got["a"]
    assert (a["tx_bytes"], a["rx_bytes"], a["segments"], a["retransmits"], a["status"], a["rtt_us"], a["app"], a["encryption"], a["ja3"]) == (101 + 103 + 104, 102 + 105, 3, 1, "ESTABLISHED", 30_000, "HTTPS/TLS", "TLS", "x")
    assert abs(a["loss"] - 100 / 3) < 1e-9 and (got["b"]["app"], got["b"]["encryption"], got["b"]["loss"]) == ("DNS", "None", 0.0) and set(got) == {"a", "b"}


def rows_of(seed, flows_=40):
    rng, rows = random.Random(seed), []
    for f in range(flows_):
        ms, tcp = rng.randrange(1000), rng.random() < 0.7
        for _ in range(rng.randrange(1, 12)):
            ms += rng.choice([5, 400, 25_000, 31_000, 61_000, 119_000, 121_000, 1_900_000])
            rows.append(packet(f"f{f}", len(rows), ms, rng.random() < 0.5, tcp, rng.choice(["S", "A", "A", "AF", "R", "SA", ""]) if tcp else "", rng.choice([0, 5, 2**32 - 3]), rng.choice([0, 7]), rng.choice([None, "HTTP"]), None))
    return sorted(rows, key=lambda r: (r[2], r[1]))


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows_of(3)
    for part in range(4):
        some = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
        spark.createDataFrame(some, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    # A packet of another flow, long after: its time closes all that is open.
    for part in (4, 5):
        spark.createDataFrame([packet("end", 10**6 + part, 10**9 + part * 10**7, tcp=False)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = flows.stream(source).writeStream.format("memory").queryName("flow_rows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("flow_rows").where("flow != 'end'").drop("closed").collect()
    want = flows.instances(spark.createDataFrame(rows, KIND)).drop("closed").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 60


def test_no_packets(spark):
    assert flows.instances(spark.createDataFrame([], KIND)).count() == 0
    assert flows.instances(spark.createDataFrame([("a", 1, 5, 7)], "flow string, ordinal long, ts_us long, bytes long")).first()["app"] == "Unknown"
    assert flows.prepared(spark.createDataFrame([("a", None)], "flow string, ts_us long")).select(F.count("*")).first()[0] == 0
