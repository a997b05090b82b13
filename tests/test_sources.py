import struct

import pytest

from netloom.operators import series
from netloom.sources import captures
from netloom.streaming import series as stream


def tcp_frame(n, payload=b"hi", vlan=False):
    tcp = struct.pack(">HHIIBBHHH", 1000 + n, 443, n, 7, 0x50, 0x18, 512, 0, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), 0, 0, 64, 6, 0, bytes([10, 0, 0, n]), bytes([192, 168, 1, 9]))
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + tcp + payload


def test_pcap_either_order_and_pcapng_round_trip(spark, tmp_path):
    for order in "<>":
        frames = [tcp_frame(i, vlan=i == 2) for i in range(5)] + [b"\0" * 12 + b"\x08\x06" + b"\0" * 28, b"\0" * 12 + b"\x08\x00\x45"]
        head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        (tmp_path / f"{'le' if order == '<' else 'be'}.pcap").write_bytes(head + b"".join(struct.pack(order + "4I", 10 + i, i, len(f), len(f)) + f for i, f in enumerate(frames)))
    got = captures.headers(captures.read(spark, str(tmp_path)))
    rows = got.orderBy("path", "ordinal").collect()
    assert len(rows) == 14 and [r.parse_status for r in rows[:7]] == ["ok"] * 5 + ["unsupported", "malformed"]
    r = rows[2]
    assert (r.vlan, r.src, r.dst, r.proto, r.src_port, r.dst_port, r.seq, r.ack, r.tcp_flags, r.window, r.payload_len) == (5, "10.0.0.2", "192.168.1.9", 6, 1002, 443, 2, 7, 0x18, 512, 2)
    assert r.ts_ns == 12 * 10**9 + 2000
    for e in captures.encode(captures.read(spark, str(tmp_path)), "path").collect():
        back = list(captures.records(bytes(e.capture)))
        assert [(b[0], b[4]) for b in back] == [(x.ts_ns, bytes(x.frame)) for x in rows if x.path == e.path]


@pytest.mark.parametrize("data", [b"", b"abcd", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 9, 1) + b"\1", b"\n\r\r\n" + b"\1" * 5])
def test_bad_captures_fail_loudly(data):
    with pytest.raises(captures.CaptureError):
        list(captures.records(data))


def test_streamed_late_split_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, (i * 7919) % 4000 + i * 40, 1) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "src string, ordinal long, ts_us long, bytes long").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    src = spark.readStream.schema("src string, ordinal long, ts_us long, bytes long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream.late_split(src, "src", 500, 700).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = series.late_split(spark.createDataFrame(rows, "src string, ordinal long, ts_us long, bytes long"), 500, 700, "src")
    got = {r.ordinal: r.late for r in spark.table("late").collect()}
    assert got == {r.ordinal: r.late for r in want.collect()} and any(got.values())


def test_streamed_buckets(spark, tmp_path):
    spark.createDataFrame([(i, i * 100_000, 2) for i in range(50)], "ordinal long, ts_us long, bytes long").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("ordinal long, ts_us long, bytes long").parquet(f"{tmp_path}/in")
    q = stream.buckets(src, "1 second", "500 milliseconds").writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.bucket_us, r.packets, r.bytes) for r in spark.table("buckets").collect()} >= {(k * 1_000_000, 10, 20) for k in range(4)}
