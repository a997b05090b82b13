"""Captures split at block boundaries, rotation, and what an aborted write leaves."""

from __future__ import annotations

import os
import struct

import pytest
from pyspark.sql import functions as F

from netloom.sources import capture_files as files
from netloom.sources import captures
from tests.test_sources import tcp_frame


def packets(spark, n=300):
    rows = [("x", i, 10**18 + i * 10**9, ("inbound", "outbound", "unknown")[i % 3], 1, 0, 2**31 + i if i == 5 else 60 + i, tcp_frame(i % 250, b"p" * (i % 7))) for i in range(n)]
    return spark.createDataFrame(rows, captures.SCHEMA)


def shown(df):
    return sorted((r["ts_ns"], r["direction"], r["link_type"], r["wire_len"], r["cap_len"], bytes(r["frame"])) for r in df.collect())


def test_written_captures_are_read_back_in_any_split(spark, tmp_path):
    df, path = packets(spark).coalesce(1).sortWithinPartitions("ts_ns"), str(tmp_path / "out")
    files.write(df, path)
    assert len(os.listdir(path)) == 1
    want = shown(df.withColumn("cap_len", F.octet_length("frame").cast("long")))
    spark.dataSource.register(files.CaptureSource)
    for split in (1, 700, 5000, 1 << 30):
        got = files.read(spark, path, split)
        assert shown(got) == want
        assert sorted(r["ordinal"] for r in got.select("ordinal").collect()) == list(range(300))
        source = spark.read.format("capture").option("splitBytes", split).load(path)
        assert shown(source) == want and source.rdd.getNumPartitions() == (1 if split > 10**6 else source.rdd.getNumPartitions())
        assert shown(captures.read(spark, path)) == want
    name = os.path.join(path, os.listdir(path)[0])
    assert len(list(files.ranges(name, 700))) > 20


def test_every_kind_of_file_splits(spark, tmp_path):
    frames = [tcp_frame(i, b"z" * i) for i in range(40)]
    for order in "<>":
        head = struct.pack(order + "IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)
        (tmp_path / f"{'le' if order == '<' else 'be'}.pcap").write_bytes(head + b"".join(struct.pack(order + "4I", 10 + i, i, len(f), len(f)) + f for i, f in enumerate(frames)))
    # Two sections, the second with a second interface of another unit; unknown blocks between.
    one = captures.head() + b"".join(captures.packet_block(i, None, 60, f) for i, f in enumerate(frames)) + captures._block(77, b"odd!")
    face = captures._block(captures.INTERFACE, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHB3xI", 9, 1, 0x80 | 10, 0))
    raw = struct.pack("<5I", 1, 0, 2048, 4, 4) + b"abcd"
    (tmp_path / "two.pcapng").write_bytes(one + captures.head() + face + captures._block(captures.PACKET, raw) * 3 + captures.statistics_block(1, 2, 3))
    for name in os.listdir(tmp_path):
        path = str(tmp_path / name)
        want = [(i, *r) for i, r in enumerate(captures.records((tmp_path / name).read_bytes()))]
        for split in (1, 200, 10**9):
            got = [x for part in files.ranges(path, split) for x in files.packets_of(*part)]
            assert [(g[1], g[2], g[3], g[4], g[6], g[7]) for g in got] == want
    assert files.read(spark, str(tmp_path), 500).count() == 123


def test_files_rotate_by_count_size_and_time(spark, tmp_path):
    df = packets(spark).coalesce(1).sortWithinPartitions("ts_ns")
    for limit, value, most in (("maxPackets", 50, lambda rs: len(rs) <= 50), ("maxSeconds", 20, lambda rs: rs[-1][0] - rs[0][0] < 20 * 10**9), ("maxBytes", 2000, lambda rs: sum(len(r[4]) for r in rs[:-1]) < 2000)):
        path = tmp_path / limit
        files.write(df, str(path), **{limit: value})
        held = [list(captures.records((path / n).read_bytes())) for n in sorted(os.listdir(path))]
        assert len(held) >= 6 and all(most(h) for h in held) and [r[0] for h in held for r in h] == [10**18 + i * 10**9 for i in range(300)]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write(packets(spark, 10).coalesce(1), path)
    before = sorted(os.listdir(path))
    bad = packets(spark, 400).repartition(4).withColumn("frame", F.when(F.col("ordinal") == 399, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("frame")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            files.write(bad, path, mode)
        assert sorted(os.listdir(path)) == before
    files.write(packets(spark, 7), path, "overwrite")
    assert files.read(spark, path).count() == 7 and not set(before) & set(os.listdir(path))
    files.write(packets(spark, 7).limit(0), path)
    assert files.read(spark, path).count() == 7


@pytest.mark.parametrize("data", [b"", b"abcd", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 9, 1) + b"\1", captures.head()[:-2], captures.head() + captures.packet_block(1, None, 2, b"xy")[:-4] + b"\0\0\0\0"])
def test_cut_captures_fail_loudly(tmp_path, data):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(captures.CaptureError):
        [list(files.packets_of(*part)) for part in files.ranges(str(tmp_path / "x"), 10)] or captures.records(data)
