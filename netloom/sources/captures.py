"""Capture files as DataFrames and back: classic pcap and pcapng, through Spark's own file readers.

`read` takes files whole (`binaryFile`), one file a task at a time, so a file may hold at most 2 GB; `capture_files.read` splits
files of any size. Frames are decoded by native expressions, so only the columns that a query uses are computed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ordinal long, ts_ns long, direction string, link_type int, cap_len long, wire_len long, frame binary"
MAX_BLOCK, MAX_INTERFACES = 16 << 20, 4096
#: Magic numbers of pcap with their nanoseconds a tick, block types of pcapng.
PCAP = {0xA1B2C3D4: 1000, 0xA1B23C4D: 1}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, STATISTICS, PACKET = 0x0A0D0D0A, 1, 2, 3, 5, 6
DIRECTIONS = {1: "inbound", 2: "outbound"}

Record = tuple[int, str, int, int, bytes]


class CaptureError(ValueError):
    """A capture file that is cut off, of an unknown format, or holds blocks that cannot be timed."""


def _pcap(data: bytes, order: str, tick: int) -> Iterator[Record]:
    if len(data) < 24:
        raise CaptureError("partial file header")
    link, at = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF, 24
    while at < len(data):
        if at + 16 > len(data):
            raise CaptureError(f"partial record header at {at}")
        sec, part, size, wire = struct.unpack_from(order + "4I", data, at)
        if at + 16 + size > len(data):
            raise CaptureError(f"partial record at {at}")
        yield sec * 10**9 + part * tick, "unknown", link, wire, data[at + 16 : at + 16 + size]
        at += 16 + size


def _options(body: bytes, order: str, at: int) -> dict[int, bytes]:
    found: dict[int, bytes] = {}
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "2H", body, at)
        if code == 0:
            break
        found.setdefault(code, body[at + 4 : at + 4 + size])
        at += 4 + -(-size // 4) * 4
    return found


def _interface(body: bytes, order: str) -> tuple[int, int]:
    """(link type, ticks a second)."""
    unit = _options(body, order, 8).get(9, b"\x06")[0]
    return struct.unpack_from(order + "H", body)[0], 2 ** (unit & 127) if unit & 128 else 10**unit


def _pcapng(data: bytes, order: str = "<", faces: list | None = None) -> Iterator[Record]:
    """The packets of whole blocks. order, faces: the byte order and interfaces in force, for blocks from within a section."""
    at, links = 0, list(faces or [])
    while at < len(data):
        if at + 12 > len(data):
            raise CaptureError(f"partial block at {at}")
        if data[at : at + 4] == b"\n\r\r\n":
            order, links = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "2I", data, at)
        if size < 12 or size % 4 or size > MAX_BLOCK or at + size > len(data):
            raise CaptureError(f"bad block length {size} at {at}")
        if data[at + 4 : at + 8] != data[at + size - 4 : at + size]:
            raise CaptureError(f"unequal block lengths at {at}")
        body = data[at + 8 : at + size - 4]
        if kind == INTERFACE:
            if len(links) == MAX_INTERFACES:
                raise CaptureError("too many interfaces")
            links.append(_interface(body, order))
        elif kind == PACKET:
            face, high, low, cap, wire = struct.unpack_from(order + "5I", body)
            if face >= len(links) or 20 + cap > len(body):
                raise CaptureError(f"bad packet block at {at}")
            link, per_second = links[face]
            flags = _options(body, order, 20 + -(-cap // 4) * 4).get(2)
            way = struct.unpack(order + "I", flags)[0] & 3 if flags and len(flags) == 4 else 0
            yield (high << 32 | low) * 10**9 // per_second, DIRECTIONS.get(way, "unknown"), link, wire, body[20 : 20 + cap]
        elif kind in (OLD_PACKET, SIMPLE_PACKET):
            raise CaptureError(f"packet block of type {kind} at {at}")
        at += size


def records(data: bytes) -> Iterator[Record]:
    """(ts_ns, direction, link_type, wire_len, frame) of a file of either format, told by its first four bytes."""
    if data[:4] == b"\n\r\r\n":
        return _pcapng(data)
    for order in "<>":
        magic = struct.unpack(order + "I", data[:4])[0] if len(data) >= 4 else 0
        if magic in PCAP:
            return _pcap(data, order, PCAP[magic])
    raise CaptureError("neither pcap nor pcapng")


def read(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """All packets of the captures at `path` (files, folders or globs), in capture order by (path, ordinal)."""

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in files:
            for name, data in zip(rows["path"], rows["content"], strict=True):
                held = []
                for i, (ts, way, link, wire, frame) in enumerate(records(bytes(data))):
                    held.append((name, i, ts, way, link, len(frame), wire, frame))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def _block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def encode(packets: DataFrame, by: str, link_type: int = 1) -> DataFrame:
    """(by, capture): the pcapng bytes of each group, nanosecond times, packets by ts_ns. Groups are one file each: rotate by a bounded `by`."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = [head(link_type)]
        for r in rows.sort_values(["ts_ns", "ordinal"]).itertuples():
            out.append(packet_block(r.ts_ns, r.direction, r.wire_len, bytes(r.frame)))
        return pd.DataFrame({by: rows[by].iloc[:1], "capture": [b"".join(out)]})

    kind = packets.schema[by].dataType.simpleString()
    return packets.select(by, "ordinal", "ts_ns", "direction", "wire_len", "frame").groupBy(by).applyInPandas(build, f"`{by}` {kind}, capture binary")


def head(link_type: int = 1) -> bytes:
    """A section with one interface of nanosecond times."""
    return _block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(INTERFACE, struct.pack("<HHI", link_type, 0, 0) + struct.pack("<HHB3xI", 9, 1, 9, 0))


def packet_block(ts_ns: int, direction: str | None, wire_len: int, frame: bytes) -> bytes:
    way = {v: k for k, v in DIRECTIONS.items()}.get(direction, 0)
    return _block(PACKET, struct.pack("<5I", 0, ts_ns >> 32, ts_ns & 0xFFFFFFFF, len(frame), wire_len) + frame + b"\0" * (-len(frame) % 4) + struct.pack("<HHII", 2, 4, way, 0))


def statistics_block(ts_ns: int, received: int, dropped: int) -> bytes:
    return _block(STATISTICS, struct.pack("<3I", 0, ts_ns >> 32, ts_ns & 0xFFFFFFFF) + struct.pack("<HHQHHQI", 4, 8, received, 5, 8, dropped, 0))


def settled(rows: DataFrame) -> DataFrame:
    """The rows as they stand: what follows reads these columns, where the planner would else repeat their expressions for each use.

    An array of one struct, taken apart again: the planner moves no expression past that, and no row leaves the JVM.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def _uint(frame: Column, at: Column, size: int) -> Column:
    """A big-endian number at a 0-based place; null where the frame ends before it."""
    return F.when(F.length(frame) >= at + size, F.conv(F.hex(F.substring(frame, at + 1, F.lit(size))), 16, 10).cast("bigint"))


def headers(packets: DataFrame) -> DataFrame:
    """packets with parse_status (ok, unsupported, malformed), vlan, src, dst, proto, ports, TCP fields and payload_len.

    Ethernet frames with up to one VLAN tag, null/loopback and raw IP links; frames of other links are unsupported. IPv6 addresses are eight groups of four hex digits.
    """
    f = F.col("frame")
    tagged = (F.col("link_type") == 1) & F.coalesce(_uint(f, F.lit(12), 2) == 0x8100, F.lit(False))
    out = packets.withColumns({"vlan": F.when(tagged, _uint(f, F.lit(14), 2) % 4096), "_l3": F.when(tagged, 18).when(F.col("link_type") == 1, 14).when(F.col("link_type").isin(0, 108), 4).otherwise(0)})
    out = out.withColumns({"_type": F.when(F.col("link_type") == 1, _uint(f, F.col("_l3") - 2, 2)), "_v": F.floor(_uint(f, F.col("_l3"), 1) / F.lit(16))})
    ip = F.col("link_type").isin(0, 101, 108) | F.col("_type").isin(0x0800, 0x86DD)
    l3, four = F.col("_l3"), F.col("_v") == 4
    dotted = lambda at: F.concat_ws(".", *[_uint(f, at + i, 1).cast("string") for i in range(4)])
    colons = lambda at: F.rtrim(F.regexp_replace(F.lower(F.hex(F.substring(f, at + 1, F.lit(16)))), "(....)(?=.)", "$1:"))
    whole = F.when(four, F.length(f) >= l3 + 20).when(F.col("_v") == 6, F.length(f) >= l3 + 40).otherwise(False)
    out = out.withColumn("parse_status", F.when(~F.coalesce(ip, F.lit(False)), F.when((F.col("link_type") == 1) & (F.length(f) < 14), "malformed").otherwise("unsupported")).when(F.coalesce(whole, F.lit(False)), "ok").otherwise("malformed"))
    ok = F.col("parse_status") == "ok"
    out = out.withColumns({
        "src": F.when(ok, F.when(four, dotted(l3 + 12)).otherwise(colons(l3 + 8))), "dst": F.when(ok, F.when(four, dotted(l3 + 16)).otherwise(colons(l3 + 24))),
        "proto": F.when(ok, F.when(four, _uint(f, l3 + 9, 1)).otherwise(_uint(f, l3 + 6, 1))), "_l4": F.when(ok, l3 + F.when(four, _uint(f, l3, 1) % 16 * 4).otherwise(40)),
        "_end": F.when(ok, l3 + F.when(four, _uint(f, l3 + 2, 2)).otherwise(_uint(f, l3 + 4, 2) + 40))})
    # A fragment has no transport header of its own, the first one included: see operators.reassembly.
    place = F.when(four, _uint(f, l3 + 6, 2))
    out = out.withColumns({
        "ip_id": F.when(ok & four, _uint(f, l3 + 4, 2)), "frag_offset": F.when(ok, place % 8192 * 8), "more_fragments": F.when(ok, F.floor(place / F.lit(8192)) % 2 == 1),
        "ip_declared": F.col("_end") - F.col("_l4"), "ip_header": F.when(ok & four, F.substring(f, l3 + 1, F.col("_l4") - l3)),
        "ip_payload": F.when(ok, F.substring(f, F.col("_l4") + 1, F.greatest(F.lit(0), F.col("_end") - F.col("_l4"))))})
    head = ~F.coalesce(F.col("more_fragments") | (F.col("frag_offset") > 0), F.lit(False))
    l4, tcp, ported = F.col("_l4"), head & (F.col("proto") == 6), head & F.col("proto").isin(6, 17)
    size = F.when(tcp, F.floor(_uint(f, l4 + 12, 1) / F.lit(16)).cast("int") * 4).when(F.col("proto") == 17, 8).otherwise(0)
    out = out.withColumns({
        "src_port": F.when(ported, _uint(f, l4, 2)), "dst_port": F.when(ported, _uint(f, l4 + 2, 2)), "seq": F.when(tcp, _uint(f, l4 + 4, 4)), "ack": F.when(tcp, _uint(f, l4 + 8, 4)),
        "tcp_flags": F.when(tcp, _uint(f, l4 + 13, 1)), "window": F.when(tcp, _uint(f, l4 + 14, 2)), "payload_len": F.greatest(F.lit(0), F.col("_end") - l4 - size),
        "payload": F.when(ported, F.substring(f, l4 + size + 1, F.greatest(F.lit(0), F.col("_end") - l4 - size))),
        "wscale": F.when(tcp & (size > 20), window_scale(F.substring(f, l4 + 21, size - 20)))})
    return out.drop("_l3", "_type", "_v", "_l4", "_end")


def window_scale(options: Column) -> Column:
    """The window scale among TCP options (at most 40 bytes); null without one, or where any option is malformed."""
    size = F.length(options)
    byte = lambda at: F.conv(F.hex(F.substring(options, at + 1, F.lit(1))), 16, 10).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("shift"), F.lit(False).alias("bad"))

    def step(walk: Column, i: Column) -> Column:
        kind, length = byte(i), byte(i + 1)
        single, whole = kind <= 1, F.coalesce((length >= 2) & (i + length <= size), F.lit(False))
        after = F.when(kind == 0, 99).when(kind == 1, i + 1).when(whole, i + length).otherwise(99)
        shift = F.coalesce(walk["shift"], F.when((kind == 3) & (length == 3) & whole, byte(i + 2)))  # the first one counts
        wrong = ~single & (~whole | (kind == 3) & (length != 3))
        here = F.struct(after.cast("int").alias("at"), shift.alias("shift"), (walk["bad"] | wrong).alias("bad"))
        return F.when((walk["at"] == i) & (i < size), here).otherwise(walk)

    return F.aggregate(F.sequence(F.lit(0), F.lit(39)), start, step, lambda w: F.when(~w["bad"], w["shift"]))
