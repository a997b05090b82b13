"""Reassembly against plain byte-by-byte loops: overlaps, gaps, wraps, caps, windows; DNS framing; replayed clocks."""

from __future__ import annotations

import random
import struct

import pytest

from netloom.functions import payloads
from netloom.operators import reassembly as r
from tests.test_payloads import query, response

SEGMENTS = "flow long, outbound boolean, n long, clock_ms long, seq long, payload binary, declared long, syn boolean, src_port int, dst_port int"


def test_interval_map_equals_a_byte_map():
    rng = random.Random(2)
    for _ in range(300):
        spans, plain = r.Spans(), {}
        for _ in range(rng.randrange(1, 9)):
            at, data = rng.randrange(-20, 20), bytes(rng.randrange(3) for _ in range(rng.randrange(12)))
            new, differ = spans.put(at, data)
            assert (new, differ) == (sum(at + i not in plain for i in range(len(data))), sum(plain.get(at + i, b) != b for i, b in enumerate(data)))
            for i, b in enumerate(data):
                plain.setdefault(at + i, b)
            assert {s + i: b for s, run in spans.runs for i, b in enumerate(run)} == plain
            assert all(a[0] + len(a[1]) < b[0] for a, b in zip(spans.runs, spans.runs[1:], strict=False))


def plain_direction(segments):
    """(assembly, kind, conflicting) of each segment, byte by byte."""
    held, out = None, []
    for now, seq, data, declared in segments:
        own = payloads.sniff(data, True, 9, 80) or {}
        if held is None and "kind" in own:
            out.append((None, own["kind"], 0))
            continue
        if not data:
            out.append((None, None, 0))
            continue
        if held and now - held["last"] > 30_000:
            held = None
        held = held or {"base": seq, "bytes": {}, "first": now, "cut": None, "over": False}
        held["last"] = now
        if held["over"] or now - held["first"] > 2000:
            held = None if held["over"] else held | {"over": True}
            out.append((None, None, 0))
            continue
        at = (seq - held["base"] + 2**31) % 2**32 - 2**31
        extent = max(held["bytes"], default=-1) + 1
        if at < 0 and extent - at > 16384 or at > 16384:
            out.append((None, None, 0))
            continue
        if at < 0:
            held["bytes"] = {k - at: v for k, v in held["bytes"].items()}
            held["base"], held["cut"], at = seq, held["cut"] and held["cut"] - at, 0
        differ = new = 0
        for i, b in enumerate(data):
            if at + i < 16384:
                new += at + i not in held["bytes"]
                differ += held["bytes"].setdefault(at + i, b) != b
        if len(data) < declared:
            held["cut"] = min(at + len(data), held["cut"] if held["cut"] is not None else 1 << 60)
        capped = at + len(data) > 16384
        held["over"] = capped
        if not new and not capped:
            out.append((None, None, differ))
            continue
        n = 0
        while n in held["bytes"]:
            n += 1
        status = r.TRUNCATED if held["cut"] is not None and held["cut"] <= n else r.MISSING if n < len(held["bytes"]) else r.WHOLE
        kind = (payloads.sniff(bytes(held["bytes"][i] for i in range(n)), True, 9, 80) or {}).get("kind")
        held = None if kind else held
        out.append((status, kind, differ))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_equal_a_plain_loop(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for flow in range(120):
        text = b"GET /" + b"x" * rng.choice([3, 40, 17_000 if flow % 10 == 0 else 300]) + b" HTTP/1.1\r\nHost: y\r\n\r\n" + bytes(rng.randrange(256) for _ in range(30))
        start, now, sent = rng.choice([5, 2**32 - 20, 2**31 - 3]), 0, []
        for n in range(rng.randrange(2, 14)):
            now += rng.choice([1, 1, 1, 300, 1500, 31_000])
            a = rng.choice([0, 0, 4, 10, rng.randrange(len(text)), 16_380, -30])
            data = text[max(a, 0) : max(a, 0) + rng.choice([0, 3, 8, 40, 2000])]
            if rng.random() < 0.15 and data:
                data = bytes([data[0] ^ 1]) + data[1:]
            declared = len(data) + (5 if rng.random() < 0.1 else 0)
            sent.append((now, (start + a) % 2**32, data, declared))
            rows.append((flow, True, n, now, (start + a) % 2**32, data, declared, False, 9, 80))
        want |= {(flow, n): w for n, w in enumerate(plain_direction(sent))}
    got = r.desegmented(spark.createDataFrame(rows, SEGMENTS).repartition(5), ["flow", "outbound"], "n").collect()
    assert {(g["flow"], g["n"]): (g["app"]["assembly"], g["app"]["kind"], g["app"]["conflicting"]) for g in got} == want
    assert {w[0] for w in want.values()} == {None, r.WHOLE, r.MISSING, r.TRUNCATED}
    total = r.counters(r.desegmented(spark.createDataFrame(rows, SEGMENTS), ["flow", "outbound"], "n"), "app").first()
    assert total["conflicting_bytes"] == sum(w[2] for w in want.values()) and total["completed"] == sum(w[:1] == (r.WHOLE,) and w[1] is not None for w in want.values())


def plain_fragments(rows):
    held, out = None, []
    for now, at, more, data, declared in rows:
        if held and (now - held["last"] > 15_000 or now - held["first"] > 15_000):
            held = None
        held = held or {"bytes": {}, "first": now, "total": None, "cut": None, "head": False}
        held["last"] = now
        if not more:
            if held["total"] not in (None, at + declared) or held["total"] is None and any(k >= at + declared for k in held["bytes"]):
                out.append("refused")
                continue
            held["total"] = at + declared
        held["head"] |= at == 0
        if len(data) < declared:
            held["cut"] = min(at + len(data), held["cut"] if held["cut"] is not None else 1 << 60)
        for i, b in enumerate(data):
            if at + i < 65_535:
                held["bytes"].setdefault(at + i, b)
        n = 0
        while n in held["bytes"]:
            n += 1
        status = r.WHOLE if held["total"] is not None and n >= held["total"] else r.TRUNCATED if held["cut"] is not None and held["cut"] <= n else None
        if status:
            out.append((status, bytes(held["bytes"][i] for i in range(min(n, held["total"] if held["total"] is not None else n)))) if held["head"] else None)
            held = None
        else:
            out.append(None)
            held = None if at + len(data) > 65_535 else held
    return out


def test_fragments_equal_a_plain_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    header = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 0, 7, 0x4000, 9, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    for ident in range(200):
        whole, now, sent = bytes(rng.randrange(256) for _ in range(40)), 0, []
        for n in range(rng.randrange(1, 9)):
            now += rng.choice([1, 1, 1, 8000, 16_000])
            at = rng.choice([0, 8, 16, 24, 32, 65_528])
            size = rng.choice([8, 8, 16])
            data, more = whole[at : at + size] or b"12345678", at != 32 or rng.random() < 0.1
            declared = len(data)
            data = data[:5] if rng.random() < 0.08 else data
            sent.append((now, at, more, data, declared))
            rows.append(("a", "b", ident, 17, n, *sent[-1][:1], at, more, header, data, declared))
        want |= {(ident, n): w for n, w in enumerate(plain_fragments(sent))}
    df = spark.createDataFrame(rows, "src string, dst string, ip_id int, proto int, ordinal long, clock_ms long, frag_offset long, more_fragments boolean, ip_header binary, ip_payload binary, ip_declared long")
    for g in r.rejoined(df).collect():
        w, j = want[g["ip_id"], g["ordinal"]], g["joined"]
        assert j["forged_end"] == (w == "refused")
        if isinstance(w, tuple):
            data = bytes(j["datagram"])
            assert (j["status"], data[20:], j["payload_len"]) == (*w, len(w[1]))
            assert struct.unpack(">H", data[2:4])[0] == len(data) and data[6:8] == b"\x40\0" and r._checksum(data[:20]) == 0
        else:
            assert j["status"] is None
    kinds = {w if isinstance(w, str) else w and w[0] for w in want.values()}
    assert kinds == {None, "refused", r.WHOLE, r.TRUNCATED}


def decided(spark, segments, src=9, dst=53):
    rows = [(1, True, n, x[2] if len(x) > 2 else n, x[0] % 2**32, x[1], len(x[1]), len(x) > 3, src, dst) for n, x in enumerate(segments)]
    return [(g["app"]["kind"], g["app"]["id"]) for g in r.desegmented(spark.createDataFrame(rows, SEGMENTS), ["flow", "outbound"], "n").orderBy("n").collect()]


def test_dns_messages_in_a_stream(spark):
    framed = lambda m: struct.pack(">H", len(m)) + m
    a, b = framed(query(1, "a.example")), framed(query(2, "b.example"))
    none, first, second = (None, None), ("dns", 1), ("dns", 2)
    assert decided(spark, [(0, a), (len(a), b)]) == [first, second]
    assert decided(spark, [(0, a[:9]), (9, a[9:]), (len(a), b)]) == [none, first, second]
    assert decided(spark, [(9, a[9:]), (0, a[:9]), (len(a), b)]) == [none, first, second]
    # The second message's head came with the first: its rest is no start, the one behind it is.
    assert decided(spark, [(2**32 - 5, a + b[:20]), (2**32 - 5 + len(a) + 20, b[20:]), (2**32 - 5 + len(a + b), a)]) == [first, none, first]
    # A length that is cut between its bytes.
    assert decided(spark, [(0, a + b[:1]), (len(a) + 1, b[1:]), (len(a + b), a)]) == [first, none, first]
    # A boundary is forgotten after 30 s of silence, and where a new connection starts.
    assert decided(spark, [(0, a + b[:20], 0), (len(a) + 20, a, 40_000)]) == [first, first]
    assert decided(spark, [(0, a + b[:20], 0), (0, b"", 1, "syn"), (5, b, 2)]) == [first, none, second]
    # From port 53 an ordinary client's request is one; a response is framed.
    answer = framed(response(3, "a.example", [(1, 5, bytes(4))]))
    assert decided(spark, [(0, b"GET / HTTP/1.1\r\n"), (16, answer)], 53, 80) == [("http", None), ("dns_response", 3)]
    # A message that never decodes does not hide the next.
    rejected = framed(struct.pack(">HHHHHH", 9, 0x100, 1, 0, 0, 0) + b"\0\0\1\0\1")
    assert decided(spark, [(0, rejected[:6]), (6, rejected[6:]), (len(rejected), b)]) == [none, none, second]


def test_cut_packets_explain_holes(spark):
    rows = [(1, True, 0, 100, 0, b"GET /", 5, False, 9, 80, 100), (1, True, 1, 200, 9, b"x", 1, False, 9, 80, 100), (1, True, 2, 1900, 12, b"y", 1, False, 9, 80, None)]
    got = r.desegmented(spark.createDataFrame(rows, SEGMENTS + ", cut_ms long"), ["flow", "outbound"], "n").orderBy("n").collect()
    assert [g["app"]["assembly"] for g in got] == [r.WHOLE, r.TRUNCATED, r.MISSING]
    clock = spark.createDataFrame([("f", 1, 10, 60, 60), ("f", 2, 20, 40, 60), ("f", 3, 30, 60, 60)], "path string, ordinal long, clock_ms long, cap_len int, wire_len int")
    assert [x["cut_ms"] for x in r.cut_clock(clock).orderBy("ordinal").collect()] == [None, 20, 20]


@pytest.mark.parametrize("times,want", [
    ([0, 10, 5, 20], [0, 10, 10, 20]), ([100, 110, 10, 115], [0, 10, 10, 15]), ([100, 110, 10, 12, 20], [0, 10, 10, 12, 20]), ([100, 110, 10, 8, 9], [0, 10, 10, 10, 11]), ([100, 39.9, 39.8, 200], [0, 0, 0, 160.2]),
])
def test_replayed_clock(spark, times, want):
    df = spark.createDataFrame([("f", i, int(t * 10**9)) for i, t in enumerate(times)], "path string, ordinal long, ts_ns long")
    got = [x["clock_ms"] / 1000 for x in r.replay_clock(df).orderBy("ordinal").collect()]
    assert got == want
    assert list(r.replay_clock(df.limit(0)).collect()) == []
