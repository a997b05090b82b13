"""Follow-stream: order, gaps, turns, resets; TLS withheld and credentials masked."""

from __future__ import annotations

import random

import pytest

from netloom.operators import follow

KIND = "flow string, ordinal long, outbound boolean, clock_ms long, seq long, ack long, payload binary, syn boolean, ack_flag boolean, fin boolean, rst boolean"


def seg(n, out, seq, data=b"", ms=None, ack=None, flags=""):
    return ("f", n, out, n if ms is None else ms, seq % 2**32, ack if ack is None else ack % 2**32, data, "S" in flags, ack is not None or "A" in flags, "F" in flags, "R" in flags)


def run(spark, rows):
    return {r["side"]: r for r in follow.streams(spark.createDataFrame(rows, KIND)).withColumn("s", follow.shown()).collect()}


def test_bytes_come_in_order_whatever_the_arrival(spark):
    rng, rows, want = random.Random(7), [], {}
    for flow in range(40):
        text, start = bytes(rng.randrange(256) for _ in range(600)), rng.choice([0, 2**32 - 50, 77])
        cuts = sorted({0, 600, *(rng.randrange(600) for _ in range(9))})
        parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        again = [(max(0, a - 5), b) for a, b in rng.sample(parts, 3)]
        sent = parts[1:] + again
        rng.shuffle(sent)
        rows += [(str(flow), *x[1:]) for x in [seg(0, True, start - 1, flags="S"), *[seg(i + 1, True, start + a, text[a:b]) for i, (a, b) in enumerate(sent)], seg(90, True, start, text[:10]), seg(91, True, start, text)]]
        want[str(flow)] = text
    got = follow.streams(spark.createDataFrame(rows, KIND)).where("side = 'c2s'").collect()
    assert {r["flow"]: bytes(r["data"]) for r in got} == want and all(not r["gaps"] and r["conflicting"] == 0 and r["start_captured"] for r in got)


def test_holes_become_gaps_of_known_size(spark):
    waits = [seg(0, True, 99, flags="S"), seg(1, True, 100, b"ab"), seg(2, True, 110, b"cd", ms=10), seg(3, True, 120, b"ef", ms=500), seg(4, False, 1, b"x", ms=2011)]
    r = run(spark, waits)["c2s"]
    assert (bytes(r["data"]), [(g["at"], g["missing"], g["reason"]) for g in r["gaps"]]) == (b"abcdef", [(2, 8, "missing"), (4, 8, "missing")])
    far = [seg(0, True, 99, flags="S"), seg(1, True, 100, b"ab"), seg(2, True, 104, b"cd"), seg(3, True, 100 + 70_000, b"ef")]
    assert [(g["at"], g["missing"]) for g in run(spark, far)["c2s"]["gaps"]] == [(2, 2), (4, 69_994)]
    late = run(spark, [*waits[:3], seg(3, True, 102, b"12345678", ms=20), seg(4, True, 102, b"1234567x", ms=21)])["c2s"]
    assert (bytes(late["data"]), late["gaps"], late["conflicting"]) == (b"ab12345678cd", [], 1)


def test_ends_turns_and_caps(spark):
    rows = [seg(0, True, 9, flags="S"), seg(1, False, 99, ack=10, flags="SA"), seg(2, True, 10, b"ask", flags="A", ack=100), seg(3, False, 100, b"tell", ack=13), seg(4, False, 104, b"more", ack=13), seg(5, True, 13, b"bye", flags="FA", ack=108), seg(6, True, 16, b"late", ack=108), seg(7, False, 108, flags="FA", ack=17)]
    got = run(spark, rows)
    assert [(t["turn"], t["start"], t["len"]) for t in got["c2s"]["turns"]] == [(0, 0, 3), (2, 3, 3)] and [(t["turn"], t["start"], t["len"]) for t in got["s2c"]["turns"]] == [(1, 0, 8)]
    assert bytes(got["c2s"]["data"]) == b"askbye" and got["c2s"]["closed"] and got["s2c"]["closed"] and not got["c2s"]["reset"] and got["c2s"]["seen"] == 10
    big = run(spark, [seg(0, True, 9, flags="S"), *[seg(i + 1, True, 10 + i * 60_000, b"z" * 60_000) for i in range(6)]])["c2s"]
    assert (len(big["data"]), big["stopped"]) == (256 * 1024, "store_cap")
    server_first = run(spark, [seg(0, True, 9, ack=5, flags="SA"), seg(1, False, 5, b"hi", ack=10)])
    assert bytes(server_first["c2s"]["data"]) == b"hi" and run(spark, [seg(0, False, 9, b"m")])["s2c"]["start_captured"] is False


def test_only_resets_in_place_count(spark):
    opened = [seg(0, True, 9, flags="S"), seg(1, False, 99, ack=10, flags="SA"), seg(2, True, 10, b"ask", ack=100), seg(3, False, 100, b"te", ack=13)]
    forged = run(spark, [*opened, seg(4, False, 2**31, flags="R"), seg(5, True, 2**31 + 7, flags="R"), seg(6, True, 13, b"on", ack=102)])
    assert bytes(forged["c2s"]["data"]) == b"askon" and not forged["c2s"]["reset"]
    for row in (seg(4, False, 102, flags="R"), seg(4, True, 13, flags="R"), seg(4, True, 13 + 2**20, flags="R")):
        got = run(spark, [*opened, row, seg(5, True, 13, b"no", ack=102)])
        assert bytes(got["c2s"]["data"]) == b"ask" and got["c2s"]["reset"] and got["s2c"]["closed"]
    unseen = run(spark, [*opened, seg(4, False, 102, ack=20), seg(5, False, 102, flags="R")])["c2s"]
    assert [(g["at"], g["missing"]) for g in unseen["gaps"]] == [(3, 7)]


SECRET = b"GET / HTTP/1.1\r\nHost: x\r\nAuthorization: Basic abc\r\nX-Other:  Bearer tok\r\nCookie: a\r\n b=c\r\nAccept: y\r\n z\r\n\r\nCookie: body\r\n"


@pytest.mark.parametrize("data,gaps,start,closed,want", [
    (SECRET, [], True, True, [b"Basic abc", b"Bearer tok", b"a", b" b=c", b"y", b" z", b"body"]),
    (b"plain text: no\nset-cookie:\r\nx", [], True, True, []),
    (b"Host: x\r\nCookie: se", [], True, True, [b"se"]),
    (b"Host: x\r\nCookie: se", [], True, False, [b"Cookie: se"]),
    (b"Host: x\r\nHost: y\r\n", [], True, False, [b"y"]),
    (b"Coo", [], True, False, [b"Coo"]), (b"not a name (", [], True, False, []), (b"Coo", [], True, True, []),
    (b"Host: abcdef: 3\r\n folded\r\nHost: x\r\n", [9], True, True, [b"Host: abcdef: 3\r", b" folded\r"]),
    (b"tail of a line\r\nHost: x\r\n", [], False, True, [b"tail of a line\r"]),
    (b"a" * 17_000 + b": v\r\n cont\r\nHost: x\r\n", [], True, True, [b"a" * 17_000 + b": v\r", b" cont\r"]),
    (b"\xff(" + b"b" * 20_000 + b"\n", [0], True, True, [b"\xff(" + b"b" * 16_382]),
    (b"Proxy-Authorization:x\nX:y\n\tz\n\tw\nQ:1\n", [], True, True, [b"x", b"y", b"\tz", b"\tw"]),
])
def test_masks(data, gaps, start, closed, want):
    found = follow.masks(data, gaps, start, closed)
    assert [data[a:b] for a, b, _ in found] == want
    assert follow._show(data, [{"at": g} for g in gaps], start, closed, None)["data"].count(b"*") - data.count(b"*") == sum(map(len, want))


def test_tls_is_withheld(spark):
    record = lambda kind, body: bytes([kind, 3, 3]) + len(body).to_bytes(2, "big") + body
    hello = record(0x16, b"\1" + b"h" * 40)
    assert follow.tls_from(hello) == 0 and follow.tls_from(b"EHLO x\r\nSTARTTLS\r\n" + record(0x17, b"q" * 9) + record(0x17, b"q")) == 0
    late = b"y" * 30_000
    assert follow.tls_from(late + record(0x17, b"q" * 9) + record(0x17, b"q")) == 30_000 and follow.tls_from(late + hello) == 30_000
    assert follow.tls_from(b"\x16\x03\x01 no record \x17\x03\x03\x00\x02zz") is None and follow.tls_from(b"") is None
    got = run(spark, [seg(0, True, 9, flags="S"), seg(1, True, 10, hello)])["c2s"]["s"]
    assert (bytes(got["data"]), got["tls_from"], got["masks"]) == (b"", 0, [])


def test_too_many_masks_cut_the_stream():
    data = b"Cookie: x\r\nHost: y\r\n" * 1100
    got = follow._show(data, [], True, True, None)
    assert got["stopped"] == "redaction_limit" and len(got["masks"]) == 1024 and b"Cookie: x" not in got["data"]


def test_pages(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 40_000),)], "data binary")
    r = df.select(follow.page(df["data"], 32_768).alias("p")).first()["p"]
    assert (r["offset"], r["next"]) == (32_768, 40_000)
