"""Payload decoders against known bytes, cuts at every length, and hostile input."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from netloom.functions import payloads as p


def qname(name):
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


def query(ident, name, qtype=1):
    return struct.pack(">HHHHHH", ident, 0x100, 1, 0, 0, 0) + qname(name) + struct.pack(">HH", qtype, 1)


def response(ident, name, answers, rcode=0, qtype=1):
    out = struct.pack(">HHHHHH", ident, 0x8180 | rcode, 1, len(answers), 0, 0) + qname(name) + struct.pack(">HH", qtype, 1)
    return out + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", t, 1, ttl, len(d)) + d for t, ttl, d in answers)


def hello(name, ciphers=(0x1301, 0xC02F), curves=(29,)):
    sni = b"\0" + struct.pack(">H", len(name)) + name
    extensions = [(0, struct.pack(">H", len(sni)) + sni), (10, struct.pack(">H", 2 * len(curves)) + b"".join(struct.pack(">H", c) for c in curves)), (11, b"\x01\x00")]
    block = b"".join(struct.pack(">HH", k, len(b)) + b for k, b in extensions)
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers) + b"\x01\0" + struct.pack(">H", len(block)) + block
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def test_dns_queries_and_responses():
    assert p.dns(query(7, "www.example.org", 28)) == {"kind": "dns", "id": 7, "name": "www.example.org", "qtype": 28}
    answers = [(1, 60, bytes([93, 184, 0, 1])), (28, 5, bytes(15) + b"\1"), (5, 9, b"\x03cdn\xc0\x10"), (16, 1, b"\x05a\\b\x00c\x02de"), (99, 2, b"xx"), (1, 1, b"bad")]
    got = p.dns(response(9, "www.example.org", answers, 3))
    assert (got["rcode"], got["answer_count"], [a["data"] for a in got["answers"]]) == (3, 6, ["93.184.0.1", "::1", "cdn.example.org", "a\\\\b\\000cde", "", ""])
    assert {a["name"] for a in got["answers"]} == {"www.example.org"} and [a["ttl"] for a in got["answers"]] == [60, 5, 9, 1, 2, 1]
    assert len(p.dns(response(1, "a.b", [(1, 1, bytes(4))] * 40))["answers"]) == 16
    whole = response(9, "www.example.org", answers)
    for n in range(len(whole)):
        cut = p.dns(whole[:n])
        assert cut is None or len(cut["answers"]) < 6
    loop = struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"\xc0\x0c"
    far = struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"\xc0\xff"
    long = query(1, ".".join(["x" * 63] * 4))
    for bad in (loop, far, long, query(1, "a")[:11], struct.pack(">HHHHHH", 1, 0x100, 0, 0, 0, 0) + qname("a"), struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"\0\0\1\0\1", query(1, "a").replace(b"\x01a\0", b"\x41a\0"), query(1, "a").replace(b"\x01a\0", b"\x01\xff\0")):
        assert p.dns(bad) is None
    chain = lambda n: struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"".join(struct.pack(">H", 0xC000 | 14 + 2 * i) for i in range(n)) + qname("a")
    assert p.dns(chain(17)) is None and p.dns(chain(16))["name"] == "a"


def test_txt_answers_are_escaped_cut_and_redacted():
    assert p.txt(b"\x03a\tb", 99) == ("a\\009b", False)
    assert p.txt(b"\x05ab", 99) == ("", False) and p.txt(b"\x01a", 0) == ("", True) and p.txt(b"\x00", 0) == ("", False)
    long, cut = p.txt(b"".join(b"\xff" + b"\x01" * 255 for _ in range(2)), 2048)
    assert len(long) == 512 and cut and long == "\\001" * 128
    assert p.txt(b"\x04a\x01bc", 3) == ("a", True)
    for said in (b"Cookie : a=secret", b"\tBearer xy", b"X-API-Key=abc"):
        assert p.txt(bytes([len(said)]) + said, 99) == ("[REDACTED]", False)
    assert p.txt(b"\x0aset:cookie", 99) == ("set:cookie", False) and p.txt(b"\x0bcookie=1234", 4) == ("[RED", True)
    many = p.dns(response(1, "a.b", [(16, 1, b"\xff" + b"y" * 255 + b"\xff" + b"y" * 255)] * 5))["answers"]
    assert [len(a["data"]) for a in many] == [510, 510, 510, 510, 8] and [a["truncated"] for a in many] == [False] * 4 + [True]


def test_client_hello_gives_name_and_ja3():
    whole = hello(b"example.com")
    got = p.client_hello(whole)
    assert got["sni"] == "example.com" and got["ja3"] == hashlib.md5(b"771,4865-49199,0-10-11,29,0").hexdigest()
    assert whole[got["sni_offset"] : got["sni_offset"] + got["sni_len"]] == b"example.com"
    for n in range(len(whole)):
        cut = p.client_hello(whole[:n])
        assert cut is None or cut["sni"] == "example.com"
    assert p.sniff(whole[:40], True, 1, 443) == {"need": len(whole) - 40} and p.sniff(whole[:3], True, 1, 443) == {"need": 2}
    assert p.client_hello(hello(b""))["sni"] == "" and p.client_hello(hello(b"\xff")) is None


@pytest.mark.parametrize("head,want", [
    (b"Content-Type: text/html; charset=x\r\nContent-Length: 12\r\n\r\n", ("text/html", 12)),
    (b"content-length: 12\ncontent-LENGTH:12\nContent-Type:a/b\n\n", ("a/b", 12)),
    (b"Content-Length: 12\r\nContent-Length: 13\r\nContent-Type: a b/c\r\n\r\n", (None, None)),
    (b"Content-Type: a/b\r\n folded\r\nContent-Length: 18446744073709551616\r\n\r\n", (None, None)),
    (b"X: y\r\n folded\r\nContent-Length: 18446744073709551615\r\nContent-Type: a/b", (None, 2**64 - 1)),
    (b"\r\nContent-Length: 5\r\n", (None, None)),
    (b"Content-Length: +5\r\nno colon\r\n\tContent-Type: a/b\r\nContent-Type: A/B+x\r\n\r\n", ("a/b+x", None)),
    (b"A: b\r\n" * 100 + b"Content-Length: 5\r\n\r\n", (None, None)),
    (b"A: " + b"b" * 8190 + b"\r\nContent-Length: 5\r\n\r\n", (None, None)),
])
def test_response_headers(head, want):
    got = p.http_response(b"HTTP/1.1 200 OK\r\n" + head)
    assert (got["content_type"], got["content_length"]) == want and got["reason"] == "OK"


def test_start_lines_and_what_is_missing():
    assert p.http_response(b"HTTP/1.1 404 Not  Found \n")["reason"] == "Not  Found"
    assert p.http_response(b"HTTP/1.1 401 bearer abc\n")["reason"] == "[REDACTED]"
    assert p.http_response(b"HTTP/2 204\r\n")["reason"] is None and p.http_response(b"HTTP/1.1 200" + b" x" * 70 + b"\n")["reason"] is None
    assert p.http_response("HTTP/1.1 200 é\n".encode())["reason"] is None
    for bad in (b"HTTP/1.1 20 OK\n", b"HTTP/1.1 200 OK", b"HTTX 200\n", b"\n", b"HTTP/1.1 \xd9\xa1\xd9\xa1\xd9\xa1 OK\n", b"HTTP/1.1 200 \xff\n"):
        assert p.http_response(bad) is None
    assert p.http_request(b"GET /a?b HTTP/1.1\r\nHost: x") == {"kind": "http", "method": "GET", "path": "/a?b"} and p.http_request(b"GET a HTTP\n") is None and p.http_request(b"TRACE / x\n") is None
    for start, need in ((b"GE", 1), (b"GET /x", 1), (b"HTTP/1.1 20", 1), (b"GETX", None), (b"GET /x\nrest", None), (b"", None), (b"GET /\x00", None), (b"G" * 3000, None), (b"GET /x\r", 1), (b"\x16", 4), (b"\x16\x03\x01\x00\x05abc", 2), (b"HTTPS", None)):
        assert p.missing(start) == need, start


def test_ports_say_where_to_look():
    q, framed = query(1, "a.b"), struct.pack(">H", len(query(1, "a.b"))) + query(1, "a.b")
    kind = lambda *a: (p.sniff(*a) or {}).get("kind")
    assert kind(q, False, 9, 53) == "dns" and kind(b"GET / x\n", False, 9, 53) is None and kind(q, False, 9, 443) is None and kind(q, True, 9, 9) == "dns"
    assert kind(framed, True, 9, 53) == "dns" and kind(q, True, 9, 53) is None and kind(b"GET / x\n", True, 53, 80) == "http" and kind(b"GET / x\n", True, 9, 53) is None
    assert p.sniff(framed[:-3], True, 53, 9) == {"need": 3} and p.sniff(b"\0", True, 9, 53) == {"need": 1} and p.sniff(b"\0\x05", True, 9, 53) is None
    assert kind(hello(b"x.y"), True, 53, 9) == "tls_client_hello" and kind(framed + framed[:4], True, 53, 9) == "dns"


def test_random_bytes_never_raise():
    rng = random.Random(5)
    seeds = [query(1, "a.b"), response(1, "a.b", [(1, 1, bytes(4)), (5, 1, b"\xc0\x0c")]), hello(b"a.b"), b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n", b"GET / HTTP/1.1\r\n"]
    for _ in range(4000):
        data = bytearray(rng.choice(seeds))
        for _ in range(rng.randrange(5)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        for tcp, a, b in ((True, 53, 1), (True, 1, 53), (False, 1, 53), (True, 1, 443), (True, 1, 80)):
            p.sniff(bytes(data[: rng.randrange(len(data) + 1)]), tcp, a, b)


def test_decoded_column(spark):
    rows = [(1, query(65535, "a.b"), False, 5, 53), (2, None, True, None, None), (3, b"", True, 1, 80), (4, b"GET", True, 1, 80), (5, response(1, "a.b", [(1, 2**32 - 1, bytes(4))]), False, 53, 5), (6, b"HTTP/1.1 200 OK\r\nContent-Length: 18446744073709551615\r\n\r\n", True, 80, 5)]
    df = spark.createDataFrame(rows, "n int, data binary, tcp boolean, src int, dst int")
    got = {r["n"]: r["a"] for r in df.select("n", p.decoded(F.col("data"), F.col("tcp"), F.col("src"), F.col("dst")).alias("a")).collect()}
    assert got[1]["id"] == 65535 and got[2] is None and got[3]["kind"] is None and got[4]["need"] == 1 and got[4]["kind"] is None
    assert got[5]["answers"][0]["ttl"] == 2**32 - 1 and int(got[6]["content_length"]) == 2**64 - 1
