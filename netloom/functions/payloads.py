"""Application payloads: DNS messages, TLS ClientHello and HTTP heads, decoded in Arrow batches.

`decoded` gives one struct a payload: what it is (`kind`), that protocol's fields, and `need`, how many more bytes at least
could let a detector decide. Each decoder is a small reader over bytes that gives a dict, or None for what it does not
recognise; whatever a message promises and does not hold makes a read fail (`Cut`), never a guess.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from netloom.functions.network import HTTP_METHODS, SECRET_HEADERS

ANSWER = "struct<name:string,rtype:int,ttl:bigint,data:string,truncated:boolean>"
APP = (
    "kind string, need int, id int, name string, qtype int, rcode int, answer_count int, "
    f"answers array<{ANSWER}>, method string, path string, status string, reason string, content_type string, "
    "content_length decimal(20,0), sni string, ja3 string, sni_offset int, sni_len int"
)
#: Limits of the decoders.
NAME_BYTES, POINTERS, ANSWERS, TXT_ANSWER, TXT_RESPONSE = 255, 16, 16, 512, 2048
HEADER_BYTES, HEADER_LINES, REASON_BYTES, MEDIA_BYTES, START_LINE = 8192, 100, 128, 255, 2048
STREAM_BYTES = 16 * 1024
#: White space as Unicode lists it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORDS = re.compile(f"[^{WHITE}]+")
_MEDIA = re.compile(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+/[!#$%&'*+\-.^_`|~0-9A-Za-z]+")


class Cut(Exception):
    """The bytes end, or break a rule, before what is read is whole."""


class Reader:
    """A place in a message; every read moves it on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Cut
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def sized(self, size: int) -> bytes:
        """Bytes behind their length, a number of `size` bytes."""
        return self.take(self.number(size))

    def name(self) -> str:
        """A domain name; compressed ones are followed, and the place is then behind the first pointer."""
        labels, used, jumps, back = [], 0, 0, None
        while n := self.number(1):
            if n >= 0xC0:
                target = (n & 0x3F) << 8 | self.number(1)
                back, jumps = self.at if back is None else back, jumps + 1
                if jumps > POINTERS:
                    raise Cut
                self.at = target
                continue
            used += n + 1
            if n >= 0x40 or used > NAME_BYTES:
                raise Cut
            labels.append(_text(self.take(n)))
        self.at = self.at if back is None else back
        return ".".join(labels)


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        raise Cut from None


def is_secret(name: str, value: str) -> bool:
    return name.lower() in SECRET_HEADERS or value.lstrip(WHITE)[:7].lower() == "bearer "


#: How a byte of TXT data is written: printable ASCII as it stands, the backslash doubled, the rest as three digits.
ESCAPES = ["\\\\" if b == 0x5C else chr(b) if 0x20 <= b <= 0x7E else f"\\{b:03d}" for b in range(256)]


def _fitting(pieces: list[str], room: int) -> str:
    """As many whole pieces as fit."""
    out = ""
    for p in pieces:
        if len(out) + len(p) > room:
            break
        out += p
    return out


def txt(data: bytes, budget: int) -> tuple[str, bool]:
    """(text, cut) of TXT data within the budget of its response; data that overruns itself is empty."""
    reader, held = Reader(data), b""
    try:
        while reader.at < len(data):
            held += reader.sized(1)
    except Cut:
        return "", False
    if not budget:
        return "", bool(held)
    pieces = [ESCAPES[b] for b in held]
    shown = _fitting(pieces, TXT_ANSWER)
    kept = held[: next((i for i in range(len(pieces) + 1) if len("".join(pieces[:i])) == len(shown)), 0)].decode("latin-1")
    key = re.split("[=:]", kept, maxsplit=1)[0].strip(WHITE)
    cut = len(kept) < len(held)
    if is_secret(key if len(key) <= 64 else "", kept):
        pieces, shown, cut = list("[REDACTED]"), "[REDACTED]", False
    fitting = _fitting(pieces, min(budget, len(shown)))
    return fitting, cut or len(fitting) < len(shown)


def _answers(reader: Reader, count: int) -> list[dict]:
    out, budget = [], TXT_RESPONSE
    while len(out) < min(count, ANSWERS):
        try:
            name, (rtype, _, ttl) = reader.name(), struct.unpack(">HHI", reader.take(8))
            size, start = reader.number(2), reader.at
            data, shown, cut = reader.take(size), "", False
        except Cut:
            break  # the rest of a message that was cut cannot be placed
        if rtype == 16:
            shown, cut = txt(data, budget)
            budget -= len(shown)
        elif (rtype, size) == (1, 4):
            shown = ".".join(map(str, data))
        elif (rtype, size) == (28, 16):
            six = ipaddress.IPv6Address(data)
            shown = f"::ffff:{six.ipv4_mapped}" if six.ipv4_mapped else str(six)
        elif rtype in (2, 5, 12):
            try:
                shown = Reader(reader.data, start).name()
            except Cut:
                shown = ""
        out.append({"name": name, "rtype": rtype, "ttl": ttl, "data": shown, "truncated": cut})
    return out


def dns(data: bytes) -> dict | None:
    """A query, or a response with the answers that are there."""
    if len(data) < 12:
        return None
    try:
        reader = Reader(data)
        ident, high, low, questions, count, _ = struct.unpack(">HBBHHI", reader.take(12))
        name = reader.name() if questions else ""
        if not name:
            return None
        if high < 0x80:
            qtype = int.from_bytes(data[reader.at : reader.at + 2], "big") if reader.at + 2 <= len(data) else 0
            return {"kind": "dns", "id": ident, "name": name, "qtype": qtype}
        out = {"kind": "dns_response", "id": ident, "name": name, "qtype": reader.number(2), "rcode": low & 15, "answer_count": count, "answers": []}
        reader.take(2)
    except Cut:
        return None
    try:
        for _ in range(1, questions):
            if questions > 16:
                raise Cut
            reader.name()
            reader.take(4)
        out["answers"] = _answers(reader, count)
    except Cut:
        pass  # a further question cannot be passed, so no answer can be placed
    return out


def dns_framed(data: bytes) -> dict | None:
    """The first message of a DNS stream, behind its length; {'need': n} while it is cut."""
    if len(data) < 2:
        return {"need": 1} if data else None
    size = int.from_bytes(data[:2], "big")
    if not 12 <= size <= STREAM_BYTES - 2:
        return None
    return {"need": size + 2 - len(data)} if len(data) < size + 2 else dns(data[2 : size + 2])


def _numbers(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)]


def client_hello(data: bytes) -> dict | None:
    """A ClientHello that names its server: name and JA3 over all that is there."""
    if data[:1] != b"\x16" or data[5:6] != b"\x01":
        return None
    reader, seen, curves, formats, server = Reader(data, 9), [], [], [], None
    try:
        version = reader.number(2)
        reader.take(32)
        reader.sized(1)
        ciphers = _numbers(reader.sized(2))
        reader.sized(1)
        reader.take(2)
    except Cut:
        return None
    while reader.at + 4 <= len(data):
        kind, size = reader.number(2), reader.number(2)
        seen.append(kind)
        start, body = reader.at, data[reader.at : reader.at + size]
        reader.at += size
        if len(body) < size:
            continue
        inner = Reader(body)
        try:
            if kind == 0:
                inner.take(3)
                server = (_text(inner.sized(2)), start + 5)
            elif kind == 10:
                curves = _numbers(inner.sized(2))
            elif kind == 11:
                formats = list(inner.sized(1))
        except Cut:
            continue
    if server is None:
        return None
    lists = ["-".join(map(str, x)) for x in (ciphers, seen, curves, formats)]
    mark = hashlib.md5(",".join([str(version), *lists]).encode()).hexdigest()
    return {"kind": "tls_client_hello", "sni": server[0], "ja3": mark, "sni_offset": server[1], "sni_len": len(server[0].encode())}


def _first_line(data: bytes) -> str | None:
    line, end, _ = data.partition(b"\n")
    try:
        return line.removesuffix(b"\r").decode() if end else None
    except UnicodeDecodeError:
        return None


def http_request(data: bytes) -> dict | None:
    if b"\n" not in data:
        return None
    words = _WORDS.findall(_first_line(data) or "")
    if len(words) > 1 and words[0] in HTTP_METHODS and words[1].startswith("/"):
        return {"kind": "http", "method": words[0], "path": words[1]}
    return None


def _media(value: bytes) -> str | None:
    media = value.partition(b";")[0].strip(b" \t")
    return media.decode().lower() if len(media) <= MEDIA_BYTES and _MEDIA.fullmatch(media) else None


def _length(value: bytes) -> int | None:
    return int(value) if value and value.isdigit() and int(value) < 1 << 64 else None


def _header_values(block: bytes) -> dict[bytes, set]:
    """For the two headers of interest all values said before the blank line; None among them where one is unreadable or folded."""
    said: dict[bytes, set] = {b"content-type": set(), b"content-length": set()}
    name = b""
    for line in block[:HEADER_BYTES].split(b"\n")[:-1][:HEADER_LINES]:  # a last line without an end may be cut
        line = line.removesuffix(b"\r")
        if not line:
            break
        if line[:1] in (b" ", b"\t"):
            if name in said:
                said[name].add(None)
            continue
        name, colon, value = line.partition(b":")
        name = name.lower() if colon else b""
        if name in said:
            said[name].add((_media if name == b"content-type" else _length)(value.strip(b" \t")))
    return said


def http_response(data: bytes) -> dict | None:
    if b"\n" not in data:
        return None
    line = (_first_line(data) or "").lstrip(WHITE)
    words = _WORDS.findall(line)
    if len(words) < 2 or not words[0].startswith("HTTP/") or not re.fullmatch("[0-9]{3}", words[1]):
        return None
    reason = line[len(words[0]) :].lstrip(WHITE)[3:].strip(WHITE)
    if not re.fullmatch(f"[ -~]{{1,{REASON_BYTES}}}", reason):
        reason = None
    elif is_secret("reason", reason):
        reason = "[REDACTED]"
    said = {k: next(iter(v)) if len(v) == 1 else None for k, v in _header_values(data.partition(b"\n")[2]).items()}
    return {"kind": "http_response", "status": words[1], "reason": reason, "content_type": said[b"content-type"], "content_length": said[b"content-length"]}


_STARTS = (*(m.encode() + b" " for m in HTTP_METHODS), b"HTTP/")
_PRINTABLE = re.compile(rb"[ -~\r]+")


def missing(data: bytes) -> int | None:
    """The least number of bytes that could complete the start of something known."""
    if data[:1] == b"\x16":
        whole = 5 + int.from_bytes(data[3:5], "big") if len(data) >= 5 else 5
        if len(data) < whole:
            return whole - len(data)
    if not data or len(data) > START_LINE or not (data.startswith(_STARTS) or any(s.startswith(data) for s in _STARTS)):
        return None
    return 1 if _PRINTABLE.fullmatch(data) else None


def sniff(data: bytes, tcp: bool, src_port: int | None, dst_port: int | None) -> dict | None:
    """What a payload is, {'need': n} for the start of something, None for all else.

    Port 53 over TCP is framed DNS; from it HTTP and TLS come first, since an ordinary client may use that port. Otherwise
    the port of the receiver says where to look: 53 DNS, 443 TLS, any other everything in turn.
    """
    if tcp and dst_port == 53:
        return dns_framed(data)
    if tcp and src_port == 53:
        order = (http_request, http_response, client_hello, dns_framed)
    else:
        order = {53: (dns,), 443: (client_hello,)}.get(dst_port, (http_request, http_response, dns, client_hello))
    for detector in order:
        if (found := detector(data)) is not None:
            return found
    need = missing(data)
    return None if need is None else {"need": need}


def decoded(payload: Column, tcp: Column, src_port: Column, dst_port: Column) -> Column:
    """A struct of APP for each payload; null where there is none."""
    kind = StructType.fromDDL(APP)
    arrow = to_arrow_type(kind)
    blank = dict.fromkeys(kind.names)

    @F.arrow_udf(kind)
    def run(data: pa.Array, over_tcp: pa.Array, sender: pa.Array, receiver: pa.Array) -> pa.Array:
        columns = (x.to_pylist() for x in (data, over_tcp, sender, receiver))
        return pa.array([None if d is None else blank | (sniff(d, bool(t), s, r) or {}) for d, t, s, r in zip(*columns, strict=True)], arrow)

    return run(payload, tcp, src_port, dst_port)
