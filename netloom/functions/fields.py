"""The field tree of a packet: one array of typed fields with their place among the bytes, its nesting, and filters over it.

`field_list` builds the array from decoded headers and payloads by native expressions; `TREE` lets the filter language look
paths up in it, the first match winning. Flat columns remain the faster way for filters that many packets must pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.display_filter import Field
from netloom.functions.network import dns_rcode, dns_type
from netloom.functions.payloads import ANSWERS
from netloom.sources.captures import _uint

#: The paths of fields, their labels and kinds.
PATHS = {
    "eth": ("Ethernet II", "group"), "eth.dst": ("Destination MAC", "addr"), "eth.src": ("Source MAC", "addr"), "eth.vlan": ("802.1Q VLAN Tag", "group"), "eth.vlan.id": ("VLAN ID", "uint"), "eth.type": ("EtherType", "str"),
    "ip": ("Internet Protocol Version 4", "group"), "ip.src": ("Source Address", "addr"), "ip.dst": ("Destination Address", "addr"), "ip.ttl": ("Time to Live", "uint"), "ip.protocol_num": ("Protocol", "uint"), "ip.checksum": ("Header Checksum", "str"),
    "ip6": ("Internet Protocol Version 6", "group"), "ip6.src": ("Source Address", "addr"), "ip6.dst": ("Destination Address", "addr"), "ip6.hop_limit": ("Hop Limit", "uint"), "ip6.next_header": ("Next Header", "uint"),
    "tcp": ("Transmission Control Protocol", "group"), "tcp.src_port": ("Source Port", "uint"), "tcp.dst_port": ("Destination Port", "uint"), "tcp.seq": ("Sequence Number", "uint"), "tcp.ack_number": ("Acknowledgment Number", "uint"),
    "tcp.flags": ("Flags", "group"), "tcp.flags.syn": ("SYN", "bool"), "tcp.flags.ack": ("ACK", "bool"), "tcp.flags.fin": ("FIN", "bool"), "tcp.flags.rst": ("RST", "bool"), "tcp.window_size": ("Window Size", "uint"),
    "udp": ("User Datagram Protocol", "group"), "udp.src_port": ("Source Port", "uint"), "udp.dst_port": ("Destination Port", "uint"),
    "http": ("Hypertext Transfer Protocol", "group"), "http.request.method": ("Request Method", "str"), "http.request.uri": ("Request URI", "str"), "http.response.code": ("Status Code", "uint"),
    "http.response.phrase": ("Response Phrase", "str"), "http.content_type": ("Content-Type", "str"), "http.content_length": ("Content-Length", "uint"),
    "dns": ("Domain Name System", "group"), "dns.id": ("Transaction ID", "uint"), "dns.flags.response": ("Response", "bool"), "dns.flags.rcode": ("Response Code", "str"), "dns.qry.name": ("Query Name", "str"), "dns.qry.type": ("Query Type", "str"),
    "dns.count.answers": ("Answer RRs", "uint"), "dns.answers": ("Answers", "group"),
    "tls": ("Transport Layer Security", "group"), "tls.handshake.sni": ("Server Name", "str"), "tls.ja3": ("JA3 Fingerprint", "str"),
}
#: Fields of each DNS answer, below dns.answer.<i>.
ANSWER_PATHS = {"name": ("Name", "str"), "type": ("Type", "str"), "ttl": ("Time to Live (s)", "uint"), "data": ("Data", "str"), "truncated": ("Data Truncated", "bool")}
#: Groups whose members do not carry them as the first part of their path only.
PARENTS = {"eth.vlan": "eth", "eth.vlan.id": "eth.vlan", "tcp.flags": "tcp", "tcp.flags.syn": "tcp.flags", "tcp.flags.ack": "tcp.flags", "tcp.flags.fin": "tcp.flags", "tcp.flags.rst": "tcp.flags", "dns.answers": "dns"}
FIELD = "struct<path:string,label:string,group:string,type:string,vu:decimal(20,0),vb:boolean,vs:string,region:string,offset:int,len:int>"


def _field(path: Column, label: Column, group: Column, kind: Column, value: Column | None, of: str, region: str, offset: Column, size: Column) -> Column:
    held = {"vu": "decimal(20,0)", "vb": "boolean", "vs": "string"}
    slot = {"uint": "vu", "bool": "vb", "str": "vs", "addr": "vs"}.get(of)
    values = [(value if value is not None and slot == n else F.lit(None)).cast(t).alias(n) for n, t in held.items()]
    return F.struct(path.alias("path"), label.alias("label"), group.alias("group"), kind.alias("type"), *values, F.lit(region).alias("region"), offset.cast("int").alias("offset"), size.cast("int").alias("len"))


def _one(path: str, region: str, offset: Column | int, size: Column | int, value: Column | None = None, when: Column | None = None) -> Column:
    """A field that is there if its value is, or for groups and where given if `when` holds."""
    label, kind = PATHS[path]
    parent = PARENTS.get(path, path.split(".")[0] if "." in path else None)
    number = lambda n: F.lit(n) if isinstance(n, int) else n
    made = _field(F.lit(path), F.lit(label), F.lit(parent).cast("string"), F.lit(kind), value, kind, region, number(offset), number(size))
    there = F.lit(True) if when is None else when
    if value is not None:
        there = there & value.isNotNull()
    return F.when(there, made)


def field_list(decoded: DataFrame, app: str = "app_data") -> Column:
    """array<FIELD> of packets with the columns of `captures.headers`, settled, and a decoded payload; null where the frame is not an IP packet.

    Application fields are relative to the payload, 2 bytes further on in DNS over TCP; what has no bytes of its own spans it.
    """
    f, ok, ether = F.col("frame"), F.col("parse_status") == "ok", F.col("link_type") == 1
    mac = lambda at: F.rtrim(F.regexp_replace(F.lower(F.hex(F.substring(f, at + 1, 6))), "(..)(?=.)", "$1:"))
    tagged = F.col("vlan").isNotNull()
    l3 = F.when(tagged, 18).when(ether, 14).when(F.col("link_type").isin(0, 108), 4).otherwise(0)
    ip = F.when(ether, l3).otherwise(0)  # places count from the IP header where there is no Ethernet
    four = F.col("ip_header").isNotNull()
    head = F.when(four, F.octet_length("ip_header")).otherwise(40)
    four_, six = ok & four, ok & ~four
    l4, tcp, udp = ip + head, F.col("seq").isNotNull(), (F.col("proto") == 17) & F.col("src_port").isNotNull()
    tcp_size = F.floor(_uint(f, l3 + head + 12, 1) / F.lit(16)) * 4
    flag = lambda bit: F.col("tcp_flags").bitwiseAND(bit) != 0
    a = lambda c: F.col(f"{app}.{c}")
    kind, size = a("kind"), F.octet_length("payload")
    http, dns, tls = kind.startswith("http"), kind.startswith("dns"), kind == "tls_client_hello"
    answer, start = kind == "dns_response", F.when(F.col("proto") == 6, 2).otherwise(0)
    h = lambda path, offset, n, value=None, when=None: _one(path, "header", offset, n, value, when)
    p = lambda path, value=None, when=None, offset=0, n=size: _one(path, "payload", offset, n, value, when)
    fixed = [
        h("eth", 0, F.when(tagged, 18).otherwise(14), when=ether), h("eth.dst", 0, 6, mac(0), ether), h("eth.src", 6, 6, mac(6), ether), h("eth.vlan", 12, 4, when=tagged), h("eth.vlan.id", 14, 2, F.col("vlan")),
        h("eth.type", F.when(tagged, 16).otherwise(12), 2, F.when(four, "IPv4").otherwise("IPv6"), ether),
        h("ip", ip, head, when=four_), h("ip.src", ip + 12, 4, F.col("src"), four_), h("ip.dst", ip + 16, 4, F.col("dst"), four_), h("ip.ttl", ip + 8, 1, _uint(f, l3 + 8, 1), four_), h("ip.protocol_num", ip + 9, 1, F.col("proto"), four_),
        h("ip.checksum", ip + 10, 2, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_uint(f, l3 + 10, 2))), 4, "0")), four_),
        h("ip6", ip, head, when=six), h("ip6.src", ip + 8, 16, F.col("src"), six), h("ip6.dst", ip + 24, 16, F.col("dst"), six), h("ip6.hop_limit", ip + 7, 1, _uint(f, l3 + 7, 1), six), h("ip6.next_header", ip + 6, 1, _uint(f, l3 + 6, 1), six),
        h("tcp", l4, tcp_size, when=tcp), h("tcp.src_port", l4, 2, F.col("src_port"), tcp), h("tcp.dst_port", l4 + 2, 2, F.col("dst_port"), tcp), h("tcp.seq", l4 + 4, 4, F.col("seq"), tcp), h("tcp.ack_number", l4 + 8, 4, F.col("ack"), tcp),
        h("tcp.flags", l4 + 13, 1, when=tcp), *[h(f"tcp.flags.{n}", l4 + 13, 1, flag(bit), tcp) for n, bit in (("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4))], h("tcp.window_size", l4 + 14, 2, F.col("window"), tcp),
        h("udp", l4, 8, when=udp), h("udp.src_port", l4, 2, F.col("src_port"), udp), h("udp.dst_port", l4 + 2, 2, F.col("dst_port"), udp),
        p("http", when=http), p("http.request.method", a("method")), p("http.request.uri", a("path")), p("http.response.code", a("status").cast("int")), p("http.response.phrase", a("reason")), p("http.content_type", a("content_type")), p("http.content_length", a("content_length")),
        p("dns", when=dns), p("dns.id", a("id"), dns, start, 2), p("dns.flags.response", answer, dns, start + 2, 1), p("dns.flags.rcode", dns_rcode(a("rcode")), answer, start + 3, 1), p("dns.qry.name", a("name"), dns), p("dns.qry.type", dns_type(a("qtype")), dns),
        p("dns.count.answers", a("answer_count"), answer, start + 6, 2), p("dns.answers", when=F.size(F.coalesce(a("answers"), F.array())) > 0),
        p("tls", when=tls), p("tls.handshake.sni", a("sni"), tls, a("sni_offset"), a("sni_len")), p("tls.ja3", a("ja3"), tls)]

    def of_answer(x: Column, i: Column) -> Column:
        base, kind_of = F.concat(F.lit("dns.answer."), i.cast("string")), dns_type(x["rtype"])
        leaf = lambda n, value, when: F.when(when & value.isNotNull(), _field(F.concat(base, F.lit("." + n)), F.lit(ANSWER_PATHS[n][0]), base, F.when(x["rtype"].isin(1, 28), "addr").otherwise("str") if n == "data" else F.lit(ANSWER_PATHS[n][1]), value, ANSWER_PATHS[n][1], "payload", F.lit(0), size))
        group = _field(base, F.concat(x["name"], F.lit(" "), kind_of), F.lit("dns.answers"), F.lit("group"), None, "group", "payload", F.lit(0), size)
        yes = F.lit(True)
        return F.array_compact(F.array(group, leaf("name", x["name"], yes), leaf("type", kind_of, yes), leaf("ttl", x["ttl"], yes), leaf("data", x["data"], x["data"] != ""), leaf("truncated", x["truncated"], x["truncated"])))

    answers = F.flatten(F.transform(F.coalesce(a("answers"), F.array().cast("array<struct<name:string,rtype:int,ttl:bigint,data:string,truncated:boolean>>")), of_answer))
    tls_fields, before = fixed[-3:], fixed[:-3]
    return F.when(ok, F.concat(F.array_compact(F.array(*before)), answers, F.array_compact(F.array(*tls_fields))))


@dataclass(frozen=True)
class TreeField(Field):
    """A path that is looked up in the array: the first field of that path, whatever the case of its letters."""

    array: str = "fields"

    @property
    def column(self) -> Column:
        path = self.name
        if self.kind == "group":
            return F.coalesce(F.exists(self.array, lambda x: F.lower(x["path"]) == path), F.lit(False))
        slot = {"uint": "vu", "bool": "vb", "str": "vs"}[self.kind]
        return F.get(F.filter(self.array, lambda x: F.lower(x["path"]) == path), F.lit(0))[slot]


def _kind(of: str) -> str:
    return "str" if of == "addr" else of


#: The paths for `compile_filter` over a column `fields`.
TREE: dict[str, Field] = {p: TreeField(p, _kind(k)) for p, (_, k) in PATHS.items()}
TREE |= {f"dns.answer.{i}.{n}": TreeField(f"dns.answer.{i}.{n}", _kind(k)) for i in range(ANSWERS) for n, (_, k) in ANSWER_PATHS.items()}
TREE |= {f"dns.answer.{i}": TreeField(f"dns.answer.{i}", "group") for i in range(ANSWERS)}
TREE["frame.len"] = Field("cap_len", "uint")


def nested(rows: DataFrame, *keys: str, fields: str = "fields") -> DataFrame:
    """(keys, at, parent_at, depth, the field): one row a field with the place of its parent. A field without a parent in its list is a root; of equal paths the last is the parent."""
    paths = lambda: F.transform(fields, lambda x: x["path"])
    held = rows.select(*keys, fields, F.posexplode(fields).alias("at", "f"))

    def parent(group: Column) -> Column:
        back = F.array_position(F.reverse(paths()), group)
        return F.when(group.isNotNull() & (back > 0), F.size(fields) - back).cast("int")

    up = lambda at: parent(F.get(F.col(fields), at)["group"])
    first = parent(F.col("f.group"))
    held = held.withColumn("parent_at", first)
    second = F.when(F.col("parent_at").isNotNull(), up(F.col("parent_at")))
    held = held.withColumn("_two", second)
    third = F.when(F.col("_two").isNotNull(), up(F.col("_two")))
    depth = sum((c.isNotNull().cast("int") for c in (F.col("parent_at"), F.col("_two"), third)), F.lit(0))
    return held.select(*keys, "at", "parent_at", depth.alias("depth"), "f.*")
