"""Scalar functions on addresses, ports, flags, sizes and headers, as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of well-known ports.
PORTS = {20: "FTP-DATA", 21: "FTP", 22: "SSH", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 443: "HTTPS/TLS", 445: "SMB",
         993: "IMAPS", 995: "POP3S", 1433: "Microsoft SQL Server", 3306: "MySQL", 3389: "RDP", 5353: "mDNS", 5432: "PostgreSQL"}
#: Mnemonics of DNS record types and response codes.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 64: "SVCB", 65: "HTTPS", 255: "ANY"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
#: Headers whose values are secrets; private or reserved IPv4 blocks.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "proxy-authorization", "x-api-key")
RESERVED = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "224.0.0.0/4")


def _named(names: dict[int, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key.cast("int")]


def port_name(port: Column) -> Column:
    return _named(PORTS, port)


def dns_type(code: Column) -> Column:
    return F.coalesce(_named(DNS_TYPES, code), F.concat(F.lit("TYPE"), code.cast("string")))


def dns_rcode(code: Column) -> Column:
    return F.coalesce(_named(DNS_RCODES, code), F.concat(F.lit("RCODE"), code.cast("string")))


def flow_status(tcp: Column, fin_or_rst: Column, established: Column, syn: Column) -> Column:
    return F.when(fin_or_rst, "TIME_WAIT").when(established, "ESTABLISHED").when(syn, "SYN_SENT").when(~tcp, "ESTABLISHED").otherwise("CLOSE_WAIT")


def idle_limit_ms(status: Column, tcp: Column) -> Column:
    return F.when(status.isin("TIME_WAIT", "CLOSE_WAIT"), 120_000).when(status == "SYN_SENT", 30_000).when(~tcp, 60_000).otherwise(1_800_000)


def health(loss_percent: Column) -> Column:
    return F.when(loss_percent < 1, "OPTIMAL").when(loss_percent < 5, "WARNING").otherwise("CRITICAL")


def deepest_layer(transport: Column, app: Column) -> Column:
    return F.when(~F.coalesce(transport.isin("TCP", "UDP"), F.lit(False)), 3).when(app.isNotNull(), 7).otherwise(4)


def signed_difference(a: Column, b: Column) -> Column:
    """a - b of 32-bit serial numbers, in [-2**31, 2**31)."""
    return F.pmod(a - b + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def relative(seq: Column, base: Column) -> Column:
    return F.pmod(seq - base, F.lit(1 << 32))


def _decimal(n: Column, unit: int, digits: int, suffix: str) -> Column:
    """n / unit with halves rounded up, in exact integers."""
    scaled = ((n * (2 * 10**digits) + unit - (n * (2 * 10**digits) + unit) % (2 * unit)) / F.lit(2 * unit)).cast("bigint")
    whole = F.floor(scaled / F.lit(10**digits)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0"), F.lit(suffix))


def bytes_text(n: Column) -> Column:
    n = n.cast("bigint")
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, _decimal(n, 1 << 10, 1, " KB")).when(n < 1 << 30, _decimal(n, 1 << 20, 1, " MB")).otherwise(_decimal(n, 1 << 30, 2, " GB"))


def speed_text(n: Column) -> Column:
    """Whole bytes a second; KB with one decimal, MB and GB with two."""
    n = n.cast("bigint")
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B/s"))).when(n < 1 << 20, _decimal(n, 1 << 10, 1, " KB/s")).when(n < 1 << 30, _decimal(n, 1 << 20, 2, " MB/s")).otherwise(_decimal(n, 1 << 30, 2, " GB/s"))


def service_text(us: Column) -> Column:
    """Microseconds, milliseconds with one decimal, seconds with two. Halves go up in exact integers: 1,150 us is 1.2 ms, where rounding the binary fraction gives 1.1."""
    us = us.cast("bigint")
    return F.when(us < 1000, F.concat(us.cast("string"), F.lit(" µs"))).when(us < 1_000_000, _decimal(us, 1000, 1, " ms")).otherwise(_decimal(us, 1_000_000, 2, " s"))


def ipv4_int(ip: Column) -> Column:
    """The address as a number; null unless it is four parts of 0 to 255."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(ip, r"\.")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).try_cast("bigint") * (1 << 24))
    return F.when(ip.rlike(rf"^{part}(\.{part}){{3}}$"), value)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    size = 1 << (32 - int(bits))
    low = sum(int(p) << 8 * (3 - i) for i, p in enumerate(base.split("."))) // size * size
    return low, low + size - 1


def in_cidr(ip: Column, cidr: str) -> Column:
    low, high = cidr_bounds(cidr)
    return F.coalesce(ipv4_int(ip).between(low, high), F.lit(False))


#: The mapped form of IPv4 in IPv6, private prefixes of IPv6.
MAPPED, PRIVATE_V6 = r"^::(?:ffff:)?([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})$", ("fe80:", "fc", "fd", "ff")


def is_private(ip: Column) -> Column:
    """Private or reserved: seven IPv4 blocks; of IPv6 the loopback ::1 and the prefixes fe80:, fc, fd and ff. Mapped IPv4 is unwrapped, malformed ones count as private."""
    low = F.lower(ip)
    mapped = F.regexp_extract(low, MAPPED, 1)

    def inside(address: Column) -> Column:
        hit = F.lit(False)
        for cidr in RESERVED:
            hit = hit | in_cidr(address, cidr)
        return hit

    six = low == "::1"
    for prefix in PRIVATE_V6:
        six = six | low.startswith(prefix)
    return F.coalesce(F.when(mapped != "", ipv4_int(mapped).isNull() | inside(mapped)).when(low.contains(":"), six).otherwise(inside(low)), F.lit(False))


#: Names of the transports in connection ids.
TRANSPORTS = {"tcp": "Tcp", "udp": "Udp", "icmp": "Icmp", "other": "Other"}


def connection_id(proto: Column, a_ip: Column, a_port: Column, b_ip: Column, b_port: Column) -> Column:
    """`Tcp-local:port-remote:port`; IPv6 addresses as they stand."""
    name = F.create_map(*[F.lit(x) for pair in TRANSPORTS.items() for x in pair])[F.lower(proto)]
    return F.concat(name, F.lit("-"), a_ip, F.lit(":"), a_port.cast("string"), F.lit("-"), b_ip, F.lit(":"), b_port.cast("string"))


def _address(text: Column) -> Column:
    """Whether an address is IPv4 or IPv6 text in its one canonical form: no leading zeros, lower case, the first longest run of zeros cut."""
    groups = F.split(text, ":")
    full = F.when(text.contains("::"), F.concat(
        F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(1)), ":"), lambda g: g != ""),
        F.array_repeat(F.lit("0"), F.lit(8) - F.size(F.filter(groups, lambda g: g != ""))),
        F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(2)), ":"), lambda g: g != ""))).otherwise(groups)
    joined = F.concat(F.lit(":"), F.array_join(full, ":"), F.lit(":"))
    longest = F.coalesce(*[F.when(joined.contains(":" + "0:" * n), F.lit(n)) for n in range(8, 1, -1)])
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), longest))
    at = F.position(zeros, joined)
    head, tail = F.substring(joined, F.lit(2), at - 2), F.substring(joined, at + F.length(zeros), F.length(joined))
    short = F.concat(head, F.lit("::"), F.substring(tail, F.lit(1), F.greatest(F.length(tail) - 1, F.lit(0))))
    written = F.when(longest.isNull(), F.array_join(full, ":")).otherwise(short)
    six = (F.size(full) == 8) & text.rlike(r"^[0-9a-f:]+$") & F.forall(full, lambda g: g.rlike(r"^(0|[1-9a-f][0-9a-f]{0,3})$")) & (written == text)
    mapped = F.regexp_extract(text, r"^::ffff:([0-9.]+)$", 1)
    six = F.when(mapped.contains("."), ipv4_int(mapped).isNotNull()).otherwise(six & ~text.rlike("^::ffff:[0-9a-f]+:[0-9a-f]+$"))
    return F.when(text.contains(":"), F.coalesce(six, F.lit(False))).otherwise(ipv4_int(text).isNotNull())


def connection_parts(connection: Column) -> Column:
    """struct(proto, local_addr, local_port, remote_addr, remote_port) of a TCP connection's id; null unless it is written exactly as `connection_id` writes it."""
    port = r"(0|[1-9][0-9]{0,4})"
    shape = rf"^(Tcp)-([0-9a-f:.]+):{port}-([0-9a-f:.]+):{port}$"
    part = lambda i: F.regexp_extract(connection, shape, i)
    local, remote = F.try_to_number(part(3), F.lit("99999")).cast("int"), F.try_to_number(part(5), F.lit("99999")).cast("int")
    whole = (part(1) != "") & _address(part(2)) & _address(part(4)) & (local <= 65535) & (remote <= 65535)
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(F.upper(part(1)).alias("proto"), part(2).alias("local_addr"), local.alias("local_port"), part(4).alias("remote_addr"), remote.alias("remote_port")))


def redact(name: Column, value: Column) -> Column:
    """Values of secret headers, and bearer tokens behind any white space under any name."""
    secret = F.lower(name).isin(*SECRET_HEADERS) | value.rlike(r"^(?U:\s*)(?i:bearer) ")
    return F.when(F.coalesce(secret, F.lit(False)) & value.isNotNull(), "[REDACTED]").otherwise(value)


#: How a cell begins that a spreadsheet runs as a formula, and what makes a cell quoted.
FORMULA, QUOTED = "^[=+\\-@\\t\\r\\n＝＋－＠]", '[",;\\t\\r\\n]'


def csv_cell(text: Column) -> Column:
    """One quoted CSV cell; cells a spreadsheet would run as a formula get a leading quote mark."""
    formula = text.rlike(FORMULA)
    body = F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(formula | body.rlike(QUOTED), F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(body)


def hex_dump(payload: Column, n: int = 64) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(F.substring(payload, 1, n))), "(..)", "$1 "))


def ja3(version: Column, *lists: Column) -> Column:
    """md5 of the version and the dash-joined lists, comma-joined."""
    return F.md5(F.concat_ws(",", version.cast("string"), *[F.coalesce(F.array_join(x.cast("array<string>"), "-"), F.lit("")) for x in lists]))


#: Request methods that are sniffed; bytes of a header token; flag names in the order of display.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")
TOKEN = "[!#$%&'*+.^_`|~0-9A-Za-z-]+"
FLAG_NAMES = ((2, "SYN"), (1, "FIN"), (4, "RST"), (8, "PSH"), (16, "ACK"))


def http_request(payload: Column) -> Column:
    """struct(method, path) of text whose first complete line is a request with a path from the root; else null."""
    line = F.regexp_extract(payload, r"^([^\n]*?)\r?\n", 1)
    words = F.split(F.btrim(line), r"[ \t\x0b\x0c\r]+")
    method, path = F.get(words, 0), F.get(words, 1)
    return F.when(method.isin(*HTTP_METHODS) & path.startswith("/"), F.struct(method.alias("method"), path.alias("path")))


def media_type(value: Column) -> Column:
    """`type/subtype` in lower case without parameters; null for all that is not token/token."""
    media = F.btrim(F.split_part(value, F.lit(";"), F.lit(1)), F.lit(" \t"))
    return F.when(media.rlike(f"^{TOKEN}/{TOKEN}$"), F.lower(media))


def flag_names(flags: Column) -> Column:
    names = F.array_compact(F.array(*[F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in FLAG_NAMES]))
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("(no flags)")


def arrow_text(flags: Column, size: Column, label: Column, retransmit: Column, zero_window: Column) -> Column:
    """Flags and length of a segment, then its label and notes."""
    text = F.concat(flag_names(flags), F.when(size > 0, F.concat(F.lit(" len="), size.cast("string"))).otherwise(""))
    return F.concat_ws(" · ", text, label, F.when(retransmit, "retransmission"), F.when(zero_window, "zero window"))


def sample_key(outbound: Column, seq: Column, ack: Column, flags: Column, ts_us: Column) -> Column:
    """The key that links a sample with its packet: direction, numbers, SYN, ACK, FIN and RST, milliseconds."""
    ms = F.floor(ts_us / F.lit(1000)).cast("string")
    return F.concat_ws("|", F.when(outbound, "o").otherwise("i"), seq.cast("string"), F.coalesce(ack.cast("string"), F.lit("-")), flags.bitwiseAND(23).cast("string"), ms)


def display_safe(text: Column, most: int) -> Column:
    """Printable ASCII as it stands and \\u{hex} for the rest; an ellipsis after `most` characters."""
    one = lambda c: F.when((c >= " ") & (c <= "~") & (F.octet_length(c) == 1), c).otherwise(F.concat(F.lit("\\u{"), F.lower(F.hex(_code_point(c))), F.lit("}")))
    shown = F.array_join(F.transform(F.split(F.substring(text, 1, most), ""), one), "")
    return F.concat(F.when(text == "", "").otherwise(shown), F.when(F.char_length(text) > most, "…").otherwise(""))


def _code_point(c: Column) -> Column:
    """Of one character: its big-endian UTF-32 bytes as a number."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")


#: Fixed value: bytes of a sample's label.
LABEL_BYTES = 64


def sample_label(app: Column, payload: Column) -> Column:
    """What a segment shows in a ladder: a ClientHello with its name, a ServerHello, a request without query or fragment, a response; else null.

    app: a struct as `payloads.decoded` gives it. Printable ASCII, escapes whole, at most LABEL_BYTES.
    """
    server = (F.octet_length(payload) >= 6) & (F.hex(F.substring(payload, 1, 2)) == "1603") & (F.hex(F.substring(payload, 6, 1)) == "02")
    path = F.regexp_extract(app["path"], "^[^?#]*", 0)
    text = (
        F.when(app["kind"] == "tls_client_hello", F.concat(F.lit("ClientHello (SNI: "), app["sni"], F.lit(")"))).when(server, "ServerHello")
        .when(app["kind"] == "http", F.concat(F.lit("HTTP "), app["method"], F.lit(" "), path)).when(app["kind"] == "http_response", F.concat_ws(" ", F.lit("HTTP"), app["status"], app["reason"])))
    one = lambda c: F.when((c >= " ") & (c <= "~") & (F.octet_length(c) == 1), c).otherwise(F.concat(F.lit("\\u{"), F.lower(F.hex(_code_point(c))), F.lit("}")))
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("full"))

    def add(held: Column, c: Column) -> Column:
        more = F.concat(held["said"], one(c))
        fits = ~held["full"] & (F.length(more) <= LABEL_BYTES)
        return F.struct(F.when(fits, more).otherwise(held["said"]).alias("said"), (~fits).alias("full"))

    return F.when(text.isNotNull(), F.aggregate(F.filter(F.split(F.substring(text, 1, LABEL_BYTES), ""), lambda c: c != ""), start, add, lambda held: held["said"]))


def mac_prefix(mac: Column) -> Column:
    """The six upper-case digits that a vendor is looked up by; null for malformed, zero, multicast and locally given addresses."""
    digits = F.upper(F.regexp_replace(mac, "[:-]", ""))
    own = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int").bitwiseAND(3) == 0
    return F.when(digits.rlike("^[0-9A-F]{12}$") & (digits != "0" * 12) & own, F.substring(digits, 1, 6))


#: Fixed value: the widest block that an allocation may claim.
LEAST_PREFIX = 8


def range_cidr(first: Column, last: Column) -> Column:
    """The one block of /8 to /32 that an IPv4 range is; null where it is none, for a wider one would claim what it does not hold."""
    low, high = ipv4_int(first), ipv4_int(last)
    size = high - low + 1
    bits = F.when(size >= 1, F.array_position(F.array(*[F.lit(1 << (32 - p)) for p in range(33)]), size) - 1)
    dotted = F.concat_ws(".", *[(F.shiftright(low, 8 * (3 - i)) % 256).cast("string") for i in range(4)])
    return F.when((bits >= LEAST_PREFIX) & (F.pmod(low, F.greatest(size, F.lit(1))) == 0), F.concat(dotted, F.lit("/"), bits.cast("string")))
