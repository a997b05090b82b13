"""The test tables as frames on the wire, built by native expressions, and queries over what is decoded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import fields, payloads
from netloom.functions.display_filter import compile_filter
from netloom.functions import network as net
from netloom.operators import lookups, reassembly, rollups, stats, transactions
from netloom.plans.model import PACKETS_SQL
from netloom.plans.model import packets as read_packets
from netloom.plans.queries import ORACLE_SQL, QUERIES
from netloom.sources import captures

CLIENT, SERVER = (10, 0), bytes([93, 184, 0, 1])


def number(value: Column | int, size: int) -> Column:
    """A big-endian number of `size` bytes."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def raw(text: bytes) -> Column:
    return F.unhex(F.lit(text.hex()))


def joined(*parts: Column) -> Column:
    return F.concat(*[p.cast("binary") for p in parts])


def sized(body: Column, size: int) -> Column:
    return joined(number(F.octet_length(body), size), body)


def ipv4(body: Column, proto: int, src: Column, dst: Column, ident: Column | int = 0, place: Column | int = 0) -> Column:
    """An IPv4 datagram or, with `place` (flags and offset), a fragment."""
    return joined(raw(b"\x45\0"), number(F.octet_length(body) + 20, 2), number(ident, 2), number(place, 2), number(64, 1), number(proto, 1), raw(b"\0\0"), src, dst, body)


def udp(data: Column, src_port: Column | int, dst_port: Column | int) -> Column:
    return joined(number(src_port, 2), number(dst_port, 2), number(F.octet_length(data) + 8, 2), raw(b"\0\0"), data)


def tcp(data: Column, src_port: Column | int, dst_port: Column | int, seq: Column | int = 0, ack: Column | int = 0, flags: int = 0x18, options: Column | None = None) -> Column:
    options = raw(b"") if options is None else options
    head = number((F.octet_length(options) / 4 + 5).cast("int") * 16, 1)
    return joined(number(src_port, 2), number(dst_port, 2), number(seq, 4), number(ack, 4), head, number(flags, 1), number(512, 2), raw(b"\0" * 4), options, data)


def ethernet(datagram: Column) -> Column:
    return joined(raw(b"\0" * 12 + b"\x08\x00"), datagram)


def dns_name(name: Column) -> Column:
    """Labels behind their lengths; names of ASCII letters."""
    labels = F.transform(F.split(name, r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(x)))
    return F.unhex(F.concat(F.array_join(labels, ""), F.lit("00")))


def dns_query(ident: Column, name: Column) -> Column:
    return joined(number(ident, 2), raw(b"\1\0\0\1\0\0\0\0\0\0"), dns_name(name), raw(b"\0\1\0\1"))


def dns_answer(ident: Column, name: Column, address: Column, ttl: Column) -> Column:
    return joined(number(ident, 2), raw(b"\x81\x80\0\1\0\1\0\0\0\0"), dns_name(name), raw(b"\0\1\0\1\xc0\x0c\0\1\0\1"), number(ttl, 4), raw(b"\0\4"), address)


def client_hello(name: Column) -> Column:
    server = joined(raw(b"\0"), sized(name, 2))
    extensions = joined(raw(b"\0\0"), sized(sized(server, 2), 2), raw(b"\0\x0a\0\4\0\2\0\x1d\0\x0b\0\2\1\0"))
    body = joined(raw(b"\3\3" + bytes(32) + b"\0\0\4\x13\1\xc0\x2f\1\0"), sized(extensions, 2))
    return joined(raw(b"\x16\3\1"), sized(joined(raw(b"\1"), sized(body, 3)), 2))


def _client(flow: Column) -> Column:
    return joined(raw(bytes(CLIENT)), number(F.floor(flow / F.lit(256)) % 256, 1), number(flow % 256, 1))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Ethernet frame an event: views ask a name over UDP, purchases answer it, clicks are HTTP requests, errors responses, sign-ups ClientHellos."""
    p = read_packets(spark, sf_dir)
    flow, k, port = F.col("flow"), F.col("k"), F.col("flow") % 20000 + 40000
    host, near, far = F.concat(F.lit("n"), flow.cast("string"), F.lit(".example.com")), _client(flow), raw(SERVER)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    get = text("GET /p/", k, "?q=", F.col("ordinal"), " HTTP/1.1\r\nHost: x\r\n\r\n")
    said = text("HTTP/1.1 ", k + 200, " Fine\r\nContent-Type: Text/Plain; a=b\r\nContent-Length: ", F.col("bytes"), "\r\n\r\n")
    address = joined(raw(b"\x0a"), number(k, 1), raw(b"\0\1"))
    syn_options = raw(b"\2\4\5\xb4\1\3\3\7")
    seq = (F.col("ordinal") * 7919 + 4294900000) % (1 << 32)
    datagram = (
        F.when(F.col("app") == "view", ipv4(udp(dns_query(k, host), port, 53), 17, near, far))
        .when(F.col("app") == "purchase", ipv4(udp(dns_answer(k, host, address, k * 60), 53, port), 17, far, near))
        .when(F.col("app") == "click", ipv4(tcp(get, port, 80, seq, k), 6, near, far))
        .when(F.col("app") == "error", ipv4(tcp(said, 80, port, seq, k), 6, far, near))
        .otherwise(ipv4(tcp(client_hello(host), port, 443, seq, k, 0x12, syn_options), 6, near, far)))
    frame = ethernet(datagram)
    return p.select("ordinal", "flow", "app", "k", "bytes", (F.col("ts_us") * 1000).alias("ts_ns"), F.when(F.col("outbound"), "outbound").otherwise("inbound").alias("direction"),
                    F.lit(1).alias("link_type"), F.octet_length(frame).cast("bigint").alias("cap_len"), F.octet_length(frame).cast("bigint").alias("wire_len"), frame.alias("frame"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = captures.headers(captures.settled(frames(spark, sf_dir)))
    return h.withColumn("app_data", payloads.decoded(F.col("payload"), F.col("proto") == 6, F.col("src_port").cast("int"), F.col("dst_port").cast("int")))


_NEAR = "'10.0.' || (flow // 256 % 256) || '.' || (flow % 256)"
_FAR = "'93.184.0.1'"
_PORT = "flow % 20000 + 40000"


def _register(name: str, make: object, sql: str) -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = f"WITH {PACKETS_SQL} {sql}"


_IN = "app IN ('purchase', 'error')"
_UDP = "app IN ('view', 'purchase')"
_register("frame_headers", lambda spark, sf_dir: captures.headers(frames(spark, sf_dir)).select("ordinal", "parse_status", "src", "dst", "proto", "src_port", "dst_port", "seq", "ack", "tcp_flags", "payload_len", "wscale"),
          f"""SELECT ordinal, 'ok' AS parse_status, CASE WHEN {_IN} THEN {_FAR} ELSE {_NEAR} END AS src, CASE WHEN {_IN} THEN {_NEAR} ELSE {_FAR} END AS dst, CASE WHEN {_UDP} THEN 17 ELSE 6 END AS proto,
  CASE app WHEN 'purchase' THEN 53 WHEN 'error' THEN 80 ELSE {_PORT} END AS src_port, CASE app WHEN 'view' THEN 53 WHEN 'click' THEN 80 WHEN 'signup' THEN 443 ELSE {_PORT} END AS dst_port,
  CASE WHEN NOT {_UDP} THEN (ordinal * 7919 + 4294900000) % 4294967296 END AS seq, CASE WHEN NOT {_UDP} THEN k END AS ack, CASE app WHEN 'signup' THEN 18 WHEN 'click' THEN 24 WHEN 'error' THEN 24 END AS tcp_flags,
  CASE app WHEN 'view' THEN 31 + length('' || flow) WHEN 'purchase' THEN 47 + length('' || flow) WHEN 'click' THEN 32 + length('' || k || ordinal)
    WHEN 'error' THEN 70 + length('' || bytes) ELSE 90 + length('' || flow) END AS payload_len, CASE app WHEN 'signup' THEN 7 END AS wscale FROM p""")
_register("decoded_payloads", lambda spark, sf_dir: decoded(spark, sf_dir).select(
    "ordinal", "app_data.kind", "app_data.id", "app_data.name", F.col("app_data.answers")[0]["data"].alias("address"), F.col("app_data.answers")[0]["ttl"].alias("ttl"), "app_data.method", "app_data.path", "app_data.status",
    "app_data.reason", "app_data.content_type", F.col("app_data.content_length").cast("bigint").alias("content_length"), "app_data.sni", "app_data.ja3"),
    """SELECT ordinal, CASE app WHEN 'view' THEN 'dns' WHEN 'purchase' THEN CASE WHEN k IS NULL THEN NULL ELSE 'dns_response' END WHEN 'click' THEN 'http' WHEN 'error' THEN 'http_response' ELSE 'tls_client_hello' END AS kind,
  CASE WHEN app IN ('view', 'purchase') THEN k END AS id, CASE WHEN app IN ('view', 'purchase') THEN 'n' || flow || '.example.com' END AS name, CASE WHEN app = 'purchase' THEN '10.' || k || '.0.1' END AS address,
  CASE WHEN app = 'purchase' THEN k * 60 END AS ttl, CASE WHEN app = 'click' THEN 'GET' END AS method, CASE WHEN app = 'click' THEN '/p/' || k || '?q=' || ordinal END AS path, CASE WHEN app = 'error' THEN '' || (k + 200) END AS status,
  CASE WHEN app = 'error' THEN 'Fine' END AS reason, CASE WHEN app = 'error' THEN 'text/plain' END AS content_type, CASE WHEN app = 'error' THEN bytes END AS content_length,
  CASE WHEN app = 'signup' THEN 'n' || flow || '.example.com' END AS sni, CASE WHEN app = 'signup' THEN md5('771,4865-49199,0-10-11,29,0') END AS ja3 FROM p""")

# The clock of a capture whose packets come up to 59 seconds out of order: it holds at the newest.
_jitter = lambda p: p.select("ordinal", (F.col("flow") % 4).alias("path"), ((F.col("ts_us") - F.col("k") % 60 * 1_000_000) * 1000).alias("ts_ns"))
_register("replay_clock", lambda spark, sf_dir: reassembly.replay_clock(_jitter(read_packets(spark, sf_dir))).select("ordinal", "clock_ms"),
          """, j AS (SELECT ordinal, flow % 4 AS path, ts_us - k % 60 * 1000000 AS t FROM p)
SELECT ordinal, (max(t) OVER (PARTITION BY path ORDER BY ordinal) - first(t) OVER (PARTITION BY path ORDER BY ordinal)) // 1000 AS clock_ms FROM j""")


def http_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request line of each event in three segments, sent in one of three orders; every fifth loses the middle one. Numbers wrap."""
    p = read_packets(spark, sf_dir).where("k is not null")
    line = F.concat(F.lit("GET /p/"), F.col("ordinal").cast("string"), F.lit(" HTTP/1.1\r\n"))
    order = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in ((1, 2, 3), (2, 1, 3), (3, 1, 2))]), F.col("k") % 3 + 1)
    s = p.select("ordinal", "k", line.alias("line"), F.posexplode(order).alias("turn", "part")).where("not (k % 5 = 0 and part = 2)")
    start = F.element_at(F.array(F.lit(0), F.lit(3), F.length("line") - 3), F.col("part"))
    stop = F.element_at(F.array(F.lit(3), F.length("line") - 3, F.length("line")), F.col("part"))
    data = F.substring("line", start + 1, stop - start).cast("binary")
    return s.select(F.col("ordinal").alias("flow"), F.lit(True).alias("outbound"), "k", F.col("turn").cast("bigint").alias("turn"), (F.col("turn") * 10).cast("bigint").alias("clock_ms"),
                    ((F.lit(4294967294) + start) % (1 << 32)).alias("seq"), data.alias("payload"), F.octet_length(data).cast("bigint").alias("declared"), F.lit(False).alias("syn"), F.lit(40000).alias("src_port"), F.lit(80).alias("dst_port"))


_register("desegmented_http", lambda spark, sf_dir: reassembly.desegmented(http_segments(spark, sf_dir), ["flow", "outbound"], "turn", ["flow", "turn"]).select(
    "flow", F.col("turn").cast("int").alias("turn"), "app.assembly", "app.need", "app.kind", "app.path"),
    f""", t AS (SELECT ordinal, k, turn, CASE k % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 1, 3] ELSE [3, 1, 2] END[turn + 1] AS part FROM p, range(0, 3) AS r(turn) WHERE k IS NOT NULL),
s AS (SELECT *, k % 5 = 0 AS lossy, list(part) OVER (PARTITION BY ordinal ORDER BY turn) AS held FROM t WHERE NOT (k % 5 = 0 AND part = 2))
SELECT ordinal AS flow, CAST(turn AS INTEGER) AS turn, CASE WHEN list_contains(held, 1) AND list_contains(held, 3) AND NOT list_contains(held, 2) THEN '{reassembly.MISSING}' ELSE '{reassembly.WHOLE}' END AS assembly,
  CASE WHEN list_contains(held, 1) AND len(held) < 3 THEN 1 END AS need, CASE WHEN len(held) = 3 THEN 'http' END AS kind, CASE WHEN len(held) = 3 THEN '/p/' || ordinal END AS path FROM s""")


def dns_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three framed queries of each event over TCP in four segments: the second is cut in the middle, the last's length between its bytes."""
    p = read_packets(spark, sf_dir).where("k is not null")
    one = lambda i: sized(dns_query(F.col("k") + i, F.concat(F.lit(f"m{i}."), F.col("ordinal").cast("string"))), 2)
    whole = p.select("ordinal", joined(one(0), one(1), one(2)).alias("all"), F.octet_length(one(0)).alias("n"))
    cuts = F.array(F.lit(0), F.col("n") + 9, 2 * F.col("n") + 1, 3 * F.col("n"))
    s = whole.select("ordinal", "all", "n", F.posexplode(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.element_at(cuts, i).alias("a"), F.element_at(cuts, i + 1).alias("b"))))).alias("turn", "c"))
    data = F.substring("all", F.col("c.a") + 1, F.col("c.b") - F.col("c.a"))
    return s.select(F.col("ordinal").alias("flow"), F.lit(True).alias("outbound"), F.col("turn").cast("bigint").alias("turn"), (F.col("turn") * 10).cast("bigint").alias("clock_ms"), (F.lit(1000) + F.col("c.a")).cast("bigint").alias("seq"),
                    data.alias("payload"), F.octet_length(data).cast("bigint").alias("declared"), F.lit(False).alias("syn"), F.lit(40000).alias("src_port"), F.lit(53).alias("dst_port"))


# A segment that starts inside a message is no new message, so only the first of the stream is decoded.
_register("dns_over_tcp", lambda spark, sf_dir: reassembly.desegmented(dns_stream(spark, sf_dir), ["flow", "outbound"], "turn", ["flow", "turn"]).select("flow", F.col("turn").cast("int").alias("turn"), "app.kind", "app.id", "app.name", "app.need", "app.assembly"),
          """SELECT ordinal AS flow, CAST(turn AS INTEGER) AS turn, CASE WHEN turn = 0 THEN 'dns' END AS kind, CASE WHEN turn = 0 THEN k END AS id, CASE WHEN turn = 0 THEN 'm0.' || ordinal END AS name,
  CAST(NULL AS INTEGER) AS need, CAST(NULL AS VARCHAR) AS assembly FROM p, range(0, 3) AS r(turn) WHERE k IS NOT NULL""")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UDP datagram of each event in three fragments, in one of three orders; every fifth loses one, every seventh has its first cut by the capture."""
    p = read_packets(spark, sf_dir).where("k is not null")
    text = F.rpad(F.concat(F.lit("event "), F.col("ordinal").cast("string")), 56, ".")
    body = udp(text, 40000, 9000)
    order = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in ((0, 1, 2), (2, 0, 1), (1, 2, 0))]), F.col("k") % 3 + 1)
    s = p.select("ordinal", "k", "flow", body.alias("body"), F.posexplode(order).alias("turn", "part")).where("not (k % 5 = 0 and part = 1)")
    data = F.substring("body", F.col("part") * 24 + 1, F.lit(24))
    place = F.when(F.col("part") < 2, 0x2000).otherwise(0) + F.col("part") * 3
    datagram = ipv4(data, 17, _client(F.col("flow")), raw(SERVER), F.col("ordinal") % 65536, place)
    kept = F.when((F.col("k") % 7 == 0) & (F.col("part") == 0), 30).otherwise(F.octet_length(datagram))
    return s.select("ordinal", "k", F.col("turn").cast("bigint").alias("turn"), (F.col("turn") * 10).cast("bigint").alias("clock_ms"), F.lit(101).alias("link_type"), F.substring(datagram, F.lit(1), kept).alias("frame"))


def _rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["src", "dst", "ip_id", "proto", "day"]  # 65,536 identifications do not tell all events apart
    rows = captures.headers(fragments(spark, sf_dir)).withColumn("day", F.floor(F.col("ordinal") / F.lit(65536)))
    return reassembly.rejoined(rows.select("ordinal", "turn", *key, *reassembly.FRAGMENT_READS), key, "turn")


def rejoined_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rejoined(spark, sf_dir).where("joined.status is not null").select("ordinal", "turn", "joined.status", "joined.payload_len", F.lit(101).alias("link_type"), F.col("joined.datagram").alias("frame"))
    again = captures.headers(out.withColumnRenamed("payload_len", "joined_len"))
    return again.select("ordinal", F.col("turn").cast("int").alias("turn"), "status", "joined_len", "src_port", "dst_port", F.col("payload").cast("string").alias("text"))


# Cut: the first fragment keeps 10 bytes of 24, so a datagram is given up once that fragment is there; else all three are needed.
_FRAGMENTS = """, f AS (SELECT ordinal, k, CASE k % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [2, 0, 1] ELSE [1, 2, 0] END AS parts, rpad('event ' || ordinal, 56, '.') AS text FROM p WHERE k IS NOT NULL)"""
_register("rejoined_datagrams", rejoined_datagrams, f"""{_FRAGMENTS}
SELECT ordinal, CAST(CASE WHEN k % 7 = 0 THEN list_position(parts, 0) - 1 ELSE 2 END AS INTEGER) AS turn, CASE WHEN k % 7 = 0 THEN '{reassembly.TRUNCATED}' ELSE '{reassembly.WHOLE}' END AS status,
  CASE WHEN k % 7 = 0 THEN 10 ELSE 64 END AS joined_len, 40000 AS src_port, 9000 AS dst_port, CASE WHEN k % 7 = 0 THEN text[1:2] ELSE text END AS text FROM f WHERE k % 7 = 0 OR k % 5 > 0""")
_register("fragment_counters", lambda spark, sf_dir: reassembly.counters(_rejoined(spark, sf_dir), "joined"), f"""{_FRAGMENTS}
SELECT count(*) FILTER (k % 7 > 0 AND k % 5 > 0) AS completed, count(*) FILTER (k % 7 = 0) AS incomplete_truncated, 0 AS incomplete_missing, 0 AS abandoned, 0 AS evicted_idle, 0 AS conflicting_bytes, 0 AS forged_ends FROM f""")


def _with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures.settled(decoded(spark, sf_dir))
    return captures.settled(rows.select("ordinal", "cap_len", fields.field_list(rows).alias("fields")))


_FIELDS = """, v AS (SELECT ordinal, app, flow, k, bytes, 'n' || flow || '.example.com' AS host FROM p)"""
_register("field_trees", lambda spark, sf_dir: fields.nested(_with_fields(spark, sf_dir), "ordinal").where("path in ('tcp.flags.syn', 'dns.answer.0.data', 'http.content_length', 'udp.dst_port', 'eth.dst')").select(
    "ordinal", "path", "group", "type", "depth", F.coalesce("vs", F.col("vu").cast("string"), F.col("vb").cast("string")).alias("value"), "offset", "len"),
    _FIELDS + """SELECT ordinal, 'eth.dst' AS path, 'eth' AS "group", 'addr' AS type, 1 AS depth, '00:00:00:00:00:00' AS value, 0 AS "offset", 6 AS len FROM v
UNION ALL SELECT ordinal, 'tcp.flags.syn', 'tcp.flags', 'bool', 2, CASE WHEN app = 'signup' THEN 'true' ELSE 'false' END, 47, 1 FROM v WHERE app IN ('click', 'error', 'signup')
UNION ALL SELECT ordinal, 'udp.dst_port', 'udp', 'uint', 1, CASE WHEN app = 'view' THEN '53' ELSE '' || (flow % 20000 + 40000) END, 36, 2 FROM v WHERE app IN ('view', 'purchase')
UNION ALL SELECT ordinal, 'http.content_length', 'http', 'uint', 1, '' || bytes, 0, 70 + length('' || bytes) FROM v WHERE app = 'error'
UNION ALL SELECT ordinal, 'dns.answer.0.data', 'dns.answer.0', 'addr', 3, '10.' || k || '.0.1', 0, 47 + length('' || flow) FROM v WHERE app = 'purchase'""")
_TREE_FILTER = 'dns.answer.0.ttl >= 3000 or DNS.answer.1 or http.response.code in {250, 251, "252"} or tcp.flags.syn == true and tls.handshake.sni contains "N1" or not eth and ip.ttl == 64'
_register("filter_field_trees", lambda spark, sf_dir: _with_fields(spark, sf_dir).where(compile_filter(_TREE_FILTER, fields.TREE)).select("ordinal"),
          _FIELDS + "SELECT ordinal FROM v WHERE app = 'purchase' AND k * 60 >= 3000 OR app = 'error' AND k IN (50, 51) OR app = 'signup' AND contains(host, 'n1')")


_register("sample_labels", lambda spark, sf_dir: captures.settled(decoded(spark, sf_dir).select("ordinal", "app_data", "payload")).select("ordinal", net.sample_label(F.col("app_data"), F.col("payload")).alias("label")),
          """SELECT ordinal, CASE app WHEN 'signup' THEN 'ClientHello (SNI: n' || flow || '.example.com)' WHEN 'click' THEN 'HTTP GET /p/' || k WHEN 'error' THEN 'HTTP ' || (k + 200) || ' Fine' END AS label FROM p""")
_register("capture_counters", lambda spark, sf_dir: stats.capture_counters(captures.headers(captures.settled(frames(spark, sf_dir).withColumns({
    "frame": F.when(F.col("k") % 10 == 0, F.substring("frame", 1, 30)).otherwise(F.col("frame")), "cap_len": F.when(F.col("k") % 10 == 0, 30).otherwise(F.col("cap_len"))})))),
    """SELECT count(*) AS received, CAST(sum(14 + 20 + CASE app WHEN 'view' THEN 8 + 31 + length('' || flow) WHEN 'purchase' THEN 8 + 47 + length('' || flow) WHEN 'click' THEN 20 + 32 + length('' || k || ordinal)
    WHEN 'error' THEN 20 + 70 + length('' || bytes) ELSE 28 + 90 + length('' || flow) END) AS BIGINT) AS bytes, count(*) FILTER (k % 10 = 0) AS unparseable, 0 AS unsupported, count(*) FILTER (k % 10 = 0) AS truncated FROM p""")
_register("range_blocks", lambda spark, sf_dir: read_packets(spark, sf_dir).select("ordinal", net.range_cidr(
    F.concat(F.lit("10."), F.col("k").cast("string"), F.lit(".0.0")), F.concat(F.lit("10."), (F.col("k") + F.when(F.col("flow") % 3 == 0, 0).when(F.col("flow") % 3 == 1, 1).otherwise(3)).cast("string"), F.lit(".255.255"))).alias("block")),
    """SELECT ordinal, CASE WHEN flow % 3 = 0 THEN '10.' || k || '.0.0/16' WHEN flow % 3 = 1 AND k % 2 = 0 THEN '10.' || k || '.0.0/15' WHEN flow % 3 = 2 AND k % 4 = 0 THEN '10.' || k || '.0.0/14' END AS block FROM p""")
_register("mac_vendors", lambda spark, sf_dir: lookups.vendors(
    read_packets(spark, sf_dir).select("ordinal", F.concat(F.lpad(F.hex(F.col("k")), 2, "0"), F.lit(":1b-2C:00:00:"), F.lpad(F.hex(F.col("flow") % 256), 2, "0")).alias("mac")),
    read_packets(spark, sf_dir).where("k % 8 = 0").select(F.concat(F.lpad(F.hex(F.col("k")), 2, "0"), F.lit("1B2C")).alias("prefix"), F.concat(F.lit("maker "), F.col("k").cast("string")).alias("vendor")).distinct()).drop("mac"),
    """SELECT ordinal, CASE WHEN k % 8 = 0 THEN 'maker ' || k END AS vendor FROM p""")


def matched_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked and answered over UDP, from decoded frames; time runs a million times as fast, and every fourth client port is a capture of its own."""
    rows = decoded(spark, sf_dir).select("ordinal", F.col("direction"), "flow", F.floor(F.col("ts_ns") / F.lit(1_000_000_000)).cast("bigint").alias("ts_us"), "src", "dst", "src_port", "dst_port", "proto", "app_data")
    ends = stats.canonical(rows.drop("flow"), None)
    flow = net.connection_id(F.when(F.col("proto") == 6, "tcp").otherwise("udp"), F.col("local_addr"), F.col("local_port"), F.col("remote_addr"), F.col("remote_port"))
    swept = transactions.sweep_clock(ends.withColumns({"flow": flow, "source": F.col("local_port") % 4}))
    return transactions.dns(transactions.dns_messages(swept)).select("flow", "ordinal", "t.event", "t.request", "t.service_us")


QUERIES["matched_dns"] = matched_dns


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = F.when(F.col("app_data.kind").startswith("dns"), "DNS").when(F.col("app_data.kind").startswith("http"), "HTTP").when(F.col("app_data.kind") == "tls_client_hello", "HTTPS/TLS")
    rows = decoded(spark, sf_dir).withColumns({"app_now": F.when(F.col("k") < 90, app), "proto": F.when(F.col("k") == 7, 1).when(F.col("k") == 8, 89).otherwise(F.col("proto"))})
    return rollups.protocol_hierarchy(rows)


_LAYERS = """, w AS (SELECT bytes, CASE WHEN k = 7 THEN ['Ethernet', 'IP', 'ICMP'] WHEN k = 8 THEN ['Ethernet', 'IP', 'Other'] ELSE ['Ethernet', 'IP', CASE WHEN app IN ('view', 'purchase') THEN 'UDP' ELSE 'TCP' END,
  CASE WHEN k >= 90 THEN 'Unknown' WHEN app IN ('view', 'purchase') THEN 'DNS' WHEN app = 'signup' THEN 'HTTPS/TLS' ELSE 'HTTP' END] END AS p FROM p),
t AS (SELECT CAST(n AS INTEGER) AS depth, array_to_string(p[1:n], '/') AS path, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS packets FROM w, unnest(range(1, len(p) + 1)) AS r(n) GROUP BY ALL)"""
_register("protocol_tree", _layered, f"{_LAYERS} SELECT * FROM t")
_register("transport_shares", lambda spark, sf_dir: rollups.transport_shares(_layered(spark, sf_dir)), f"""{_LAYERS}
SELECT split_part(path, '/', 3) AS name, bytes, packets, bytes * 100.0::DOUBLE / (SELECT bytes FROM t WHERE depth = 2) AS percent FROM t WHERE depth = 3""")
