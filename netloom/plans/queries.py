"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import network as net
from netloom.functions.display_filter import compile_filter
from netloom.operators import folds, joins, rollups, series, tcp
from netloom.plans.model import FIELDS, PACKETS_SQL, SEGMENTS_SQL, packets, segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def _on_packets(name: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(packets(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {PACKETS_SQL} {sql}"


def _on_segments(name: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(segments(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {SEGMENTS_SQL} {sql}"


FILTERS = {
    "filter_presence": ("k", "k IS NOT NULL"),
    "filter_missing": ("tcp.seq != 3", "false"),
    "filter_not_missing_is_true": ("not tcp.seq == 3", "true"),
    "filter_compare_number": ("k >= 40 and frame.len < 5000", "coalesce(k >= 40, false) AND coalesce(bytes < 5000, false)"),
    "filter_string_ci": ('app == "PURCHASE" or app == "Click"', "coalesce(lower(app) IN ('purchase', 'click'), false)"),
    "filter_bool": ("out == true", "coalesce(outbound, false)"),
    "filter_mismatch_is_false": ('k != "3"', "false"),
    "filter_in_mixed_set": ('k in {1, 2, "3", 90}', "coalesce(k IN (1, 2, 90), false)"),
    "filter_contains": ('app contains "IE"', "coalesce(contains(lower(app), 'ie'), false)"),
    "filter_nested": ('not (k < 50 or app == "view") and out != true', "NOT (coalesce(k < 50, false) OR coalesce(lower(app) = 'view', false)) AND coalesce(outbound <> true, false)"),
}
for _name, (_source, _where) in FILTERS.items():
    _on_packets(_name, f"SELECT ordinal, flow, bytes FROM p WHERE {_where}", lambda p, s=_source: p.where(compile_filter(s, FIELDS)).select("ordinal", "flow", "bytes"))

SERIES = {"all": ("", "true"), "buys": ('app == "purchase"', "coalesce(app = 'purchase', false)"), "high": ("k >= 90", "coalesce(k >= 90, false)")}


def _series_sql(width: int) -> str:
    one = " UNION ALL ".join(f"SELECT '{k}' AS series, * FROM p WHERE {w}" for k, (_, w) in SERIES.items())
    return f"""SELECT series, CAST(floor(ts_us / {width}.0) AS BIGINT) * {width} AS bucket_us, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(k) AS agg_count,
  CAST(sum(k) AS DECIMAL(38,0)) AS agg_sum, min(CAST(k AS BIGINT)) AS agg_min, max(CAST(k AS BIGINT)) AS agg_max FROM ({one}) GROUP BY ALL"""


def _series(p: DataFrame, width: int) -> DataFrame:
    return series.io_series(p, {k: compile_filter(v[0], FIELDS) for k, v in SERIES.items()}, width, F.col("k"))


_on_packets("io_series_100ms", _series_sql(100_000), lambda p: _series(p, 100_000))
_on_packets("series_hours", _series_sql(HOUR), lambda p: _series(p, HOUR))
_late = lambda p: series.late_split(p.withColumns({"src": F.col("flow") % 4, "ts_us": F.col("ts_us") - F.when(F.col("k") % 7 == 0, 9 * HOUR).otherwise(0)}), HOUR, 5 * HOUR, "src")
_on_packets("series_on_time_and_late", f""", l AS (SELECT * REPLACE (ts_us - CASE WHEN k % 7 = 0 THEN {9 * HOUR} ELSE 0 END AS ts_us), flow % 4 AS src FROM p),
w AS (SELECT *, first(ts_us) OVER (PARTITION BY src ORDER BY ordinal) AS f, max(ts_us) OVER (PARTITION BY src ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l),
t AS (SELECT *, coalesce(ts_us // {HOUR} < greatest(f // {HOUR}, (m - {5 * HOUR}) // {HOUR}), false) AS late FROM w),
u AS ({" UNION ALL ".join(f"SELECT '{k}' AS series, * FROM t WHERE {w}" for k, (_, w) in SERIES.items())})
SELECT series, ts_us // {HOUR} * {HOUR} AS bucket_us, count(*) FILTER (NOT late) AS packets, CAST(coalesce(sum(bytes) FILTER (NOT late), 0) AS BIGINT) AS bytes, count(k) FILTER (NOT late) AS agg_count,
  CAST(sum(k) FILTER (NOT late) AS DECIMAL(38,0)) AS agg_sum, min(CAST(k AS BIGINT)) FILTER (NOT late) AS agg_min, max(CAST(k AS BIGINT)) FILTER (NOT late) AS agg_max,
  count(*) FILTER (late) AS late_packets, CAST(coalesce(sum(bytes) FILTER (late), 0) AS BIGINT) AS late_bytes FROM u GROUP BY ALL""",
    lambda p: series.io_series(_late(p), {k: compile_filter(v[0], FIELDS) for k, v in SERIES.items()}, HOUR, F.col("k").cast("bigint"), F.col("late")))
_on_packets("series_rollup_avg", f"""SELECT series, CAST(floor(bucket_us / {24 * HOUR}.0) AS BIGINT) * {24 * HOUR} AS bucket_us, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(agg_count) AS BIGINT) AS agg_count, CAST(sum(agg_sum) AS DECIMAL(38,0)) AS agg_sum, min(agg_min) AS agg_min, max(agg_max) AS agg_max, CAST(sum(agg_sum) AS DOUBLE) / sum(agg_count) AS agg_avg
  FROM ({_series_sql(HOUR)}) GROUP BY ALL""", lambda p: series.roll_up(_series(p, HOUR), 24 * HOUR).withColumn("agg_sum", F.col("agg_sum").cast("decimal(38,0)")))
_on_packets("series_late_split", f""", l AS (SELECT ordinal, flow, ts_us - CASE WHEN k % 7 = 0 THEN {9 * HOUR} ELSE 0 END AS ts_us FROM p),
w AS (SELECT *, first(ts_us) OVER (ORDER BY ordinal) AS f, max(ts_us) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l)
SELECT ordinal, coalesce(ts_us // {HOUR} < greatest(f // {HOUR}, (m - {5 * HOUR}) // {HOUR}), false) AS late FROM w""",
    lambda p: series.late_split(p.withColumn("ts_us", F.col("ts_us") - F.when(F.col("k") % 7 == 0, 9 * HOUR).otherwise(0)), HOUR, 5 * HOUR).select("ordinal", "late"))

_FLOW = """CAST(coalesce(sum(bytes) FILTER (outbound), 0) AS BIGINT) AS bytes_tx, CAST(coalesce(sum(bytes) FILTER (NOT outbound), 0) AS BIGINT) AS bytes_rx, count(*) FILTER (outbound) AS packets_tx,
  count(*) FILTER (NOT outbound) AS packets_rx, min(ts_us) AS first_us, max(ts_us) AS last_us"""
_on_packets("flow_rollup", f"SELECT flow, {_FLOW} FROM p GROUP BY flow", lambda p: rollups.flows(p, "flow"))
_on_packets("conversation_rollup", f"SELECT flow, app, {_FLOW}, max(ts_us) - min(ts_us) AS duration_us FROM p GROUP BY flow, app", lambda p: rollups.flows(p, "flow", "app").withColumn("duration_us", F.col("last_us") - F.col("first_us")))
_on_packets("protocol_hierarchy", "SELECT outbound, app, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS packets, CAST(2 - grouping(outbound) - grouping(app) AS INTEGER) AS depth FROM p GROUP BY ROLLUP (outbound, app)", lambda p: rollups.hierarchy(p, ["outbound", "app"]))
_on_packets("app_shares", "SELECT app, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS packets, sum(bytes) * 100.0::DOUBLE / (SELECT sum(bytes) FROM p) AS percent FROM p GROUP BY app", lambda p: rollups.shares(p, "app"))
_on_packets("top_n_flows", "SELECT flow, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY flow ORDER BY bytes DESC, flow LIMIT 10", lambda p: rollups.top_n(p, "flow", 10))
_PAGE = (1704200000000000, 0)
_on_packets("keyset_page", "SELECT ordinal, ts_us, flow, bytes FROM p WHERE (ts_us, ordinal) > (1704200000000000, 0) ORDER BY ts_us, ordinal LIMIT 200", lambda p: p)
QUERIES["keyset_page"] = lambda spark, sf_dir: rollups.keyset_page(packets(spark, sf_dir, _PAGE[0]), _PAGE).select("ordinal", "ts_us", "flow", "bytes")
_on_packets("flow_sessions_gap", f""", g AS (SELECT *, coalesce(CAST(ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY ts_us, ordinal) > {8 * HOUR} AS INTEGER), 1) AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY flow ORDER BY ts_us, ordinal ROWS UNBOUNDED PRECEDING) AS instance FROM g)
SELECT flow, CAST(instance AS BIGINT) AS instance, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM i GROUP BY ALL""",
    lambda p: rollups.sessions(p, "flow", 8 * HOUR).groupBy("flow", "instance").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")))
# open: how many requests wait before a row, as a walk that never falls below zero; a response that finds none matches nothing.
_MATCH = """, v AS (SELECT flow, ordinal, ts_us, app = 'view' AS req FROM p WHERE app IN ('view', 'purchase')),
w AS (SELECT *, sum(CASE WHEN req THEN 1 ELSE -1 END) OVER (PARTITION BY flow ORDER BY ordinal) AS s FROM v),
x AS (SELECT *, greatest(0, max(-s) OVER (PARTITION BY flow ORDER BY ordinal ROWS UNBOUNDED PRECEDING)) AS floor_now FROM w),
y AS (SELECT *, s + floor_now - CASE WHEN req THEN 1 ELSE -1 END AS waiting, NOT req AND floor_now > coalesce(lag(floor_now) OVER (PARTITION BY flow ORDER BY ordinal), 0) AS lost FROM x),
q AS (SELECT flow, ordinal, ts_us, CAST(row_number() OVER (PARTITION BY flow ORDER BY ordinal) AS INTEGER) AS n FROM y WHERE req),
r AS (SELECT flow, ordinal, ts_us, CAST(row_number() OVER (PARTITION BY flow ORDER BY ordinal) AS INTEGER) AS n FROM y WHERE NOT req AND NOT lost),
m AS (SELECT q.flow, q.n, q.ordinal AS req_ordinal, r.ordinal AS resp_ordinal, CASE WHEN r.ordinal IS NOT NULL THEN greatest(0, r.ts_us - q.ts_us) END AS service_us FROM q LEFT JOIN r USING (flow, n))"""
_fifo = lambda p: rollups.match_fifo(p, "flow", F.col("app") == "view", F.col("app") == "purchase")
_on_packets("txn_fifo", f"{_MATCH} SELECT flow, n, req_ordinal, resp_ordinal, service_us FROM m", _fifo)
_on_packets("service_time_summary", f"""{_MATCH}, s AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY service_us NULLS LAST, req_ordinal) AS rn, count(service_us) OVER (PARTITION BY flow) AS c FROM m)
SELECT flow, count(service_us) AS answered, count(*) FILTER (service_us IS NULL) AS unanswered, min(service_us) AS min_us, max(service_us) AS max_us,
  max(service_us) FILTER (rn = greatest(1, ceil(c * 50 / 100.0))) AS p50_us, max(service_us) FILTER (rn = greatest(1, ceil(c * 95 / 100.0))) AS p95_us FROM s GROUP BY flow""", lambda p: rollups.service_times(_fifo(p), "flow"))

# Of segments with payload, each direction for itself: the place after unwrapping, and the highest place before.
_RETRANSMIT = """, d AS (SELECT *, coalesce(((seq - lag(seq) OVER (PARTITION BY flow, outbound ORDER BY i) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0) AS step FROM s WHERE len > 0),
a AS (SELECT *, sum(step) OVER (PARTITION BY flow, outbound ORDER BY i ROWS UNBOUNDED PRECEDING) AS pos FROM d),
m AS (SELECT flow, i, coalesce(pos <= max(pos) OVER (PARTITION BY flow, outbound ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM a),
r AS (SELECT s.*, coalesce(again, false) AS retransmit FROM s LEFT JOIN m USING (flow, i))"""
_on_segments("retransmit_mark", f"{_RETRANSMIT} SELECT flow, seq, bytes, retransmit FROM r", lambda s: tcp.retransmits(s).select("flow", "seq", "bytes", "retransmit"))
_on_segments("packet_loss", f"{_RETRANSMIT} SELECT flow, count(*) FILTER (len > 0) AS segments, count(*) FILTER (retransmit) AS retransmits, CASE WHEN count(*) FILTER (len > 0) = 0 THEN 0 ELSE least(100.0::DOUBLE, count(*) FILTER (retransmit) * 100.0::DOUBLE / count(*) FILTER (len > 0)) END AS loss FROM r GROUP BY flow", lambda s: tcp.loss_percent(tcp.retransmits(s)))
_on_segments("first_reset", """, b AS (SELECT *, coalesce(max(CAST(rst AS INTEGER)) OVER (PARTITION BY flow ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS before FROM s)
SELECT flow, bool_or(rst) AS reset, CAST(sum(CASE WHEN before THEN bytes ELSE 0 END) AS BIGINT) AS bytes_until FROM b GROUP BY flow""", tcp.first_reset)


def follow_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("turn", "at").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return tcp.turns(c, "conv_id", "at", "role", "size")


QUERIES["follow_turns"] = follow_turns
ORACLE_SQL["follow_turns"] = """WITH c AS (SELECT conv_id, turn AS pos, role, CAST(coalesce(length(text), 0) AS BIGINT) AS size FROM conversations),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, role ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
  coalesce(CAST(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS INTEGER), 1) AS fresh FROM c),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS turn FROM s)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CAST(min(st) AS BIGINT) AS start, CAST(sum(size) AS BIGINT) AS length FROM r GROUP BY conv_id, turn, role"""


_IP = "concat(CAST(k % 3 * 91 + 10 AS {t}), '.', CAST(k + 168 AS {t}), '.', CAST(flow % 256 AS {t}), '.', CAST(ordinal % 256 AS {t}))"
_on_packets("address_scope", f"""SELECT ordinal, {_IP.format(t="VARCHAR")} AS ip, CASE WHEN k + 168 > 255 THEN NULL ELSE (k % 3 * 91 + 10)::BIGINT * 16777216 + (k + 168) * 65536 + flow % 256 * 256 + ordinal % 256 END AS ip_int,
  coalesce(k + 168 <= 255 AND (k % 3 = 0 OR k % 3 = 2 AND k = 0), false) AS private FROM p""", lambda p: p.withColumn("ip", F.expr(_IP.format(t="STRING"))).select("ordinal", "ip", net.ipv4_int(F.col("ip")).alias("ip_int"), net.is_private(F.col("ip")).alias("private")))
_KB, _MB = "(CAST(bytes AS BIGINT) * 20 + 1024) // 2048", "(CAST(bytes AS BIGINT) * 20 + 1048576) // 2097152"
_on_packets("formatted_sizes", f"""SELECT ordinal, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN ({_KB}) // 10 || '.' || ({_KB}) % 10 || ' KB' ELSE ({_MB}) // 10 || '.' || ({_MB}) % 10 || ' MB' END AS size FROM p WHERE bytes >= 0 AND bytes < 1073741824""",
    lambda p: p.where("bytes >= 0 and bytes < 1073741824").select("ordinal", net.bytes_text(F.col("bytes")).alias("size")))
_on_packets("flow_status", """, f AS (SELECT flow, bool_or(app = 'error') AS ended, bool_or(app = 'view') AS acked, bool_or(app = 'click') AS syn, min(k) % 2 = 0 AS tcp FROM p GROUP BY flow),
s AS (SELECT *, CASE WHEN ended THEN 'TIME_WAIT' WHEN acked THEN 'ESTABLISHED' WHEN syn THEN 'SYN_SENT' WHEN NOT tcp THEN 'ESTABLISHED' ELSE 'CLOSE_WAIT' END AS status FROM f)
SELECT flow, status, CAST(CASE WHEN status IN ('TIME_WAIT', 'CLOSE_WAIT') THEN 120000 WHEN status = 'SYN_SENT' THEN 30000 WHEN NOT tcp THEN 60000 ELSE 1800000 END AS INTEGER) AS idle_ms FROM s""",
    lambda p: p.groupBy("flow").agg(F.bool_or(F.col("app") == "error").alias("e"), F.bool_or(F.col("app") == "view").alias("a"), F.bool_or(F.col("app") == "click").alias("s"), (F.min("k") % 2 == 0).alias("tcp"))
    .withColumn("status", net.flow_status(F.col("tcp"), F.col("e"), F.col("a"), F.col("s"))).select("flow", "status", net.idle_limit_ms(F.col("status"), F.col("tcp")).alias("idle_ms")))
_on_packets("csv_cells", """SELECT ordinal, CASE WHEN app = 'view' THEN '"''=view"' WHEN app = 'click' THEN '"cl;""ick"' ELSE app END AS cell FROM p""",
    lambda p: p.select("ordinal", net.csv_cell(F.when(F.col("app") == "view", "=view").when(F.col("app") == "click", 'cl;"ick').otherwise(F.col("app"))).alias("cell")))
_on_packets("dns_names_of_codes", """SELECT ordinal, CASE k WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' WHEN 33 THEN 'SRV' WHEN 64 THEN 'SVCB' WHEN 65 THEN 'HTTPS' ELSE 'TYPE' || k END AS type,
  CASE k % 8 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN 'REFUSED' ELSE 'RCODE' || (k % 8) END AS rcode FROM p""", lambda p: p.select("ordinal", net.dns_type(F.col("k")).alias("type"), net.dns_rcode(F.col("k") % 8).alias("rcode")))

_learned = lambda p: p.where("app = 'view'").select("ordinal", "flow", "ts_us", (F.col("ts_us") + 30 * HOUR).alias("expires_us"), F.concat(F.lit("n"), F.col("ordinal").cast("string")).alias("name"))
_on_packets("dns_name_asof", f""", l AS (SELECT flow, ts_us, max(ordinal) AS o FROM p WHERE app = 'view' GROUP BY ALL), q AS (SELECT * FROM p WHERE app = 'purchase')
SELECT q.ordinal, CASE WHEN l.ts_us + {30 * HOUR} > q.ts_us THEN 'n' || l.o END AS name FROM q ASOF LEFT JOIN l ON q.flow = l.flow AND q.ts_us >= l.ts_us""", lambda p: joins.asof(p.where("app = 'purchase'").select("ordinal", "flow", "ts_us"), _learned(p), "flow", "name").select("ordinal", "name"))
_on_packets("ownership_range", """, r AS (SELECT ordinal AS pos, bytes % 2000 * 8 AS low, bytes % 2000 * 8 + k AS high, 'org' || ordinal AS org FROM p WHERE ordinal % 50 = 0)
SELECT p.ordinal, min_by(org, pos) AS org FROM p LEFT JOIN r ON p.bytes BETWEEN low AND high GROUP BY p.ordinal""",
    lambda p: joins.in_range(p.select("ordinal", "bytes"), p.where("ordinal % 50 = 0").selectExpr("ordinal as pos", "bytes % 2000 * 8 as low", "bytes % 2000 * 8 + k as high", "concat('org', ordinal) as org"), "bytes", "low", "high", "pos", "org").select("ordinal", "org"))
_on_packets("unique_links", """, a AS (SELECT flow, k, min(ordinal) AS left_id FROM p WHERE app = 'view' GROUP BY ALL HAVING count(*) = 1), b AS (SELECT flow, k, min(ordinal) AS right_id FROM p WHERE app = 'click' GROUP BY ALL HAVING count(*) = 1)
SELECT * FROM a JOIN b USING (flow, k)""", lambda p: joins.unique_links(p.where("app = 'view'"), p.where("app = 'click'"), ["flow", "k"], "ordinal", "ordinal"))
_on_packets("unanswered_requests", f"{_MATCH} SELECT flow, n, req_ordinal FROM m WHERE resp_ordinal IS NULL", lambda p: _fifo(p).where("resp_ordinal is null").select("flow", "n", "req_ordinal"))
_on_packets("unmatched_responses", f"{_MATCH} SELECT ordinal, flow, ts_us FROM p WHERE app = 'purchase' AND ordinal NOT IN (SELECT resp_ordinal FROM m WHERE resp_ordinal IS NOT NULL)", lambda p: joins.unmatched_responses(_fifo(p), p, F.col("app") == "purchase").select("ordinal", "flow", "ts_us"))
_on_packets("carry_forward", """SELECT n.flow, coalesce(n.host, b.host) AS host, n.bytes FROM (SELECT flow, max(CASE WHEN app = 'error' THEN 'h' || k END) AS host, CAST(sum(bytes) AS BIGINT) AS bytes FROM p WHERE k >= 80 GROUP BY flow) n
LEFT JOIN (SELECT flow, max('h' || k) AS host FROM p WHERE k < 80 GROUP BY flow) b USING (flow)""",
    lambda p: joins.carry_forward(p.where("k >= 80").groupBy("flow").agg(F.max(F.when(F.col("app") == "error", F.concat(F.lit("h"), F.col("k").cast("string")))).alias("host"), F.sum("bytes").alias("bytes")), p.where("k < 80").groupBy("flow").agg(F.max(F.concat(F.lit("h"), F.col("k").cast("string"))).alias("host")), "flow", ["host"]))
_on_packets("handshake_rtt", """, t AS (SELECT *, CASE WHEN app = 'purchase' THEN ts_us - max(CASE WHEN app = 'view' THEN ts_us END) OVER (PARTITION BY flow ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS r FROM p)
SELECT flow, max_by(r, ordinal) FILTER (r IS NOT NULL) AS rtt_us FROM t GROUP BY flow""", lambda p: folds.handshake_rtt(p, "flow", F.col("app") == "view", F.col("app") == "purchase"))
_on_packets("sticky_app", """SELECT ordinal, coalesce(last_value(CASE WHEN k < 30 THEN app END IGNORE NULLS) OVER (PARTITION BY flow ORDER BY ordinal ROWS UNBOUNDED PRECEDING), CASE k WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 67 THEN 'DHCP' WHEN 68 THEN 'DHCP' END) AS app_now FROM p""",
    lambda p: folds.sticky(p, "flow", F.when(F.col("k") < 30, F.col("app")), net.port_name(F.when(F.col("k").isin(53, 80, 67, 68), F.col("k")))).select("ordinal", "app_now"))
_samples = lambda p: p.select("flow", (F.row_number().over(Window.partitionBy("flow").orderBy("ordinal")) - 1).alias("index"), "ts_us", "outbound", (F.col("bytes") * (F.col("k") % 2)).alias("bytes"), (F.col("k") % 3 == 0).alias("syn"), (F.col("k") == 99).alias("rst"), (F.col("k") > 80).alias("fin"), (F.col("k") % 4).alias("win"))
_SAMPLES = """, t AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY ordinal) - 1 AS idx, ts_us, outbound, bytes * (k % 2) AS bytes, k % 3 = 0 AS syn, k = 99 AS rst, k > 80 AS fin, k % 4 AS win FROM p)"""
_on_packets("throughput_bins", f"""{_SAMPLES}, e AS (SELECT flow, min(ts_us) AS a, max(ts_us) AS z, bool_or(idx = 0 AND syn) AS whole, bool_or(rst) OR bool_or(fin AND outbound) AND bool_or(fin AND NOT outbound) AS ended FROM t GROUP BY flow),
g AS (SELECT flow, unnest(range(a // {HOUR} + CASE WHEN whole OR a % {HOUR} = 0 THEN 0 ELSE 1 END, z // {HOUR} + CASE WHEN ended THEN 1 ELSE 0 END)) AS b FROM e),
u AS (SELECT flow, ts_us // {HOUR} AS b, sum(CASE WHEN outbound THEN bytes ELSE 0 END) AS o, sum(CASE WHEN outbound THEN 0 ELSE bytes END) AS i FROM t GROUP BY ALL)
SELECT flow, b * {HOUR} AS bin_us, CAST(coalesce(o, 0) AS BIGINT) AS outbound_bytes, CAST(coalesce(i, 0) AS BIGINT) AS inbound_bytes FROM g LEFT JOIN u USING (flow, b)""", lambda p: folds.throughput(_samples(p), "flow", HOUR, 0, 1 << 61))
_on_packets("covered_buckets", f""", s AS ({_series_sql(HOUR)}), e AS (SELECT series, unnest(range(min(bucket_us), max(bucket_us) + 1, {HOUR})) AS bucket_us FROM s GROUP BY series)
SELECT series, bucket_us, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes FROM e LEFT JOIN s USING (series, bucket_us)""", lambda p: folds.covered(_series(p, HOUR), HOUR))
_on_packets("bandwidth_history", f""", s AS (SELECT series, bucket_us, bytes FROM ({_series_sql(HOUR)}))
SELECT series, bucket_us, array_to_string(list(bytes) OVER (PARTITION BY series ORDER BY bucket_us ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), ',') AS history FROM s""", lambda p: folds.history(_series(p, HOUR), "series", "bucket_us", "bytes").select("series", "bucket_us", F.array_join(F.col("history").cast("array<string>"), ",").alias("history")))
_on_packets("ended_flows", "SELECT flow, bool_or(k = 99) OR (bool_or(k > 90 AND outbound) AND bool_or(k > 90 AND NOT outbound)) AS ended FROM p GROUP BY flow", lambda p: folds.ended(p, "flow", F.col("k") == 99, F.col("k") > 90))
_gapped = lambda p: _samples(p).withColumn("index", F.col("index") + F.floor(F.col("index") / F.lit(7)).cast("int"))
_on_packets("zero_window_spans", f"""{_SAMPLES}, g AS (SELECT *, idx + idx // 7 AS pos, idx // 7 AS run FROM t), e AS (SELECT flow, run, max(pos) AS last_pos, max_by(ts_us, pos) AS end_us FROM g GROUP BY ALL),
z AS (SELECT * FROM (SELECT flow, max(run) AS top FROM g GROUP BY flow)), o AS (SELECT * FROM g WHERE NOT rst),
n AS (SELECT *, win = 0 AND coalesce(lag(win) OVER (PARTITION BY flow, run, outbound ORDER BY pos), 1) <> 0 AS fresh FROM o),
c AS (SELECT n.flow, n.run, n.outbound, n.pos, n.ts_us, min_by(l.ts_us, l.pos) AS until_us FROM n LEFT JOIN o l ON l.flow = n.flow AND l.run = n.run AND l.outbound = n.outbound AND l.pos > n.pos AND l.win <> 0 WHERE fresh GROUP BY ALL)
SELECT flow, outbound, ts_us AS from_us, coalesce(until_us, end_us) AS to_us, until_us IS NULL AND run = top AS open FROM c JOIN e USING (flow, run) JOIN z USING (flow)""", lambda p: folds.zero_window_spans(_gapped(p), "flow"))
_on_packets("lines_at_gaps", """, r AS (SELECT flow, k, k - row_number() OVER (PARTITION BY flow ORDER BY k) AS i FROM (SELECT DISTINCT flow, k FROM p)), g AS (SELECT flow, i, min(k) AS first, max(k) AS last, count(*) AS points FROM r GROUP BY ALL)
SELECT flow, first, last, points, CAST(row_number() OVER (PARTITION BY flow ORDER BY first) AS INTEGER) AS line FROM g""", lambda p: folds.islands(p, "flow", "k"))
QUERIES["paced_sample"] = lambda spark, sf_dir: folds.paced(packets(spark, sf_dir), "flow", 4, 24 * HOUR).select("ordinal", "admitted")
_on_segments("findings", f"""{_RETRANSMIT}, x AS (SELECT *, row_number() OVER (PARTITION BY flow, rst ORDER BY i) AS c FROM r)
SELECT flow, seq, bytes, 'retransmission' AS code, 'warning' AS severity FROM x WHERE retransmit UNION ALL SELECT flow, seq, bytes, 'connection-reset', 'note' FROM x WHERE rst AND c = 1""", lambda s: folds.findings(tcp.retransmits(s)).select("flow", "seq", "bytes", "code", "severity"))
_on_segments("finding_markers", f"{_RETRANSMIT}, f AS (SELECT flow, min_by('retransmission', i) AS finding FROM r WHERE retransmit GROUP BY flow) SELECT s.flow, s.seq, finding FROM s LEFT JOIN f USING (flow)", lambda s: joins.first_finding(s, folds.findings(tcp.retransmits(s)).where("code = 'retransmission'"), "flow", "idx").select("flow", "seq", "finding"))
