"""Named queries of table views, counters and transactions, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import network as net
from netloom.functions.display_filter import compile_filter, connection_fields
from netloom.operators import joins, rollups, stats, tcp, transactions, views
from netloom.plans.model import FIELDS
from netloom.plans.model import packets as read_packets
from netloom.plans.queries import HOUR, ORACLE_SQL, QUERIES, _on_packets, _on_segments, _series, _series_sql
from netloom.sources import events

__all__ = ["ORACLE_SQL", "QUERIES"]
DAY0 = 1_704_067_200_000_000

# Searches, sorts and pages. The columns that a viewer shows are made of the packets' own.
_shown = lambda p: p.select("ordinal", "ts_us", F.initcap("app").alias("protocol"), F.concat(F.lit("len="), F.col("bytes").cast("string"), F.lit(" K"), F.col("k").cast("string")).alias("summary"), F.concat(F.lit("h"), F.col("flow").cast("string")).alias("src"), F.concat(F.lit("H"), F.col("k").cast("string")).alias("dst"), F.when(F.col("k") % 3 == 0, 7).otherwise(4).alias("layer"))
_SHOWN = """, v AS (SELECT ordinal, ts_us, upper(app[1]) || app[2:] AS protocol, 'len=' || bytes || ' K' || k AS summary, 'h' || flow AS src, 'H' || k AS dst, CASE WHEN k % 3 = 0 THEN 7 ELSE 4 END AS layer FROM p)"""
_on_packets("packets_in_time", f"SELECT ordinal, ts_us FROM p WHERE ts_us >= {DAY0} AND ts_us < {DAY0 + 40 * HOUR}", _shown)
QUERIES["packets_in_time"] = lambda spark, sf_dir: views.in_time(read_packets(spark, sf_dir, DAY0, DAY0 + 40 * HOUR), DAY0, DAY0 + 40 * HOUR).select("ordinal", "ts_us")
_on_packets("packet_search", f"{_SHOWN} SELECT ordinal FROM v WHERE (contains(lower(protocol), 'h7') OR contains(lower(summary), 'h7') OR contains(src, 'h7') OR contains(dst, 'h7'))", lambda p: views.packets_found(_shown(p), "h7").select("ordinal"))
_on_packets("packet_search_in_any_case", f"{_SHOWN} SELECT ordinal FROM v WHERE contains(lower(protocol), 'ick') OR contains(lower(summary), 'ick') OR contains(src, 'ICK') OR contains(dst, 'ICK')", lambda p: views.packets_found(_shown(p), "ICK").select("ordinal"))
_on_packets("layer_filter", f"{_SHOWN} SELECT ordinal, layer FROM v WHERE layer = 7", lambda p: views.packets_found(_shown(p), "", 7).select("ordinal", "layer"))
_conns = lambda p: p.select("ordinal", F.col("app").alias("protocol"), F.concat(F.lit("Proc"), F.col("k").cast("string")).alias("process"), F.concat(F.lit("10.0.0."), (F.col("flow") % 256).cast("string")).alias("remote_addr"), F.lit(None).cast("string").alias("remote_host"), F.lit("10.0.0.1").alias("local_addr"), F.when(F.col("k") % 2 == 0, "TCP").otherwise("UDP").alias("transport"), "app", F.col("k").alias("local_port"))
_CONNS = """, c AS (SELECT ordinal, app AS protocol, 'Proc' || k AS process, '10.0.0.' || (flow % 256) AS remote_addr, CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS transport, app, k AS local_port FROM p)"""
_on_packets("connection_search", f"{_CONNS} SELECT ordinal FROM c WHERE transport = 'TCP' AND (contains(lower(process), 'proc4') OR contains(lower(protocol), 'proc4') OR contains(remote_addr, 'PROC4'))", lambda p: views.connections_found(_conns(p), "PROC4", "TCP").select("ordinal"))
_on_packets("connection_tab_of_an_app", f"{_CONNS} SELECT ordinal FROM c WHERE contains(upper(app), 'VIEW')", lambda p: views.connections_found(_conns(p), "", "VIEW").select("ordinal"))
_on_packets("host_search", f"{_CONNS} SELECT ordinal FROM c WHERE contains(lower(remote_addr || ' ' || process), '.7 proc')", lambda p: views.hosts_found(_conns(p), ".7 PROC", ("remote_addr", "remote_host", "process")).select("ordinal"))
_on_packets("connection_filter", f"{_CONNS} SELECT ordinal FROM c WHERE lower(process) = 'proc12' OR local_port >= 90 AND transport = 'UDP'", lambda p: _conns(p).where(compile_filter('connection.process == "PROC12" or connection.local_port >= 90 and connection.transport == "udp" or tcp.port == 3', connection_fields({}))).select("ordinal"))
_HOSTS = """, h AS (SELECT flow AS host, CAST(coalesce(sum(bytes) FILTER (outbound), 0) AS BIGINT) AS bytes_tx, CAST(coalesce(sum(bytes) FILTER (NOT outbound), 0) AS BIGINT) AS bytes_rx, count(*) FILTER (outbound) AS packets_tx,
  count(*) FILTER (NOT outbound) AS packets_rx, count(DISTINCT k) AS flow_count, min(ts_us) AS first_us, max(ts_us) AS last_us FROM p GROUP BY flow)"""
_hosts = lambda p: stats.endpoints(p, "flow", "k").withColumnRenamed("flow", "host")
_on_packets("endpoint_rollup", f"{_HOSTS} SELECT * FROM h", _hosts)
_on_packets("host_table_by_bytes", f"{_HOSTS} SELECT host, CAST(row_number() OVER (ORDER BY bytes_tx + bytes_rx DESC, host) AS INTEGER) AS place FROM h", lambda p: views.host_table(_hosts(p)).select("host", "place"))
_on_packets("host_table_by_flows", f"{_HOSTS} SELECT host, CAST(row_number() OVER (ORDER BY flow_count, host) AS INTEGER) AS place FROM h", lambda p: views.host_table(_hosts(p), "flow_count", False).select("host", "place"))
_on_packets("newest_packets", "SELECT ordinal, ts_us FROM p ORDER BY ts_us DESC, ordinal DESC LIMIT 100", lambda p: views.newest(p).select("ordinal", "ts_us"))
_on_packets("newest_points", f"SELECT series, bucket_us, packets FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bucket_us DESC) AS r FROM ({_series_sql(HOUR)})) WHERE r <= 200", lambda p: views.newest_points(_series(p, HOUR), 200).select("series", "bucket_us", "packets"))
_on_packets("drill_down", f"SELECT ordinal FROM p WHERE ts_us >= {DAY0 + 20 * HOUR} AND ts_us < {DAY0 + 44 * HOUR} AND app = 'purchase'", _shown)
QUERIES["drill_down"] = lambda spark, sf_dir: views.drilled(
    read_packets(spark, sf_dir, DAY0 + 20 * HOUR, DAY0 + 44 * HOUR), compile_filter('app == "purchase"', FIELDS), DAY0 + 20 * HOUR, 24 * HOUR).select("ordinal")
_on_packets("connections_csv", f"""{_HOSTS}, t AS (SELECT *, row_number() OVER (ORDER BY bytes_tx + bytes_rx DESC, host) AS place FROM h)
SELECT -2::BIGINT AS line, '# showing ' || count(*) || ' of 100000 observed' AS text FROM t UNION ALL SELECT -1, 'Protocol,Local,Remote,Process,PID,RX Bytes,TX Bytes,Status'
UNION ALL SELECT place, 'HTTP,10.0.0.1:' || host || ',' || CASE WHEN host % 2 = 0 THEN '"''=' || host || ':80"' ELSE 'h' || host || ':80' END || ',' || CASE WHEN host % 3 = 0 THEN '"a ""b"", c"' ELSE '' END
  || ',' || host || ',' || bytes_rx || ',' || bytes_tx || ',ESTABLISHED' FROM t""",
    lambda p: views.connections_csv(views.host_table(_hosts(p)).select(
        "place", F.lit("HTTP").alias("protocol"), F.lit("10.0.0.1").alias("local_addr"), F.col("host").alias("local_port"), F.concat(F.when(F.col("host") % 2 == 0, "=").otherwise("h"), F.col("host").cast("string")).alias("remote_addr"),
        F.lit(80).alias("remote_port"), F.when(F.col("host") % 3 == 0, 'a "b", c').alias("process"), F.col("host").alias("pid"), F.col("bytes_rx").alias("rx_bytes"), F.col("bytes_tx").alias("tx_bytes"), F.lit("ESTABLISHED").alias("status"), F.lit("secret").alias("payload")), 100_000))

# Samples of a flow: index from 0, some lost.
_ring = lambda p: p.select("flow", (F.row_number().over(Window.partitionBy("flow").orderBy("ordinal")) - 1).alias("index"), "ordinal", "ts_us", "outbound", "k", (F.col("bytes") * (F.col("k") % 2)).alias("bytes"))
_RING = """, g AS (SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY ordinal) - 1 AS INTEGER) AS idx, ordinal, ts_us, outbound, k, bytes * (k % 2) AS bytes FROM p)"""
_on_packets("sample_page", f"{_RING} SELECT flow, idx AS index, n > 5 AS more, low - 3 AS dropped_older FROM (SELECT *, count(*) OVER (PARTITION BY flow) AS n, min(idx) OVER (PARTITION BY flow) AS low, row_number() OVER (PARTITION BY flow ORDER BY idx) AS r FROM g WHERE idx >= 3) WHERE r <= 5",
            lambda p: views.sample_page(_ring(p), "flow", 3, 5).select("flow", "index", "more", "dropped_older"))
_on_packets("ring_retention", f"{_RING} SELECT flow, idx AS index FROM (SELECT *, max(idx) OVER (PARTITION BY flow) AS z FROM g) WHERE idx < 2 OR idx > z - 4", lambda p: views.retained(_ring(p), "flow", 4, 2).select("flow", "index"))
_on_packets("held_values", f"SELECT ordinal FROM (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY flow ORDER BY ts_us, ordinal), 4611686018427387904) AS u FROM p) WHERE ts_us < {DAY0 + 60 * HOUR} AND u > {DAY0 + 30 * HOUR}", lambda p: views.held_values(p, "flow", DAY0 + 30 * HOUR, DAY0 + 60 * HOUR).select("ordinal"))
_on_packets("run_collapse", f"""{_RING}, i AS (SELECT *, k % 5 = 0 AS hit, sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY idx) AS run FROM g)
SELECT flow, CAST(run AS BIGINT) AS run, count(*) AS segments, count(*) FILTER (outbound AND bytes > 0) AS out_data, CAST(sum(CASE WHEN outbound THEN bytes ELSE 0 END) AS BIGINT) AS out_bytes, count(*) FILTER (outbound AND bytes <= 0) AS out_acks,
  count(*) FILTER (NOT outbound AND bytes > 0) AS in_data, CAST(sum(CASE WHEN outbound THEN 0 ELSE bytes END) AS BIGINT) AS in_bytes, count(*) FILTER (NOT outbound AND bytes <= 0) AS in_acks FROM i WHERE NOT hit GROUP BY flow, run""", lambda p: stats.runs(_ring(p), "flow", F.col("k") % 5 == 0))
_on_packets("time_ranges", "SELECT flow, min(ts_us) AS from_us, max(ts_us) AS to_us FROM p GROUP BY flow", lambda p: stats.time_range(p, "flow"))
_FLAGS = "(k * 7) % 32"
_on_packets("arrow_texts", f"""SELECT ordinal, coalesce(nullif(concat_ws(',', CASE WHEN {_FLAGS} & 2 > 0 THEN 'SYN' END, CASE WHEN {_FLAGS} & 1 > 0 THEN 'FIN' END, CASE WHEN {_FLAGS} & 4 > 0 THEN 'RST' END, CASE WHEN {_FLAGS} & 8 > 0 THEN 'PSH' END, CASE WHEN {_FLAGS} & 16 > 0 THEN 'ACK' END), ''), '(no flags)')
  || CASE WHEN bytes > 0 THEN ' len=' || bytes ELSE '' END || CASE WHEN app = 'error' THEN ' · error' ELSE '' END || CASE WHEN k > 90 THEN ' · retransmission' ELSE '' END || CASE WHEN k % 9 = 0 THEN ' · zero window' ELSE '' END AS text FROM p""",
    lambda p: p.select("ordinal", net.arrow_text(F.expr(_FLAGS), F.col("bytes"), F.when(F.col("app") == "error", F.col("app")), F.col("k") > 90, F.col("k") % 9 == 0).alias("text")))
_on_packets("sample_keys", f"SELECT ordinal, CASE WHEN outbound THEN 'o' ELSE 'i' END || '|' || flow || '|' || CASE WHEN k % 2 = 0 THEN CAST(ordinal AS VARCHAR) ELSE '-' END || '|' || ({_FLAGS} & 23) || '|' || (ts_us // 1000) AS key FROM p",
            lambda p: p.select("ordinal", net.sample_key(F.col("outbound"), F.col("flow"), F.when(F.col("k") % 2 == 0, F.col("ordinal")), F.expr(_FLAGS), F.col("ts_us")).alias("key")))
_on_packets("fields_at_a_byte", """, f AS (SELECT flow AS frame, k AS lo, bytes % 40 + 1 AS size, k % 3 = 0 AS is_group, ordinal AS position FROM p)
SELECT frame, position FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY is_group, size, position) AS r FROM f WHERE lo <= 50 AND lo + size > 50) WHERE r = 1""",
    lambda p: views.most_specific_field(p.select(F.col("flow").alias("frame"), F.col("k").alias("at"), (F.col("bytes") % 40 + 1).alias("size"), (F.col("k") % 3 == 0).alias("is_group"), F.col("ordinal").alias("position")), 50).select("frame", "position"))
_KBS, _MBS = "(bytes * 20 + 1024) // 2048", "(bytes * 64 * 200 + 1048576) // 2097152"
_on_packets("formatted_speeds", f"""SELECT ordinal, CASE WHEN bytes < 1024 THEN bytes || ' B/s' ELSE ({_KBS}) // 10 || '.' || ({_KBS}) % 10 || ' KB/s' END AS speed,
  CASE WHEN bytes * 64 < 1048576 THEN NULL ELSE ({_MBS}) // 100 || '.' || lpad(CAST(({_MBS}) % 100 AS VARCHAR), 2, '0') || ' MB/s' END AS fast FROM p WHERE bytes BETWEEN 0 AND 1000000""",
    lambda p: p.where("bytes between 0 and 1000000").select("ordinal", net.speed_text(F.col("bytes")).alias("speed"), F.when(F.col("bytes") * 64 >= 1048576, net.speed_text(F.col("bytes") * 64)).alias("fast")))

# Counters.
_on_packets("canonical_flows", """, e AS (SELECT ordinal, 'h' || (flow % 20) AS src, k AS src_port, 'h' || (k % 20) AS dst, CAST(flow % 100 AS INTEGER) AS dst_port FROM p), o AS (SELECT *, src < dst OR src = dst AND src_port <= dst_port AS outbound FROM e)
SELECT ordinal, outbound, CASE WHEN outbound THEN src ELSE dst END AS local_addr, CASE WHEN outbound THEN src_port ELSE dst_port END AS local_port, CASE WHEN outbound THEN dst ELSE src END AS remote_addr, CASE WHEN outbound THEN dst_port ELSE src_port END AS remote_port FROM o""",
    lambda p: stats.canonical(p.selectExpr("ordinal", "concat('h', flow % 20) as src", "k as src_port", "concat('h', k % 20) as dst", "cast(flow % 100 as int) as dst_port")).select("ordinal", "outbound", "local_addr", "local_port", "remote_addr", "remote_port"))
_on_packets("local_flows", """SELECT ordinal, CASE WHEN flow % 20 IN (3, 4) THEN 'h' || (flow % 20) ELSE 'h' || (k % 20) END AS local_addr, flow % 20 IN (3, 4) AS outbound FROM p WHERE flow % 20 IN (3, 4) OR k % 20 IN (3, 4)""",
    lambda p: stats.canonical(p.selectExpr("ordinal", "concat('h', flow % 20) as src", "k as src_port", "concat('h', k % 20) as dst", "cast(flow % 100 as int) as dst_port"), ["h3", "h4"]).select("ordinal", "local_addr", "outbound"))
_marked = lambda p: rollups.sessions(p, "flow", 8 * HOUR).withColumns({"rst": F.col("k") == 99, "ack": F.col("k") % 2 == 0, "label": F.when(F.col("k") % 10 == 1, F.col("app"))})
_on_packets("flow_facts", f""", g AS (SELECT *, CASE WHEN coalesce(ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY ts_us, ordinal) > {8 * HOUR}, true) THEN 1 ELSE 0 END AS fresh FROM p)
SELECT flow, CAST(sum(fresh) AS BIGINT) AS instances, coalesce(max_by(k <> 99, ordinal) FILTER (k = 99 OR k % 2 = 0), false) AS established, min_by(app, ordinal) FILTER (k % 10 = 1) AS label FROM g GROUP BY flow""", lambda p: stats.flow_facts(_marked(p), "flow"))
_on_packets("freshest_label", "SELECT flow, max_by(app, ordinal) FILTER (k % 10 = 1) AS label FROM p GROUP BY flow", lambda p: stats.freshest(p.withColumn("label", F.when(F.col("k") % 10 == 1, F.col("app"))), "flow", "label"))
_FLOWS = """, f AS (SELECT flow, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS packets, max(k) > 90 AS active, CAST(min(k) AS DOUBLE) AS loss, max(app) FILTER (k % 10 = 1) AS app FROM p GROUP BY flow),
y AS (SELECT 3 AS layer, * FROM f UNION ALL SELECT 4, * FROM f UNION ALL SELECT 7, * FROM f WHERE app IS NOT NULL),
l AS (SELECT layer, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, count(*) FILTER (active) AS active, sum(loss) / count(*) AS loss FROM y GROUP BY layer)"""
_layers = lambda p: stats.layers(p.groupBy("flow").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"), (F.max("k") > 90).alias("active"), F.min("k").cast("double").alias("loss"), F.max(F.when(F.col("k") % 10 == 1, F.col("app"))).alias("app")))
_on_packets("layer_stats", f"{_FLOWS} SELECT * FROM l", _layers)
_on_packets("error_average", f"{_FLOWS} SELECT round(avg(loss), 9) AS error, avg(loss) < 0.2 AS healthy FROM l", lambda p: stats.mean_error(_layers(p)).select(F.round("error", 9).alias("error"), "healthy"))
_on_packets("tick_rates", f"SELECT flow, ts_us // {HOUR} * {HOUR} AS tick_us, sum(CASE WHEN outbound THEN 0 ELSE bytes END) / 3600.0::DOUBLE AS rx_rate, sum(CASE WHEN outbound THEN bytes ELSE 0 END) / 3600.0::DOUBLE AS tx_rate FROM p GROUP BY ALL", lambda p: stats.rates(p, "flow", HOUR))
_on_packets("series_rates", f"SELECT series, bucket_us, packets / 3600.0::DOUBLE AS packet_rate, bytes * 8 / 3600.0::DOUBLE AS bit_rate FROM ({_series_sql(HOUR)})", lambda p: stats.series_rate(_series(p, HOUR), HOUR).select("series", "bucket_us", "packet_rate", "bit_rate"))
_on_packets("drop_totals", "SELECT CAST(sum(d) AS BIGINT) AS dropped, CAST(sum(i) AS BIGINT) AS if_dropped FROM (SELECT max_by(bytes, ordinal) AS d, max_by(k, ordinal) AS i FROM p GROUP BY flow)", lambda p: stats.drop_totals(p.select(F.col("flow").alias("handle"), "ordinal", F.col("bytes").alias("dropped"), F.col("k").alias("if_dropped"))))
_on_packets("process_attribution", """, f AS (SELECT flow AS host, k AS local_port, max(ts_us) AS last_us FROM p GROUP BY ALL), o AS (SELECT host, max_by(local_port, struct_pack(a := last_us, b := local_port)) AS port FROM f WHERE local_port % 4 = 0 GROUP BY host)
SELECT host, coalesce(port + 1000, 0) AS pid, coalesce('proc' || port, 'unknown') AS process FROM (SELECT DISTINCT flow AS host FROM p) LEFT JOIN o USING (host)""",
    lambda p: stats.attributed(p.select(F.col("flow").alias("host")).distinct(), p.groupBy(F.col("flow").alias("host"), F.col("k").alias("local_port")).agg(F.max("ts_us").alias("last_us")), p.where("k % 4 = 0").select(F.col("k").alias("local_port")).distinct().selectExpr("local_port", "local_port + 1000 as pid", "concat('proc', local_port) as process")))
_on_packets("response_links", "SELECT b.ordinal AS response, a.ordinal AS request FROM p b JOIN p a ON a.ordinal = b.ordinal - b.k - 1 WHERE b.app = 'purchase'", lambda p: stats.response_links(p.withColumn("response_to", F.when(F.col("app") == "purchase", F.col("ordinal") - F.col("k") - 1))))
_on_packets("enrichment", """, f AS (SELECT flow, max_by('n' || ordinal, ordinal) FILTER (k % 5 = 0) AS name FROM p WHERE app = 'error' GROUP BY flow) SELECT h.flow AS flow, coalesce(f.name, 'h' || h.flow) AS name FROM (SELECT DISTINCT flow FROM p) h LEFT JOIN f USING (flow)""",
    lambda p: stats.enriched(p.select("flow", F.concat(F.lit("h"), F.col("flow").cast("string")).alias("name")).distinct(), p.where("app = 'error'").select("flow", "ordinal", F.when(F.col("k") % 5 == 0, F.concat(F.lit("n"), F.col("ordinal").cast("string"))).alias("name")), "flow", ["name"]))
_on_packets("open_problems", "SELECT 'malformed-frame' AS code, 'warning' AS severity, flow, ordinal, 'frame:' || ordinal AS target FROM p WHERE k = 13 UNION ALL SELECT 'unanswered-request', 'warning', flow, ordinal, 'frame:' || ordinal FROM p WHERE k = 14",
            lambda p: stats.problem_findings(p.withColumn("parse_status", F.when(F.col("k") == 13, "malformed").otherwise("ok")), p.where("k = 14")))

# Transactions: ordered folds with timeouts, which SQL does not express; tests compare them with a plain loop.
def _dns(p: DataFrame) -> DataFrame:
    rows = p.where("app in ('view', 'purchase')")
    return transactions.dns(rows.select("flow", "ordinal", (F.col("ordinal") * 20_000).alias("ts_us"), (F.col("app") == "view").alias("outbound"), (F.col("k") % 3).alias("id"), F.when(F.col("app") == "view", "Example.org").otherwise("eXample.ORG").alias("name"), (F.col("app") == "view").alias("is_query")))


def _http(p: DataFrame) -> DataFrame:
    rows = p.where("app in ('view', 'purchase')")
    return transactions.http(rows.select("flow", "ordinal", (F.col("ordinal") * 20_000).alias("ts_us"), (F.col("app") == "view").alias("outbound"), F.when(F.col("app") == "purchase", F.when(F.col("k") < 10, 100).otherwise(200)).alias("status")))


QUERIES["dns_transactions"] = lambda spark, sf_dir: _dns(read_packets(spark, sf_dir)).select("flow", "ordinal", "t.*")
QUERIES["http_transactions"] = lambda spark, sf_dir: _http(read_packets(spark, sf_dir)).select("flow", "ordinal", "t.*")
QUERIES["dns_unanswered"] = lambda spark, sf_dir: transactions.unanswered(_dns(read_packets(spark, sf_dir))).select("flow", "ordinal")
_answer = "named_struct('name', {0}, 'rtype', {1}, 'data', {2}, 'ttl', {3})"
_on_packets("learned_names", f"""SELECT '10.0.0.' || k AS address, 'host' || flow AS name, ts_us + greatest(3600, least(86400, k * 1000)) * 1000000::BIGINT AS expires_us FROM p WHERE app = 'view' AND k % 2 = 0""",
    lambda p: transactions.learned_names(p.where("app = 'view'").select(F.concat(F.lit("HOST"), F.col("flow").cast("string")).alias("name"), "ts_us", F.expr("array(" + ", ".join([
        _answer.format("'c2.Example'", "1", "concat('10.0.0.', k)", "k * 1000"), _answer.format("'c1.example'", "5", "'C2.example'", "1"), _answer.format("concat('host', flow)", "5", "if(k % 2 = 0, 'c1.EXAMPLE', 'other')", "1"), _answer.format("'stranger'", "1", "'1.1.1.1'", "1"), _answer.format("'c2.example'", "28", "''", "1")]) + ")").alias("answers"))))
_on_packets("http_requests", "SELECT ordinal, CASE WHEN app IN ('view', 'click') THEN 'GET' END AS method, CASE WHEN app IN ('view', 'click') THEN '/' || k END AS path FROM p",
            lambda p: p.select("ordinal", net.http_request(F.concat(F.when(F.col("app") == "view", "GET /").when(F.col("app") == "click", "  GET\t/").when(F.col("app") == "error", "get /").otherwise("GET x/"), F.col("k").cast("string"), F.lit(" HTTP/1.1\r\nHost: a\r\n\r\n"))).alias("r")).select("ordinal", "r.*"))
_on_packets("media_types", "SELECT ordinal, CASE app WHEN 'view' THEN 'text/x-' || k WHEN 'click' THEN 'a/b' END AS media FROM p", lambda p: p.select("ordinal", net.media_type(F.when(F.col("app") == "view", F.concat(F.lit(" Text/X-"), F.col("k").cast("string"), F.lit(" ; charset=x"))).when(F.col("app") == "click", "A/b").otherwise("a b/c")).alias("media")))
_on_packets("display_safe_texts", "SELECT ordinal, app || '\\u{e9}\\u{9}' || CASE WHEN length(app) > 4 THEN '…' ELSE k || CASE WHEN length(app) + length(CAST(k AS VARCHAR)) + 2 > 99 THEN '…' ELSE '' END END AS text FROM p WHERE app = 'view'", lambda p: p.where("app = 'view'").select("ordinal", net.display_safe(F.concat("app", F.lit("é\t"), F.col("k").cast("string")), 99).alias("text")))

_on_segments("top_n_segments", "SELECT flow, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY flow ORDER BY bytes DESC, flow LIMIT 10", lambda s: rollups.top_n(s, "flow", 10))
_SYNS = """, g AS (SELECT flow, ordinal, CAST(row_number() OVER (PARTITION BY flow ORDER BY ordinal) - 1 AS INTEGER) AS idx, outbound, k % 4 = 0 AS syn, k % 3 = 0 AS ack, bytes % 65536 AS win, CASE WHEN k % 5 > 0 THEN k % 17 END AS wscale FROM p),
f AS (SELECT flow, outbound, min(idx) AS at_idx, min_by(ack, idx) AS ack, arg_min_null(least(wscale, 14), idx) AS shift FROM g WHERE syn GROUP BY flow, outbound)"""
_on_packets("scaled_windows", f"""{_SYNS} SELECT g.ordinal, coalesce(g.idx >= l.at_idx AND g.idx >= r.at_idx AND l.ack <> r.ack AND l.shift IS NOT NULL AND r.shift IS NOT NULL AND NOT g.syn, false) AS scaled,
  CASE WHEN coalesce(g.idx >= l.at_idx AND g.idx >= r.at_idx AND l.ack <> r.ack AND l.shift IS NOT NULL AND r.shift IS NOT NULL AND NOT g.syn, false) THEN g.win << CASE WHEN g.outbound THEN l.shift ELSE r.shift END ELSE g.win END AS win
  FROM g LEFT JOIN f l ON l.flow = g.flow AND l.outbound LEFT JOIN f r ON r.flow = g.flow AND NOT r.outbound""",
    lambda p: tcp.scaled_windows(_ring(p).join(p.select("ordinal", (F.col("k") % 4 == 0).alias("syn"), (F.col("k") % 3 == 0).alias("ack"), (F.col("bytes") % 65536).alias("win"), F.when(F.col("k") % 5 > 0, F.col("k") % 17).alias("wscale")), "ordinal"), "flow").select("ordinal", "scaled", F.col("window").alias("win")))
_on_packets("longest_prefix", """, r AS (SELECT ordinal % 4000 AS low, ordinal % 4000 + (k + 1) * 10 AS high, (k + 1) * 10 * 1000000 + ordinal AS width, 'svc' || ((k + 1) * 10) AS svc FROM p WHERE ordinal % 50 = 0)
SELECT p.ordinal, min_by(svc, width) AS svc FROM p LEFT JOIN r ON p.bytes BETWEEN low AND high GROUP BY p.ordinal""",
    lambda p: joins.longest_prefix(p.select("ordinal", "bytes"), p.where("ordinal % 50 = 0").selectExpr("ordinal % 4000 as low", "ordinal % 4000 + (k + 1) * 10 as high", "concat('svc', (k + 1) * 10) as svc"), "bytes", "svc").select("ordinal", "svc"))
_on_packets("hop_places", "SELECT flow AS connection, k AS hop, 'c' || (k // 2) AS country, CASE WHEN k % 2 = 0 THEN 'o' || k END AS org FROM p WHERE k < 60 UNION ALL SELECT flow, k, NULL, NULL FROM p WHERE k >= 60",
            lambda p: joins.hop_places(p.select(F.col("flow").alias("connection"), F.col("k").alias("hop"), F.when(F.col("k") < 80, F.concat(F.lit("ip"), F.col("k").cast("string"))).alias("ip")), p.where("k < 60").selectExpr("concat('ip', k) as ip", "concat('c', k div 2) as country", "if(k % 2 = 0, concat('o', k), null) as org").distinct()).drop("ip"))
# Recorded lines as an agent writes them: the payload under its own key, times as text; some lack a field or have a wrong value.
_WIRE = """
case when app = 'click' then concat('{"type":"finding","finding":{"id":"f', ordinal, '","timestamp":"', ts_us div 1000, '","severity":"', if(k < 50, 'warning', 'loud'), '","code":"retransmission"',
  if(k % 4 > 0, ',"summary":"again"', ''), ',"flowId":"Tcp-', flow, '"}}')
else concat('{"type":"connection_update","connection":{"id":"', ordinal, '","protocol":"HTTP","appLayerProtocol":"HTTP","transportProtocol":"TCP","osiStack":"L4","localAddr":"10.0.0.1","localPort":',
  if(k = 5, '"x"', cast(k as string)), ',"remoteAddr":"10.0.0.2","remotePort":80,"processName":"unknown","pid":0,"rxSpeed":0.0,"txSpeed":1.5,', if(k % 4 > 0, concat('"rxBytesTotal":', bytes, ','), ''),
  '"txBytesTotal":', k - 10, ',"packetLoss":0.0,"status":"', if(app = 'error', 'odd', 'ESTABLISHED'), '","encryption":"None","sparkline":[]}}') end as value"""
_on_packets("wire_events", """SELECT CAST(ordinal AS VARCHAR) AS id, CASE WHEN app = 'error' THEN 'unknown' ELSE 'ESTABLISHED' END AS status, CASE WHEN k % 4 > 0 THEN CAST(bytes AS BIGINT) END AS "rxBytesTotal",
  k % 4 = 0 OR bytes < 0 OR k < 10 OR k = 5 AS bad FROM p WHERE app <> 'click'""",
            lambda p: events.parsed(p.selectExpr(_WIRE), "connection_update").select("id", "status", F.col("rxBytesTotal").cast("bigint").alias("rxBytesTotal"), "bad"))
_on_packets("wire_findings", """SELECT 'f' || ordinal AS id, CAST(ts_us // 1000 AS VARCHAR) AS timestamp, CASE WHEN k < 50 THEN 'warning' ELSE 'unknown' END AS severity, 'Tcp-' || flow AS "flowId", k % 4 = 0 AS bad
  FROM p WHERE app = 'click'""", lambda p: events.parsed(p.selectExpr(_WIRE), "finding").select("id", "timestamp", "severity", "flowId", "bad"))

# Ladders and round trips. Rows with k % 11 = 0 are lost, so that indexes have gaps.
_LADDER = f"""{_RING}, x AS (SELECT *, bytes > 0 AND row_number() OVER (PARTITION BY flow, outbound, bytes > 0 ORDER BY idx) = 1 AS opens FROM g WHERE k % 11 > 0),
h AS (SELECT *, k % 7 = 0 OR opens AS hit, coalesce(idx - lag(idx) OVER (PARTITION BY flow ORDER BY idx) - 1, 0) AS gap FROM x),
r AS (SELECT *, sum(CASE WHEN hit OR gap > 0 OR coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY idx) AS run FROM (SELECT *, lag(hit) OVER (PARTITION BY flow ORDER BY idx) AS before FROM h)),
l AS (SELECT *, count(*) OVER (PARTITION BY flow, run) > 4 AS collapsed FROM r),
w AS (SELECT flow, CASE WHEN collapsed THEN 'run' ELSE 'arrow' END AS kind, min(idx) AS start, count(*) AS segments, CAST(sum(bytes) FILTER (outbound) AS BIGINT) AS out_bytes, count(*) FILTER (NOT outbound AND bytes <= 0) AS in_acks
  FROM l GROUP BY flow, run, collapsed, CASE WHEN NOT collapsed THEN idx END UNION ALL SELECT flow, 'gap', idx, gap, NULL, NULL FROM h WHERE gap > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY start, kind <> 'gap') AS p, count(*) OVER (PARTITION BY flow) AS n FROM w)"""
_on_packets("flow_ladder", f"""{_LADDER} SELECT flow, CAST(CASE WHEN n > 20 AND p > 10 THEN p - n + 21 ELSE p END AS INTEGER) AS place, kind, CAST(start AS BIGINT) AS "at", 1::BIGINT AS rows, CAST(segments AS BIGINT) AS segments,
  CASE WHEN kind <> 'gap' THEN coalesce(out_bytes, 0) END AS out_bytes, in_acks FROM n WHERE n <= 20 OR p <= 10 OR p > n - 10
UNION ALL SELECT flow, 11, 'elided', CAST(min(start) AS BIGINT), count(*), CAST(sum(CASE WHEN kind = 'gap' THEN 0 ELSE segments END) AS BIGINT), NULL, NULL FROM n WHERE n > 20 AND p > 10 AND p <= n - 10 GROUP BY flow""",
    lambda p: tcp.ladder(_ring(p).where("k % 11 > 0").withColumnRenamed("bytes", "len"), "flow", F.col("k") % 7 == 0, most=20).select("flow", "place", "kind", "at", "rows", "segments", "out_bytes", "in_acks"))
_on_packets("evicted_flows", f"""{_HOSTS}, i AS (SELECT host, last_us, max(last_us) OVER () AS z FROM h), f AS (SELECT host, last_us FROM h WHERE NOT {DAY0 + 720 * HOUR} - last_us > {HOUR} * (host % 10))
SELECT host, 'idle' AS reason FROM h WHERE {DAY0 + 720 * HOUR} - last_us > {HOUR} * (host % 10) UNION ALL SELECT host, 'capacity' FROM (SELECT host, row_number() OVER (ORDER BY last_us DESC, host) AS r FROM f) WHERE r > 5""",
    lambda p: views.evicted(_hosts(p), "host", DAY0 + 720 * HOUR, HOUR * (F.col("host") % 10), 5))
_on_packets("traces_complete", "SELECT ordinal // 3 AS trace, bool_or(coalesce('ip' || k = 'ip7', false) OR k // 3 >= 30) AS complete FROM p GROUP BY ALL",
            lambda p: views.traces_complete(p.select(F.expr("ordinal div 3").alias("trace"), (F.col("k") / 3).cast("int").alias("hop"), F.concat(F.lit("ip"), F.col("k").cast("string")).alias("ip"), F.lit("ip7").alias("remote")), "trace"))
_on_packets("packets_json", "SELECT ordinal, CAST(to_json({'ordinal': ordinal, 'app': app, 'k': CASE WHEN k > 50 THEN k END, 'outbound': outbound}) AS VARCHAR) AS json FROM p",
            lambda p: views.packets_json(p.select("ordinal", "app", F.when(F.col("k") > 50, F.col("k")).alias("k"), "outbound"), "ordinal"))


def _acked(p: DataFrame) -> DataFrame:
    """Packets as segments of 10 bytes or none, both sides numbering near the wrap; a fold, so without SQL."""
    n = F.col("index")
    s = _ring(p).select("flow", "index", "ordinal", "ts_us", "outbound", ((F.lit(4294967096) + n * 10) % (1 << 32)).alias("seq"), ((F.lit(4294967096) + (n - F.col("k") % 4) * 10) % (1 << 32)).alias("ack"),
                        (F.col("k") % 3 > 0).alias("has_ack"), F.when(F.col("k") % 2 == 0, 10).otherwise(0).cast("bigint").alias("len"), (F.col("k") % 10 == 4).alias("retransmit"))
    return tcp.ack_rtts(s, "flow")


QUERIES["ack_round_trips"] = lambda spark, sf_dir: _acked(read_packets(spark, sf_dir)).select("flow", "ordinal", "rtt_us")
