"""Queries over the flow table and over captures that are written and read back, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators import follow, history
from netloom.plans import traffic
from netloom.plans.model import PACKETS_SQL, packets
from netloom.plans.queries import ORACLE_SQL, QUERIES
from netloom.sources import capture_files
from netloom.streaming import flows

__all__ = ["ORACLE_SQL", "QUERIES"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only a local master does without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets whose flags make flows of every status; time runs 400 times as fast, so that all idle times matter."""
    p, k, app = packets(spark, sf_dir), F.col("k"), F.col("app")
    rows = p.select(
        F.col("flow").cast("string").alias("flow"), "ordinal", F.floor(F.col("ts_us") / F.lit(400)).alias("ts_us"), "outbound", "bytes", (F.col("flow") % 3 > 0).alias("tcp"), (app == "signup").alias("syn"),
        app.isin("view", "click").alias("ack"), ((app == "purchase") & (k < 20)).alias("fin"), ((app == "error") & (k < 10)).alias("rst"), (k * 100).alias("seq"), (k % 2 * 10).alias("size"),
        F.when(k >= 90, "HTTP").alias("app"), F.when(F.col("flow") % 2 == 0, "DNS").alias("port_app"))
    return flows.instances(rows).select("flow", "first_us", "last_us", "tx_bytes", "rx_bytes", "packets", "status", "app", "closed")


QUERIES["flow_table"] = flow_table
ORACLE_SQL["flow_table"] = f"""WITH RECURSIVE {PACKETS_SQL}, q AS (SELECT flow, ordinal, ts_us // 400 AS t, outbound, bytes, k, flow % 3 > 0 AS tcp, app = 'signup' AS syn, app IN ('view', 'click') AS ack,
  app = 'purchase' AND k < 20 OR app = 'error' AND k < 10 AS ended, app = 'error' AND k < 10 AS rst, row_number() OVER (PARTITION BY flow ORDER BY ordinal) AS i FROM p),
w AS (SELECT flow, i, 1 AS inst, t, tcp, CASE WHEN tcp THEN syn AND NOT ack ELSE false END AS syn, tcp AND ack AND NOT rst AS up, tcp AND ended AS ended FROM q WHERE i = 1
  UNION ALL SELECT flow, i, inst, t, tcp, tcp AND (syn OR had_syn), tcp AND NOT rst AND (ack OR had_up), tcp AND (ended OR had_end) FROM (
    SELECT q.flow, q.i, q.t, q.tcp, q.syn, q.ack, q.rst, q.ended, CASE WHEN late THEN inst + 1 ELSE inst END AS inst, NOT late AND w.syn AS had_syn, NOT late AND w.up AS had_up, NOT late AND w.ended AS had_end
    FROM (SELECT *, CASE WHEN ended THEN 120000 WHEN up OR NOT tcp AND NOT syn THEN CASE WHEN tcp THEN 1800000 ELSE 60000 END WHEN syn THEN 30000 ELSE 120000 END AS idle FROM w) AS w
    JOIN q ON q.flow = w.flow AND q.i = w.i + 1, LATERAL (SELECT q.t // 1000 - w.t // 1000 > w.idle AS late))),
e AS (SELECT w.*, q.outbound, q.bytes, q.k, max(inst) OVER (PARTITION BY w.flow) AS newest FROM w JOIN q ON q.flow = w.flow AND q.i = w.i)
SELECT CAST(flow AS VARCHAR) AS flow, min(t) AS first_us, max(t) AS last_us, CAST(coalesce(sum(bytes) FILTER (outbound), 0) AS BIGINT) AS tx_bytes, CAST(coalesce(sum(bytes) FILTER (NOT outbound), 0) AS BIGINT) AS rx_bytes, count(*) AS packets,
  CASE WHEN arg_max(ended, i) THEN 'TIME_WAIT' WHEN arg_max(up, i) OR NOT any_value(tcp) THEN 'ESTABLISHED' WHEN arg_max(syn, i) THEN 'SYN_SENT' ELSE 'CLOSE_WAIT' END AS status,
  CASE WHEN bool_or(k >= 90) THEN 'HTTP' WHEN flow % 2 = 0 THEN 'DNS' ELSE 'Unknown' END AS app, inst < any_value(newest) AS closed FROM e GROUP BY flow, inst"""


def capture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames written as rotating captures and read back in splits."""
    folder = shared_folder(spark, "captures")
    capture_files.write(traffic.frames(spark, sf_dir).repartition("flow").sortWithinPartitions("ts_ns"), folder, maxPackets=20_000)
    back = capture_files.read(spark, folder, 1 << 20)
    # A small file of events is many frames, which must not go through the driver: hence the hint.
    return back.select("ts_ns", "direction", "link_type", "cap_len", "wire_len", F.md5("frame").alias("digest")).join(
        traffic.frames(spark, sf_dir).select("ordinal", "ts_ns", F.md5("frame").alias("digest")).hint("merge"), ["ts_ns", "digest"]).select("ordinal", "ts_ns", "direction", "link_type", "wire_len")


QUERIES["capture_round_trip"] = capture_round_trip
ORACLE_SQL["capture_round_trip"] = f"""WITH {PACKETS_SQL} SELECT ordinal, ts_us * 1000 AS ts_ns, CASE WHEN outbound THEN 'outbound' ELSE 'inbound' END AS direction, 1 AS link_type,
  14 + 20 + CASE app WHEN 'view' THEN 8 + 31 + length('' || flow) WHEN 'purchase' THEN 8 + 47 + length('' || flow) WHEN 'click' THEN 20 + 32 + length('' || k || ordinal)
    WHEN 'error' THEN 20 + 70 + length('' || bytes) ELSE 28 + 90 + length('' || flow) END AS wire_len FROM p"""


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as TCP flows: a handshake, each turn with a header, a cookie and its text, and a FIN each way.

    Of each side two segments at a time arrive in the wrong order; every fifth conversation loses the first answer.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("outbound", F.coalesce(F.col("role") != "assistant", F.lit(True)))
    data = F.concat(F.lit("X-Turn: "), F.col("turn").cast("string"), F.lit("\r\nCookie: c"), F.col("turn").cast("string"), F.lit("\r\n"), F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")
    side = Window.partitionBy("conv_id", "outbound").orderBy("turn")
    size = F.octet_length("payload")
    d = c.withColumn("payload", data).withColumns({
        "seq": F.lit(4294967000) + 1 + F.coalesce(F.sum(size).over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.row_number().over(side), "all": F.sum(size).over(Window.partitionBy("conv_id", "outbound"))})
    kept = d.where("not (conv_id % 5 = 0 and not outbound and n = 1)")
    base = lambda rows, seq, ordinal, payload, syn, fin: rows.select(
        F.col("conv_id").alias("flow"), "outbound", F.lit(ordinal).cast("bigint").alias("ordinal") if isinstance(ordinal, int) else ordinal.cast("bigint").alias("ordinal"), F.pmod(seq, F.lit(1 << 32)).cast("bigint").alias("seq"), payload.alias("payload"),
        F.lit(syn).alias("syn"), F.lit(fin).alias("fin"))
    sides = d.groupBy("conv_id", "outbound").agg(F.max("all").alias("all"))
    none = F.lit(b"")
    swapped = F.col("n") + F.when(F.col("n") % 2 == 1, 1).otherwise(-1)
    rows = base(sides, F.lit(4294967000), 0, none, True, False).union(base(kept, F.col("seq"), swapped * 2 + F.col("outbound").cast("int") + 10, F.col("payload"), False, False))
    rows = rows.union(base(sides, F.lit(4294967001) + F.col("all"), 1 << 40, none, False, True))
    order = F.when(F.col("outbound"), 0).otherwise(1)
    return rows.select("flow", "outbound", (F.col("ordinal") * 2 + order).alias("ordinal"), F.col("ordinal").alias("clock_ms"), "seq", F.lit(0).cast("bigint").alias("ack"), "payload", "syn", (F.col("syn") & ~F.col("outbound")).alias("ack_flag"), "fin", F.lit(False).alias("rst"))


def followed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = follow.streams(conversation_segments(spark, sf_dir)).withColumn("s", follow.shown())
    return rows.select("flow", "side", F.octet_length("data").cast("bigint").alias("bytes"), F.md5("s.data").alias("digest"), F.size("s.masks").alias("masks"), F.size("gaps").alias("gaps"), F.get("gaps", F.lit(0))["missing"].alias("missing"), "closed")


QUERIES["followed_streams"] = followed_streams
ORACLE_SQL["followed_streams"] = """WITH c AS (SELECT conv_id, turn, coalesce(role <> 'assistant', true) AS out, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id, coalesce(role <> 'assistant', true) ORDER BY turn) AS n FROM conversations),
t AS (SELECT *, 'X-Turn: ' || turn || chr(13) || chr(10) AS h, 'Cookie: c' || turn || chr(13) || chr(10) || text || chr(10) AS b, NOT out AND conv_id % 5 = 0 AS lossy FROM c),
k AS (SELECT conv_id, out, lossy, n, octet_length(encode(h || b)) AS size, CASE WHEN lossy AND n = 2 THEN repeat('*', length(h) - 1) || chr(10) ELSE h END
  || 'Cookie: ' || repeat('*', length('c' || turn)) || chr(13) || chr(10) || text || chr(10) AS said FROM t),
g AS (SELECT conv_id, out, lossy, coalesce(sum(size) FILTER (NOT (lossy AND n = 1)), 0) AS bytes, coalesce(string_agg(said, '' ORDER BY n) FILTER (NOT (lossy AND n = 1)), '') AS said, count(*) AS turns, max(size) FILTER (n = 1) AS first FROM k GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS flow, CASE WHEN out THEN 'c2s' ELSE 's2c' END AS side, CAST(bytes AS BIGINT) AS bytes, md5(said) AS digest, CAST(CASE WHEN lossy THEN greatest(0, (turns - 1) + CASE WHEN turns > 1 THEN 1 ELSE 0 END) ELSE turns END AS INTEGER) AS masks,
  CAST(CASE WHEN lossy AND turns > 1 THEN 1 ELSE 0 END AS INTEGER) AS gaps, CASE WHEN lossy AND turns > 1 THEN first END AS missing, NOT (lossy AND turns = 1) AS closed FROM g
UNION ALL SELECT CAST(conv_id AS VARCHAR), 's2c', 0, md5(''), 0, 0, NULL, false FROM g GROUP BY conv_id HAVING count(*) = 1 AND bool_and(out)
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'c2s', 0, md5(''), 0, 0, NULL, false FROM g GROUP BY conv_id HAVING count(*) = 1 AND NOT bool_or(out)"""


_FROM, _TO = 1_704_067_200, 1_705_067_200


def series_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a second as a millisecond: a message an hour covers it, every tenth hour hides its first half second, every seventh packet is late."""
    p = packets(spark, sf_dir).withColumn("ms", F.floor(F.col("ts_us") / F.lit(1_000_000)).cast("bigint")).withColumn("hour", F.floor(F.col("ms") / F.lit(3600)).cast("bigint"))
    hours = p.select("hour").distinct()
    messages = hours.select(F.lit("s").alias("source"), F.col("hour").alias("ordinal"), F.lit("e").alias("epoch"), F.lit(1).cast("bigint").alias("revision"), (F.col("hour") * 3600).alias("from_ms"), (F.col("hour") * 3600 + 3600).alias("to_ms"))
    counts = p.select(F.lit("s").alias("source"), F.col("hour").alias("ordinal"), F.lit("all").alias("series"), (F.col("ms") - F.col("ms") % 100).alias("start_ms"), F.lit(1).cast("bigint").alias("packets"), "bytes", (F.col("k") % 7 == 0).alias("late"))
    unseen = messages.where("ordinal % 10 = 0").select("source", "ordinal", "from_ms", (F.col("from_ms") + 500).alias("to_ms"), F.lit("backlog").alias("reason"))
    held = history.tiers(messages, counts.where("late is not null"), unseen)
    return history.points(held, "all", 10_000, _FROM, _TO).drop("source")


QUERIES["series_history"] = series_history
ORACLE_SQL["series_history"] = f"""WITH {PACKETS_SQL}, e AS (SELECT *, ts_us // 1000000 AS ms FROM p WHERE k IS NOT NULL), h AS (SELECT DISTINCT ts_us // 1000000 // 3600 AS h FROM p),
i AS (SELECT unnest(range({_FROM} // 10000 * 10000, {_TO}, 10000)) AS a),
c AS (SELECT a, sum(greatest(0, least(a + 10000, h * 3600 + 3600) - greatest(a, h * 3600))) AS covered,
  sum(CASE WHEN h % 10 = 0 THEN greatest(0, least(a + 10000, h * 3600 + 500) - greatest(a, h * 3600)) ELSE 0 END) AS unseen FROM i JOIN h ON h * 3600 < a + 10000 AND h * 3600 + 3600 > a GROUP BY a),
n AS (SELECT (ms - ms % 100) // 10000 * 10000 AS a, count(*) FILTER (k % 7 > 0) AS packets, sum(bytes) FILTER (k % 7 > 0) AS bytes, count(*) FILTER (k % 7 = 0) AS late FROM e GROUP BY 1),
s AS (SELECT a, CASE WHEN unseen > 0 THEN 'notObserved' WHEN covered >= 10000 THEN 'value' ELSE 'unknown' END AS state, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes, coalesce(late, 0) AS late, coalesce(unseen, 0) AS unseen
  FROM i LEFT JOIN c USING (a) LEFT JOIN n USING (a))
SELECT a AS start_ms, state, CASE WHEN state = 'value' THEN packets ELSE 0 END AS packets, CAST(CASE WHEN state = 'value' THEN bytes ELSE 0 END AS BIGINT) AS bytes, late AS late_packets, CAST(unseen AS BIGINT) AS unseen_ms,
  CASE WHEN unseen > 0 THEN 'backlog' END AS reason FROM s"""
