"""The test tables as packets, segments, transactions and turns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.display_filter import Field

OUTBOUND = ("click", "purchase")


def cents(x: str) -> Column:
    """round(100 x) of numbers with two decimals, which 100 x meets up to far less than a half; `round` itself would go through decimals row by row."""
    return F.floor(F.col(x) * 100 + 0.5)


def packets(spark: SparkSession, sf_dir: str, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Events as packets. Bounds of time are put to the stored column, so that they reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for sign, bound in ((">=", from_us), ("<", to_us)):
        if bound is not None:
            e = e.where(f"ts {sign} timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=bound)}'")
    return e.select(
        F.col("event_id").alias("ordinal"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("user_id").alias("flow"), F.col("event_type").isin(*OUTBOUND).alias("outbound"),
        F.col("event_type").alias("app"), F.get_json_object("props", "$.k").cast("int").alias("k"), cents("value").alias("bytes"))


PACKETS_SQL = """p AS (SELECT event_id AS ordinal, epoch_us(ts) AS ts_us, user_id AS flow, event_type IN ('click', 'purchase') AS outbound, event_type AS app,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS bytes FROM events)"""

FIELDS = {"frame.len": Field("bytes", "uint"), "app": Field("app", "str"), "k": Field("k", "uint"), "out": Field("outbound", "bool"), "flow": Field("flow", "uint")}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as TCP segments of both directions in a total order; a fifth carry no payload, sequence numbers wrap at 2**32."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(
        F.col("l_orderkey").alias("flow"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("idx"),
        ((F.lit(4293507296) + F.col("l_partkey") * 1460) % (1 << 32)).alias("seq"), F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("len"),
        (F.col("l_suppkey") % 2 == 0).alias("outbound"), cents("l_extendedprice").alias("bytes"), (F.col("l_returnflag") == "R").alias("rst"), (F.col("l_linestatus") == "F").alias("ack"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"))


SEGMENTS_SQL = """s AS (SELECT l_orderkey AS flow, (4293507296 + l_partkey * 1460) % 4294967296 AS seq, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS len,
  l_suppkey % 2 = 0 AS outbound, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, l_returnflag = 'R' AS rst, l_linestatus = 'F' AS ack, epoch_us(l_shipdate) AS ts_us,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem)"""
