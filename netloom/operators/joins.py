"""As-of, range, exactly-once and snapshot joins of traffic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(asked: DataFrame, learned: DataFrame, key: str, value: str, expires: str = "expires_us", order: str = "ordinal") -> DataFrame:
    """asked with `value` as last learned for its key at or before its ts_us, null once expired; of facts of one time that of the highest `order` counts. One shuffle, no pair of rows is made."""
    facts = learned.select(key, "ts_us", F.lit(0).alias("_ask"), F.col(order).alias("_turn"), F.struct(F.col(value).alias("v"), F.col(expires).alias("e")).alias("_fact"))
    both = facts.unionByName(asked.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts_us", "_ask", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("_now", F.last("_fact", ignorenulls=True).over(w)).where("_ask = 1")
    return known.select(*asked.columns, F.when(F.col("_now.e") > F.col("ts_us"), F.col("_now.v")).alias(value))


DIGIT = 16


def _aligned(low: Column, high: Column) -> Column:
    """array<struct<level, cell>>: a range as blocks of DIGIT ** level numbers that start at a multiple of it, at most 30 of each level."""
    cells = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    def step(held: Column, level: Column) -> Column:
        a, b = held["a"], held["b"]
        up = F.least(b, a + F.pmod(-a, F.lit(DIGIT)))
        down = F.greatest(up, b - F.pmod(b, F.lit(DIGIT)))
        whole = F.concat(held["blocks"], cells(level, a, up), cells(level, down, b))
        shrunk = lambda c: F.when(up < down, F.shiftright(c, 4)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(shrunk(up).alias("a"), shrunk(down).alias("b"), whole.alias("blocks"))

    start = F.struct(low.cast("bigint").alias("a"), (high.cast("bigint") + 1).alias("b"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), start, step, lambda held: held["blocks"])


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, order: str, value: str) -> DataFrame:
    """points with the value of the first range (smallest `order`) that holds them, else null.

    A range of any width becomes a few aligned blocks at the levels of a grid of powers of 16, so the join is one of equal
    level and cell, with no pair that does not hit: a range over all addresses is one row. Equal points are looked up once,
    at the levels that the ranges use. Numbers from 0 to 2**62; ranges that end before they begin hold nothing.
    """
    dealt = ranges.where(f"`{low}` <= `{high}`").select(F.explode(_aligned(F.col(low), F.col(high))).alias("_b"), F.col(order).alias("_order"), F.col(value).alias("_value")).select("_b.*", "_order", "_value")
    dealt = dealt.groupBy("level", "cell").agg(F.min("_order").alias("_order"), F.min_by("_value", "_order").alias("_value"))  # a block's other ranges answer no point
    levels = F.broadcast(dealt.agg(F.collect_set("level").alias("_levels")))  # one row of 16 numbers at most
    asked = points.select(F.col(point).cast("bigint").alias("_p")).where("_p is not null").distinct().crossJoin(levels).select("_p", F.explode("_levels").alias("level"))
    asked = asked.withColumn("cell", F.expr("shiftright(_p, 4 * level)"))
    hits = asked.join(dealt, ["level", "cell"]).groupBy("_p").agg(F.min_by("_value", "_order").alias(value))
    return points.join(hits, points[point].cast("bigint") == hits["_p"], "left").drop("_p")


def spans_touching(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of half-open spans (from_us, to_us) of one key that overlap; a span of no length touches the one that holds it."""
    a, b = left.alias("a"), right.alias("b")
    empty = F.col("a.from_us") == F.col("a.to_us")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.from_us") < F.col("b.to_us")) & ((F.col("b.from_us") < F.col("a.to_us")) | empty & (F.col("b.from_us") <= F.col("a.from_us")))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), *[F.col(f"a.{c}").alias(f"left_{c}") for c in ("from_us", "to_us")], *[F.col(f"b.{c}").alias(f"right_{c}") for c in ("from_us", "to_us")])


def unique_links(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Keys that stand exactly once on both sides, with both ids; null keys link nothing."""
    once = lambda d, i, name: d.dropna(subset=keys).groupBy(*keys).agg(F.min(i).alias(name), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return once(left, left_id, "left_id").join(once(right, right_id, "right_id"), keys)


def first_finding(rows: DataFrame, findings: DataFrame, key: str, order: str, code: str = "code") -> DataFrame:
    """rows with the code of their key's first finding."""
    return rows.join(findings.groupBy(key).agg(F.min_by(code, order).alias("finding")), key, "left")


def carry_forward(now: DataFrame, before: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new snapshot; columns it lacks a value for keep the previous one's."""
    old = before.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    return now.join(old, key, "left").select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in columns else F.col(c) for c in now.columns])


def unmatched_responses(matched: DataFrame, packets: DataFrame, response: Column) -> DataFrame:
    """Responses that answer no request."""
    used = matched.where("resp_ordinal is not null").select(F.col("resp_ordinal").alias("ordinal"))
    return packets.where(response).join(used, "ordinal", "left_anti")


def longest_prefix(points: DataFrame, services: DataFrame, point: str, value: str) -> DataFrame:
    """points with the value of the narrowest block that holds them. services: low, high, value."""
    sized = services.select("low", "high", (F.col("high") - F.col("low")).alias("_width"), value)
    return in_range(points, sized, point, "low", "high", "_width", value)


def hop_places(hops: DataFrame, places: DataFrame) -> DataFrame:
    """hops (connection, hop, ip) with the country and organisation of their address; hops that gave no address keep nulls."""
    return hops.join(places.select("ip", "country", "org"), "ip", "left").select("connection", "hop", "ip", "country", "org")
