"""Time-bucket series: all series of a set are counted in one pass over the packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts_us: Column, width_us: int) -> Column:
    return (F.floor(ts_us / F.lit(width_us)) * width_us).cast("bigint")


def io_series(packets: DataFrame, series: dict[str, Column], width_us: int, value: Column | None = None, late: Column | None = None) -> DataFrame:
    """(series, bucket_us, packets, bytes, agg_count, agg_sum, agg_min, agg_max), only buckets with a match.

    All series are summed in one row of the bucket and unpivoted after the shuffle. With `late` (see `late_split`) late
    packets never join on-time counts; they come in `late_packets` and `late_bytes`.
    """
    given = {"packets": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast("bigint"), "agg_count": F.lit(0).cast("bigint"), "agg_sum": F.lit(None).cast("decimal(38,0)"), "agg_min": F.lit(None).cast("bigint"), "agg_max": F.lit(None).cast("bigint"),
             "late_packets": F.lit(0).cast("bigint"), "late_bytes": F.lit(0).cast("bigint")}
    rows = packets.select(bucket(F.col("ts_us"), width_us).alias("bucket_us"), "bytes", *([] if value is None else [value.alias("v")]), *([] if late is None else [late.alias("late")]), *[p.alias(f"p{i}") for i, p in enumerate(series.values())])
    # Values of 32 bits add up in 64; wider ones in decimals. What nobody asked for is not computed.
    narrow = value is not None and rows.schema["v"].dataType.simpleString() in ("tinyint", "smallint", "int")
    sums: dict[str, Column] = {}
    for i in range(len(series)):
        hit = F.col(f"p{i}") if late is None else F.col(f"p{i}") & ~F.col("late")
        sums |= {f"packets{i}": F.count_if(hit), f"bytes{i}": F.coalesce(F.sum(F.when(hit, F.col("bytes"))), F.lit(0))}
        if value is not None:
            x = F.when(hit, F.col("v"))
            sums |= {f"agg_count{i}": F.count(x), f"agg_sum{i}": F.sum(x if narrow else x.cast("decimal(20,0)")), f"agg_min{i}": F.min(x), f"agg_max{i}": F.max(x)}
        if late is not None:
            missed = F.col(f"p{i}") & F.col("late")
            sums |= {f"late_packets{i}": F.count_if(missed), f"late_bytes{i}": F.coalesce(F.sum(F.when(missed, F.col("bytes"))), F.lit(0))}
    names = list(given) if late is not None else list(given)[:-2]
    wide = lambda name: {"agg_sum": "decimal(38,0)"}.get(name, "bigint" if narrow and name.startswith("agg_m") else None)
    said = lambda name, i: given[name] if f"{name}{i}" not in sums else F.col(f"{name}{i}").cast(wide(name)) if wide(name) else F.col(f"{name}{i}")
    one = [F.struct(F.lit(name).alias("series"), *[said(c, i).alias(c) for c in names]) for i, name in enumerate(series)]
    out = rows.groupBy("bucket_us").agg(*[c.alias(n) for n, c in sums.items()]).select("bucket_us", F.explode(F.array(*one)).alias("s"))
    out = out.where("s.packets > 0" if late is None else "s.packets > 0 or s.late_packets > 0")
    return out.select("s.series", "bucket_us", *[F.col(f"s.{c}").alias(c) for c in names])


def roll_up(series: DataFrame, width_us: int) -> DataFrame:
    """Coarser buckets by exact sums; the mean is the sum of sums over the sum of counts."""
    out = series.groupBy("series", bucket(F.col("bucket_us"), width_us).alias("bucket_us")).agg(*[F.sum(c).alias(c) for c in ("packets", "bytes", "agg_count")], F.sum("agg_sum").alias("agg_sum"), F.min("agg_min").alias("agg_min"), F.max("agg_max").alias("agg_max"))
    return out.withColumn("agg_avg", F.when(F.col("agg_count") > 0, F.col("agg_sum").cast("double") / F.col("agg_count")))


def late_split(packets: DataFrame, width_us: int, grace_us: int, source: str | None = None) -> DataFrame:
    """packets with `late`: the bucket lies before that of the first packet and of the newest earlier one less the grace.

    The order is that of capture, so each source is one sequence; sources run side by side.
    """
    by = Window.partitionBy(source if source else F.lit(0)).orderBy("ordinal")
    newest = F.max("ts_us").over(by.rowsBetween(Window.unboundedPreceding, -1))
    floor = F.greatest(bucket(F.first("ts_us").over(by), width_us), bucket(newest - grace_us, width_us))
    return packets.withColumn("late", F.coalesce(bucket(F.col("ts_us"), width_us) < floor, F.lit(False)))
