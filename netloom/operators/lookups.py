"""Lookup tables beside the traffic: local processes, vendors, fingerprint names, the enrichment cache and its query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.network import mac_prefix

#: Fixed value: days that queries are kept.
LOG_DAYS = 30
DAY_MS = 86_400_000


def processes(listing: DataFrame, line: str = "value", order: str = "ordinal") -> DataFrame:
    """(local_port, pid, process) from the lines of a socket listing (command, pid, ..., local->remote in the ninth column).

    Heads and lines of other shapes fall out; of a port that stands more than once the last line counts.
    """
    words = F.filter(F.split(F.col(line), r"\s+"), lambda w: w != "")
    rows = listing.select(words.alias("w"), F.col(order).alias("_o")).where(F.size("w") >= 9)
    port = F.element_at(F.split(F.split_part(F.get("w", F.lit(8)), F.lit("->"), F.lit(1)), ":"), -1)
    whole = lambda c, most: F.when(c.rlike("^[+]?[0-9]{1,10}$"), c.try_cast("bigint"))  # noqa: E731, ARG005
    said = rows.select(whole(port, 65535).alias("local_port"), whole(F.get("w", F.lit(1)), 2**32).alias("pid"), F.get("w", F.lit(0)).alias("process"), "_o")
    held = said.where("local_port between 0 and 65535 and pid between 0 and 4294967295")
    last = held.groupBy("local_port").agg(F.max_by(F.struct("pid", "process"), "_o").alias("p"))
    return last.select(F.col("local_port").cast("int"), F.col("p.pid").alias("pid"), F.col("p.process").alias("process"))


def vendors(rows: DataFrame, assignments: DataFrame, mac: str = "mac") -> DataFrame:
    """rows with `vendor`, by the assignment of the first 24 bits of an address. assignments: prefix, vendor."""
    return rows.withColumn("prefix", mac_prefix(F.col(mac))).join(assignments.select("prefix", "vendor"), "prefix", "left").drop("prefix")


def fingerprints(rows: DataFrame, labels: DataFrame, mark: str = "ja3") -> DataFrame:
    """rows with `ja3_label`, where the table of known fingerprints (ja3, label) names theirs."""
    return rows.join(labels.select(F.col("ja3").alias(mark), F.col("label").alias("ja3_label")), mark, "left")


def cached(cache: DataFrame, learned: DataFrame) -> DataFrame:
    """The enrichment cache (key, record, expires_ms, place) after `learned` (the same columns): a key's newest entry counts, and keeps the place of its first."""
    both = cache.select("key", "record", "expires_ms", "place", F.lit(0).alias("_new")).unionByName(learned.select("key", "record", "expires_ms", "place", F.lit(1).alias("_new")))
    return both.groupBy("key").agg(F.max_by(F.struct("record", "expires_ms"), F.struct("_new", "place")).alias("e"), F.min(F.struct("_new", "place")).alias("_first")).select(
        "key", "e.record", "e.expires_ms", F.col("_first.place").alias("place"))


def fresh(cache: DataFrame, now_ms: int) -> DataFrame:
    """Entries that have not expired, negative ones (a null record) too."""
    return cache.where(F.col("expires_ms") > now_ms)


def pruned(log: DataFrame, now_ms: int, days: int = LOG_DAYS) -> DataFrame:
    """The query log without what is older than `days`."""
    return log.where(F.col("at_ms") >= now_ms - days * DAY_MS)
