"""History of a series in three tiers: counts and coverage at 100 ms for 15 minutes, at a second for an hour, at a minute for a day.

Messages carry a set of series by (epoch, revision). Only the newest epoch's newest revision counts; a message that repeats
time already covered adds nothing for it. Time is told apart as measured (zeros included), not observed, and unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a slot and slots kept, by tier; points of a chart; samples kept and those of the head.
TIERS = {100: 9000, 1000: 3600, 60_000: 1440}
RING_OF = {100: 100, 1000: 1000, 10_000: 1000, 60_000: 60_000}
POINTS, SAMPLES, HEAD = 2000, 4096, 16


def current(messages: DataFrame, source: str = "source") -> DataFrame:
    """Messages (source, ordinal, epoch, revision, from_ms, to_ms) that belong to the newest set, with `fresh_ms`: where the time that no earlier one covers begins.

    A new epoch starts anew; within one, revisions only go forward, and what is left of an older one is dropped.
    """
    newest = messages.groupBy(source).agg(F.max_by("epoch", "ordinal").alias("_epoch"))
    held = messages.join(newest, source).where(F.col("epoch") == F.col("_epoch")).drop("_epoch")
    last = held.groupBy(source).agg(F.max("revision").alias("_revision"))
    held = held.join(last, source).where(F.col("revision") == F.col("_revision")).drop("_revision")
    before = F.max("to_ms").over(Window.partitionBy(source).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("fresh_ms", F.greatest("from_ms", F.coalesce(before, F.col("from_ms"))))


def _slots(spans: DataFrame, source: str, start: Column, stop: Column, step: int) -> DataFrame:
    """One row for each slot that a span meets, with the ms of the slot inside it."""
    first, last = F.floor(start / F.lit(step)).cast("bigint"), F.floor((stop - 1) / F.lit(step)).cast("bigint")
    at = spans.where(stop > start).select("*", start.alias("_a"), stop.alias("_b"), F.explode(F.sequence(first, last)).alias("slot"))
    inside = F.least(F.col("_b"), (F.col("slot") + 1) * step) - F.greatest(F.col("_a"), F.col("slot") * step)
    return at.withColumn("ms", inside)


def tiers(messages: DataFrame, counts: DataFrame, unseen: DataFrame, source: str = "source") -> DataFrame:
    """(source, tier_ms, series, start_ms, packets, bytes, late_packets, late_bytes, covered_ms, unseen_ms, reason): what each tier still holds.

    messages as for `current`; counts: source, ordinal (of their message), series, start_ms, packets, bytes, late; unseen: source,
    ordinal, from_ms, to_ms, reason. A tier drops a slot once its newest one is as many slots on as it keeps; that is decided
    by time alone, for all series. Slots without counts are there as zeros, for the series '' that stands for time itself.
    """
    now = current(messages, source).select(source, "ordinal", "fresh_ms", "to_ms", "from_ms")
    told = counts.join(now.select(source, "ordinal", "fresh_ms"), [source, "ordinal"]).where("late or start_ms >= fresh_ms")
    hidden = unseen.join(now.select(source, "ordinal"), [source, "ordinal"])
    out = []
    for step, kept in TIERS.items():
        each = lambda late, c: F.coalesce(F.sum(F.when(F.col("late") == F.lit(late), F.col(c))), F.lit(0)).cast("bigint")
        sums = told.groupBy(source, "series", F.floor(F.col("start_ms") / F.lit(step)).cast("bigint").alias("slot")).agg(
            each(False, "packets").alias("packets"), each(False, "bytes").alias("bytes"), each(True, "packets").alias("late_packets"), each(True, "bytes").alias("late_bytes"))
        seen = _slots(now, source, F.col("fresh_ms"), F.col("to_ms"), step).groupBy(source, "slot").agg(F.sum("ms").alias("covered_ms"))
        gaps = _slots(hidden, source, F.col("from_ms"), F.col("to_ms"), step).groupBy(source, "slot").agg(F.sum("ms").alias("unseen_ms"), F.max_by("reason", "ordinal").alias("reason"))
        clock = seen.join(gaps, [source, "slot"], "full").select(source, "slot", F.coalesce("covered_ms", F.lit(0)).alias("covered_ms"), F.coalesce("unseen_ms", F.lit(0)).alias("unseen_ms"), "reason")
        rows = sums.unionByName(clock.withColumn("series", F.lit("")), allowMissingColumns=True)
        newest = F.max("slot").alias("_newest")
        rows = rows.join(rows.groupBy(source).agg(newest), source).where(F.col("slot") > F.col("_newest") - kept)
        out.append(rows.select(source, F.lit(step).alias("tier_ms"), "series", (F.col("slot") * step).alias("start_ms"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("packets", "bytes", "late_packets", "late_bytes", "covered_ms", "unseen_ms")], "reason"))
    return reduce(DataFrame.unionByName, out)


def points(held: DataFrame, series: str, interval_ms: int, from_ms: int, to_ms: int, source: str = "source") -> DataFrame:
    """(source, start_ms, state, packets, bytes, late_packets, unseen_ms, reason) of one series over a range, at most POINTS points, the newest.

    state: `notObserved` where any of the interval was not observed, `value` where all of it is covered, else `unknown`. Only a
    value has counts; late packets count in any state.
    """
    last = (to_ms - 1) // interval_ms * interval_ms
    first = max(from_ms // interval_ms * interval_ms, last - (POINTS - 1) * interval_ms)
    ring = held.where((F.col("tier_ms") == RING_OF[interval_ms]) & F.col("series").isin("", series) & (F.col("start_ms") >= first) & (F.col("start_ms") < last + interval_ms))
    at = (F.col("start_ms") - F.pmod(F.col("start_ms"), F.lit(interval_ms))).alias("start_ms")
    sums = ring.groupBy(source, at).agg(*[F.sum(c).alias(c) for c in ("packets", "bytes", "late_packets", "covered_ms", "unseen_ms")], F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("start_ms"))).alias("reason"))
    spine = held.select(source).distinct().withColumn("start_ms", F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (first, last, interval_ms)]))) if to_ms > from_ms else held.select(source, F.lit(0).cast("bigint").alias("start_ms")).limit(0)
    state = F.when(F.col("unseen_ms") > 0, "notObserved").when(F.col("covered_ms") >= interval_ms, "value").otherwise("unknown")
    whole = spine.join(sums, [source, "start_ms"], "left").withColumn("state", state)
    shown = lambda c: F.when(F.col("state") == "value", F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return whole.select(source, "start_ms", "state", shown("packets"), shown("bytes"), F.coalesce("late_packets", F.lit(0)).alias("late_packets"), F.coalesce("unseen_ms", F.lit(0)).alias("unseen_ms"), "reason")


def merged_pages(pages: DataFrame, key: str, samples: int = SAMPLES, head: int = HEAD) -> DataFrame:
    """Sample rows (key, page, generation, index, ...) as a reader holds them after all pages of its flow, in order of `page`.

    A page of another generation than the one before starts anew. Of one index the newest page counts, and a page replaces all
    from its first index on. The newest `samples` stay, and of the first `head` indexes those that came.
    """
    by = Window.partitionBy(key).orderBy("page")
    firsts = pages.groupBy(key, "page", "generation").agg(F.min("index").alias("_first"))
    turned = F.coalesce((F.col("generation") != F.lag("generation").over(by)).cast("int"), F.lit(0))
    firsts = firsts.withColumn("_era", F.sum(turned).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = Window.partitionBy(key)
    firsts = firsts.withColumn("_newest", F.max("_era").over(last)).where("_era = _newest")
    later = F.min("_first").over(by.rowsBetween(1, Window.unboundedFollowing))
    firsts = firsts.withColumn("_cut", later)
    held = pages.join(firsts.select(key, "page", "_cut"), [key, "page"]).where(F.col("_cut").isNull() | (F.col("index") < F.col("_cut")) | (F.col("index") < head))
    one = Window.partitionBy(key, "index").orderBy(F.desc("page"))
    rows = held.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r", "_cut")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("index")))
    return rows.withColumn("_p", place).where((F.col("_p") <= samples) | (F.col("index") < head)).drop("_p")
