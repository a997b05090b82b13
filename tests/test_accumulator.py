"""The streamed accumulator against the batch series with late packets apart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from netloom.operators import series
from netloom.streaming import accumulator

KIND = "source string, ordinal long, ts_us long, bytes long, k decimal(20,0), end boolean"


def watched():
    return {"all": F.lit(True), "high": F.col("k") > 50, "never": F.col("k") < 0}


def run(spark, tmp_path, name, rows, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(parts):
        some = rows[part * len(rows) // parts : (part + 1) * len(rows) // parts]
        spark.createDataFrame(some, KIND).coalesce(1).write.parquet(f"{tmp_path}/{name}/p{part}")
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    out = accumulator.accumulate(source, watched(), value=F.col("k"), end=F.col("end"), width_us=100, grace_us=500)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_stream_equals_batch_and_covers_all_time(spark, tmp_path):
    from decimal import Decimal

    rng, rows, now = random.Random(9), [], {"a": 10_000, "b": 50_000}
    for n in range(600):
        src = rng.choice("ab")
        now[src] += rng.choice([0, 3, 40, 90, 700 if rng.random() < 0.1 else 20])
        back = rng.choice([0, 0, 0, 200, 499, 650, 1500])
        rows.append((src, n, now[src] - back, rng.randrange(2**40), Decimal(rng.choice([2**64 - 1, 7, 51, 60])) if rng.random() < 0.8 else None, False))
    ends = [(s, 10_000, None, None, None, True) for s in "ab"]
    given = run(spark, tmp_path, "acc", rows + ends, 5)
    df = spark.createDataFrame(rows, KIND)
    want = series.io_series(series.late_split(df, 100, 500, "source"), watched(), 100, F.col("k"), F.col("late"))
    columns = ["series", "bucket_us", "packets", "bytes", "agg_count", "agg_sum", "agg_min", "agg_max", "late_packets", "late_bytes"]
    text = lambda d: sorted(str([None if x is None else str(x) for x in r]) for r in d.select(*columns).collect())
    assert text(accumulator.totals(given)) == text(want) and given.where("kind = 'late'").count() > 20
    for src in "ab":
        spans = sorted((r["bucket_us"], r["until_us"]) for r in given.where(f"kind = 'covered' and source = '{src}'").collect())
        mine = [r for r in rows if r[0] == src]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert (spans[0][0], spans[-1][1]) == (mine[0][2] // 100 * 100, max(r[2] for r in mine) // 100 * 100 + 100)


def test_open_buckets_wait_for_the_end(spark, tmp_path):
    rows = [("a", 1, 1000, 5, None, False), ("a", 2, 1599, 5, None, False)]
    assert run(spark, tmp_path, "waiting", rows, 1).where("kind = 'bucket'").count() == 0
    closed = run(spark, tmp_path, "closing", [*rows, ("a", 3, 1600, 5, None, False)], 3)
    assert [(r["bucket_us"], r["packets"], r["agg_sum"]) for r in closed.where("kind = 'bucket'").collect()] == [(1000, 1, None)]
    assert run(spark, tmp_path, "only_end", [("a", 1, None, None, None, True)], 1).count() == 0
