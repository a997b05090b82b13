"""What grows with the tables: which rows and columns travel to Python, into one task, or meet in a join."""

from pyspark.sql import functions as F

from netloom.operators import joins, transactions
from netloom.operators.folds import fold
from netloom.plans import stateful, traffic
from netloom.sources import captures

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_settled_rows_stay_in_the_jvm(spark):
    rows = spark.range(3).select("id", F.when(F.col("id") > 0, F.col("id") * 7).alias("a b"), F.array("id").alias("c"))
    held = captures.settled(rows)
    assert held.schema.names == rows.schema.names and [tuple(r) for r in held.orderBy("id").collect()] == [(0, None, [0]), (1, 7, [1]), (2, 14, [2])]
    plan = _plan(held.where("`a b` > 7 and `a b` < 20"))
    assert "MapInArrow" not in plan and plan.count("* 7") == 1  # nor is the expression repeated


def test_equal_blocks_meet_points_once(spark):
    ranges = spark.range(500).selectExpr("0L as low", "99L as high", "id + 5 as place", "concat('v', id) as v")
    out = joins.in_range(spark.range(200).select(F.col("id").alias("p")), ranges, "p", "low", "high", "place", "v")
    assert {(r.p, r.v) for r in out.collect()} == {(i, "v0" if i < 100 else None) for i in range(200)}
    assert "Aggregate [level#" in _plan(out)


def test_sweep_clock_orders_time_and_place_only(spark):
    rows = spark.range(300).selectExpr("if(id % 50 = 0, null, id % 3) as source", "id as ordinal", "id * 70000 + id % 7 * 90000 as ts_us", "repeat('x', 50) as payload")
    out = transactions.sweep_clock(rows)
    want, at = {}, {}
    for r in rows.orderBy("ordinal").collect():
        want[r.ordinal] = None if r.source is None else at.get(r.source)
        if r.source is not None and (r.source not in at or r.ts_us - at[r.source] >= transactions.SWEEP_US):
            at[r.source] = r.ts_us
    assert {r.ordinal: r.swept_us for r in out.collect()} == want and out.columns == [*rows.columns, "swept_us"]
    folds = [line for line in _plan(out).splitlines() if "MapInArrow" in line]
    assert len(folds) == 1 and "payload" not in folds[0]


def test_rejoined_datagrams_fold_what_they_need(spark):
    folds = [line for line in _plan(traffic.rejoined_datagrams(spark, SF)).splitlines() if "MapInArrow" in line]
    assert len(folds) == 1 and "window" not in folds[0] and "wscale" not in folds[0]


def test_captures_meet_their_frames_without_a_broadcast(spark):
    plan = stateful.capture_round_trip(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_desegmented_folds_and_returns_what_is_read(spark):
    plan = _plan(traffic.QUERIES["desegmented_http"](spark, SF))
    mapped = [line for line in plan.splitlines() if "MapInArrow" in line]
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(mapped) == len(dealt) == 1 and "k#" not in dealt[0] and "payload#" not in mapped[0].rpartition("[")[2]


def test_fold_keeps_chosen_columns_and_exact_values(spark):
    rows = spark.range(200).selectExpr("if(id % 9 = 0, null, id % 5) as key", "id as at", "if(id % 2 = 0, null, 1152921504606846976 + id) as big", "9007199254740993 + id as whole", "id % 3 = 0 as flag", "'x' as lost")
    step = lambda state, r: f"{r['big']} {r['whole']} {r['flag']}"
    out = fold(rows, "key", ["at"], dict, step, "said", "string", ["big", "whole", "flag"], ["at"])
    assert out.columns == ["at", "said"]
    want = {i: None if i % 9 == 0 else f"{None if i % 2 == 0 else 2**60 + i} {2**53 + 1 + i} {i % 3 == 0}" for i in range(200)}
    assert {r["at"]: r.said for r in out.collect()} == want
