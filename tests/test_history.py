"""History tiers and pages against plain loops; ranges of every width."""

from __future__ import annotations

import random

from netloom.operators import history, joins

MESSAGES = "source string, ordinal long, epoch string, revision long, from_ms long, to_ms long"
COUNTS = "source string, ordinal long, series string, start_ms long, packets long, bytes long, late boolean"
UNSEEN = "source string, ordinal long, from_ms long, to_ms long, reason string"


def test_tiers_and_points_equal_a_plain_loop(spark):
    rng, messages, counts, unseen, at = random.Random(3), [], [], [], 1_000_000_000
    messages.append(("s", 0, "old", 9, 0, 5000))
    counts.append(("s", 0, "all", 100, 7, 7, False))
    for n in range(1, 60):
        gap, width = rng.choice([0, 0, 0, 400]), rng.choice([500, 1000, 60_000])
        back = rng.choice([0, 0, 700])
        start = at + gap - back
        revision = 1 if n < 10 or n == 15 else 2
        messages.append(("s", n, "new", revision, start, start + width))
        for t in range(start, start + width, 100):
            if rng.random() < 0.3:
                counts.append(("s", n, rng.choice(["all", "big"]), t, rng.randrange(1, 9), 100, False))
        if rng.random() < 0.3:
            counts.append(("s", n, "all", start - rng.choice([2000, 900_100]), 1, 10, True))
        if gap:
            unseen.append(("s", n, at, at + gap, "backlog"))
        at = max(at, start + width)
    held = history.tiers(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(counts, COUNTS), spark.createDataFrame(unseen, UNSEEN))
    # The same by hand: one pass over the messages of the newest revision.
    high, total, covered, hidden = None, {}, {}, {}
    for _, n, epoch, revision, a, b in messages:
        if epoch != "new" or revision != 2:
            continue
        fresh = a if high is None else max(a, high)
        for s, m, series, t, p, size, late in counts:
            if m == n and (late or t >= fresh):
                for step in history.TIERS:
                    cell = total.setdefault((step, series, t // step), [0, 0, 0, 0])
                    cell[2 * late] += p
                    cell[2 * late + 1] += size
        for step in history.TIERS:
            for t in range(fresh, b, 100):
                covered[step, t // step] = covered.get((step, t // step), 0) + 100
        high = b if b > fresh else high
        for _, m, x, y, _ in unseen:
            if m == n:
                for step in history.TIERS:
                    for t in range(x, y, 100):
                        hidden[step, t // step] = hidden.get((step, t // step), 0) + 100
    newest = {step: max([k[-1] for k in [*total, *covered, *hidden] if k[0] == step]) for step in history.TIERS}
    live = lambda k: k[-1] > newest[k[0]] - history.TIERS[k[0]]
    got = held.collect()
    assert {(r["tier_ms"], r["series"], r["start_ms"] // r["tier_ms"]): [r["packets"], r["bytes"], r["late_packets"], r["late_bytes"]] for r in got if r["series"]} == {k: v for k, v in total.items() if live(k)}
    assert {(r["tier_ms"], r["start_ms"] // r["tier_ms"]): r["covered_ms"] for r in got if not r["series"] and r["covered_ms"]} == {k: v for k, v in covered.items() if live(k)}
    assert {(r["tier_ms"], r["start_ms"] // r["tier_ms"]): r["unseen_ms"] for r in got if not r["series"] and r["unseen_ms"]} == {k: v for k, v in hidden.items() if live(k)}
    for interval in (100, 1000, 10_000):
        ring = history.RING_OF[interval]
        rows = {r["start_ms"]: r for r in history.points(held, "all", interval, at - 50_000, at + 700).collect()}
        assert set(rows) == set(range((at - 50_000) // interval * interval, at + 700, interval))
        for t, r in rows.items():
            slots = range(t // ring, (t + interval) // ring)
            lost, seen = sum(hidden.get((ring, k), 0) for k in slots), sum(covered.get((ring, k), 0) for k in slots)
            state = "notObserved" if lost else "value" if seen >= interval else "unknown"
            assert (r["state"], r["packets"]) == (state, sum(total.get((ring, "all", k), [0])[0] for k in slots) if state == "value" else 0)
    assert len({r["state"] for r in rows.values()}) >= 2


def test_pages_merge(spark):
    rows = [("f", 1, "g1", i, "a") for i in range(6)] + [("f", 2, "g2", i, "b") for i in range(0, 30)] + [("f", 3, "g2", i, "c") for i in range(28, 40)] + [("f", 4, "g2", i, "d") for i in range(40, 44)] + [("e", 1, "g", 0, "z")]
    got = history.merged_pages(spark.createDataFrame(rows, "flow string, page int, generation string, index long, v string"), "flow", samples=10, head=3).collect()
    assert sorted((r["index"], r["v"]) for r in got if r["flow"] == "f") == [(0, "b"), (1, "b"), (2, "b")] + [(i, "c") for i in range(34, 40)] + [(i, "d") for i in range(40, 44)]
    assert [r["v"] for r in got if r["flow"] == "e"] == ["z"]


def test_ranges_of_every_width(spark):
    rng = random.Random(6)
    ranges = [(0, 2**32 - 1, 999, "all"), (0, 2**62, 1000, "more"), (7, 7, 1, "one"), (9, 3, 0, "none"), (2**32 - 1, 2**32, 2, "edge")]
    for i in range(60):
        low = rng.randrange(2**32)
        ranges.append((low, low + rng.choice([0, 1, 15, 16, 255, 10**6, 2**31]), i + 3, f"r{i}"))
    asked = [0, 7, 9, 3, 2**32 - 1, 2**32, 2**62, 2**61 + 3, None] + [rng.randrange(2**32) for _ in range(200)] + [low + d for low, *_ in ranges[5:] for d in (-1, 0, 1, 16)]
    got = joins.in_range(spark.createDataFrame([(p,) for p in asked], "p long"), spark.createDataFrame(ranges, "low long, high long, place long, org string"), "p", "low", "high", "place", "org").collect()
    want = lambda p: None if p is None else min(((o, v) for a, b, o, v in ranges if a <= p <= b), default=(0, None))[1]
    assert len(got) == len(asked) and all(r["org"] == want(r["p"]) for r in got)
    blocks = spark.createDataFrame(ranges[:1], "low long, high long, place long, org string").select(joins._aligned(joins.F.col("low"), joins.F.col("high")).alias("b")).first()["b"]
    assert len(blocks) == 1
