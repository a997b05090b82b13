import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import network as net
from netloom.functions.display_filter import Field, FilterError, compile_filter, compile_for_series, connection_fields
from netloom.operators import joins, tcp, views
from netloom.plans.core import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    cell = lambda x: "null" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("source,token", [("k ==", "<end>"), ("and k", "and"), ('k == "a', "<end>"), ("k in {}", "}"), ("(k", "<end>"), ('k == "a\\n"', "n"), ("k == \u0663", "\u0663"), ("k\u0085", "\u0085")])
def test_bad_filters_say_where(spark, source, token):
    with pytest.raises(FilterError) as e:
        compile_filter(source, {"k": Field("k", "uint")})
    assert e.value.token == token


def test_filter_positions_count_utf16_units():
    with pytest.raises(FilterError) as e:
        compile_filter('k == "\U0001f600" \ufeff )', {"k": Field("k", "str")})
    assert (e.value.token, e.value.position) == (")", 12)


def test_filters_for_series_refuse_what_only_viewers_know():
    fields = connection_fields({}) | {"dns.response_to": Field("r", "uint")}
    for source in ('connection.protocol == "DNS"', "dns.response_to == 3"):
        with pytest.raises(FilterError):
            compile_for_series(source, fields)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where(compile_filter("n >= 3 and n in {4, 5}", {"n": Field("l_linenumber", "uint")}))
    assert "GreaterThanOrEqual(l_linenumber,3)" in df._jdf.queryExecution().toString()


def test_null_fields_are_two_valued(spark):
    df = spark.sql("select * from values (1, null), (2, 5) as t(id, k)")
    fields = {"k": Field("k", "uint")}
    ids = lambda s: [r.id for r in df.where(compile_filter(s, fields)).collect()]
    assert ids("k != 5") == [] and ids("not k == 5") == [1] and ids("K >= 5") == [2] and ids("") == [1, 2]


def test_retransmits_cross_the_wrap(spark):
    df = spark.createDataFrame([(1, i, s, True, 1) for i, s in enumerate([4294967290, 4, 4294967295, 10])], "flow long, idx int, seq long, outbound boolean, len long")
    assert [r.retransmit for r in tcp.retransmits(df).orderBy("idx").collect()] == [False, False, True, False]


def test_retransmits_count_payload_and_each_direction(spark):
    rows = [(100, True, 10), (110, True, 0), (110, True, 10), (500, False, 7), (110, True, 10), (500, False, 0)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "flow long, idx int, seq long, outbound boolean, len long")
    marked = tcp.retransmits(df)
    assert [r.retransmit for r in marked.orderBy("idx").collect()] == [False, False, False, False, True, False]
    assert tcp.loss_percent(marked).first().asDict() == {"flow": 1, "segments": 4, "retransmits": 1, "loss": 25.0}


def test_fifo_is_a_queue(spark):
    got = {r.req_ordinal: (r.resp_ordinal, r.service_us) for r in QUERIES["txn_fifo"](spark, "/root/testdata/sf0.01").collect()}
    p = pd.read_parquet("/root/testdata/sf0.01/events.parquet").sort_values("event_id")
    open_, want = {}, {}
    for r in p.itertuples():
        queue = open_.setdefault(r.user_id, [])
        if r.event_type == "view":
            queue.append((r.event_id, r.ts))
            want[r.event_id] = (None, None)
        elif r.event_type == "purchase" and queue:
            first, sent = queue.pop(0)
            want[first] = (r.event_id, max(0, (r.ts - sent) // pd.Timedelta(microseconds=1)))
    assert got == want and sum(v[0] is not None for v in want.values()) > 1400


def test_addresses_and_secrets(spark):
    one = lambda rows, c: [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(c).collect()]
    ips = ["::1", "::", "fe80::1", "fe90::1", "fd00::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:999.1.1.1", "::ffff:1234.1.1.1", "2001:db8::1", "10.1.1.1", "8.8.8.8", None]
    assert one(ips, net.is_private(F.col("x"))) == [True, False, True, False, True, True, True, True, False, False, True, False, False]
    assert one(["\tBearer abc", "\u3000bearer x", "bearerx", None], net.redact(F.lit("x-any"), F.col("x"))) == ["[REDACTED]", "[REDACTED]", "bearerx", None]
    assert one(["a\u00e9\n\U0001f600b", "", None], net.display_safe(F.col("x"), 4)) == ["a\\u{e9}\\u{a}\\u{1f600}…", "", None]
    assert one(["GET /x HTTP/1.1\r\nHost: a", "GET /x", "GET x\n", "get /x\n"], net.http_request(F.col("x"))) == [("GET", "/x"), None, None, None]
    assert one(["Text/HTML; charset=x", "a/b/c", " a/b ", "a", "/b"], net.media_type(F.col("x"))) == ["text/html", None, "a/b", None, None]


def test_paced_sample_is_greedy(spark):
    got = QUERIES["paced_sample"](spark, SF).toPandas().set_index("ordinal")["admitted"]
    p = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    last, gap = {}, pd.Timedelta(hours=6)
    for r in p.itertuples():
        ok = r.user_id not in last or r.ts - last[r.user_id] >= gap
        assert bool(got[r.event_id]) == ok
        if ok:
            last[r.user_id] = r.ts


def test_spans_touch(spark):
    a = spark.createDataFrame([("x", 0, 5), ("x", 7, 7), ("x", 10, 12)], "k string, from_us long, to_us long")
    b = spark.createDataFrame([("x", 4, 8), ("y", 0, 99)], "k string, from_us long, to_us long")
    assert sorted(r.left_from_us for r in joins.spans_touching(a, b, "k").collect()) == [0, 7]


def test_transactions_equal_a_plain_loop(spark):
    for name, timeout in (("dns_transactions", 5_000_000), ("http_transactions", 30_000_000)):
        got = {r.ordinal: (r.event, r.request, r.service_us) for r in QUERIES[name](spark, SF).collect()}
        p = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")
        flows, want, prior = {}, {}, {}
        for r in p[p.event_type.isin(["view", "purchase"])].itertuples():
            now, k = r.event_id * 20_000, int(r.props.split(":")[1].strip(" }"))
            waiting, done = flows.setdefault(r.user_id, ([], {}))
            # A packet is matched before it sweeps, so requests expire as of the packet before.
            waiting[:] = [x for x in waiting if prior.get(r.user_id, x[0]) - x[0] < timeout]
            prior[r.user_id] = now
            dns, key = name.startswith("dns"), k % 3
            same = [x for x in waiting if not dns or x[2] == key]
            if r.event_type == "view":
                known = dns and bool(same)
                want[r.event_id] = ("retransmitted" if known else "request" if len(waiting) < 32 or dns else "untracked", None, None)
                if want[r.event_id][0] == "request":
                    done.pop(key, None)
                    waiting.append((now, r.event_id, key))
            elif same and not dns and k < 10:
                want[r.event_id] = ("informational", None, None)
            elif same:
                waiting.remove(same[0])
                done[key] = now
                want[r.event_id] = ("answered", same[0][1], now - same[0][0])
            else:
                want[r.event_id] = ("duplicate" if dns and now - done.get(key, -timeout) < timeout else "unmatched", None, None)
        assert got == want and len({v[0] for v in want.values()}) > 3


def test_chart_steps():
    assert [views.finest_interval_ms(0, x) for x in (200_000, 200_001, 2_000_001, 10**9)] == [100, 1000, 10_000, 60_000]
    assert [views.finest_bin_us(x) for x in (200_000, 200_001, 10**13)] == [1000, 2000, 3_600_000_000]


def test_round_trips_follow_acks(spark):
    top = 2**32 - 5
    steps = [  # outbound, seq, ack, has_ack, len, retransmit -> time to the answered segment
        (True, top, 0, True, 10, False, None), (True, 5, 0, True, 10, False, None), (False, 0, 4, True, 0, False, None),
        (False, 0, 15, True, 0, False, 2), (False, 0, 15, True, 0, False, None), (True, 15, 0, False, 10, False, None),
        (True, 25, 0, False, 10, False, None), (True, 20, 0, False, 5, True, None), (False, 0, 35, True, 7, False, None), (True, 35, 7, True, 0, False, 1)]
    df = spark.createDataFrame([("f", i, i, *s[:6]) for i, s in enumerate(steps)], "f string, index int, ts_us long, outbound boolean, seq long, ack long, has_ack boolean, len long, retransmit boolean")
    assert [r.rtt_us for r in tcp.ack_rtts(df, "f").orderBy("index").collect()] == [s[6] for s in steps]
    assert tcp.ack_rtts(df.limit(0), "f").count() == 0


def test_round_trips_equal_a_plain_loop(spark):
    got = QUERIES["ack_round_trips"](spark, SF).toPandas().set_index("ordinal")["rtt_us"]
    p, sent, place = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id"), {}, {}
    for r in p.itertuples():
        k, n, out = int(r.props.split(":")[1].strip(" }")), place.get(r.user_id, 0), r.event_type in ("click", "purchase")
        place[r.user_id] = n + 1
        mine, theirs = sent.setdefault((r.user_id, out), []), sent.setdefault((r.user_id, not out), [])
        covered = [x for x in theirs if x[0] <= (n - k % 4) * 10] if k % 3 else []
        want = max(0, (r.ts - covered[-1][1]) // pd.Timedelta(microseconds=1)) if covered else None
        theirs[:] = theirs[len(covered):]
        if k % 2 == 0:
            mine[:] = [x for x in mine if x[0] <= n * 10] if k % 10 == 4 else [*mine, (n * 10 + 10, r.ts)]
        assert want == (None if pd.isna(got[r.event_id]) else got[r.event_id])
    assert got.notna().sum() > 20
