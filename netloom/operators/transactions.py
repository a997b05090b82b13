"""Requests and responses with timeouts, as one ordered fold per flow: DNS by transaction id, HTTP by the order of requests.

Each row gets an `event`: request, retransmitted, answered, duplicate, unmatched, informational, untracked or none. A
request that is never answered within its timeout is unanswered. Requests expire in sweeps (see `sweep_clock`); flows are
independent, so the fold is spread over the cluster by flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.folds import fold

#: Timeouts, the number of open requests of an HTTP connection, and the time between sweeps.
DNS_TIMEOUT_US, HTTP_TIMEOUT_US, PIPELINE, SWEEP_US = 5_000_000, 30_000_000, 32, 500_000
EVENT = "struct<event:string,request:bigint,service_us:bigint>"


def _said(event: str, request: int | None = None, service_us: int | None = None) -> dict:
    return {"event": event, "request": request, "service_us": service_us}


def sweep_clock(packets: DataFrame, source: str = "source", every_us: int = SWEEP_US) -> DataFrame:
    """packets (source, ordinal, ts_us) with `swept_us`, the time of the newest sweep before each.

    Requests expire in sweeps, which the packets of a whole capture drive: a packet is matched first, then sweeps if the last
    sweep is `every_us` old. A capture is one sequence, of which only time and place are put in order; what else the packets
    hold stays dealt over the cluster and meets its sweep by (source, ordinal), which name one packet.
    """

    def step(state: dict, row: dict) -> int | None:
        before, now = state.get("at"), row["ts_us"]
        if before is None or now - before >= every_us:
            state["at"] = now
        return before

    clock = fold(packets.select(source, "ordinal", "ts_us"), source, ["ordinal"], dict, step, "swept_us", "bigint", ["ts_us"])
    clock = clock.where("swept_us is not null").groupBy(F.col(source).alias("_source"), F.col("ordinal").alias("_ordinal")).agg(F.min("swept_us").alias("swept_us"))
    return packets.join(clock.hint("merge"), (F.col(source) == F.col("_source")) & (F.col("ordinal") == F.col("_ordinal")), "left").drop("_source", "_ordinal")


def _expire(open_requests: dict, state: dict, row: dict, timeout: int) -> None:
    """Drop requests that a sweep before this row found old: the capture's sweeps where known, else one at each earlier row of the flow."""
    swept = row["swept_us"] if "swept_us" in row else state.get("prior")
    state["prior"] = row["ts_us"]
    if swept is not None:
        for i in [i for i, held in open_requests.items() if swept - held[0] >= timeout]:
            del open_requests[i]


def _read(messages: DataFrame, *columns: str) -> list[str]:
    return [*columns, *(c for c in ("swept_us",) if c in messages.columns)]


def dns_messages(packets: DataFrame, app: str = "app_data") -> DataFrame:
    """The DNS messages that are matched: over UDP, the server on port 53. packets: flow, outbound, local_port, remote_port, proto, and decoded payloads; a retransmitted segment says nothing new."""
    a = lambda c: F.col(f"{app}.{c}")
    asks = a("kind") == "dns"
    server = F.when(asks == F.col("outbound"), F.col("remote_port")).otherwise(F.col("local_port"))
    rows = packets.where(a("kind").isin("dns", "dns_response") & (F.col("proto") == 17) & (server == 53))
    return rows.select(*[c for c in ("flow", "ordinal", "ts_us", "outbound", "swept_us") if c in packets.columns], a("id").alias("id"), a("name").alias("name"), asks.alias("is_query"))


def http_messages(packets: DataFrame, app: str = "app_data") -> DataFrame:
    """Requests (status null) and responses of packets that were not sent again (`retransmit`, where the packets have it)."""
    a = lambda c: F.col(f"{app}.{c}")
    rows = packets.where(a("kind").isin("http", "http_response"))
    rows = rows.where(~F.coalesce("retransmit", F.lit(False))) if "retransmit" in packets.columns else rows
    return rows.select(*[c for c in ("flow", "ordinal", "ts_us", "outbound", "swept_us") if c in packets.columns], a("status").alias("status"))


def dns(messages: DataFrame, key: str = "flow") -> DataFrame:
    """messages (key, ordinal, ts_us, outbound, id, name, is_query; swept_us by `sweep_clock`) with `t`, an EVENT.

    A response answers the open query of its id, if it travels the other way and repeats the name in any case; a query that
    is open already was sent again and keeps its first time; a second answer within the timeout is a duplicate. An answer
    that comes late still counts as long as no sweep has met its request.
    """

    def step(state: dict, row: dict) -> dict:
        now, known = row["ts_us"], state.setdefault("open", {})
        answered = state.setdefault("answered", {})
        _expire(known, state, row, DNS_TIMEOUT_US)
        for i in [i for i, at in answered.items() if now - at >= DNS_TIMEOUT_US]:
            del answered[i]
        i, name = row["id"], (row["name"] or "").lower()
        if row["is_query"]:
            if i in known:
                return _said("retransmitted")
            answered.pop(i, None)
            known[i] = (now, row["outbound"], name, row["ordinal"])
            return _said("request")
        if i in known and known[i][1] != row["outbound"] and known[i][2] == name:
            sent, _, _, request = known.pop(i)
            answered[i] = now
            return _said("answered", request, max(0, now - sent))
        return _said("duplicate" if i not in known and i in answered else "unmatched")

    return fold(messages, key, ["ordinal"], dict, step, "t", EVENT, _read(messages, "ordinal", "ts_us", "outbound", "id", "name", "is_query"))


def http(messages: DataFrame, key: str = "flow") -> DataFrame:
    """messages (key, ordinal, ts_us, outbound, status; null for requests; swept_us by `sweep_clock`) with `t`, an EVENT.

    A final response answers the oldest open request if it travels the other way; interim ones (1xx but 101) answer none.
    """

    def step(state: dict, row: dict) -> dict:
        now, waiting = row["ts_us"], state.setdefault("open", {})  # by ordinal, so in order
        _expire(waiting, state, row, HTTP_TIMEOUT_US)
        status = row["status"]
        if status is None:
            if len(waiting) >= PIPELINE:
                return _said("untracked")
            waiting[row["ordinal"]] = (now, row["outbound"])
            return _said("request")
        request = next(iter(waiting), None)
        if request is None or waiting[request][1] == row["outbound"]:
            return _said("unmatched")
        text = str(status)
        if text.startswith("1") and text != "101":
            return _said("informational")
        sent, _ = waiting.pop(request)
        return _said("answered", request, max(0, now - sent))

    return fold(messages, key, ["ordinal"], dict, step, "t", EVENT, _read(messages, "ordinal", "ts_us", "outbound", "status"))


def unanswered(tracked: DataFrame, key: str = "flow", timeout_us: int = DNS_TIMEOUT_US) -> DataFrame:
    """Requests that got no answer and whose timeout has passed by the newest row of all."""
    newest = F.broadcast(tracked.agg(F.max("ts_us").alias("_newest")))  # one row
    used = tracked.where("t.event = 'answered'").select(key, F.col("t.request").alias("ordinal"))
    asked = tracked.where("t.event = 'request'").join(used, [key, "ordinal"], "left_anti")
    return asked.crossJoin(newest).where(F.col("_newest") - F.col("ts_us") >= timeout_us).drop("_newest", "t")


def learned_names(responses: DataFrame, least_s: int = 3600, most_s: int = 86_400) -> DataFrame:
    """(address, name, expires_us): what one response each teaches. responses: name, ts_us, answers array<struct<name, rtype, data, ttl>>.

    An A or AAAA answer (types 1 and 28) counts if its owner is the asked name or reached from it over CNAMEs (type 5), in
    whatever order they come.
    """
    name = F.lower("name")
    low = F.transform("answers", lambda a: F.struct(F.lower(a["name"]).alias("name"), a["rtype"].alias("rtype"), F.lower(a["data"]).alias("to"), a["data"].alias("data"), a["ttl"].alias("ttl")))
    aliases = lambda: F.filter("low", lambda a: a["rtype"] == 5)
    step = lambda seen, _: F.array_union(seen, F.transform(F.filter(aliases(), lambda a: F.array_contains(seen, a["name"])), lambda a: a["to"]))
    reached = responses.withColumn("low", low).withColumn("reached", F.aggregate("low", F.array(name), step))
    hits = F.filter("low", lambda a: a["rtype"].isin(1, 28) & (a["data"] != "") & F.array_contains("reached", a["name"]))
    rows = reached.select("ts_us", name.alias("name"), F.explode(hits).alias("a"))
    kept = F.greatest(F.lit(least_s), F.least(F.lit(most_s), F.col("a.ttl"))).cast("bigint") * 1_000_000
    return rows.select(F.col("a.data").alias("address"), "name", (F.col("ts_us") + kept).alias("expires_us"))
