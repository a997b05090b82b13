"""The flow table: packets of a five-tuple as instances, with idle times that depend on what the instance has shown.

Packets count in capture order. `Flow` is one instance; `instances` folds a batch, `stream` keeps the same state in Structured Streaming, where an event-time
timer of each flow closes it. Both give one row an instance.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netloom.operators.folds import unfold

#: Idle times in milliseconds.
CLOSING_MS, OPENING_MS, DATAGRAM_MS, OPEN_MS = 120_000, 30_000, 60_000, 1_800_000
INSTANCE = (
    "flow string, first_us bigint, last_us bigint, tx_bytes bigint, rx_bytes bigint, packets bigint, segments bigint, retransmits bigint, "
    "status string, rtt_us bigint, app string, encryption string, ja3 string, closed boolean"
)
#: What a packet brings: missing numbers are -1 and missing names empty, so that both forms see equal, exact values.
PACKET = {
    "flow": "string", "ordinal": "bigint", "ts_us": "bigint", "outbound": "boolean", "bytes": "bigint", "tcp": "boolean", "syn": "boolean", "ack": "boolean", "fin": "boolean", "rst": "boolean",
    "seq": "bigint", "size": "bigint", "app": "string", "port_app": "string", "ja3": "string",
}


class Flow(dict):
    """One instance, as plain values that survive JSON."""

    @classmethod
    def opened(cls, p: dict) -> Flow:
        return cls(flow=p["flow"], tcp=p["tcp"], first=p["ts_us"], last=p["ts_us"], bytes=[0, 0], packets=0, segments=0, retransmits=0, highest=[None, None], up=False, fin=False, rst=False, syn=None, rtt=None, app=None, tls=False, ja3=None)

    def status(self) -> str:
        if self["fin"] or self["rst"]:
            return "TIME_WAIT"
        if self["up"] or not self["tcp"] and self["syn"] is None:
            return "ESTABLISHED"
        return "CLOSE_WAIT" if self["syn"] is None else "SYN_SENT"

    def idle_ms(self) -> int:
        status = self.status()
        return OPENING_MS if status == "SYN_SENT" else CLOSING_MS if status != "ESTABLISHED" else OPEN_MS if self["tcp"] else DATAGRAM_MS

    def over(self, ts_us: int) -> bool:
        """Whether a packet of that time comes too late for this instance."""
        return ts_us // 1000 - self["last"] // 1000 > self.idle_ms()

    def add(self, p: dict) -> None:
        side = int(p["outbound"])
        self["last"], self["packets"] = p["ts_us"], self["packets"] + 1
        self["bytes"][side] += p["bytes"]
        if p["app"]:
            self["app"], self["tls"] = p["app"], self["tls"] or bool(p["ja3"])
            self["ja3"] = self["ja3"] or p["ja3"] or None  # one handshake a flow: the first counts
        elif self["app"] is None:
            self["app"] = p["port_app"] or None
        if not p["tcp"]:
            return
        if p["syn"] and not p["ack"]:
            self["syn"] = p["ts_us"]
        if p["syn"] and p["ack"] and not side and self["syn"] is not None:
            self["rtt"] = max(0, p["ts_us"] - self["syn"])
        self["up"] = (self["up"] or p["ack"]) and not p["rst"]
        self["fin"], self["rst"] = self["fin"] or p["fin"], self["rst"] or p["rst"]
        if p["size"] > 0 and p["seq"] >= 0:
            self["segments"] += 1
            top = self["highest"][side]
            if top is not None and (p["seq"] - top + (1 << 31)) % (1 << 32) <= 1 << 31:
                self["retransmits"] += 1
            else:
                self["highest"][side] = p["seq"]

    def row(self, closed: bool) -> dict:
        return {
            "flow": self["flow"], "first_us": self["first"], "last_us": self["last"], "tx_bytes": self["bytes"][1], "rx_bytes": self["bytes"][0], "packets": self["packets"], "segments": self["segments"],
            "retransmits": self["retransmits"], "status": self.status(), "rtt_us": self["rtt"], "app": self["app"] or "Unknown", "encryption": "TLS" if self["tls"] else "None", "ja3": self["ja3"], "closed": closed}


def prepared(packets: DataFrame) -> DataFrame:
    """The columns of PACKET; those that the packets lack are missing everywhere."""

    def one(name: str, kind: str) -> Column:
        blank = {"bigint": F.lit(-1), "boolean": F.lit(False), "string": F.lit("")}[kind]
        return (F.coalesce(F.col(name).cast(kind), blank.cast(kind)) if name in packets.columns else blank.cast(kind)).alias(name)

    return packets.where("flow is not null and ts_us is not null").select(*[one(n, k) for n, k in PACKET.items()])


def instances(packets: DataFrame) -> DataFrame:
    """One row an instance, in batch. The last one of a flow is open (`closed` false): only a later packet of its flow closes one."""

    def step(held: dict, p: dict) -> list[dict]:
        flow, out = held.get("flow"), []
        if flow is not None and flow.over(p["ts_us"]):
            out, flow = [flow.row(True)], None
        held["flow"] = flow = Flow.opened(p) if flow is None else flow
        flow.add(p)
        return out

    return unfold(prepared(packets), "flow", ["ordinal"], dict, step, lambda held: [held["flow"].row(False)], INSTANCE)


def rates(flows: DataFrame) -> DataFrame:
    """instances with `loss`, the retransmissions among segments with payload in percent."""
    return flows.withColumn("loss", F.when(F.col("segments") > 0, F.least(F.lit(100.0), F.col("retransmits") * 100.0 / F.col("segments"))).otherwise(0.0))


class FlowTable(StatefulProcessor):
    """State: the open instance of a flow. Its timer is set to the time after which no packet can belong to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("flow", "held string")

    def _close(self) -> pd.DataFrame:
        row = Flow(json.loads(self.held.get()[0])).row(True)
        self.held.clear()
        return pd.DataFrame([row], columns=[f.split()[0] for f in INSTANCE.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("ordinal")
        flow = Flow(json.loads(self.held.get()[0])) if self.held.exists() else None
        for p in batch.to_dict("records"):
            if flow is not None and flow.over(p["ts_us"]):
                self.held.update((json.dumps(flow),))
                yield self._close()
                flow = None
            flow = Flow.opened(p) if flow is None else flow
            flow.add(p)
        self.held.update((json.dumps(flow),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(flow["last"] // 1000 + flow.idle_ms() + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists():
            yield self._close()

    def close(self) -> None:
        pass


def stream(packets: DataFrame, grace: str = "10 seconds") -> DataFrame:
    """Closed instances of a stream, each once: when a packet comes that is too late for it, or the watermark has passed its idle time."""
    timed = prepared(packets).withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", grace)
    return timed.groupBy("flow").transformWithStateInPandas(FlowTable(), StructType.fromDDL(INSTANCE), "Append", "EventTime")
