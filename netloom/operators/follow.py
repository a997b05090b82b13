"""Follow-stream: the bytes of both directions of a flow in order, with exact gaps, turns, and credentials masked.

`streams` is an ordered fold by flow. Bytes ahead of the contiguous edge wait in an interval map; a hole that stays open for
two seconds, or that a segment far ahead leaves behind, becomes a gap of known size. What came first stays. `shown` then
withholds TLS and masks, line by line, what is or may be a credential; both work on at most 256 KiB a direction.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from netloom.functions.payloads import is_secret
from netloom.operators.folds import unfold
from netloom.operators.reassembly import CUT_MS, Spans

#: Bytes, gaps, masks and turns that are kept, the window of bytes ahead, and how long a hole may wait.
KEPT, GAPS, MASKS, TURNS, AHEAD, WAIT_MS, RESET_WINDOW = 256 * 1024, 1024, 1024, 4096, 64 * 1024, 2000, 1 << 20
LINE, RECORD, CANDIDATES = 16 * 1024, 18_432, 20 * 1024
STREAM = (
    "flow string, side string, data binary, seen bigint, stopped string, gaps array<struct<at:int,missing:bigint,reason:string>>, "
    "turns array<struct<turn:int,start:int,len:int,first_ms:bigint>>, conflicting bigint, start_captured boolean, closed boolean, reset boolean"
)


def _ahead(a: int, b: int) -> int:
    """a - b of 32-bit serial numbers."""
    return ((a - b + (1 << 31)) % (1 << 32)) - (1 << 31)


class Side:
    """One direction. Places count from its first byte."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.edge, self.since, self.run, self.seen, self.conflicts = 0, 0, 0, 0, 0
        self.data, self.held, self.gaps, self.turns = bytearray(), Spans(), [], []
        self.fin: int | None = None
        self.stopped: str | None = None
        self.closed = self.start_captured = False
        self.top: int | None = None  # anchors of reset checks: this side's position and its newest ACK
        self.acked: int | None = None
        self.sure = False

    def open(self) -> bool:
        return not self.closed and self.stopped is None

    def begin(self, seq: int, start: bool) -> None:
        self.base, self.start_captured = seq, start


class Stream:
    """Both directions of one flow, client first."""

    def __init__(self, flow: str, client_outbound: bool) -> None:
        self.flow, self.client_outbound, self.sides, self.reset = flow, client_outbound, (Side(), Side()), False
        self.turns, self.last = 0, None

    # -- what becomes contiguous

    def _keep(self, i: int, data: bytes, now: int) -> None:
        side = self.sides[i]
        if not data or not side.open():
            return
        if self.last != i:
            if self.turns >= TURNS:
                for s in self.sides:
                    s.stopped = s.stopped or "turn_limit"
                return
        room = KEPT - len(side.data)
        taken = data[:room]
        if taken:
            if self.last != i:
                side.turns.append({"turn": self.turns, "start": len(side.data), "len": 0, "first_ms": now})
                self.turns, self.last = self.turns + 1, i
            side.turns[-1]["len"] += len(taken)
            side.data += taken
            side.run += len(taken)
        if len(taken) < len(data):
            side.stopped = "store_cap"

    def _drain(self, i: int, now: int) -> None:
        side = self.sides[i]
        while (data := side.held.run_from(side.edge)) and side.open():
            data = data if side.fin is None else data[: max(0, side.fin - side.edge)]
            if not data:
                break
            side.held.runs = [(s, b) for s, b in side.held.runs if s != side.edge] + ([(side.edge + len(data), rest)] if (rest := side.held.run_from(side.edge)[len(data) :]) else [])
            side.held.runs.sort()
            side.edge += len(data)
            self._keep(i, data, now)

    def _gap(self, i: int, missing: int, cut: bool) -> bool:
        side = self.sides[i]
        if len(side.gaps) >= GAPS:
            side.stopped = "gap_limit"
            return False
        side.gaps.append({"at": len(side.data), "missing": missing, "reason": "snaplen_likely" if cut else "missing"})
        side.edge, side.run = side.edge + missing, 0
        return True

    def _hole_end(self, i: int, limit: int) -> int:
        side = self.sides[i]
        ends = [limit, *([side.held.runs[0][0]] if side.held else []), *([] if side.fin is None else [side.fin])]
        return min(ends)

    def expire(self, i: int, now: int, cut: bool, flush: bool = False) -> None:
        """Holes that have waited long enough become gaps."""
        side = self.sides[i]
        while side.open() and side.held and (flush or now - side.since >= WAIT_MS):
            end = self._hole_end(i, side.held.runs[0][0])
            if end > side.edge and not self._gap(i, end - side.edge, cut):
                break
            before = len(side.held.runs), side.edge
            self._drain(i, now)
            if (len(side.held.runs), side.edge) == before:
                break  # what is left lies behind the end
        if side.fin is not None and side.edge >= side.fin:
            side.closed = True
        if not side.open():
            side.held = Spans()

    def _place(self, i: int, at: int, data: bytes, now: int, cut: bool) -> None:
        side = self.sides[i]
        while at + len(data) > side.edge + AHEAD:
            end = self._hole_end(i, at)
            if end <= side.edge or not self._gap(i, end - side.edge, cut):
                return
            self._drain(i, now)
            if not side.open():
                return
        if at == side.edge and not side.held:
            side.edge += len(data)
            self._keep(i, data, now)
            return
        if not side.held:
            side.since = now
        side.conflicts += side.held.put(at, data)[1]
        self._drain(i, now)

    def _receive(self, i: int, seq: int, row: dict, cut: bool) -> None:
        side, data, now = self.sides[i], row["payload"] or b"", row["clock_ms"]
        at = side.edge + _ahead(seq, (side.base + side.edge) % (1 << 32))
        if row["fin"] and side.fin is None and at + len(data) >= side.edge:
            side.fin = at + len(data)
        if side.fin is not None:
            data = data[: max(0, side.fin - at)]
        if at < side.edge and data:
            old = data[: side.edge - at]
            if side.open():  # against what was stored since the last gap
                place = len(side.data) - (side.edge - at)
                side.conflicts += sum(side.data[place + k] != b for k, b in enumerate(old) if side.edge - at - k <= side.run and place + k >= 0)
            data, at = data[len(old) :], side.edge
        for k in range(0, len(data), AHEAD):
            if side.open():
                self._place(i, at + k, data[k : k + AHEAD], now, cut)
        if side.fin is not None and side.edge >= side.fin:
            side.closed = True

    # -- resets

    def _trusted(self, i: int, row: dict) -> bool:
        """Whether a reset sits where its sender, or what the peer acknowledged, says it could."""
        mine, peer = self.sides[i], self.sides[1 - i]
        near = lambda at, anchor: anchor is not None and 0 <= _ahead(at, anchor) <= RESET_WINDOW
        if mine.sure and near(row["seq"], mine.top) or peer.sure and near(row["seq"], peer.acked):
            return True
        return not mine.sure and bool(row["ack_flag"]) and peer.sure and peer.top is not None and near(peer.top, row["ack"])

    def _track(self, i: int, row: dict) -> None:
        mine, peer = self.sides[i], self.sides[1 - i]
        first = mine.top is None and peer.top is None
        near = lambda at, anchor: anchor is not None and 0 <= _ahead(at, anchor) <= RESET_WINDOW
        knows = bool(row["ack_flag"]) and peer.sure and peer.top is not None and near(peer.top, row["ack"])
        met = peer.sure and near(row["seq"], peer.acked)
        end = (row["seq"] + len(row["payload"] or b"") + bool(row["syn"]) + bool(row["fin"])) % (1 << 32)
        if mine.top is None or not mine.sure and (knows or met):
            mine.top, mine.acked = end, row["ack"] if row["ack_flag"] else None
        elif met or abs(_ahead(row["seq"], mine.top)) <= RESET_WINDOW:
            if _ahead(end, mine.top) > 0:
                mine.top = end
            if row["ack_flag"] and (mine.acked is None or _ahead(row["ack"], mine.acked) > 0):
                mine.acked = row["ack"]
        else:
            return
        mine.sure = mine.sure or first or knows or met

    # -- one segment

    def take(self, row: dict) -> None:
        i, now = int(bool(row["outbound"]) != self.client_outbound), row["clock_ms"]
        cut = row.get("cut_ms") is not None and now - row["cut_ms"] <= CUT_MS
        if row["rst"] and not self.reset and not self._trusted(i, row):
            return
        self.sides[i].seen += len(row["payload"] or b"")
        if not row["rst"]:
            self._track(i, row)
        if self.reset:
            return
        if row["rst"]:
            self.reset = True
            for j in (0, 1):
                self.expire(j, now, cut, flush=True)
                side, peer = self.sides[j], self.sides[1 - j]
                if side.open() and side.base is not None and peer.sure and peer.acked is not None:
                    more = _ahead(peer.acked, (side.base + side.edge) % (1 << 32))
                    end = side.edge + more if side.fin is None else min(side.edge + more, side.fin)
                    if more > 0 and end > side.edge:
                        self._gap(j, end - side.edge, cut)
                side.closed, side.held = True, Spans()
            return
        side, seq = self.sides[i], row["seq"]
        if row["syn"]:
            if side.base is not None:
                seq = None  # sent again, or forged
            else:
                seq = (seq + 1) % (1 << 32)
                side.begin(seq, True)
        elif side.base is None and (row["payload"] or row["fin"]):
            side.begin(seq, False)
        if seq is not None and side.base is not None:
            self._receive(i, seq, row, cut)
        for j in (0, 1):
            self.expire(j, now, cut)

    def rows(self) -> list[dict]:
        out = []
        for i, name in enumerate(("c2s", "s2c")):
            self.expire(i, 0, False, flush=True)
            s = self.sides[i]
            out.append({"flow": self.flow, "side": name, "data": bytes(s.data), "seen": s.seen, "stopped": s.stopped, "gaps": s.gaps, "turns": s.turns, "conflicting": s.conflicts, "start_captured": s.start_captured, "closed": s.closed, "reset": self.reset})
        return out


def streams(segments: DataFrame, order: str = "ordinal") -> DataFrame:
    """Two rows (STREAM) a flow: its bytes, gaps and turns. Holes still open at the end are gaps.

    segments: flow, outbound, clock_ms, seq, ack, payload, syn, ack_flag, fin, rst, and cut_ms where known. The client is who
    sends a SYN without an ACK, or gets one with it; of a flow without a handshake, the outbound side.
    """

    def step(state: dict, row: dict) -> list[dict]:
        if row["seq"] is None:
            return []
        if "stream" not in state:
            client = row["outbound"] if not row["syn"] else row["outbound"] != bool(row["ack_flag"])
            state["stream"] = Stream(row["flow"], bool(client) if row["syn"] else True)
        state["stream"].take(row)
        return []

    rows = segments.withColumn("flow", F.col("flow").cast("string"))
    return unfold(rows, "flow", [order], dict, step, lambda state: state["stream"].rows() if "stream" in state else [], STREAM)


# --- what may be shown ---------------------------------------------------------------------------------------------------

HEADER = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+)(:?)[ \t]*")
SHOWN = "struct<data:binary,tls_from:int,stopped:string,masks:array<struct<start:int,len:int,reason:string>>>"


def _record(data: bytes, at: int) -> int | None:
    """The place behind a TLS record whose header stands at `at`."""
    head = data[at : at + 5]
    if len(head) < 5 or not 0x14 <= head[0] <= 0x17 or head[1] != 3 or head[2] > 4:
        return None
    size = int.from_bytes(head[3:], "big")
    return at + 5 + size if 0 < size <= RECORD else None


def tls_from(data: bytes) -> int | None:
    """Where TLS begins: at 0 if the stream is TLS, further on if it was upgraded; null for cleartext. All bytes have been seen."""
    hello = lambda at: data[at] == 0x16 and data[at + 5 : at + 6] in (b"\1", b"\2")
    if len(data) >= 6 and _record(data, 0) and hello(0):
        return 0
    for m in re.finditer(rb"[\x14-\x17]\x03[\x00-\x04]", data):
        end = _record(data, m.start())
        if end is not None and _record(data, end) is not None:
            return 0 if m.start() < CANDIDATES else m.start()
        if end is not None and hello(m.start()):
            return m.start()
    return None


def masks(data: bytes, gaps: list[int], start_captured: bool, closed: bool) -> list[tuple[int, int, str]]:
    """(start, end, reason) of what must not be shown: values of secret headers with their continuations, and what a gap or an open end leaves undecided."""
    out: list[tuple[int, int, str]] = []
    bounds = sorted({0, len(data), *gaps})
    for a, b in zip(bounds, bounds[1:], strict=False):
        unsure = a in gaps or not start_captured and a == 0
        pending: tuple[int, int, bool] | None = None  # a header's value, not yet known to end with its line
        carried = "uncertain" if unsure else None  # what a line that begins with a blank would continue
        at, first = a, True
        while at < b:
            end = data.find(b"\n", at, b)
            whole, end = end >= 0, b if end < 0 else end
            content = end - (end > at and data[end - 1] == 0x0D)
            fold, settled = data[at] in b" \t", whole or closed and b == len(data)
            if pending and (fold or pending[2]):
                out.append((*pending[:2], "credential"))
            carried, pending = "credential" if pending and fold else carried, None
            long = end - at > LINE
            if carried == "uncertain" and (first and unsure or fold):
                out.append((at, min(end, at + LINE), "uncertain"))
                carried = None if long else "uncertain"
            elif carried == "credential" and fold:
                out.append((at, end if long or not settled else content, "credential"))
            else:
                carried, head = None, HEADER.match(data, at, end)
                colon = head is not None and head[2] == b":"
                named = colon or head is not None and head.end(1) == end and not whole
                if named and long:
                    out.append((at, end, "uncertain"))
                    carried = "uncertain"
                elif colon:
                    start = min(head.end(), content)
                    name, value = head[1][:33].decode(), data[start : min(content, start + 16)].decode("utf-8", "ignore")
                    secret = is_secret(name if len(name) < 33 else "", value)
                    if settled:
                        pending = (start, content, secret)
                    else:
                        out.append((at, end, "uncertain"))
                elif named and not settled:
                    out.append((at, end, "uncertain"))
            at, first = end + 1, False
        if pending:
            if pending[2]:
                out.append((*pending[:2], "credential"))
            elif not (closed and b == len(data)):
                out.append((*pending[:2], "uncertain"))
    merged: list[tuple[int, int, str]] = []
    for start, end, reason in sorted(m for m in out if m[0] < m[1]):
        if merged and merged[-1][2] == reason and merged[-1][1] >= start:
            start = merged.pop()[0]
        merged.append((start, end, reason))
    return merged


def _show(data: bytes, gaps: list[dict], start_captured: bool, closed: bool, stopped: str | None) -> dict:
    tls = tls_from(data)
    kept = data if tls is None else data[:tls]
    found = masks(kept, [g["at"] for g in gaps if g["at"] <= len(kept)], start_captured, closed and stopped is None and tls is None)
    if len(found) > MASKS:
        kept, stopped, found = kept[: found[MASKS][0]], "redaction_limit", found[:MASKS]
    text = bytearray(kept)
    for start, end, _ in found:
        text[start:end] = b"*" * (end - start)
    return {"data": bytes(text), "tls_from": tls, "stopped": stopped, "masks": [{"start": a, "len": b - a, "reason": r} for a, b, r in found]}


def shown() -> Column:
    """Of the rows of `streams`: a struct SHOWN, the bytes up to where TLS begins with masked ones as `*`."""
    kind = StructType.fromDDL(f"s {SHOWN}").fields[0].dataType
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(data: pa.Array, gaps: pa.Array, start: pa.Array, closed: pa.Array, stopped: pa.Array) -> pa.Array:
        columns = (x.to_pylist() for x in (data, gaps, start, closed, stopped))
        return pa.array([_show(*row) for row in zip(*columns, strict=True)], arrow)

    return run("data", "gaps", "start_captured", "closed", "stopped")


def page(data: Column, offset: int, most: int = 32 * 1024) -> Column:
    """One page of a stream: struct(offset, next, data in base64)."""
    part = F.substring(data, offset + 1, most)
    return F.struct(F.lit(offset).alias("offset"), (F.lit(offset) + F.octet_length(part)).alias("next"), F.base64(part).alias("data"))
