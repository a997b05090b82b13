"""Bytes put back together: IPv4 fragments by datagram, TCP segments by flow and direction, DNS messages in a TCP stream.

All are ordered folds over the cluster, one datagram or one direction of a flow at a time. What is held is an interval map,
in which bytes that came first stay: a later copy fills gaps only, and where it differs that is counted. What is handed on
is the run of bytes from the start, never bytes joined over a hole.
"""

from __future__ import annotations

import struct
from operator import ne

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.functions import payloads
from netloom.operators.folds import fold

#: Bounds of a datagram and of a direction, times in milliseconds.
DATAGRAM_BYTES, FRAGMENT_MS = 65_535, 15_000
STREAM_BYTES, IDLE_MS, DECIDE_MS, CUT_MS = payloads.STREAM_BYTES, 30_000, 2_000, 5_000
REORDER_NS = 60 * 10**9
#: How complete the bytes are that a result came from.
WHOLE, TRUNCATED, MISSING = "reassembled", "incomplete — frames truncated at capture", "incomplete — frames missing"


def replay_clock(packets: DataFrame, source: str = "path", order: str = "ordinal") -> DataFrame:
    """packets (source, order, ts_ns) with `clock_ms`: the time that has passed in a capture, which never runs backwards.

    A packet up to a minute behind the newest holds the clock. One further behind is waited on: if the next is as far behind
    the clock was set back, and goes on from there; else it was an outlier. A capture is one sequence.
    """

    def step(clock: dict, row: dict) -> int:
        now = row["ts_ns"]
        newest = clock.setdefault("newest", now)
        odd = clock.pop("odd", None)
        if now >= newest:
            clock.update(newest=now, passed=clock.get("passed", 0) + now - newest)
        elif newest - now > REORDER_NS:
            if odd is None:
                clock["odd"] = now
            else:
                clock.update(newest=now, passed=clock.get("passed", 0) + max(0, now - odd))
        return clock.get("passed", 0) // 1_000_000

    return fold(packets, source, [order], dict, step, "clock_ms", "bigint", ["ts_ns"])


def cut_clock(packets: DataFrame, source: str = "path", order: str = "ordinal") -> DataFrame:
    """packets (clock_ms, cap_len, wire_len) with `cut_ms`: when the newest packet up to this one was cut short by the capture."""
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return packets.withColumn("cut_ms", F.last(F.when(F.col("cap_len") < F.col("wire_len"), F.col("clock_ms")), ignorenulls=True).over(w))


class Spans:
    """An interval map of bytes: disjoint runs in order. What is written first stays."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, bytes]] = []

    def put(self, at: int, data: bytes) -> tuple[int, int]:
        """(bytes that are new, bytes that differ from those held)."""
        end, new, differ, rest, cursor = at + len(data), [], 0, [], at
        for start, held in self.runs:
            stop = start + len(held)
            if stop <= at or start >= end:
                rest.append((start, held))
                continue
            if cursor < start:
                new.append((cursor, data[cursor - at : start - at]))
            low, high = max(start, at), min(stop, end)
            ours, theirs = data[low - at : high - at], held[low - start : high - start]
            differ += sum(map(ne, ours, theirs)) if ours != theirs else 0
            rest.append((start, held))
            cursor = high
        if cursor < end:
            new.append((cursor, data[cursor - at :]))
        self.runs = []
        for start, held in sorted(rest + new):
            if self.runs and self.end() == start:
                before = self.runs.pop()
                start, held = before[0], before[1] + held
            self.runs.append((start, held))
        return sum(len(b) for _, b in new), differ

    def run_from(self, at: int) -> bytes:
        return next((held for start, held in self.runs if start == at), b"")

    def end(self) -> int | None:
        return self.runs[-1][0] + len(self.runs[-1][1]) if self.runs else None

    def __bool__(self) -> bool:
        return bool(self.runs)


def _checksum(header: bytes) -> int:
    total = sum(struct.unpack(f">{len(header) // 2}H", header))
    while total > 0xFFFF:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def datagram(header: bytes, payload: bytes) -> bytes:
    """One unfragmented IPv4 datagram: lengths, fragment fields and checksum set anew."""
    out = header[:2] + struct.pack(">H", len(header) + len(payload)) + header[4:6] + bytes([header[6] & 0x40, 0]) + header[8:10] + b"\0\0" + header[12:]
    return out[:10] + struct.pack(">H", _checksum(out)) + out[12:] + payload


class Datagram:
    """The fragments of one datagram."""

    def __init__(self, now: int) -> None:
        self.bytes, self.first, self.last, self.total, self.header, self.hole = Spans(), now, now, None, None, None

    def status(self) -> str:
        held = len(self.bytes.run_from(0))
        if self.total is not None and held >= self.total:
            return WHOLE
        return TRUNCATED if self.hole is not None and self.hole <= held else MISSING


#: What a fragment is rejoined by, besides its key. All columns of the rows pass through Python, so callers leave out what they need not.
FRAGMENT_READS = ["clock_ms", "frag_offset", "more_fragments", "ip_header", "ip_payload", "ip_declared"]
FRAGMENT = "struct<status:string,datagram:binary,payload_len:int,ended:string,expired:string,conflicting:bigint,forged_end:boolean>"


def rejoined(fragments: DataFrame, key: list[str] | None = None, order: str = "ordinal") -> DataFrame:
    """fragments with `joined`: at the fragment that settles a datagram its status and bytes.

    fragments: src, dst, ip_id, proto (the key), clock_ms, frag_offset, more_fragments, ip_header, ip_payload, ip_declared (the
    payload length by the header). A datagram is whole once its end is known and all before it is held; it is given up as
    truncated once a hole is met that the capture cut. An end that contradicts the known one, or what is held behind it, is
    refused whole. A datagram expires 15 s after its first or newest fragment; `expired` is the status it had.
    """

    def step(state: dict, row: dict) -> dict:
        now, at, data, declared = row["clock_ms"], row["frag_offset"], row["ip_payload"] or b"", row["ip_declared"]
        out, held = {"conflicting": 0, "forged_end": False}, state.get("datagram")
        if held and max(now - held.last, now - held.first) > FRAGMENT_MS:
            out["expired"], held = held.status(), None
        held = state["datagram"] = held or Datagram(now)
        held.last, end = now, at + declared
        if not row["more_fragments"]:
            if held.total not in (None, end) or held.total is None and (held.bytes.end() or 0) > end:
                return out | {"forged_end": True}
            held.total = end
        if at == 0 and held.header is None:
            held.header = row["ip_header"]
        if len(data) < declared:
            held.hole = min(at + len(data), at + len(data) if held.hole is None else held.hole)
        _, out["conflicting"] = held.bytes.put(at, data[: max(0, DATAGRAM_BYTES - at)])
        status = held.status()
        if status == MISSING:
            if at + len(data) > DATAGRAM_BYTES:
                state["datagram"], out["ended"] = None, "abandoned"
            return out
        state["datagram"], out["ended"] = None, status
        if held.header is None:
            return out
        payload = held.bytes.run_from(0)[: held.total]
        return out | {"status": status, "datagram": datagram(held.header, payload), "payload_len": len(payload)}

    blank = dict.fromkeys(x.split(":")[0] for x in FRAGMENT[7:-1].split(","))
    return fold(fragments, key or ["src", "dst", "ip_id", "proto"], [order], dict, lambda s, r: blank | step(s, r), "joined", FRAGMENT, FRAGMENT_READS)


class Direction:
    """What is held of one direction. Places count from the first segment; those before it are negative."""

    def __init__(self, seq: int, now: int) -> None:
        self.origin, self.base, self.bytes, self.hole, self.first, self.last, self.over = seq, 0, Spans(), None, now, now, False

    def place(self, seq: int) -> int:
        """Of a sequence number, by its signed distance from the base."""
        return self.base + ((seq - self.origin - self.base + (1 << 31)) % (1 << 32)) - (1 << 31)

    def prefix(self) -> bytes:
        return self.bytes.run_from(self.base)

    def status(self) -> str:
        end = self.base + len(self.prefix())
        if self.hole is not None and self.hole <= end:
            return TRUNCATED
        return MISSING if (self.bytes.end() or end) > end else WHOLE


class Boundary:
    """Where the next DNS message of a direction starts, as a sequence number; with `high`, where the second byte of its length does."""

    def __init__(self) -> None:
        self.next: int | None = None
        self.high: int | None = None
        self.seen = 0

    def forget(self) -> None:
        self.next = self.high = None

    def ahead(self, seq: int) -> int:
        """How far a sequence number lies past the boundary."""
        return ((seq - self.next + (1 << 31)) % (1 << 32)) - (1 << 31)

    def passed(self, seq: int, data: bytes, answers: bool, now: int) -> bool:
        """Whether a segment starts inside a known message. Its bytes behind the boundary, if any, move the boundary on."""
        if self.next is None:
            return False
        if now - self.seen > IDLE_MS:
            self.forget()
            return False
        gap = self.ahead(seq)
        if gap > 0 or gap == 0 and self.high is None:
            return False
        if rest := data[-gap:] if gap else data:
            carried = b"" if self.high is None else bytes([self.high])
            self.follow((self.next - len(carried)) % (1 << 32), carried + rest, answers, now)
        return True

    def consumed(self, seq: int, data: bytes, answers: bool, now: int) -> None:
        """A segment that nobody decoded still says where messages start."""
        if data and not self.passed(seq, data, answers, now) and (plausible(data) if self.next is None else self.next == seq):
            self.follow(seq, data, answers, now)

    def record(self, seq: int, data: bytes, other: bool, answers: bool, now: int) -> None:
        """Bytes from `seq` on start a message, unless they are of another protocol or, unannounced, do not look like one."""
        if answers and other:
            self.forget()
        elif self.next is not None and self.ahead(seq) <= 0 or plausible(data):
            self.follow(seq, data, answers, now)

    def follow(self, seq: int, data: bytes, answers: bool, now: int) -> None:
        """Walk the lengths in `data`. `answers`: only a response may start here, as any client may use this port."""
        known = self.next is not None
        if answers and not (data[4] & 0x80 if len(data) > 4 else known):
            return self.forget()
        at, self.high, self.seen = 0, None, now
        while at + 2 <= len(data):
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 12:  # no message: what came before it counts, if anything
                self.next = (seq + at) % (1 << 32) if at else None
                return None
            at += 2 + size
        if at + 1 == len(data):
            self.high, at = data[at], at + 1
        self.next = (seq + at) % (1 << 32)
        return None

    def covers(self, seq: int, data: bytes) -> bool:
        """Whether the first message of `data` is whole and behind the boundary."""
        size = int.from_bytes(data[:2], "big")
        return self.next is not None and 2 <= len(data) >= size + 2 and self.ahead((seq + size + 2) % (1 << 32)) <= 0


def plausible(data: bytes) -> bool:
    """Whether a length and a header stand here that a DNS message could have."""
    if len(data) < 14:
        return False
    size, _, high, low, questions, *records = struct.unpack(">HHBB4H", data[:14])
    response, opcode, rcode = high >> 7, high >> 3 & 15, low & 15
    fits = 12 + 5 * questions + 11 * sum(records) <= size
    return fits and opcode in (0, 1, 2, 4, 5, 6) and not low & 0x40 and rcode <= 11 and bool(response or not rcode and questions <= 1)


SEGMENT = "assembly string, ended string, evicted boolean, conflicting bigint"


def _segment_step(state: dict, row: dict) -> dict:
    seq, data, now, out = row["seq"], row["payload"] or b"", row["clock_ms"], {"conflicting": 0, "evicted": False}
    ports = (row["src_port"], row["dst_port"])
    is_dns, answers = 53 in ports, 53 in ports and ports[1] != 53
    boundary: Boundary = state.setdefault("boundary", Boundary())
    held: Direction | None = state.get("held")
    if seq is None:
        return out
    if is_dns:
        if row["syn"]:
            boundary.forget()
        elif held is None and boundary.passed(seq, data, answers, now):
            return out
    if held is None:
        own = payloads.sniff(data, True, *ports) or {}
        if "kind" in own:
            if is_dns:
                boundary.record(seq, data, not own["kind"].startswith("dns"), answers, now)
            return out | own

    def ignored() -> dict:
        if is_dns:
            boundary.consumed(seq, data, answers, now)
        return out

    if not data:
        return ignored()
    if held is not None and now - held.last > IDLE_MS:
        out["evicted"], held = True, None
    if held is None:
        held = state["held"] = Direction(seq, now)
    held.last = now
    if held.over:
        state["held"] = None
        return ignored()
    if now - held.first > DECIDE_MS:
        held.over, held.bytes, out["ended"] = True, Spans(), "abandoned"
        return ignored()
    at, extent = held.place(seq), (held.bytes.end() or held.base) - held.base
    if at < held.base and held.base - at + extent > STREAM_BYTES or at - held.base > STREAM_BYTES:
        return ignored()
    held.base = min(held.base, at)
    room = held.base + STREAM_BYTES - at
    new, out["conflicting"] = held.bytes.put(at, data[:room]) if room > 0 else (0, 0)
    if len(data) < row["declared"]:
        held.hole = min(at + len(data), at + len(data) if held.hole is None else held.hole)
    if len(data) > room:
        held.over, out["ended"] = True, "abandoned"
    elif not new:
        return ignored()
    status, prefix = held.status(), held.prefix()
    cut = row.get("cut_ms")
    if status == MISSING and cut is not None and now - cut <= CUT_MS:
        status = TRUNCATED
    found = payloads.sniff(prefix, True, *ports) or {}
    base = (held.origin + held.base) % (1 << 32)
    if is_dns:
        boundary.record(base, prefix, "kind" in found and not found["kind"].startswith("dns"), answers, now)
        if len(prefix) >= STREAM_BYTES:
            boundary.passed(seq, data, answers, now)
        if not found and boundary.covers(base, prefix):
            state["held"], out["ended"] = None, status
    if "kind" in found:
        state["held"], out["ended"] = None, status
    return out | {"assembly": status} | found


def desegmented(segments: DataFrame, key: list[str], order: str = "ordinal", keep: list[str] | None = None) -> DataFrame:
    """segments with `app`: what each segment decided, alone or with what was held of its direction before.

    segments: key (a flow and its direction), clock_ms, seq, payload, declared (payload length by the headers), syn, src_port,
    dst_port, and cut_ms where known (see `cut_clock`). `assembly` says how complete the bytes are;
    a segment that decides with nothing held has none. A direction
    is held for 2 s and 16 KiB at most; it is dropped after 30 s of silence. `ended`: completeness of what was decided, or
    abandoned; `conflicting`: bytes that contradict those held; `need`: more bytes that could decide, at least. With `keep`
    only those columns of the segments come back.
    """
    fields = StructType.fromDDL(f"{SEGMENT}, {payloads.APP}")
    reads = ["clock_ms", "seq", "payload", "declared", "syn", "src_port", "dst_port", *(c for c in ("cut_ms",) if c in segments.columns)]
    return fold(segments, key, [order], dict, _segment_step, "app", fields.simpleString(), reads, keep)


def counters(results: DataFrame, column: str) -> DataFrame:
    """One row: how many results were whole, truncated, missing, abandoned, evicted, and the bytes that contradicted others."""
    at = lambda c: F.col(f"{column}.{c}")
    ended = lambda s: F.count_if(at("ended") == s)
    held = results.schema[column].dataType.fieldNames()
    expired: Column = at("expired").isNotNull() if "expired" in held else at("evicted")
    sums = [ended(WHOLE).alias("completed"), ended(TRUNCATED).alias("incomplete_truncated"), ended(MISSING).alias("incomplete_missing"), ended("abandoned").alias("abandoned"), F.count_if(expired).alias("evicted_idle"),
            F.coalesce(F.sum(at("conflicting")), F.lit(0)).alias("conflicting_bytes")]
    if "forged_end" in held:
        sums.append(F.count_if(at("forged_end")).alias("forged_ends"))
    return results.agg(*sums)
