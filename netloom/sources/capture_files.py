"""Captures of any size: files split at block boundaries for reading, and a sink that rotates and publishes whole files only.

`read` works in two steps of tasks: one walks the block lengths of each file and cuts it into ranges, noting what a range needs
to be read alone (byte order, interfaces, the number of its first packet); the other parses ranges. `CaptureSource` offers
the same as `spark.read.format("capture")`, there with the walk in its planning step, and writing with `df.write`.
Files are opened through pyarrow, which knows local folders, HDFS, S3 and GCS.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from netloom.sources import captures
from netloom.sources.captures import CaptureError

SPLIT_BYTES = 64 << 20
RANGES = "path string, start long, stop long, ordinal long, state string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; `file:/x` as Spark writes it counts as local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def ranges(path: str, split_bytes: int = SPLIT_BYTES) -> Iterator[tuple[str, int, int, int, str]]:
    """(path, start, stop, ordinal, state) of ranges of about split_bytes, each of whole blocks; raises where the file is cut off."""
    system, inner = opened(path)
    size = system.get_file_info(inner).size
    with system.open_input_file(inner) as raw:
        file = io.BufferedReader(raw, 1 << 20)
        first = file.read(4)
        walk = _walk_pcapng if first == b"\n\r\r\n" else _walk_pcap
        start, ordinal, state, count = None, 0, "", 0
        for at, packets, now in walk(file, first, size):
            if start is None or at - start >= split_bytes:
                if start is not None:
                    yield path, start, at, ordinal, state
                start, ordinal, state = at, count, json.dumps(now)
            count += packets
        if start is not None:
            yield path, start, size, ordinal, state


def _walk_pcap(file: io.BufferedReader, first: bytes, size: int) -> Iterator[tuple[int, int, dict]]:
    order = next((o for o in "<>" if len(first) == 4 and struct.unpack(o + "I", first)[0] in captures.PCAP), None)
    if order is None:
        raise CaptureError("neither pcap nor pcapng")
    if size < 24:
        raise CaptureError("partial file header")
    file.seek(20)
    state = {"order": order, "tick": captures.PCAP[struct.unpack(order + "I", first)[0]], "link": struct.unpack(order + "I", file.read(4))[0] & 0xFFFF}
    at = 24
    while at < size:
        head = file.read(16)
        end = at + 16 + (struct.unpack_from(order + "I", head, 8)[0] if len(head) == 16 else size)
        if end > size:
            raise CaptureError(f"partial record at {at}")
        yield at, 1, state
        at = end
        file.seek(at)


def _walk_pcapng(file: io.BufferedReader, first: bytes, size: int) -> Iterator[tuple[int, int, dict]]:
    at, state = 0, {"order": "<", "faces": []}
    while at < size:
        file.seek(at)
        head = file.read(12)
        if len(head) < 12:
            raise CaptureError(f"partial block at {at}")
        if head[:4] == b"\n\r\r\n":
            state = {"order": "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">", "faces": []}
        kind, length = struct.unpack_from(state["order"] + "2I", head)
        if length < 12 or length % 4 or length > captures.MAX_BLOCK or at + length > size:
            raise CaptureError(f"bad block length {length} at {at}")
        yield at, int(kind == captures.PACKET), state
        if kind == captures.INTERFACE:
            body = (head[8:] + file.read(length - 16))[: length - 12]
            state = {"order": state["order"], "faces": [*state["faces"], captures._interface(body, state["order"])]}
        at += length


def packets_of(path: str, start: int, stop: int, ordinal: int, state: str) -> Iterator[tuple]:
    """The rows of `captures.SCHEMA` in one range."""
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        data = file.read(stop - start)
    held = json.loads(state)
    if "faces" in held:
        found = captures._pcapng(data, held["order"], [tuple(f) for f in held["faces"]])
    else:
        found = captures._pcap(b"\0" * 20 + struct.pack(held["order"] + "I", held["link"]) + data, held["order"], held["tick"])
    for i, (ts, way, link, wire, frame) in enumerate(found):
        yield path, ordinal + i, ts, way, link, len(frame), wire, frame


NAMES = [c.split()[0] for c in captures.SCHEMA.split(", ")]


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, batch: int = 5000) -> DataFrame:
    """All packets of the captures at `path` (files, folders or globs that Spark can list), in capture order by (path, ordinal)."""

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name in files["path"]:
                yield pd.DataFrame(list(ranges(name, split_bytes)), columns=[c.split()[0] for c in RANGES.split(", ")])

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for part in some.itertuples(index=False):
                held = []
                for row in packets_of(*part):
                    held.append(row)
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=NAMES)
                        held = []
                yield pd.DataFrame(held, columns=NAMES)

    files = spark.read.format("binaryFile").load(path).select("path")  # only listed: contents are not read here
    parts = files.repartition(F.xxhash64("path")).mapInPandas(walked, RANGES)
    return parts.repartition(F.xxhash64("path", "start")).mapInPandas(parsed, captures.SCHEMA)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int
    ordinal: int
    state: str


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Part]:
        system, inner = opened(self.path)
        info = system.get_file_info(inner)
        chosen = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        names = sorted(f.path for f in chosen if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(inner).split("/")))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        with ThreadPoolExecutor(8) as pool:
            return [Part(*r) for found in pool.map(lambda n: list(ranges(n, self.split_bytes)), names) for r in found]

    def read(self, partition: Part) -> Iterator[tuple]:
        return packets_of(partition.path, partition.start, partition.stop, partition.ordinal, partition.state)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CaptureWriter(DataSourceWriter):
    """Each task writes files of its own under a folder of the job; they get their names when the whole job commits."""

    def __init__(self, path: str, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        limit = lambda name: int(options[name.lower()]) if name.lower() in options else None
        self.max_bytes, self.max_packets, self.max_seconds = limit("maxBytes"), limit("maxPackets"), limit("maxSeconds")
        self.link_type, self.job = int(options.get("linktype", 1)), uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, inner = opened(self.path)
        context, files, file = TaskContext.get(), [], None
        folder = f"{inner}/_temporary-{self.job}/{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        system.create_dir(folder, recursive=True)

        def close() -> None:
            file.write(captures.statistics_block(newest, count, 0))
            file.close()

        for row in iterator:
            ts = row["ts_ns"]
            full = file is not None and (
                self.max_bytes is not None and size >= self.max_bytes or self.max_packets is not None and count >= self.max_packets or self.max_seconds is not None and ts - first >= self.max_seconds * 10**9)
            if full:
                close()
            if file is None or full:
                name = f"capture-{self.job}-{context.partitionId():05d}-{len(files):05d}.pcapng"
                files.append((f"{folder}/{name}", f"{inner}/{name}"))
                file, size, count, first, newest = system.open_output_stream(files[-1][0]), 0, 0, ts, ts
                file.write(captures.head(self.link_type))
            block = captures.packet_block(ts, row["direction"], row["wire_len"], bytes(row["frame"]))
            file.write(block)
            size, count, newest = size + len(block), count + 1, max(newest, ts)
        if file is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        if self.overwrite:
            held = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            for old in (f.path for f in held if f.type == fs.FileType.File and f.extension == "pcapng"):
                system.delete_file(old)
        for message in messages:
            for made, name in message.files if message else []:
                system.move(made, name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = opened(self.path)
        folder = f"{inner}/_temporary-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class CaptureSource(DataSource):
    """`capture`: options path, splitBytes; for writing maxBytes, maxPackets, maxSeconds (of packet time) and linkType."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return captures.SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], {k.lower(): v for k, v in self.options.items()}, overwrite)


def write(packets: DataFrame, path: str, mode: str = "append", **limits: int) -> None:
    """packets (ts_ns, direction, wire_len, frame) as pcapng files, rotated by maxBytes, maxPackets or maxSeconds; order them within partitions first."""
    packets.sparkSession.dataSource.register(CaptureSource)
    columns = [f.split() for f in captures.SCHEMA.split(", ")]
    held = [F.col(n).cast(t).alias(n) if n in packets.columns else F.lit(None).cast(t).alias(n) for n, t in columns]
    packets.select(*held).write.format("capture").mode(mode).options(**{k: str(v) for k, v in limits.items()}).save(path)
