"""WARC bundles in seekable Zstandard: records grouped into independent frames, a footer seek table, a record index.

Each task writes bundles of bounded size to the shared folder. A frame holds whole records of about `frame_bytes`; the
footer is the public seekable-format table (frame sizes, compressed and plain). The index maps a record id to its bundle,
frame number and offset inside the plain frame, so one record is read by one ranged read and one small decompression.
Bundle names are drawn anew by each attempt of a task and the index lists only those of attempts that counted, so a lost
executor leaves at most an orphan file.

Edge cases: null html is an empty payload; of equal payloads the smallest id is the response and the others revisits of
it; rows that repeat a page_id with an equal payload are alike, record id included; rows with a null id are written without
a page id and are never what others refer to; ids keep all 64 bits; an empty table writes nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, shared_dir

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    """A response's id follows from its page and payload, so that revisits elsewhere can name it; a page without an id gets a random one."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit has no block; it names the response, its digest and the payload's length."""
    kind, digest = "response" if refers_to is None else "revisit", digest_of(payload)
    name = _record_id(page_id, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    def __init__(self, path: str) -> None:
        self.path, self.frames, self.at = path, [], 0
        self.store, self.name = _store(path)
        self.out = self.store.open_output_stream(self.name + ".part")

    def frame(self, plain: bytes) -> tuple[int, int, int]:
        packed = zstandard.ZstdCompressor(level=3).compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.at += len(packed)
        return len(self.frames) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.store.move(self.name + ".part", self.name)


def seek_table(path: str) -> list[tuple[int, int]]:
    """(offset, size) of each frame, from the footer alone."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        end = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        assert magic == SEEKABLE
        sizes = [x[0] for x in struct.iter_unpack("<II", f.read_at(8 * n, end - 9 - 8 * n))]
    out, at = [], 0
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def write_bundles(pages: DataFrame, folder: str | None = None, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20) -> DataFrame:
    """Write all pages and return the index, one row per record."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, name = _store(folder)
    store.create_dir(name, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url" if "url" in pages.columns else F.lit(None).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("key"))
    again = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = keyed.join(cut(again.select("key", "first"), "repeated"), "key", "left")
    # Nulls travel as flags beside 0: in a pandas column with a null, 64-bit ids would become rounded floats.
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = marked.select(F.col("page_id").isNotNull().alias("named"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "url", "html", again.alias("again"), F.coalesce("first", F.lit(0)).alias("first"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, waiting, done = None, bytearray(), [], []

        def flush() -> None:
            nonlocal held, waiting
            if waiting:
                frame, at, size = out.frame(bytes(held))
                done.extend((p, out.path, frame, at, size, a, n) for p, a, n in waiting)
                held, waiting = bytearray(), []

        def close() -> Iterator[pd.DataFrame]:
            nonlocal out, done
            flush()
            out.close()
            yield pd.DataFrame({x.split()[0]: pd.array([r[i] for r in done], "Int64") if i == 0 else [r[i] for r in done] for i, x in enumerate(INDEX.split(", "))})
            out, done = None, []

        for rows in batches:
            for named, page_id, url, html, again, first in rows.itertuples(index=False):
                out = out or BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                page = int(page_id) if named else None
                raw = record(page, url, html.encode("utf-8", "surrogatepass"), int(first) if again else None, date)
                waiting.append((page, len(held), len(raw)))
                held += raw
                if len(held) >= frame_bytes:
                    flush()
                if out.at >= bundle_bytes:
                    yield from close()
        if out:
            yield from close()

    return cut(marked.mapInPandas(write, INDEX), "index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Read whole bundles by their seek tables: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    bundles = index.select("bundle").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(x) if x else None
        for rows in batches:
            for path in rows["bundle"]:
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    for at, size in seek_table(path):
                        found = []
                        for h, block in records(zstandard.ZstdDecompressor().decompress(f.read_at(size, at))):
                            said, length = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                            if h["WARC-Type"] == "response" and (digest_of(block), len(block)) != (said, length):
                                raise ValueError(f"damaged record {h['WARC-Record-ID']} in {path}")
                            found.append((number(h.get("X-Page-ID")), length, said, h["WARC-Type"], number(h.get("X-Refers-To-Page"))))
                        columns = dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), map(list, zip(*found, strict=True)), strict=True))
                        yield pd.DataFrame(columns | {c: pd.array(columns[c], "Int64") for c in ("page_id", "refers_to")})

    spread = bundles.repartition(max(1, min(bundles.count(), 100_000)))
    return spread.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """(page_id, record): single records, each by one ranged read of its frame."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                store, name = _store(r.bundle)
                with store.open_input_file(name) as f:
                    out.append(zstandard.ZstdDecompressor().decompress(f.read_at(r.frame_bytes, r.frame_at))[r.at : r.at + r.bytes])
            yield pd.DataFrame({"page_id": rows["page_id"], "record": out})

    return index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi").mapInPandas(read, "page_id long, record binary")


def digest(pages: DataFrame) -> DataFrame:
    return read_bundles(write_bundles(pages))
