"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole
records, followed by a seek table in a skippable frame (the public seekable
format: a size pair for each frame, then the frame count, a descriptor byte and
a magic number). The index maps a record to bundle, frame and the offset inside
the decompressed frame, so one record costs one seek and one small frame.

Each task writes its own bundles into a new folder below the shared folder; a
task that runs again writes under new names, and only the index, written once,
says which bundles count. Bundles close at ``BUNDLE_BYTES``.

Records follow WARC 1.1: each has an id of its own (a random UUID), the time of
writing, and a payload digest; a revisit names the URI and time of the record it
revisits. ``X-`` fields carry the page ids, the length of a payload that isn't
stored, and a URI that has characters which a field can't hold.

Defined cases: a null html is an empty payload, of any size whole in one record;
records with equal payloads of at least ``MIN_REVISIT`` bytes revisit the
smallest page_id (null ids come last), and a row that repeats that page_id is a
response too; a null or empty url gives no URI; an empty table writes nothing and
reads back as an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize, new_path, worker_imports
from tidebook.llm.tables import read, small_side

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Neighbouring frames that one task reads.
FRAMES = 64
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def _location(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class BundleWriter:
    """Writes frames as they fill; keeps two integers for each frame."""

    def __init__(self, out, level: int = 3):
        self.out, self.held, self.size, self.frames, self.bytes = out, [], 0, [], 0
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.bytes += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access by frame through the seek table at the end."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * count)
        pairs = struct.unpack(f"<{2 * count}I", file.read(8 * count))
        self.sizes = list(zip(pairs[::2], pairs[1::2], strict=True))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.now, self.data, self.unpack = -1, b"", zstandard.ZstdDecompressor()

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.now:
            self.file.seek(self.starts[frame])
            packed, plain = self.sizes[frame]
            self.now, self.data = frame, self.unpack.decompress(self.file.read(packed), max_output_size=plain)
        return self.data[offset : offset + length]


def record_bytes(page_id, url, payload: bytes, digest: str, at: str, first=None, first_url=None) -> bytes:
    """One WARC record; ``first`` is the page that a revisit refers to."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {at}"]
    if url:
        head.append(f"WARC-Target-URI: {_field(url)}")
        if _field(url) != url:
            head.append(f"X-URI: {json.dumps(url)}")
    head += ["Content-Type: text/html", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [] if page_id is None else [f"X-Page: {page_id}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {at}", f"X-Refers-To-Page: {first}"]
        head += [f"WARC-Refers-To-Target-URI: {_field(first_url)}"] if first_url else []
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _field(url: str) -> str:
    """A URL whose spaces and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), url)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages (page_id, url, html) to bundles in ``folder``; the index."""
    spark = pages.sparkSession
    worker_imports(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = keyed.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
    copies = materialize(groups.where("n > 1").select("digest", "first", "first_url"), "copies")
    at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    planned = keyed.join(small_side(copies), "digest", "left").withColumn("first", F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first")))

    def write(batches):
        store, root = _location(folder)
        store.create_dir(root, recursive=True)
        bundle, name, rows = None, "", []
        for pdf in batches:
            for page, url, payload, digest, first, first_url in pdf[["page_id", "url", "payload", "digest", "first", "first_url"]].itertuples(index=False, name=None):
                if bundle is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                page, first = None if pd.isna(page) else int(page), None if pd.isna(first) else int(first)
                data = record_bytes(page, url, bytes(payload), digest, at, first, first_url)
                rows.append((page, name, *bundle.add(data), len(data)))
                if bundle.bytes >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pd.DataFrame(rows, columns=["page_id", "bundle", "frame", "offset", "length"]).astype({"page_id": "Int64"})
            rows = []
        if bundle is not None:
            bundle.close()

    return materialize(planned.mapInPandas(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Fetch each indexed record by its offset; a row for each with what it says."""
    worker_imports(index.sparkSession)

    def fetch(batches):
        store, root = _location(folder)
        name, reader = None, None
        for pdf in batches:
            rows = []
            for bundle, frame, offset, length in pdf[["bundle", "frame", "offset", "length"]].itertuples(index=False, name=None):
                if bundle != name:
                    if reader is not None:
                        reader.file.close()
                    name, reader = bundle, BundleReader(store.open_input_file(f"{root}/{bundle}"))
                head, body = parse_record(reader.record(frame, offset, length))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"damaged record in {bundle}")
                ids = [int(head[k]) if k in head else None for k in ("X-Page", "X-Refers-To-Page")]
                url = json.loads(head["X-URI"]) if "X-URI" in head else head.get("WARC-Target-URI")
                rows.append((ids[0], int(head["X-Payload-Length"]), digest, kind, ids[1], url))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    # a number of its own, so that the small index isn't folded into one task that reads all archives
    bundles = max(1, index.select("bundle").distinct().count())
    ordered = index.repartition(4 * bundles, "bundle", F.floor(F.col("frame") / FRAMES)).sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInPandas(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def bundle_bytes(frames: list[list[bytes]]) -> bytes:
    """A bundle in memory, for small archives and tests."""
    out = io.BytesIO()
    out.close = lambda: None
    writer = BundleWriter(out)
    for frame in frames:
        for record in frame:
            writer.add(record)
        writer.flush()
    writer.close()
    return out.getvalue()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f IS NOT NULL AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM r
""",
}
