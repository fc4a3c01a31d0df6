"""WARC archives as seekable Zstandard bundles (operator 8).

A bundle holds WARC/1.1 records in independent Zstandard frames of about FRAME_BYTES and ends in the seek table of the
seekable format: a skippable frame with each frame's compressed and decompressed size. A second file maps each record's id
to its frame, its place in the decompressed frame and its length, so one record costs one frame.

Payloads of REVISIT_BYTES and more that are equal are stored once: the record with the largest page id is the response, the
others are revisit records without a payload, which name it. Only digests meet in a shuffle, aggregated before it; a payload that a
third of all pages have is one row there. Digests that repeat are told to all tasks and each task bundles the pages it reads, so no
payload is shuffled. Where more than TOLD digests repeat, those of the most pages are told, and pages of the others meet theirs in a
join; pages that have what they need are dealt at random there.

A task writes bundles under names of its own attempt and tells which it wrote; these make the manifest, and only what it names is
read, by the records' index. So a task that is repeated, in whatever order it reads its rows, leaves nothing that counts twice.

Results: a null html is an empty payload. Rows of the largest id are responses all, if the id repeats; their records have one id, and
lookup() finds the first. A null page id is smaller than any other and is kept; a null url has no target header. An empty table makes
no bundle. A record of more than BUNDLE_BYTES is a bundle of its own or ends one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fetch, scratch, upload, written

REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
#: Bytes of records in a bundle, which ends with the record that passes it.
BUNDLE_BYTES = 32 << 20
LEVEL = 3
#: Repeated digests that are told to all tasks.
TOLD = 500_000
#: Fixed values of the seekable format: magic numbers of skippable frames and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: WARC dates must not depend on the clock.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no block; its payload's size and digest are in the header."""
    block = b"" if refers_to is not None else payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", "".join(url.split()))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    found = name.strip("<>").rpartition(":")[2]
    return None if found == "null" else int(found)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place behind it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(fields["Content-Length"])
    return fields, data[start : start + size], start + size + 4


class Bundle:
    """Collects records; finish() gives the archive and its index."""

    def __init__(self):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.index: list[tuple[str, int, int, int]] = []
        self.bytes = 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), len(self.open), len(data)))
        self.open += data
        self.bytes += len(data)
        if len(self.open) >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            self.frames.append(self.compressor.compress(bytes(self.open)))
            self.sizes.append((len(self.frames[-1]), len(self.open)))
            self.open = bytearray()

    def finish(self) -> tuple[bytes, bytes]:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        index = "".join(f"{name}\t{frame}\t{at}\t{size}\n" for name, frame, at, size in self.index)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, index.encode()


class Archive:
    """Reads a bundle by its seek table."""

    def __init__(self, data: bytes):
        import zstandard

        n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9]))
        self.data, self.starts, self.sizes = data, [0], sizes
        for size, _ in sizes:
            self.starts.append(self.starts[-1] + size)
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.decompressor.decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=self.sizes[k][1])

    def records(self, index: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records, by their index; each frame is decompressed once."""
        now, data = -1, b""
        for _, frame, at, size in entries(index):
            if frame != now:
                now, data = frame, self.frame(frame)
            fields, block, end = parse(data, at)
            if end - at != size:
                raise ValueError(f"no record of {size} bytes at {at} of frame {frame}")
            yield fields, block

    def lookup(self, index: bytes, name: str) -> tuple[dict[str, str], bytes]:
        """The (first) record with an id: one frame is decompressed."""
        for found, frame, at, _ in entries(index):
            if found == name:
                fields, block, _ = parse(self.frame(frame), at)
                return fields, block
        raise KeyError(name)


def entries(index: bytes) -> Iterator[tuple[str, int, int, int]]:
    """Of each record its id, frame, place in the decompressed frame and size."""
    for line in index.decode().splitlines():
        name, frame, at, size = line.rsplit("\t", 3)
        yield name, int(frame), int(at), int(size)


def _linked(rows: DataFrame) -> DataFrame:
    """rows with refers_to, the largest page of those with the same payload where it is another one."""
    many = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page").alias("largest")).where("n > 1")
    many = written(many, "repeated-payloads")
    digests, pages = many.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    border = 0 if digests <= TOLD else pages // TOLD
    told = many.where(F.col("n") > border).drop("n")
    out = rows.join(F.broadcast(told), ["digest", "size"], "left")
    if border:
        rest = many.where(F.col("n") <= border).select(F.col("digest").alias("of"), F.col("size").alias("of_size"), F.col("largest").alias("other"))
        done = F.col("largest").isNotNull() | (F.col("size") < REVISIT_BYTES)
        of = F.when(done, F.concat(F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit("")))).otherwise(F.col("digest"))
        out = out.withColumn("of", of).withColumn("of_size", F.col("size")).join(rest, ["of", "of_size"], "left").withColumn("largest", F.coalesce("largest", "other"))
    return out.select("page", "url", "html", "digest", F.when(~F.col("page").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Writes bundles and their indexes to a new shared folder. Gives its path and the manifest: bundle and records."""
    spark = pages.sparkSession
    to = scratch(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.sha1(F.encode(html, "UTF-8"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), html.alias("html"), digest.alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, bundle, own = TaskContext.get().partitionId(), 0, Bundle(), uuid.uuid4().hex

        def flush() -> pa.RecordBatch:
            nonlocal bundle, count
            name = f"{task:08d}-{count:06d}-{own}"
            data, index = bundle.finish()
            upload(f"{to}/index/{name}.tsv", index)
            upload(f"{to}/{name}.warc.zst", data)
            done = len(bundle.index)
            bundle, count = Bundle(), count + 1
            return pa.RecordBatch.from_pydict({"bundle": [name], "records": [done]}, schema=pa.schema([("bundle", pa.string()), ("records", pa.int64())]))

        for b in batches:
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                bundle.add(_name(page), record(page, url, html.encode(), digest, refers_to))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield flush()
        if bundle.index:
            yield flush()

    return to, written(_linked(rows).mapInArrow(run, "bundle string, records bigint"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the bundles that the manifest names: page_id, url, html (null in revisits), payload_bytes, payload_digest,
    record_type, refers_to. Digests of payloads that are there are computed anew and must agree."""
    schema = "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index, rows = fetch(f"{folder}/index/{bundle}.tsv"), []
                for fields, block in Archive(fetch(f"{folder}/{bundle}.warc.zst")).records(index):
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    refers_to = _id(fields["WARC-Refers-To"]) if revisit else None
                    rows.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), None if revisit else block.decode(), int(fields["WARC-Payload-Length"]) if revisit else len(block), digest, fields["WARC-Type"], refers_to))
                    records -= 1
                    if len(rows) >= 2000:
                        yield _batch(rows, kinds)
                        rows = []
                if records:
                    raise ValueError(f"{bundle} has {records} records fewer than were written")
                if rows:
                    yield _batch(rows, kinds)

    # a bundle is much work for a short row: each core gets some
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("bundle", "records").repartition(n).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
