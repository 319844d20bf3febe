"""WARC archives: records, whole-file gzip archives, their normal form and an offset index.

``records`` decides which page's payload is stored and which pages only refer to it;
``write_archives`` writes one gzip stream per archive; ``normalise`` inflates such a stream once,
writes every record as a gzip member of its own and a sidecar index of their offsets;
``read_members`` fetches records by that index. All folders are reached through pyarrow's file
systems, so they may lie in any store that it knows.

Defined cases: a null html is an empty payload; pages that share the smallest page_id and the
payload are all stored (they are the same record twice); null ids come after all others, and a
payload that only has pages without id is stored with each. Long payloads lie whole in one record.
An empty table gives no archive. Other columns are ignored.

A task may run again: every attempt writes files under names of its own, and only those that a
finished attempt has reported in the stored manifest are read on.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import drop_folder, shared_dir, small_batches, stored, text_of

ARCHIVES = "archive string, n_records long"
NORMAL = "archive string, index string, n_records long"
MEMBERS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK = 1 << 20


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """Pages with ``refers_to``: the smallest page_id of an equal payload of at least
    ``least_bytes``, or null where the page's own payload is stored.

    Payloads that occur once have no row in the counted side, which is aggregated before its
    shuffle and stored: so both sides of the join come from exchanges of its own, and a payload
    shared by very many pages is split by Spark's skew join.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), text_of(url).alias("url"),
        text_of(html).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    shared = stored(
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("sha1", "first_id")
    )
    first = F.when(F.octet_length("html") >= least_bytes, F.col("first_id"))
    again = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return rows.join(shared, "sha1", "left").select(
        "page_id", "url", "html", F.when(again, first).alias("refers_to"))


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:")
                                            else f"file://{folder}")
    return system, path


def _record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload if refers_to is None else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Target-URI: {url.encode('unicode_escape').decode()}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write records as whole-file gzip archives of about ``archive_bytes`` uncompressed bytes;
    the manifest of the archives, lazily: storing it does the work."""
    small_batches(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        out, squeeze, name, size, n = None, None, "", 0, 0

        def finish() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return _batch([(name, n)], ARCHIVES)

        for batch in batches:
            for key, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(name, compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = _record(key, url, html.encode(), refers)
                out.write(squeeze.compress(record))
                size, n = size + len(record), n + 1
                if size >= archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, ARCHIVES)


def inflate(stream) -> Iterator[bytes]:
    """The uncompressed bytes of a gzip stream of one or many members, a chunk at a time."""
    engine = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield engine.decompress(data)
            data = b""
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an uncompressed WARC stream into records by their stated lengths."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        at = held.find(b"\r\n\r\n")
        while at < 0:
            seen = len(held)
            if not need(seen + 1):
                raise ValueError("a record ends within its header")
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
        end = at + 4 + int(_headers(bytes(held[:at]))["content-length"]) + 4
        if not need(end):
            raise ValueError("a record ends within its block")
        yield bytes(held[:end])
        del held[:end]


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives record by record, one gzip member each, with a sidecar offset index."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name, offset, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                side = f"{name}.idx"
                with system.open_input_stream(source, compression=None) as stream, \
                        system.open_output_stream(name, compression=None) as out, \
                        system.open_output_stream(side, compression=None) as index:
                    for record in split_records(inflate(stream)):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        line = {"offset": offset, "length": len(member)}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield _batch([(name, side, n)], NORMAL)

    n = manifest.count()
    return manifest.select("archive").repartition(max(1, n)).mapInArrow(rewrite, NORMAL)


def read_members(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of normalised archives, each fetched by its place in the sidecar index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for name, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
                with system.open_input_stream(side, compression=None) as lines, \
                        system.open_input_file(name) as file:
                    rows, size = [], 0
                    for line in io.TextIOWrapper(lines, encoding="utf-8"):
                        place = json.loads(line)
                        file.seek(place["offset"])
                        rows.append(_parse(zlib.decompress(file.read(place["length"]), 31)))
                        size += len(rows[-1][-1] or b"")
                        if len(rows) == 500 or size > _CHUNK:
                            yield _batch(rows, MEMBERS)
                            rows, size = [], 0
                    yield _batch(rows, MEMBERS)

    n = manifest.count()
    return manifest.select("archive", "index").repartition(max(1, n)).mapInArrow(read, MEMBERS)


def _id(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "None"
    return None if value == "None" else int(value)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    stays = fields["warc-type"] == "response"
    if stays and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
    return (_id(fields["warc-record-id"]),
            fields["warc-target-uri"].encode().decode("unicode_escape"), fields["warc-type"],
            _id(fields.get("warc-refers-to")), int(fields["x-payload-length"]), digest,
            payload if stays else None)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, normalise them and read them back."""
    spark = pages.sparkSession
    raw, tidy = shared_dir(spark), shared_dir(spark)
    written = stored(write_archives(records(pages, least_bytes=least_bytes), raw))
    kept = stored(normalise(written, tidy))
    drop_folder(spark, raw)
    return read_members(kept, tidy)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields])
