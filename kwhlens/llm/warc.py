"""WARC archives: writing pages, reading records, and assembling transactions.

Each page becomes a request, a response (or, for a payload that an earlier page
has, a revisit) and a metadata record; request and metadata name the response
by ``WARC-Concurrent-To``.  Archives are gzip members per record in the shared
folder, one set of files per partition.  Reading streams record by record, so a task
holds one record's payload at a time.  Assembly joins the records of a capture
through their concurrent-to identifiers, whichever of them points to which,
and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhlens.llm.shared_files import AtomicFile, open_folder
from kwhlens.session import Scratch

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes after which a partition begins a new archive.
FILE_BYTES = 256 << 20
#: Revisits (page_id, digest and the response's page_id) broadcast at most.
BROADCAST_ROWS = 200_000
RECORD_SCHEMA = ("record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, "
                 "stated_digest string, content_type string, payload binary, payload_bytes long, payload_digest string")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# ------------------------------------------------------------------ writing
def record(kind: str, record_id: str, uri: str, block: bytes, content_type: str, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, **{
        k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    return zlib.compress(data, 1, 31)


def _clean(url: str | None) -> str:
    """A URL fit for a header line."""
    return "".join(c for c in url or "" if c.isprintable()).strip()


def _records(name: str, n: int, page_id, url, html, first) -> Iterator[bytes]:
    uri, payload = _clean(url), (html or "").encode("utf-8", "surrogatepass")
    main, ask, about = (f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}/{k}').urn}>" for k in ("main", "ask", "about"))
    path, host = uri.split("://", 1)[-1], uri.split("://", 1)[-1].split("/", 1)[0]
    path = "/" + path.split("/", 1)[1].split("#", 1)[0] if "/" in path else "/"
    yield record("request", ask, uri, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
                 "application/http; msgtype=request", WARC_Concurrent_To=main)
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    if first is None:
        yield record("response", main, uri, head + payload, "application/http; msgtype=response",
                     WARC_Payload_Digest=f"sha1:{digest(payload)}")
    else:
        yield record("revisit", main, uri, head, "application/http; msgtype=response",
                     WARC_Profile=REVISIT_PROFILE, WARC_Payload_Digest=f"sha1:{digest(payload)}")
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n"
    yield record("metadata", about, uri, fields.encode(), "application/warc-fields", WARC_Concurrent_To=main)


def _write_map(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        part, k, files, rows, n = TaskContext.get().partitionId(), 0, [], [], 0
        stream = (r for batch in batches for lo in range(0, len(batch), 256)
                  for r in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)))
        row = next(stream, None)
        while row is not None:
            name, size = f"part-{part:06d}-{k:04d}.warc.gz", 0
            with AtomicFile(system, f"{path}/{name}") as out:
                out.write(member(record("warcinfo", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>", "",
                                        f"format: {VERSION}\r\n".encode(), "application/warc-fields",
                                        WARC_Filename=name)))
                while row is not None and size < file_bytes:
                    for r in _records(name, n, *row):
                        size += len(r)
                        out.write(member(r))
                    n += 1
                    row = next(stream, None)
            files.append(name)
            rows.append(n)
            k += 1
        yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "pages": pa.array(rows, pa.int64())})

    return run


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes a capture per row into ``folder`` and returns the names of the archives.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id
    is the response (and rows that repeat it); the others revisit it.  Null html is an empty payload, a
    null url an absent target.  A row without page_id revisits a page that has one,
    else is a response.  Other columns are not read; an empty table gives no archive.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    scratch = Scratch(pages.sparkSession, "revisits")
    keys = base.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    again = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and first is not null").select("digest", "first")
    # the pairs are few bytes each, so the html itself moves only if they are too many to broadcast
    revisits = scratch.table(
        keys.join(again, "digest").where("not (page_id <=> first)").select("page_id", "digest", "first").distinct(), "r")
    few = revisits.count() <= BROADCAST_ROWS
    r = (F.broadcast(revisits) if few else revisits).alias("r")
    ready = base.alias("p").join(
        r, F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left").select("p.page_id", "url", "html", "first")
    if not few:  # rows come in any order from a shuffle; a retried task must write the same files
        ready = ready.sortWithinPartitions("page_id", "url", "html")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return sorted(x.file for x in ready.mapInArrow(_write_map(folder, file_bytes), "file string, pages long").collect())


# ------------------------------------------------------------------ reading
class _Bytes:
    """Plain bytes of an archive, gzip members joined, read on demand."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed, self.held = stream, packed, bytearray()
        self.z = zlib.decompressobj(31) if packed else None
        self.over = False

    def _more(self) -> None:
        data = self.stream.read(1 << 20)
        if not data:
            self.over = True
            return
        while data:
            if not self.packed:
                self.held += data
                return
            self.held += self.z.decompress(data)
            data = self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, which is passed; None at the end."""
        seen = 0
        while True:
            at = self.held.find(mark, max(0, seen - len(mark)))
            if at >= 0:
                out = bytes(self.held[:at])
                del self.held[: at + len(mark)]
                return out
            seen = len(self.held)
            if self.over:
                return None
            self._more()

    def take(self, n: int) -> bytes:
        while len(self.held) < n and not self.over:
            self._more()
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(stream, packed: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; the length counts, not what the block holds.

    Of ``WARC-Concurrent-To``, the one field that may be repeated, all values are kept, a line each.
    """
    data = _Bytes(stream, packed)
    while (head := data.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            key, value = key.strip().lower(), value.strip()
            fields[key] = f"{fields[key]}\n{value}" if key == "warc-concurrent-to" and key in fields else value
        block = data.take(int(fields.get("content-length", 0)))
        data.take(4)
        yield fields, block


def _read_map(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in parse(stream, name.endswith(".gz")):
                        payload = block
                        if head.get("content-type", "").startswith("application/http"):
                            payload = block.partition(b"\r\n\r\n")[2]
                        rows.append({
                            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
                            "concurrent_to": head.get("warc-concurrent-to", "").split(), "target_uri": head.get("warc-target-uri"),
                            "date": head.get("warc-date"),
                            "stated_digest": head.get("warc-payload-digest", "").partition(":")[2] or None,
                            "content_type": head.get("content-type"), "payload": payload, "payload_bytes": len(payload),
                            "payload_digest": digest(payload) if head.get("warc-type") == "response" else None})
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_records(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A row per WARC record of the named archives (plain or gzip), see ``RECORD_SCHEMA``."""
    files = spark.createDataFrame([(x,) for x in names], "file string")
    return files.repartition(max(1, len(names)), "file").mapInArrow(_read_map(folder), RECORD_SCHEMA)


# ------------------------------------------------------------------ assembly
def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, response, request, metadata, more_requests): one nested row per capture.

    ``response`` is the response or revisit, ``request`` the request with the
    smallest id, ``more_requests`` any others by id, ``metadata`` the list of metadata records by id.  Any of
    them may point to others, to several if the field is repeated: request and metadata to the response, the
    response to its request, metadata to the request.  A record that belongs to several
    captures is in each.  Records that point to none of
    the given responses make a capture of their own without response.  Records of
    other types (warcinfo) belong to no capture.

    The records are parsed once, into a table of the shared folder with a part per type.
    """
    records = Scratch(records.sparkSession, "records").table(
        records.where("record_type in ('request', 'response', 'revisit', 'metadata')"), "r", "record_type")
    part = F.struct("record_id", "record_type", "target_uri", "date", "stated_digest", "content_type", "payload",
                    "payload_bytes", "payload_digest")
    main = records.where("record_type in ('response', 'revisit')")
    links = records.where("record_type in ('request', 'response', 'revisit')").select(
        "record_id", "record_type", F.explode("concurrent_to").alias("other"))
    # request id -> ids of its responses, pointed to from either side
    from_main = links.where("record_type <> 'request'").select(F.col("other").alias("rid"), F.col("record_id").alias("cid"))
    from_ask = links.where("record_type = 'request'").select(F.col("record_id").alias("rid"), F.col("other").alias("cid"))
    owner = from_main.union(from_ask).distinct()
    asks = records.where("record_type = 'request'").join(owner, F.col("record_id") == F.col("rid"), "left").select(
        F.coalesce("cid", "record_id").alias("capture_id"), part.alias("request"))
    asks = asks.groupBy("capture_id").agg(F.array_sort(F.collect_list("request")).alias("requests")).select(
        "capture_id", F.col("requests")[0].alias("request"),
        F.slice("requests", F.lit(2), F.greatest(F.lit(0), F.size("requests") - 1)).alias("more_requests"))
    told = records.where("record_type = 'metadata'").select("*", F.explode_outer("concurrent_to").alias("other"))
    about = told.join(owner, F.col("other") == F.col("rid"), "left").select(
        F.coalesce("cid", "other", "record_id").alias("capture_id"), part.alias("m"))
    about = about.groupBy("capture_id").agg(F.array_sort(F.collect_set("m")).alias("metadata"))
    main = main.select(F.col("record_id").alias("capture_id"), part.alias("response"))
    # the small sides first, so that payloads are shuffled once, and not at all by who doesn't read them
    return main.join(asks.join(about, "capture_id", "full"), "capture_id", "full").select(
        "capture_id", "response", "request", "metadata", "more_requests")


def page_summary(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per capture that has a response.

    Lengths and digests are of the payloads read; a revisit takes them from the
    response with its stated digest, whose page_id it refers to.
    """
    field = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page-id: (-?\d+)", 1)
    rows = captures.where("response is not null").select(
        F.when(field != "", field.cast("long")).alias("page_id"), F.col("response.record_type").alias("record_type"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"))
    rows = Scratch(captures.sparkSession, "captures").table(rows, "rows")
    full = rows.where("record_type = 'response'").groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.min("own_bytes").alias("full_bytes"))
    seen = rows.where("record_type = 'response'").select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    return seen.union(rows.where("record_type = 'revisit'").join(full, "payload_digest").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("first").alias("refers_to")))
