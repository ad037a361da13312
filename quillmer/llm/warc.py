"""WARC archives: writing with revisits, reading, and transaction assembly.

A capture is a request, a response (or revisit) and a metadata record; request
and metadata name the capture in WARC-Concurrent-To. Archives are gzip members,
one a record, in files of a bounded size under the shared folder, written beside
and renamed when complete. File names hold the task attempt, and readers open only
the files that the committed table of files names, so what a lost or repeated
attempt left behind is never read. ``assemble`` joins the records of a transaction
through their concurrent-to identifiers, whatever files they are in, into one
nested row a capture.

A record's identifier comes from its page id, its payload's digest and, where
several rows share both (counted before any shuffle), the place of its row in the
writing task. A revisit names its response's page in its own metadata record, and
the response's identifier too unless several rows share that page and payload.

Defined results: a null payload is empty; a null URL becomes ``urn:page:ID`` and
blanks or controls in a URL are percent-encoded; rows with a null id are archived
as responses of their own; of rows with one id and one payload the copies are
archived each; rows with one id and several payloads are captures of their own;
very long payloads are written whole; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_STEP = 1 << 14
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: object, digest: str, place: str = "") -> str:
    """The identifier of a page's record; ``place`` tells rows with one page and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{page}:{digest}:{place}')}>"


def record(kind: str, rid: str, uri: str, block: bytes, content: str, **more: str) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": _DATE, "WARC-Target-URI": uri, "Content-Type": content, **more}
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def capture(page: object, place: str, url: str | None, payload: bytes, first: object, first_alone: bool) -> bytes:
    """The three records of a capture; a revisit of page ``first`` unless that is None."""
    uri = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
    digest = payload_digest(payload)
    host = urllib.parse.urlsplit(uri).netloc if url else ""
    rid = record_id("capture", page, digest, place)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    same = {"WARC_Payload_Digest": "sha1:" + digest}
    note = f"page-id: {'' if page is None else page}\r\npayload-bytes: {len(payload)}\r\n"
    if first is None:
        main = record("response", rid, uri, http + payload, "application/http; msgtype=response", **same)
    else:
        more = {"WARC_Profile": _PROFILE}
        if first_alone:
            more["WARC_Refers_To"] = record_id("capture", first, digest)
        main = record("revisit", rid, uri, http, "application/http; msgtype=response", **same, **more)
        note += f"refers-to-page-id: {first}\r\n"
    get = record("request", record_id("request", page, digest, place), uri, f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request", WARC_Concurrent_To=rid)
    meta = record("metadata", record_id("metadata", page, digest, place), uri, note.encode(), "application/warc-fields", WARC_Concurrent_To=rid)
    return get + main + meta


def firsts(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest, alone (no other row has both), first: the page each revisits (null: it is a response), first_alone."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    each = pages.select("page_id", F.sha1(raw).alias("digest"), F.length(raw).alias("n"))
    each = each.groupBy("page_id", "digest", "n").agg(F.count("*").alias("rows"))
    named = each.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    low = named.groupBy("digest").agg(F.min(F.struct("page_id", "rows")).alias("low"))
    joined = each.join(low, "digest", "left")
    again = (F.col("page_id") > F.col("low.page_id")) & (F.col("n") >= least)
    first = F.when(again, F.col("low.page_id")).alias("first")
    return joined.select("page_id", "digest", ((F.col("rows") == 1) & F.col("page_id").isNotNull()).alias("alone"), first, (F.col("low.rows") == 1).alias("first_alone"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0, most_bytes: int = 32 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as archives of about ``most_bytes``; the files' names and record counts.

    Only files named in the result (as one stored run of it has them) belong to the archive.
    """
    known = firsts(pages, least).withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"))
    names = ["page_id", "url", "html", "alone", "first", "first_alone"]
    rows = rows.join(known, rows["page_id"].eqNullSafe(known["_p"]) & (F.sha1("html") == F.col("_d")), "left").select(*names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, part, n, at = TaskContext.get(), 0, 0, 0
        run = uuid.uuid4().hex[:8]
        out = io.BytesIO()
        made: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal part, n, out
            if n:
                name = f"pages-{task.partitionId():06d}-{part:05d}-{task.taskAttemptId()}-{run}.warc.gz"
                with store.open_output_stream(f"{root}/{name}.part", compression=None) as f:
                    f.write(out.getvalue())
                store.move(f"{root}/{name}.part", f"{root}/{name}")
                made.append((name, n))
            part, n, out = part + 1, 0, io.BytesIO()

        for b in it:
            for page, url, payload, alone, first, first_alone in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                at += 1
                place = "" if alone else f"{task.partitionId()}.{at}"
                out.write(capture(page, place, url, payload, first, bool(first_alone)))
                n += 3
                if out.tell() >= most_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "records"])

    return rows.mapInArrow(batches, "file string, records bigint")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a gzip archive."""
    at = 0
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof and at < len(content):  # small steps: what follows the member is handed back as a copy
            step = content[at : at + _STEP]
            parts.append(inflate.decompress(step))
            at += len(step) - len(inflate.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


#: Columns of a record as read back.
RECORD = (
    "record_id string, kind string, uri string, concurrent_to string, refers_to string, digest string, payload_bytes bigint, "
    "page_id bigint, noted_bytes bigint, noted_first bigint"
)


def read_archives(spark: SparkSession, folder: str, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a record of the archives in ``files`` (file); payload_bytes and payload_digest are computed from the stored payload of responses.

    The names are dealt to tasks at random, so no task gets a run of large files.
    """
    tasks = tasks or max(1, min(files.count(), 20 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kinds = [pa.string()] * 6 + [pa.int64()] * 4
    names = [c.split()[0] for c in RECORD.split(", ")]

    def rows_of(content: bytes) -> Iterator[tuple]:
        for f, block in parse_archive(content):
            kind, note, n, digest = f["warc-type"], {}, None, f.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                n, digest = len(payload), payload_digest(payload)
            elif kind == "metadata":
                note = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            noted = [int(note[k]) if note.get(k) else None for k in ("page-id", "payload-bytes", "refers-to-page-id")]
            yield f["warc-record-id"], kind, f.get("warc-target-uri"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), digest or None, n, *noted

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in it:
            for name in b.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = list(rows_of(f.read()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("file").repartition(tasks).mapInArrow(batches, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its main record, its requests and its metadata.

    A request or metadata record belongs to the response or revisit that its
    concurrent-to names. Records that name none that exists form captures
    without a main record, so nothing is lost.
    """
    main = F.col("kind").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    own = F.struct("record_id", "kind", "uri", "refers_to", "digest", "payload_bytes")
    note = F.struct("record_id", "page_id", "noted_bytes", "noted_first")
    return records.groupBy(key.alias("capture_id")).agg(
        F.first(F.when(main, own), ignorenulls=True).alias("main"),
        F.collect_list(F.when(F.col("kind") == "request", F.struct("record_id", "uri"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", note)).alias("metadata"),
    )


def page_captures(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages, read the archives back and report each capture."""
    scratch = Scratch(spark, "warc")
    folder = scratch.root + "/archives"
    files = scratch.keep(write_archives(spark, pages, folder, least), "files")
    captures = assemble(read_archives(spark, folder, files))
    noted = lambda c: F.get(F.col("metadata"), F.lit(0))[c]
    return captures.select(
        noted("page_id").alias("page_id"), F.coalesce("main.payload_bytes", noted("noted_bytes")).alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"), F.col("main.kind").alias("record_type"), noted("noted_first").alias("refers_to"),
    )
