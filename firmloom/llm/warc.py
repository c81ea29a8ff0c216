"""WARC archives: write page captures, read records, assemble transactions.

Writing: every page gives a request, a response or revisit, and a metadata record;
request and metadata name the response in WARC-Concurrent-To. Of pages with equal
payloads of at least `least` bytes the one with the smallest id is the response, the
others are revisits that name it in WARC-Refers-To and carry HTTP headers only.
Tasks write files of their own attempt; only the files that a finished task names in
the manifest belong to the archive, so a repeated task leaves nothing wrong behind.

Reading: one task per file reads records one after the other, by Content-Length, and
passes them on in batches of bounded size. Compressed and plain files are told apart
by their first bytes. A broken record is an error, not a skipped row.

Assembly: records of a transaction name one or several of its records in
WARC-Concurrent-To. They meet by the first identifier; groups that are linked further,
because a record names several or one that itself names another, are joined as connected
components. One nested row per capture: request, response, metadata; a part that is
missing has null fields. If a role occurs twice, the smaller record id counts. The block
of a metadata record is in `fields`, the payload of the others in `payload`; the caller
may name the fields that the rows shall have. `capture_id` is the identifier that the
records meet by, of linked groups the smallest.

Defined cases: a null html is empty; a null url is written as `urn:null` and comes
back as null; null ids come after all others; rows that repeat an id and payload are
captures of their own and the first row is the response; very long texts are written
and read whole; an empty table gives an empty archive; other columns are not written.
Records without an identifier stand in no capture; identifiers of records that are in no
file still bring together those that name them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom.llm.common import attach, broadcast_if_small, shared_path, stage, text_of
from firmloom.llm.components import components

# Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "content_type string, payload_digest string, http_status int, payload_bytes bigint, payload_sha256 string, "
    "http_headers string, fields string, payload binary"
)
MANIFEST = "path string, records bigint, bytes bigint"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
FLUSH_BYTES, FLUSH_ROWS = 16 << 20, 1000


def record_name(archive: str, role: str, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}/{role}/{row}'.encode()).digest())}>"


def build_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def page_records(archive: str, date: str, page: dict) -> Iterator[bytes]:
    """The three records of one page."""
    row, payload = page["row"], page["payload"].encode()
    url = "urn:null" if page["url"] is None else urllib.parse.quote(page["url"], safe="!#$%&'()*+,/:;=?@[]~")
    name = record_name(archive, "response", row)
    common = [("WARC-Date", date), ("WARC-Target-URI", url)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    yield build_record("request", [
        ("WARC-Record-ID", record_name(archive, "request", row)), ("WARC-Concurrent-To", name), *common,
        ("Content-Type", "application/http; msgtype=request"),
    ], f"GET {url} HTTP/1.1\r\n\r\n".encode())
    head = [("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha256:{page['digest']}"),
            ("Content-Type", "application/http; msgtype=response")]
    if page["first_row"] is None or page["first_row"] == row:
        yield build_record("response", head, http + payload)
    else:
        seen = record_name(archive, "response", page["first_row"])
        yield build_record("revisit", [*head, ("WARC-Refers-To", seen), ("WARC-Profile", PROFILE)], http)
    yield build_record("metadata", [
        ("WARC-Record-ID", record_name(archive, "metadata", row)), ("WARC-Concurrent-To", name), *common,
        ("Content-Type", "application/json"),
    ], json.dumps({"page_id": page["page_id"], "url": page["url"]}).encode())


def archive_writer(folder: str, archive: str, date: str, level: int, file_bytes: int):
    """mapInArrow function: writes its rows into files of about `file_bytes`, gives their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        out, done, number, count, size = None, [], 0, 0, 0
        try:
            for batch in batches:
                for page in batch.to_pylist():
                    if out is None:
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc" + (".gz" if level else "")
                        out, number, count, size = files.open_output_stream(f"{base}/{name}", compression=None), number + 1, 0, 0
                    for record in page_records(archive, date, page):
                        data = gzip.compress(record, level, mtime=0) if level else record
                        out.write(data)
                        count, size = count + 1, size + len(data)
                    if size >= file_bytes:
                        out.close()
                        out = done.append((f"{folder}/{name}", count, size))
            if out is not None:
                out.close()
                out = done.append((f"{folder}/{name}", count, size))
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*done, strict=True)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["path", "records", "bytes"])

    return write


def capture_roles(pages: DataFrame, least: int) -> DataFrame:
    """Staged `pages` with first_row: the row that holds the payload, or null if it occurs once."""
    groups = (
        pages.filter(F.col("payload_bytes") >= least).groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", F.col("first.row").alias("first_row"))
    )
    linked = attach(pages.filter(F.col("payload_bytes") >= least).select("row", "digest", "part"), groups, ["digest"], "part")
    return pages.join(broadcast_if_small(stage(linked.select("row", "first_row"), "repeats")), "row", "left")


def write_archive(
    pages: DataFrame, least: int = 100, level: int = 1, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z",
    id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """Write all pages to a new archive in the shared folder; returns its manifest."""
    spark = pages.sparkSession
    html = text_of(html_column)
    rows = stage(pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), html.alias("payload"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"),
    ), "pages")
    folder = shared_path(spark, "warc")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    ready = capture_roles(rows, least).select("row", "page_id", "url", "payload", "digest", "first_row")
    write = archive_writer(folder, uuid.uuid4().hex, date, level, file_bytes)
    return stage(ready.mapInArrow(write, MANIFEST), "manifest")


def parse_records(stream: io.BufferedIOBase, name: str) -> Iterator[dict]:
    """The records of one uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record where one must begin: {line[:40]!r}")
        headers, named = {}, []
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
            if key.strip().lower() == "warc-concurrent-to":
                named.append(value.strip())
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{name}: record {headers.get('warc-record-id')} ends early")
        yield record_row(headers, named, block)


def record_row(headers: dict[str, str], named: list[str], block: bytes) -> dict:
    http, payload, status, size = None, block, None, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        http = head.decode("utf-8", "replace")
        lines = http.split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        parts = lines[0].split(" ")
        status = int(parts[1]) if lines[0].startswith("HTTP/") and len(parts) > 1 and parts[1].isdigit() else None
        size = int(fields.get("content-length", 0)) if headers["warc-type"] == "revisit" else len(payload)
    kind = headers["warc-type"]
    return {
        "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": named,
        "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"), "content_type": headers.get("content-type"),
        "payload_digest": headers.get("warc-payload-digest"), "http_status": status, "payload_bytes": size,
        "payload_sha256": None if kind == "revisit" else hashlib.sha256(payload).hexdigest(), "http_headers": http,
        "fields": block.decode("utf-8", "replace") if kind == "metadata" else None,
        "payload": None if kind in ("revisit", "metadata") else payload,
    }


TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(n, TYPES.get(t, pa.string())) for n, t in (f.split() for f in RECORD.split(", "))])


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: records of the files named in column `path`."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, inner = fs.FileSystem.from_uri(path)
            with files.open_input_file(inner) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                plain = io.BufferedReader(raw, 1 << 20)
                rows, held = [], 0
                try:
                    for row in parse_records(gzip.GzipFile(fileobj=plain) if packed else plain, path):
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                except (EOFError, zlib.error) as error:
                    raise ValueError(f"{path}: {error}") from error
                yield pa.RecordBatch.from_pylist(rows, ARROW)


def read_archive(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the files in column `path`, in columns of RECORD."""
    files = manifest.select("path")
    return files.repartition(max(files.count(), 1)).mapInArrow(read_files, RECORD)


ROLES = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}


def linked_groups(records: DataFrame) -> DataFrame:
    """node, part of the groups (`capture_id`) that are linked with others; empty if all records are one hop apart."""
    naming = records.filter(F.size("concurrent_to") > 0)
    several = naming.select(F.col("capture_id").alias("a"), F.explode("concurrent_to").alias("b"))
    named = naming.select(F.col("capture_id").alias("b")).distinct()
    further = naming.select(F.col("capture_id").alias("a"), F.col("record_id").alias("b")).join(named, "b", "left_semi")
    return components(several.filter("a <> b").unionByName(further.select("a", "b")))


def assemble(records: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row per capture: capture_id, request, response, metadata (structs of `fields`). Only those are staged and shuffled."""
    wanted = list(dict.fromkeys(["record_id", "type", "concurrent_to", *fields]))
    keyed = stage(records.filter(F.col("record_id").isNotNull() & F.col("type").isin(*sum(ROLES.values(), []))).select(
        *wanted, F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id").alias("capture_id")), "records")
    linked = broadcast_if_small(linked_groups(keyed))
    keyed = keyed.join(linked, F.col("capture_id") == F.col("node"), "left").withColumn(
        "capture_id", F.coalesce("part", "capture_id")).drop("node", "part")
    picks = [
        F.min_by(field, F.when(F.col("type").isin(*kinds), F.col("record_id"))).alias(f"{role}_{field}")
        for role, kinds in ROLES.items() for field in fields
    ]
    whole = keyed.groupBy("capture_id").agg(*picks)
    return whole.select("capture_id", *[
        F.struct(*[F.col(f"{role}_{f}").alias(f) for f in fields]).alias(role) for role in ROLES])


REPORT_FIELDS = ["record_id", "type", "refers_to", "payload_digest", "payload_bytes", "payload_sha256", "fields"]


def capture_report(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id) per capture, from the read records."""
    about = F.col("metadata.fields")
    rows = stage(captures.select(
        F.get_json_object(about, "$.page_id").cast("bigint").alias("page_id"),
        F.get_json_object(about, "$.url").alias("url"), F.spark_partition_id().alias("part"),
        F.col("response.record_id").alias("record_id"), F.col("response.type").alias("record_type"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.refers_to").alias("seen"),
        F.coalesce("response.payload_sha256", F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
    ), "captures")
    first = rows.select(F.col("record_id").alias("seen"), F.col("page_id").alias("refers_to")).filter("seen is not null")
    again = attach(rows.filter("seen is not null"), first, ["seen"], "part", "left")
    once = rows.filter("seen is null").withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return once.select(*columns).unionByName(again.select(*columns))
