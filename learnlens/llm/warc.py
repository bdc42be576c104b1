"""Web archives (WARC 1.1) as a PySpark data source.

Reading plans one partition per archive file, and per ``split_bytes`` of a large one
whose committed index says where records start.  Filters on the record type and on header
fields are pushed down: the reader parses a record's headers first and, where they do not
match or no payload column is asked for, steps over the block without decoding it.

Writing gives every task files of its own, rolled at ``file_bytes``; with the option ``compression`` set to ``gzip`` every record is a member
of its own, as the format advises, so that a file can still be entered where a record starts.  The driver lists the files of the
tasks that succeeded in a manifest when the write commits, and readers of a folder with a
manifest read those files alone, so a retried task leaves nothing behind that counts.

Columns (any subset in a schema given to ``spark.read.schema``): ``record_type``, ``record_id``,
``target_uri``, ``date``, ``refers_to``, ``payload_digest`` (bare lower-case hex SHA-1),
``payload_bytes`` and ``payload`` (null for a revisit, whose payload is elsewhere).

Defined results: a null html is an empty payload, a null url a record without a target, a null
page_id a record named ``null``; rows of equal page_ids stay separate records; line breaks in a url
are percent-encoded; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from learnlens.llm.shared import Scratch

MANIFEST = "_manifest.json"
LEVEL = 6  # of compression
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
# Fixed values of the format: header names and the profile of revisits.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def record(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    http = _HTTP.format(row["payload_bytes"]).encode()
    response = row["record_type"] == "response"
    block = http + (row["payload"] or b"") if response else http
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["target_uri"] is not None:
        uri = row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
        fields.append(("WARC-Target-URI", uri))
    if not response:
        fields.append(("WARC-Profile", REVISIT_PROFILE))
        fields.append(("WARC-Refers-To", f"<{row['refers_to']}>"))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(source) -> dict[str, str] | None:
    """The headers of the record that starts here; None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts here: {line[:40]!r}")
    fields = {}
    while (line := source.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _bare(field: str, value: str | None) -> str | None:
    if value is None:
        return None
    if field in ("record_id", "refers_to"):
        return value.strip("<>")
    if field == "payload_digest":
        kind, _, digest = value.partition(":")
        if kind.lower() == "sha1" and len(digest) == 32:
            return base64.b32decode(digest.upper()).hex()
        return digest.lower()
    return value


def records(source, fields: list[str], wanted: dict[str, set], end: int | None = None) -> Iterator[tuple]:
    """The wanted records as tuples of ``fields``, from here to byte ``end``.

    Headers come first; a block is read only where the record is wanted and its payload or the
    payload's length is.
    """
    deep = [f for f in fields if f in ("payload", "payload_bytes")]
    while end is None or source.tell() < end:
        headers = _headers(source)
        if headers is None:
            return
        size = int(headers.get("content-length", 0))
        values = {f: _bare(f, headers.get(h)) for f, h in HEADERS.items()}
        if any(values[f] not in allowed for f, allowed in wanted.items()):
            source.seek(size, 1)
            continue
        read = 0
        if deep and headers.get("content-type", "").startswith("application/http"):
            http, length = b"", None
            while read < size and (line := source.readline()):
                read += len(line)
                http = line.rstrip(b"\r\n")
                if not http:
                    break
                name, _, value = http.partition(b":")
                if name.strip().lower() == b"content-length":
                    length = int(value)
            if values["record_type"] == "revisit":
                values["payload"], values["payload_bytes"] = None, length
            elif "payload" in fields:
                values["payload"] = source.read(size - read)
                values["payload_bytes"] = size - read
                read = size
            else:
                values["payload_bytes"] = size - read
        elif deep:
            values["payload"], values["payload_bytes"] = None, size
            if "payload" in fields:
                values["payload"], read = source.read(size), size
        source.seek(size - read, 1)
        yield tuple(values[f] for f in fields)


class _Files(InputPartition):
    def __init__(self, name: str, start: int, end: int | None):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.fields = fields
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for condition in filters:
            if isinstance(condition, EqualTo | In) and len(condition.attribute) == 1:
                field = condition.attribute[0]
                if field in HEADERS:
                    values = condition.value if isinstance(condition, In) else [condition.value]
                    allowed = {v for v in values if v is not None}
                    self.wanted[field] = self.wanted.get(field, allowed) & allowed
                    continue
            yield condition  # Spark applies what is not pushed down

    def partitions(self):
        system, path = file_system(self.folder)
        manifest = f"{path}/{MANIFEST}"
        if system.get_file_info(manifest).type == pyarrow.fs.FileType.File:
            with system.open_input_stream(manifest) as source:
                files = json.loads(source.read())
        else:
            found = system.get_file_info(pyarrow.fs.FileSelector(path))
            files = [
                {"name": f.base_name, "marks": []} for f in found if f.base_name.endswith((".warc", ".warc.gz"))
            ]
        plan = []
        for file in files:
            cuts, last = [0], 0
            for mark in file["marks"]:
                if mark - last >= self.split:
                    cuts.append(mark)
                    last = mark
            ends = [*cuts[1:], None]
            plan += [_Files(file["name"], a, b) for a, b in zip(cuts, ends, strict=True)]
        return plan or [_Files("", 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        system, path = file_system(self.folder)
        with system.open_input_file(f"{path}/{partition.name}") as raw:
            raw.seek(partition.start)
            if partition.name.endswith(".gz"):
                source = raw if partition.end is None else _Part(raw, partition.end - partition.start)
                with gzip.open(source) as members:
                    yield from records(members, self.fields, self.wanted)
            else:
                yield from records(_Buffered(raw), self.fields, self.wanted, partition.end)


class _Part(io.RawIOBase):
    """The next bytes of a file, and no more: the members between two marks."""

    def __init__(self, raw, size: int):
        self.raw, self.left = raw, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


class _Buffered:
    """Lines and skips over a random-access file, read in large pieces."""

    def __init__(self, raw, piece: int = 1 << 20):
        self.raw, self.piece = raw, piece
        self.begin, self.data, self.at = raw.tell(), b"", 0

    def tell(self) -> int:
        return self.begin + self.at

    def _more(self, size: int) -> bool:
        """Have ``size`` bytes from here on, as far as there are any."""
        if len(self.data) - self.at >= size:
            return True
        place = self.tell()
        self.raw.seek(self.begin + len(self.data))
        self.data = self.data[self.at :] + self.raw.read(max(self.piece, size - len(self.data) + self.at))
        self.begin, self.at = place, 0
        return len(self.data) >= size

    def read(self, size: int) -> bytes:
        self._more(size)
        out = self.data[self.at : self.at + size]
        self.at += len(out)
        return out

    def readline(self) -> bytes:
        want = 1
        while True:
            whole = self._more(want)
            stop = self.data.find(b"\n", self.at)
            if stop >= 0:
                return self.read(stop + 1 - self.at)
            if not whole:
                return self.read(len(self.data) - self.at)
            want = len(self.data) - self.at + 1

    def seek(self, distance: int, whence: int = 1) -> None:
        self.at += distance
        if self.at > len(self.data):  # step over without reading
            self.begin, self.data, self.at = self.tell(), b"", 0
            self.raw.seek(self.begin)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.file_bytes = int(options.get("file_bytes", 256 << 20))
        self.mark_bytes = int(options.get("mark_bytes", 8 << 20))
        self.packed = {"none": False, "gzip": True}[options.get("compression", "none")]

    def write(self, batches):
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        files, out, at = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", "marks": []})
                    out, at, mark = system.open_output_stream(f"{path}/{files[-1]['name']}", compression=None), 0, 0
                if at - mark >= self.mark_bytes:
                    files[-1]["marks"].append(at)
                    mark = at
                raw = gzip.compress(record(row), LEVEL, mtime=0) if self.packed else record(row)
                out.write(raw)
                at += len(raw)
                if at >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        message = WriterCommitMessage()
        message.files = files
        return message

    def commit(self, messages):
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        files = [file for message in messages if message for file in message.files]
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        system, path = file_system(self.folder)
        for message in messages:
            for file in message.files if message else []:
                system.delete_file(f"{path}/{file['name']}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, [field.name for field in schema.fields])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def archive(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    compression: str = "none",
) -> None:
    """Write a record per page.  Of equal payloads of ``min_bytes`` or more, the page with the
    largest id is the response and the others revisit it."""
    register(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    made = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")}
    )
    # one row per digest, summed before the shuffle however many pages share it
    sizes = pages.select("page_id", payload.alias("payload")).filter(F.length("payload") >= min_bytes)
    shared = (
        sizes.groupBy(F.sha1("payload").alias("payload_digest"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = made.join(shared, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        page_uri(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, page_uri(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").option("path", folder).option("compression", compression).save()


def _page_id(uri: str) -> Column:
    return F.regexp_extract(uri, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """A row per archived page.  Responses are read with their payload, whose digest and length are
    taken anew; of revisits only the headers are decoded."""
    register(spark)
    read = spark.read.format("warc").option("path", folder)
    responses = (
        read.schema("record_type string, record_id string, payload binary")
        .load()
        .filter("record_type = 'response'")
        .select(
            _page_id("record_id").alias("page_id"),
            F.length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
            "record_type",
            F.lit(None).cast("long").alias("refers_to"),
        )
    )
    revisits = (
        read.schema(
            "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
        )
        .load()
        .filter("record_type = 'revisit'")
        .select(
            _page_id("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            _page_id("refers_to").alias("refers_to"),
        )
    )
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    folder = scratch.fresh("archives")
    archive(pages, folder, compression="gzip")
    return pages_of(pages.sparkSession, folder)
