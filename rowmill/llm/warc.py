"""WARC archives as a PySpark Python data source, and an archive writer that stores equal payloads once.

Reading: files are planned as ranges between record starts (from the writer's manifest; archives
without one are a range each). A record's header lines are parsed first; predicates on them that Spark
pushes down (``spark.sql.python.filterPushdown.enabled``) drop records whose payloads are then passed
over, neither kept nor decoded. ``.warc`` payloads are passed over by position, those of ``.warc.gz`` (a gzip
member per record) are only inflated.

Writing: each task writes files of its own under the given folder, which must be one that driver and
executors share; the manifest that the driver writes on commit names the files that count, so what
lost or repeated tasks leave is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from rowmill.llm.shared import cut, join_hot, scratch

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Each write has a manifest of its own; readers take all of them.
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def manifests_of(fs: pafs.FileSystem, root: str) -> list[str]:
    """The manifests of all writes to the folder, the earliest first."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return [x.path for x in sorted((x for x in found if x.base_name.startswith(MANIFEST)), key=lambda x: (x.mtime_ns or 0, x.path))]


def _value(text: object) -> str:
    return urllib.parse.quote(str(text), safe="".join(map(chr, range(33, 127))) + " ", encoding="utf-8")


def record(fields: dict[str, str | None], block: bytes, content_type: str = "application/http; msgtype=response") -> bytes:
    """One record; values are kept on their line by percent-encoding what is not printable ASCII."""
    lines = ["WARC/1.1", *(f"{k}: {_value(v)}" for k, v in fields.items() if v is not None), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, digest: str, refers_to, payload: bytes | None) -> bytes:
    """A response with its payload, or (payload None) a revisit that refers to a response."""
    fields = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if payload is None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return record(fields, http + (payload or b""))


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines of a record; a line that begins with a blank continues the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Plain:
    """Bytes of an uncompressed archive; ``skip`` moves the position."""

    def __init__(self, raw, end: int):
        self.raw, self.end = raw, end

    def head(self) -> bytes | None:
        got = bytearray()
        while True:
            line = self.raw.readline()
            if not line:
                if got.strip():
                    raise ValueError("the archive ends inside a header")
                return None
            if not got and line in (b"\r\n", b"\n"):
                if self.raw.tell() >= self.end:
                    return None
                continue
            if line in (b"\r\n", b"\n"):
                return bytes(got)
            got += line

    def block(self, n: int) -> bytes:
        got = self.raw.read(n)
        if len(got) < n:
            raise ValueError("the archive ends inside a record")
        self.raw.seek(4, io.SEEK_CUR)
        return got

    def skip(self, n: int) -> None:
        self.raw.seek(n + 4, io.SEEK_CUR)

    def more(self) -> bool:
        return self.raw.tell() < self.end


class Zipped:
    """A gzip member per record; ``skip`` inflates to the member's end and keeps nothing."""

    def __init__(self, raw, end: int):
        self.raw, self.end, self.rest = raw, end, b""

    def _feed(self, most: int) -> bytes:
        while True:
            data = self.rest or self.raw.read(1 << 16)
            self.rest = b""
            got = self.inflate.decompress(data, most)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got or self.inflate.eof:
                return got
            if not data:
                raise ValueError("the archive ends inside a record")

    def more(self) -> bool:
        return self.raw.tell() - len(self.rest) < self.end

    def head(self) -> bytes | None:
        self.inflate, self.got = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in self.got:
            part = self._feed(4096)
            if not part:
                if self.got.strip():
                    raise ValueError("the archive ends inside a header")
                return None
            self.got += part
        head, _, self.got = self.got.partition(b"\r\n\r\n")
        return head

    def block(self, n: int) -> bytes:
        parts, have = [self.got], len(self.got)
        while not self.inflate.eof:
            parts.append(self._feed(1 << 20))
            have += len(parts[-1])
        if have < n:
            raise ValueError("a record is shorter than its length")
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        while not self.inflate.eof:
            self._feed(1 << 20)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADER and isinstance(f, EqualTo):
                self.wanted.append((column, {f.value}))
            elif column in HEADER and isinstance(f, In):
                self.wanted.append((column, set(f.value)))
            elif column in HEADER and isinstance(f, IsNotNull):
                self.wanted.append((column, set()))
            yield f  # Spark tests again what is left

    def partitions(self):
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Range(self.path, 0, info.size)]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        base, files = self.path.rstrip("/"), []
        for manifest in (manifests := manifests_of(fs, root)):
            with fs.open_input_stream(manifest) as f:
                files += json.loads(f.read())
        if manifests:
            return [Range(f"{base}/{x['name']}", a, b) for x in files for a, b in zip(x["marks"][:-1], x["marks"][1:], strict=True)]
        found = sorted((x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [Range(f"{base}/{name}", 0, size) for name, size in found]

    def _rows(self, part: Range) -> Iterator[tuple]:
        fs, path = opened(part.path)
        with fs.open_input_file(path) as f:
            raw = io.BufferedReader(f, 1 << 18) if not path.endswith(".gz") else f
            raw.seek(part.start)
            source = (Zipped if path.endswith(".gz") else Plain)(raw, part.end)
            while source.more():
                head = source.head()
                if head is None:
                    break
                headers = parse_headers(head)
                n = int(headers["Content-Length"])
                fields = {k: headers.get(name) for k, name in HEADER.items()}
                if any(fields[k] is None or (ok and fields[k] not in ok) for k, ok in self.wanted):
                    source.skip(n)
                    continue
                payload = None
                if self.payload:
                    payload = payload_of(headers, source.block(n))
                else:
                    source.skip(n)
                yield (*fields.values(), n, list(headers.items()), payload)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there is nothing to read
            return
        kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [*HEADER, "content_length", "headers", "payload"]
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= 1000 or size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceWriter):
    """Rows (page_id, url, digest, refers_to, payload); payload null makes a revisit."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.zip, self.overwrite = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip", overwrite
        self.roll, self.mark = int(options.get("fileBytes", 256 << 20)), int(options.get("splitBytes", 8 << 20))

    def write(self, iterator) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files, out, at = [], None, 0
        for row in iterator:
            data = page_record(row["page_id"], row["url"], row["digest"], row["refers_to"], None if row["payload"] is None else bytes(row["payload"]))
            if self.zip:
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = z.compress(data) + z.flush()
            if out is None or at >= self.roll:
                if out is not None:
                    out.close()
                    files[-1]["marks"].append(at)
                name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zip
                out, at = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                files.append({"name": name, "marks": [0]})
            elif at - files[-1]["marks"][-1] >= self.mark:
                files[-1]["marks"].append(at)
            out.write(data)
            at += len(data)
        if out is not None:
            out.close()
            files[-1]["marks"].append(at)
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests_of(fs, root)
        beside, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(beside, compression=None) as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        fs.move(beside, name)
        for manifest in before if self.overwrite else ():
            with fs.open_input_stream(manifest) as f:
                gone = json.loads(f.read())
            fs.delete_file(manifest)
            for x in gone:
                fs.delete_file(f"{root}/{x['name']}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                if fs.get_file_info(f"{root}/{x['name']}").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/{x['name']}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record under ``path``, beside what is there.

    Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is the
    response. A null html is an empty payload; a null page_id is smaller than any other, and where
    all are null, all are responses. Rows that repeat id and payload are the same page and get the
    same type. A null url leaves its header out.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    # types are decided on ids and digests alone; payloads only meet the few rows that revisit, on a key that is never hot
    narrow = cut(rows.where(F.length("payload") >= least).select("page_id", "sha"), "warc-digests")
    twice = cut(narrow.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "warc-twice")
    again = join_hot(narrow, twice.select("sha", "head"), "sha", "page_id", twice.select("sha", "n")).where("head is not null and not (page_id <=> head)")
    again = again.distinct().withColumnsRenamed({"page_id": "p", "sha": "s"})
    rows = rows.join(again, F.expr("page_id <=> p and sha = s"), "left")

    @F.pandas_udf("string")
    def base32(sha):
        return sha.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    revisit = F.col("s").isNotNull()
    out = rows.select("page_id", "url", base32("sha").alias("digest"), F.when(revisit, F.col("head")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    out.write.format("warc").mode("append").option("path", path).option("compression", compression).save()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives under ``path``.

    Responses are measured on the payload read; revisits, whose payloads are not stored, take the
    length from the response they refer to.
    """
    register(spark)

    @F.pandas_udf("string")
    def digest(payload):
        return payload.map(lambda x: base64.b32encode(hashlib.sha1(bytes(x)).digest()).decode())

    number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    page = F.when(number != "", number.cast("long"))
    def records() -> DataFrame:  # a reader of its own for each scan, as it keeps the predicates pushed into it
        return spark.read.format("warc").load(path)

    full = records().where("record_type = 'response'").select(page.alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), digest("payload").alias("payload_digest"))
    full = cut(full, "warc-measured")  # read twice below; payloads are inflated and hashed once
    target = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long")
    again = records().where("record_type = 'revisit'").select(page.alias("page_id"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), target.alias("refers_to"))
    sizes = full.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes")).withColumnsRenamed({"page_id": "head", "payload_digest": "d"})
    again = again.join(sizes, F.expr("refers_to = head and payload_digest = d"), "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    full = full.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return full.select(*cols).union(again.withColumn("record_type", F.lit("revisit")).select(*cols))


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    archive(pages, path)
    return read_back(pages.sparkSession, path)
