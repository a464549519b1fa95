"""WARC archives: a writer and a Python data source that plans by file and parses headers first.

write() puts one record per row into gzip archives (a member per record) in a folder. Each task writes
files of its own and reports them; the driver then writes the list `_files.json`, so what failed or
speculative attempts left behind is never read. Records with equal payloads of at least `least` bytes:
the one with the smallest id is a response, the others are revisits that carry no payload.

WarcSource ("warc") plans a partition per archive (or group of small ones) of that list, or of all files
named .warc or .warc.gz in a folder without one, streams them a record at a time, takes filters on record
type, record id, target and digest, and inflates a member's headers only: the gzip extra field `sl`
holds the member's size, so a payload that no filter or column wants is skipped, not inflated.

Edge cases: a null payload is empty, and empty payloads equal each other (with least = 0); a null id is
written as "null" and read as null, never referred to and always a response; rows of equal id and
payload are written once each, as responses if the first; a null target has no header; other columns
are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import new_path, table

#: Bytes after which a task starts another archive.
ROLL = 64 << 20
SCHEMA = "record_id string, record_type string, target string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_DATE = "2000-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def file_system(uri: str):
    """(file system, path) of a shared folder: any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A record as a gzip member whose extra field has the member's size and the headers' size."""
    head = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode()
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    # the headers are flushed on their own, so that they inflate without the payload
    packed = deflate.compress(head) + deflate.flush(zlib.Z_FULL_FLUSH) + deflate.compress(body + b"\r\n\r\n") + deflate.flush()
    raw = head + body + b"\r\n\r\n"
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(packed) + 8, len(raw))
    start = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return start + packed + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Window:
    """The bytes of a stream by their place, of which only a stretch is held: fetch() reads on, drop() forgets."""

    STEP = 1 << 20

    def __init__(self, stream) -> None:
        self.stream, self.held, self.first, self.over = stream, b"", 0, False

    def fetch(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end."""
        while self.first + len(self.held) < at + n and not self.over:
            more = self.stream.read(max(self.STEP, at + n - self.first - len(self.held)))
            self.over = not more
            self.held += more
        return self.held[max(0, at - self.first) : max(0, at + n - self.first)]

    def drop(self, at: int) -> None:
        """Forget what is before a place; read over what isn't held, by a seek where the stream can."""
        here = self.first + len(self.held)
        if at > here and not self.over:
            try:
                self.stream.seek(at)
                self.held, self.first = b"", at
                return
            except (OSError, AttributeError, ValueError):
                self.held, self.first = b"", here
                while at > self.first and not self.over:
                    n = len(self.stream.read(min(self.STEP, at - self.first)))
                    self.first, self.over = self.first + n, not n
                return
        if at - self.first >= self.STEP or at >= here:
            self.held, self.first = self.held[at - self.first :], min(at, here)


def records(stream, wanted=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the wanted records of an archive, a record at a time; the block is None if not asked for."""
    data, at = Window(stream), 0
    while start := data.fetch(at, 18):
        if start[:2] != b"\x1f\x8b":  # not compressed
            n = 1 << 12
            while (end := (top := data.fetch(at, n)).find(b"\r\n\r\n")) < 0 and len(top) == n:
                n *= 2
            if end < 0:
                return
            headers = parse_headers(top[:end])
            begin, size = at + end + 4, int(headers.get("content-length", 0))
            if wanted(headers):
                yield headers, data.fetch(begin, size) if payload else None
            at = begin + size + 4
            data.drop(at)
            continue
        size, begin, bits = None, at, 31
        if start[3] & 4:
            length = struct.unpack_from("<H", start, 10)[0]
            extra, field = data.fetch(at + 12, length), 0
            while field + 4 <= length:
                n = struct.unpack_from("<H", extra, field + 2)[0]
                if extra[field : field + 2] == b"sl" and n == 8:
                    size, begin, bits = struct.unpack_from("<I", extra, field + 4)[0], at + 12 + length, -15
                field += 4 + n
        inflate, block, fed, headers, keep = zlib.decompressobj(bits), b"", begin, None, True
        parts: list[bytes] = []
        while not inflate.eof and (step := data.fetch(fed, 512 if headers is None else 1 << 16)):  # headers first, in small steps
            fed += len(step)
            got = inflate.decompress(step)
            if headers is None:
                block += got
                if b"\r\n\r\n" in block:
                    top, _, rest = block.partition(b"\r\n\r\n")
                    headers = parse_headers(top)
                    keep = wanted(headers)
                    parts.append(rest)
                    if size is not None:  # the member's end is known: inflate the rest at once or not at all
                        if keep and payload:
                            parts.append(inflate.decompress(data.fetch(fed, at + size - fed)))
                        break
            elif keep and payload:
                parts.append(got)
            if size is None:
                data.drop(fed)
        if size is None:
            size = fed - len(inflate.unused_data) - at
            if inflate.unused_data:
                data.held, data.first = inflate.unused_data + data.held[fed - data.first :], at + size
        if headers is not None and keep:
            yield headers, b"".join(parts)[: int(headers.get("content-length", 0))] if payload else None
        at += size
        data.drop(at)


def write(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", target: str = "url", least: int = 0) -> None:
    """Write df's rows as archives under path."""
    spark = df.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = df.select(F.col(key).alias("id"), F.col(target).alias("target") if target in df.columns else F.lit(None).cast("string").alias("target"), body.alias("body"))
    seen = own.select("id", F.sha1("body").alias("sha"), (F.octet_length("body") >= least).alias("share"))
    first = seen.where("share").groupBy("sha").agg(F.min("id").alias("first"))
    # a page and its digest meet in small rows; the payload joins by id, never by a digest that many pages have
    refers = seen.where("share").join(first, "sha").where("first < id").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "first").distinct()
    full = own.withColumn("sha", F.sha1("body")).join(refers, (F.col("id") == F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")

    def run(batches):
        import pyarrow as pa

        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        out, size, names = None, 0, []
        for batch in batches:
            for i, to, raw, sha, ref in zip(*(batch.column(c) for c in ("id", "target", "body", "sha", "first")), strict=True):
                if out is None or size > ROLL:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                raw = raw.as_py()
                revisit = ref.is_valid
                block = b"" if revisit else raw
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{i.as_py() if i.is_valid else 'null'}>"), ("WARC-Date", _DATE)]
                if to.is_valid:
                    headers.append(("WARC-Target-URI", to.as_py().replace("\r", "%0D").replace("\n", "%0A")))
                if revisit:
                    headers += [("WARC-Refers-To", f"<urn:page:{ref.as_py()}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                headers += [("WARC-Payload-Digest", f"sha1:{base32(sha.as_py())}"), ("WARC-Payload-Length", str(len(raw))), ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
                done = member(headers, block)
                out.write(done)
                size += len(done)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    files = [r[0] for r in full.select("id", "target", "body", "sha", "first").mapInArrow(run, "file string").collect()]  # a name per archive
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_files.json") as out:
        out.write(json.dumps(sorted(files)).encode())


class Archives(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcReader(DataSourceReader):
    #: Columns whose filters are evaluated on the headers, and the header of each.
    PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target": "warc-target-uri", "payload_digest": "warc-payload-digest"}

    def __init__(self, options) -> None:
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.per = int(options.get("bytesPerPartition", 64 << 20))
        self.filters: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.filters.append((f.attribute[0], frozenset(values)))
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_files.json").type == FileType.File:
            names = json.loads(fs.open_input_stream(f"{root}/_files.json").read())
            found = fs.get_file_info([f"{root}/{n}" for n in names])
        else:  # archives of others: all files of the folder that are named so
            found = [i for i in fs.get_file_info(FileSelector(root, recursive=True)) if i.type == FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        sizes = {i.path.removeprefix(root).lstrip("/"): i.size for i in found}
        names = sorted(sizes)
        parts: list[list[str]] = []
        room = 0
        for n in names:
            if not parts or sizes[n] > room:
                parts.append([])
                room = self.per
            parts[-1].append(f"{root}/{n}")
            room -= sizes[n]
        return [Archives(p) for p in parts] or [Archives([])]

    def row(self, h: dict[str, str]) -> dict:
        name = lambda x: None if x in (None, "null") else x
        strip = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
        n = h.get("warc-payload-length", h.get("content-length"))
        return {"record_id": name(strip(h.get("warc-record-id"))), "record_type": h.get("warc-type"), "target": h.get("warc-target-uri"), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": int(n) if n else None, "refers_to": strip(h.get("warc-refers-to"))}

    def read(self, partition):
        import pyarrow as pa

        fs, _ = file_system(self.path)
        fields = ["record_id", "record_type", "target", "payload_digest", "payload_bytes", "refers_to"]
        schema = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.string()) for f in fields] + [("payload", pa.binary())])
        for name in partition.names:
            rows, held = [], 0
            for h, block in records(fs.open_input_file(name), lambda h: all(self.row(h)[c] in v for c, v in self.filters), self.payload):
                rows.append(self.row(h) | {"payload": block})
                held += len(block or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); option payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under path; filters on headers reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def verified(archive: DataFrame) -> DataFrame:
    """archive with payload_digest and payload_bytes taken from the payload itself where a record has one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            digest, size = [], []
            for kind, d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("record_type", "payload_digest", "payload_bytes", "payload")), strict=True):
                full = kind == "response"
                digest.append(base64.b32encode(hashlib.sha1(raw).digest()).decode() if full else d)
                size.append(len(raw) if full else n)
            kept = ["record_id", "record_type", "refers_to", "target"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(digest, pa.string()), pa.array(size, pa.int64())], names=[*kept, "payload_digest", "payload_bytes"])

    return archive.mapInArrow(run, "record_id string, record_type string, refers_to string, target string, payload_digest string, payload_bytes long")


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return verified(read(spark, path)).select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
