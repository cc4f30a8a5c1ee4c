"""Web archives with a Zstandard dictionary in front.

Each task writes archives whose records are compressed one by one, with a dictionary built from the
first records of the archive.  The dictionary stands in a leading skippable frame, so a file can be read
by itself.  Equal payloads are stored once: the others are revisit records.
"""
from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import scratch_root
from .common import key, looked_up, map_batches, written

#: Fixed values of the formats.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID(int=0)

DICTIONARY_BYTES = 1 << 15
#: Bytes of records a dictionary is built from, and bytes of records (before compression) of an archive.
SAMPLE_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 26
LEVEL = 3


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def one_line(value: str) -> str:
    """A header value without line breaks, percent-encoded where it has some."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n%") else value


def record(page_id, url: str | None, payload: bytes, target) -> bytes:
    """A response record, or a revisit of page ``target`` when that is given."""
    digest = digest_of(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {one_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if target is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(target, digest)}", f"X-Refers-To-Page-Id: {target}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where there are enough samples; else the bytes of the samples themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n",
                                         dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One file: the dictionary frame, then a frame per record."""

    def __init__(self, root: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        self.path, self.uri = f"{base}/{name}", f"{root}/{name}"
        self.waiting: list[bytes] = []
        self.out = self.compressor = None
        self.records = self.raw = self.stored = 0

    def _open(self):
        dictionary = build_dictionary(self.waiting)
        raw = dictionary.as_bytes()
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self._put(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
        for one in self.waiting:
            self._put(self.compressor.compress(one))
        self.waiting = []

    def _put(self, data: bytes):
        self.out.write(data)
        self.stored += len(data)

    def add(self, one: bytes):
        self.records += 1
        self.raw += len(one)
        if self.out is None:
            self.waiting.append(one)
            if self.raw >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(self.compressor.compress(one))

    def close(self) -> tuple:
        if self.out is None:
            self._open()
        self.out.close()
        return self.uri, self.records, self.raw, self.stored


def frames(uri: str, chunk: int = 1 << 20):
    """The records of an archive, one at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        dictionary, data = None, head
        if head[:4] == SKIPPABLE:
            dictionary, data = zstandard.ZstdCompressionDict(f.read(int.from_bytes(head[4:], "little"))), b""
        reader = zstandard.ZstdDecompressor(dict_data=dictionary)
        part, one = reader.decompressobj(), []
        while data or (data := f.read(chunk)):
            one.append(part.decompress(data))
            data = part.unused_data if part.eof else b""
            if part.eof:
                yield b"".join(one)
                part, one = reader.decompressobj(), []
        if any(one):
            raise ValueError(f"{uri} ends within a record")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   root: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every row as a record and return the list of archives: ``path, records, raw_bytes, stored_bytes``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is a response
    and the others are revisits of it; a row that repeats that id is a response too, and so are equal
    payloads none of which has an id.  A null html is an empty payload, a null url an empty one; an empty
    table gives no archives.  The list is written before it is returned; a file that a lost task left behind is not in it.
    """
    spark = df.sparkSession
    root = root or f"{scratch_root(spark)}/archives-{uuid.uuid4().hex}"
    if "://" not in root and not root.startswith("/"):
        raise ValueError("root must be an absolute path or URI")
    if root.startswith("file:/") and not root.startswith("file:///"):
        root = "file://" + root[5:]
    html = F.coalesce(key(html_col), F.lit(""))
    # the headers name payloads by SHA-1, for which different payloads with one digest are known; equality goes by SHA-256
    pages = df.select(key(id_col, "id"), key(url_col, "url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    groups = written(pages.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha")
                     .agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "target"), "payloads")
    other = ~F.col("id").eqNullSafe(F.col("target"))
    rows = (looked_up(pages, ["sha"], groups)
            .select("id", "url", "html", F.when(other, F.col("target")).alias("target")))

    def run(batches):
        archive, done = None, []
        for batch in batches:
            for page_id, url, text, target in zip(*(batch.column(c) for c in ("id", "url", "html", "target"))):
                if archive is None:
                    archive = Archive(root, f"pages-{uuid.uuid4().hex}.warc.zst")
                archive.add(record(page_id.as_py(), url.as_py(), text.as_py().encode(), target.as_py()))
                if archive.raw >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        columns = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                                         ["path", "records", "raw_bytes", "stored_bytes"])

    return written(map_batches(rows, run, "path string, records long, raw_bytes long, stored_bytes long"), "archives")


def read_archives(archives: DataFrame, id_col: str = "page_id", id_type: str = "bigint", payload: bool = False) -> DataFrame:
    """The records of all archives: ``id_col, url, payload_bytes, payload_digest, record_type, refers_to`` and, on demand, ``payload``.

    The payload of each response is checked against its digest.
    """
    spread = archives.select("path").repartition(max(1, archives.count()))

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for data in frames(path):
                    fields = parse_record(data)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(fields["payload"]) != digest:
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} does not match its digest")
                    rows.append((fields.get("X-Page-Id"), fields["WARC-Target-URI"], int(fields["http"]["Content-Length"]), digest, kind,
                                 fields.get("X-Refers-To-Page-Id"), fields["payload"] if payload and kind == "response" else None))
                    held += len(data) if payload else 0
                    if len(rows) >= 10_000 or held >= 1 << 24:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    read = map_batches(spread, run, "id string, url string, payload_bytes long, payload_digest string, record_type string, "
                                    "refers string, payload binary")
    out = read.select(F.col("id").cast(id_type).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type",
                      F.col("refers").cast(id_type).alias("refers_to"), "payload")
    return out if payload else out.drop("payload")
