"""Zstandard WARC archives: a dictionary in a leading skippable frame, one frame a record."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE_DICTIONARY = 0x184D2A5D  # frame type that holds the dictionary
FRAME = 0xFD2FB528
DICTIONARY_BYTES = 32_768
CHUNK = 1 << 20

ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
RECORD = ("path string, offset long, record_id string, record_type string, target_uri string, date string, payload_bytes long, "
          "payload_digest string, refers_to_id string, payload binary, error string")
_LINE = re.compile(rb"([!-9;-~]+):[ \t]*(.*)")


# --- writing --------------------------------------------------------------------------


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_bytes(record_id: str, record_type: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A whole WARC record; a revisit holds the HTTP headers only, which give the length of the payload it leaves out."""
    block = _http(len(payload)) + (payload if record_type == "response" else b"")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the first records of an archive; their plain bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Writes archives of about ``roll_bytes`` below ``folder``.

    An archive is written under a name of its own and moved to its final name, which the
    task's number and a count make up, when complete: a task that runs again replaces whole
    files by equal ones and never leaves half of one.
    """

    def __init__(self, folder: str, task: int, roll_bytes: int, samples: int = 100):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.task, self.roll_bytes, self.samples = task, roll_bytes, samples
        self.count, self.held, self.out, self.written = 0, [], None, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.held.append(record)
            if len(self.held) >= self.samples or sum(map(len, self.held)) >= CHUNK * 4:
                self._open()
        else:
            self._frame(record)
        if self.written >= self.roll_bytes:
            self.close()

    def _open(self) -> None:
        dictionary = _dictionary(self.held)
        self.name = f"{self.base}/part-{self.task:06d}-{self.count:05d}.warc.zst"
        self.temporary = f"{self.base}/_{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        packed = zstandard.ZstdCompressor().compress(dictionary)
        self.out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for record in self.held:
            self._frame(record)
        self.held = []

    def _frame(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.written += len(frame)

    def close(self) -> str | None:
        """Completes the archive at hand."""
        if self.out is None:
            if not self.held:
                return None
            self._open()
        self.out.close()
        self.fs.move(self.temporary, self.name)
        self.out, self.written, self.count = None, 0, self.count + 1
        return self.name


def revisits(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, digest, first) of the rows whose payload another row with a larger key has too.

    Only keys, lengths and digests are shuffled, and counted per task first.
    """
    digests = pages.select(F.col(key).alias("_key"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_size")).where(F.col("_size") >= least_bytes)
    firsts = digests.groupBy("_digest", "_size").agg(F.max("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    return digests.join(firsts.drop("_n"), ["_digest", "_size"]).where("_key IS NULL OR _key < _first")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 1000, roll_bytes: int = 256 << 20) -> None:
    """A WARC record for every row of ``pages``, payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of ``least_bytes`` at least the one with the largest key is
    the response and the others are revisits of it.  Rows of one key and payload are of one
    kind; a null key is smaller than any, and a group without keys is all responses.  An
    empty table writes no archive.  ``folder`` must be shared by all executors.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("_payload"))
    again = revisits(rows.select("_key", "_payload"), "_key", "_payload", least_bytes).select(
        F.col("_key").alias("_again"), F.col("_digest").alias("_same"), "_first").distinct()
    marked = rows.withColumn("_sha", F.sha1("_payload")).join(
        again, F.col("_key").eqNullSafe(F.col("_again")) & (F.col("_sha") == F.col("_same")), "left").select("_key", "_url", "_payload", "_sha", "_first")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        writer = ArchiveWriter(folder, TaskContext.get().partitionId(), roll_bytes)
        count = 0
        for batch in batches:
            for k, uri, payload, sha, first in batch.itertuples(index=False):
                whole = lambda x: None if pd.isna(x) else f"urn:page:{int(x)}"
                again_of = whole(first)
                writer.add(record_bytes(whole(k) or "urn:page:", "response" if again_of is None else "revisit",
                                        re.sub(r"[\x00-\x20\x7f]", "", uri), payload, sha, again_of))
                count += 1
        writer.close()
        yield pd.DataFrame({"records": [count]})

    marked.mapInPandas(write, "records long").agg(F.sum("records")).collect()


# --- reading --------------------------------------------------------------------------


class BadRecord(ValueError):
    pass


def parse_record(raw: bytes) -> dict:
    """Fields of one record after checking version, headers, lengths, end marks and digest."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        raise BadRecord("headers do not end")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord(f"not a WARC version: {version[:20]!r}")
    fields = {}
    for line in lines:
        m = _LINE.fullmatch(line)
        if not m:
            raise BadRecord(f"not a header: {line[:60]!r}")
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise BadRecord(f"{len(rest) - 4} bytes, Content-Length {fields['content-length']}")
    if rest[-4:] != b"\r\n\r\n":
        raise BadRecord("no end mark")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", b"\r\n" + http)
    if not mark or not told:
        raise BadRecord("HTTP headers without a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (len(payload) != int(told[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadRecord("payload differs from its length or digest")
    if not response and (fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields):
        raise BadRecord("neither a response nor a revisit of one")
    return {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
            "payload_bytes": int(told[1]), "payload_digest": digest, "refers_to_id": fields["warc-refers-to"].strip("<>") if not response else None,
            "payload": payload if response else None}


def read_frames(stream: io.RawIOBase) -> Iterator[tuple[int, bytes | BadRecord]]:
    """(offset, record) of every frame, with one record in memory at a time."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE_DICTIONARY:
        raise BadRecord("no dictionary frame at the start")
    size = struct.unpack("<II", head)[1]
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise BadRecord("dictionary frame cut short")
    if dictionary[:4] == struct.pack("<I", FRAME):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at, held = 8 + size, b""
    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        frame, parts, used = decompressor.decompressobj(), [], 0
        try:
            while not frame.eof:
                held = held or stream.read(CHUNK)
                if not held:
                    raise BadRecord("frame cut short")
                parts.append(frame.decompress(held))
                used += len(held) - len(frame.unused_data)
                held = frame.unused_data
        except (zstandard.ZstdError, BadRecord) as e:
            yield at, BadRecord(str(e))  # the next frame's start is unknown
            return
        yield at, b"".join(parts)
        at += used


def read_archives(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Records of all ``*.warc.zst`` files below ``folder``: an archive a task, a record in memory at a time.

    With ``strict`` a bad file or record ends the job; otherwise it is a row whose
    ``error`` says what is wrong and whose other fields but path and offset are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    frames = read_frames(stream)
                    while True:
                        at, row = 0, {}
                        try:
                            at, raw = next(frames)
                            if isinstance(raw, BadRecord):
                                raise raw
                            row, held = parse_record(raw), held + len(raw)
                        except StopIteration:
                            break
                        except BadRecord as e:
                            if strict:
                                raise BadRecord(f"{path} at {at}: {e}") from None
                            row = {"error": str(e)}
                        rows.append({"path": path, "offset": at, **row})
                        if held > 8 * CHUNK or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartition(parts, "path").mapInArrow(read, RECORD)
