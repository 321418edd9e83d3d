"""Dictionary-compressed WARC archives.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from archived records, then has one Zstandard frame a
record: a warcinfo and the responses and revisits. A response carries the HTTP
head and the payload. Of records with equal payloads of at least ``least`` bytes
only one is a response, that of the largest id; the others are revisits of it
with the HTTP head alone.

Scale: equal payloads meet as digests only, never as bodies. The dictionary
samples the whole table: payloads are cut into pieces of ``PIECE`` bytes, each
is taken or not by a hash, so that about ``sample_bytes`` (a documented bound of
the sample; every record is compressed with the dictionary) reach the one task
that builds it, and the dictionary alone goes through the driver. A task writes
files of at most ``FILE_ROWS`` bundles of about ``BUNDLE`` bytes, so no file is
read whole that is larger than that or than one record. Files are written by
Spark's text writer, which puts a separator after each row: that separator is an
empty skippable frame, which readers of Zstandard ignore, so the files are plain
.warc.zst archives in any store Spark writes to.

Defined cases: a null html is an empty payload, a null url an empty one; a very
long page is one record; a null id is less than any other, and repeated rows
with the largest id are each a response, of which revisits name the first;
record ids are unique; an empty table makes no archive and reads back as no
rows; other columns are ignored. Control characters in a url are dropped.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut, shared_dir

DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\0\0\0\0"  # the latter: 0x184D2A50 and a length of 0
PIECE, BUNDLE, FILE_ROWS = 16 << 10, 1 << 20, 64
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
READ = "page_id {0}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {0}, payload binary, intact boolean"


def decided(pages: DataFrame, least: int = 1000, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to, copy (null: the one that others refer to)."""
    rows = _numbered(pages).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload"))
    large = rows.where(F.col("payload_bytes") >= least)
    same = cut(large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Groups of copies are broadcast only when they are counted to be few.
    same = F.broadcast(same) if same.count() <= broadcast_rows else same
    both = rows.join(same, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return both.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "copy")


def _numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with copy: null for the first row of a page id and payload, else a number of its own.

    Rows that repeat an id and payload are found by digests; mostly there are none.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("__no"))
    key = [F.col("page_id").alias("__id"), F.sha1("payload").alias("__sha")]
    twice = cut(rows.groupBy(*key).agg(F.min("__no").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(None).cast("long")).drop("__no")
    both = rows.join(twice, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1("payload") == F.col("__sha")), "left")
    return both.withColumn("copy", F.when(F.col("__no") != F.col("__first"), F.col("__no"))).drop("__no", "__id", "__sha", "__first")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(*parts: object) -> str:
    return f"<{uuid.uuid5(SPACE, ':'.join(map(str, parts))).urn}>"


def page_record(page: object, url: str | None, payload: bytes, digest: str, kind: str, refers: object, copy: int | None, date: str) -> bytes:
    clean = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    own = ("page", page, digest) if copy is None else ("page", page, digest, copy)
    fields = [("WARC-Record-ID", _name(*own)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page is None else str(page))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name("page", refers, digest)), ("X-Refers-To-Page-ID", str(refers))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(kind, [*fields, ("Content-Type", "application/http;msgtype=response")], head + (payload if kind == "response" else b""))


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small samples: their own text serves
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


ROW = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "copy")


def dictionary(rows: DataFrame, size: int, sample_bytes: int, date: str) -> bytes:
    """A dictionary of at most ``size`` bytes from pieces of all of ``rows``."""
    total = rows.agg(F.sum(F.octet_length("payload") + F.lit(600))).first()[0] or 0
    share = min(1.0, sample_bytes / max(1, total))
    places = F.sequence(F.lit(0), F.floor(F.octet_length("payload") / PIECE).cast("int"))
    chosen = F.filter(places, lambda k: F.pmod(F.xxhash64("page_id", "url", "payload_digest", k), F.lit(1 << 30)) < int(share * (1 << 30)))
    pieces = rows.withColumn("__k", F.explode(chosen)).withColumn("payload", F.substring("payload", F.col("__k") * PIECE + 1, F.lit(PIECE)))
    order = F.xxhash64("page_id", "url", "payload_digest", "__k")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [page_record(*row, date) for b in batches for row in zip(*(b[c].to_pylist() for c in ROW), strict=True)]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([_dictionary(samples, size).as_bytes()], pa.binary())], ["dictionary"])

    one = pieces.select(*ROW, order.alias("__o")).repartition(1).sortWithinPartitions("__o", "page_id", "url")
    found = one.mapInArrow(learn, "dictionary binary").first()
    return bytes(found[0]) if found else b" " * 8


def archive(rows: DataFrame, path: str, level: int = 3, dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``decided`` rows into the new folder ``path``, archive files of up to ``FILE_ROWS`` bundles."""
    raw, run = dictionary(rows, dictionary_bytes, sample_bytes, date), uuid.uuid4().hex
    file_rows = FILE_ROWS

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
        held: list[bytes] = []

        def bundle() -> pa.RecordBatch:
            """The next row; each file's first begins with the dictionary and a warcinfo."""
            nonlocal made
            head = []
            if made % file_rows == 0:
                info = [("WARC-Record-ID", _name("info", run, task, made)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                head = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, press.compress(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))]
            made += 1
            row = b"".join(head + held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["frame"])

        size = 0
        for b in batches:
            for row in zip(*(b[c] for c in ROW), strict=True):
                held.append(press.compress(page_record(*(x.as_py() for x in row), date)))
                size += len(held[-1])
                if size >= BUNDLE:
                    yield bundle()
                    size = 0
        if held:
            yield bundle()

    made = rows.select(*ROW).mapInArrow(frames, "frame binary")
    made.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").option("maxRecordsPerFile", file_rows).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive file."""
    magic, size = struct.unpack_from("<II", data)
    known = None
    if magic == DICTIONARY_MAGIC:
        raw = data[8 : 8 + size]
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(data), read_across_frames=True), 1 << 17)
    while line := source.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("no WARC record where one should start")
        fields = {}
        while (line := source.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        block = source.read(int(fields["content-length"]))
        source.read(4)
        yield fields, block


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The page records of the archives in ``path``; ``intact``: a response's payload has the digest it says."""
    whole = "int" in id_type or id_type == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_id = lambda x: (int(x) if whole else x) if x else None
        kind = pa.int64() if whole else pa.string()
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact"]
        types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary(), pa.bool_()]

        def built(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for f, block in records(data):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    said = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    digest, response = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"] == "response"
                    own = hashlib.sha1(payload).hexdigest() if response else digest
                    rows.append((to_id(f["x-page-id"]), f["warc-target-uri"], len(payload) if response else said, own, f["warc-type"], to_id(f.get("x-refers-to-page-id")), payload if response else None, own == digest))
                    size += len(block)
                    if size > 8 << 20:
                        yield built(rows)
                        rows, size = [], 0
                if rows:
                    yield built(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ.format("long" if whole else "string"))


def written(pages: DataFrame, least: int = 1000, **how: object) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/junctura-warc-{uuid.uuid4().hex}"
    archive(decided(pages, least), path, **how)
    return read(spark, path, pages.schema["page_id"].dataType.simpleString())
