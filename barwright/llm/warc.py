"""WARC archives compressed record by record with a shared Zstandard dictionary.

A file is a sequence of Zstandard frames: first a skippable frame that holds the dictionary, then one frame per record.  The dictionary is
built from a bounded sample of the records (``SAMPLE_BYTES`` at most, of the rows with the smallest hashes).  Files are written by Spark's own text writer, one
per task, through whatever file system the folder lies in and under its commit protocol, so a lost executor leaves no half-written archive.
The writer ends every row with a separator; here that separator is an empty skippable frame, which readers pass over.

Of records with equal payloads (SHA-1 and length) the one with the smallest id is a ``response``; the others become ``revisit`` records that
name it and carry no payload.  The smallest id is found by an aggregate that combines in the map tasks, so a payload shared by a third of
all rows costs one row per task.

Null payloads and null URLs are written as empty.  A null id counts as larger than all ids.  Rows that repeat an id and payload keep the
same type.  Payloads below ``min_bytes`` are never compared.  An empty table gives an archive without records.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import folder

SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
# Fixed values of the Zstandard and WARC formats: the frame magics and the empty skippable frame used as row separator.
FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"

RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the digest and length of the payload it leaves out."""
    body = b"" if revisit else payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of ``RECORD`` from the bytes of one record; a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    number = lambda k: int(v) if (v := fields.get(k, "<urn:page:>")[len("<urn:page:"):-1]) else None
    payload, kind, said = rest[:int(fields["Content-Length"])], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), said, kind, number("WARC-Refers-To"), payload


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, found from the block sizes without decompressing."""
    at = 0
    while at < len(data):
        begin, magic = at, struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            info = zstandard.get_frame_parameters(data[at:at + 18])
            at += zstandard.frame_header_size(data[at:at + 18])
            last = False
            while not last:
                block = int.from_bytes(data[at:at + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                at += 3 + (1 if kind == 1 else block >> 3)
            at += 4 * info.has_checksum
        yield magic, begin, at


def train_dictionary(pages: DataFrame, page_id: str, url: str, html: str) -> bytes:
    """A dictionary from a bounded sample of the records; empty when they are too few to train one."""
    total = pages.count()
    if not total:
        return b""
    rows, most = 1024, SAMPLE_BYTES // 1024
    share = min(1.0, rows / total)
    sample = (pages.where(F.xxhash64(page_id) / F.lit(2.0 ** 64) + 0.5 < share).select(page_id, url, F.substr(F.col(html), F.lit(1), F.lit(most)).alias("p"))
              .orderBy(F.xxhash64(page_id)).limit(rows).collect())
    samples = [record(r[0], r[1], (r[2] or "").encode()[:most], None, False) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to train on
        return b""


def with_types(pages: DataFrame, page_id: str, html: str, min_bytes: int) -> DataFrame:
    """Columns id, url-free payload and ``refers_to`` (null for a response)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.withColumn("_key", F.unhex(F.sha1(payload.cast("binary")))).withColumn("_size", F.octet_length(payload))
    firsts = (keyed.where(F.col("_size") >= min_bytes).groupBy("_key", "_size").agg(F.min(page_id).alias("_min"), F.count("*").alias("_rows"))
              .where((F.col("_rows") > 1) & F.col("_min").isNotNull()).select(F.col("_key").alias("_k"), F.col("_size").alias("_s"), "_min"))
    joined = keyed.join(firsts, (F.col("_key") == F.col("_k")) & (F.col("_size") == F.col("_s")), "left")
    return joined.withColumn("_refers", F.when(~F.col(page_id).eqNullSafe(F.col("_min")), F.col("_min")))


def write_archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, level: int = 3) -> str:
    """Write one archive file per task and return the folder."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    path = path or folder(pages.sparkSession, "warc")
    dictionary = train_dictionary(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        begun = False
        for batch in batches:
            out = [] if begun else [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary]
            begun = True
            for p, u, h, r in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                out.append(pack.compress(record(p, u, (h or "").encode(), r, r is not None)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    typed = with_types(pages, "page_id", "html", min_bytes).select("page_id", "url", "html", "_refers")
    # the cast keeps the bytes as they are; the writer adds SEPARATOR after each
    typed.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, with the columns of ``RECORD``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                data, unpack, rows, size = data.as_py(), zstandard.ZstdDecompressor(), [], 0
                for magic, start, end in frames(data):
                    if magic == DICTIONARY_FRAME and end - start > 8:
                        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[start + 8:end]))
                    elif magic == FRAME:
                        rows.append(parse(unpack.decompress(data[start:end])))
                        size += len(rows[-1][-1])
                    if size > 4 << 20 or len(rows) > 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)
