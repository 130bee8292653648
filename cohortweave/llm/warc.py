"""WARC archives with a dictionary in a leading skippable frame and one Zstandard frame a record."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.session import materialise, shared_dir

# Frame magics of the Zstandard format, and of the WARC dictionary convention.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 48 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
READ_TASKS = 20_000  # tasks that read archives at most; one reads several if there are more
READ_BYTES = 1 << 15
MANIFEST = "path string, size long, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
           "payload binary")


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to for every row.

    The smallest id of each digest comes from a pre-aggregated narrow table; only it is joined back.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT_BYTES
    first = (rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1 AND _first IS NOT NULL"))
    joined = rows.join(first, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("_first")).alias("refers_to"))


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the payload's length and digest but not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id)}",
            f"WARC-Target-URI: {url.encode('unicode_escape').decode()}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload or None)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    page = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != record_urn(None) else None
    kind = fields["WARC-Type"]
    return (page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"].encode().decode("unicode_escape"), kind,
            page(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            int(stated["Content-Length"]), payload if kind == "response" else None)


def train(samples: list[bytes]) -> bytes:
    """A dictionary built from some of the archive's records; plain content when too few to train on."""
    total = sum(map(len, samples))
    if total >= 10 * DICTIONARY_BYTES and len(samples) >= 20:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    return b"".join(samples)[-DICTIONARY_BYTES:]


def encode_archive(records: list[bytes]) -> bytes:
    """A skippable frame with the compressed dictionary, then every record in a frame of its own.

    The dictionary is built from evenly spread records of this archive, up to SAMPLE_BYTES of them;
    records longer than a quarter of that are left out of the sample.
    """
    usable = [r for r in records if len(r) <= SAMPLE_BYTES // 4]
    step = max(1, sum(map(len, usable)) // SAMPLE_BYTES)
    content = train(usable[::step])
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
    out = [struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed]
    if content:
        one = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind),
                                       write_checksum=True)
    else:
        one = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    out += [one.compress(r) for r in records]
    return b"".join(out)


def decode_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, from its bytes alone."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    content = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    reader = (zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
              if content else zstandard.ZstdDecompressor())
    at = 8 + size
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(data[at:at + READ_BYTES]))
            at = min(at + READ_BYTES, len(data))
        at -= len(one.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write one record a row to archives under `folder` (a new one in the shared folder by default).

    Returns the manifest (path, size, records), stored, so the files of failed or repeated task
    attempts are left out. A task holds one archive of at most ARCHIVE_BYTES of records (or one record).

    Null html is an empty payload, null url an empty one. Payloads of at least MIN_REVISIT_BYTES equal
    to that of a smaller page_id become revisits; rows that repeat the smallest page_id and its payload
    are responses again. Null page_id revisits a row with an id, or is a response when no equal payload
    has one. An empty table gives no archive. Other columns are not read.
    """
    folder = folder or posixpath.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(uri)
        target.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        held, size, n = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, n
            path, data = f"{name}-{n:05d}.warc.zst", encode_archive(held)
            with target.open_output_stream(f"{root}/{path}", compression=None) as f:
                f.write(data)
            out = pa.RecordBatch.from_pydict({"path": [f"{uri}/{path}"], "size": [len(data)], "records": [len(held)]})
            held, size, n = [], 0, n + 1
            return out

        for row in rows_of(batches):
            held.append(encode_record(*row))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
        if held:
            yield close()

    rows = with_revisits(pages, id_col, url_col, html_col)
    return materialise(rows.mapInArrow(write, MANIFEST))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a stored manifest, payloads included (null for revisits).

    Each archive is about one partition: their number is given, so that small manifest rows are not put together."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for path, _, records in rows_of(batches):
            source, at = fs.FileSystem.from_uri(path)
            with source.open_input_stream(at, compression=None) as f:
                data = f.read()
            held, n = [], 0
            for raw in decode_archive(data):
                held.append(decode_record(raw))
                n += 1
                if len(held) >= 500:
                    yield batch_of(held, names, kinds)
                    held = []
            if held:
                yield batch_of(held, names, kinds)
            if n != records:
                raise ValueError(f"{path}: {n} records instead of {records}")

    parts = min(max(manifest.count(), 1), READ_TASKS)
    return manifest.repartition(parts, "path").mapInArrow(read, RECORDS)


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def restored_payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of every revisit taken from the response it refers to."""
    own = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("_of"),
                                                           F.col("payload_digest"))
    found: Column = F.coalesce("payload", "_of")
    return records.join(own.dropDuplicates(["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "left").select(
        *[found.alias("payload") if c == "payload" else c for c in records.columns])
