"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds its dictionary, trained on records of the same
archive; each record is a frame of its own, so that a record can be read alone. Every task writes its
archives to a shared folder under names that no other attempt uses, and the table of archives that the
successful tasks return says which files count.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import staged

#: Fixed values of the WARC and Zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes of an archive, of its dictionary, and of the records that train it.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
#: Records are sampled in pieces of this many bytes.
PIECE_BYTES = 4 << 10
LEVEL = 3
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())]
)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    # A line break in a URL would end its header line.
    target = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url) if url is not None else None
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {target}"] if target is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"] if kind == "revisit" else []
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of ``RECORDS`` of one record; the digest of a stored payload is checked."""
    top, _, rest = record.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, body = block.partition(b"\r\n\r\n")
    size = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    out = {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None, "url": fields.get("WARC-Target-URI"), "payload": None}
    if kind == "revisit":
        out["refers_to"] = _page(fields["WARC-Refers-To"])
    else:
        if len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        out["payload"] = body.decode()
    return out


def _dictionary(records: list[bytes]):
    """A dictionary of pieces from all over the records, so that few large records give as many as many small ones.

    Where the trainer finds too little in common, the first pieces themselves are the dictionary.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    sample = [r[at : at + PIECE_BYTES] for r in records for at in range(0, len(r), PIECE_BYTES)][::step]
    size = min(DICTIONARY_BYTES, max(256, total // 8))
    if len(sample) >= 16:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(size, sample, k=256 if size >= 4096 else 64, d=8)
    first = b"".join(piece[: max(64, size // len(sample))] for piece in sample[: size // 64])[:size]
    return zstandard.ZstdCompressionDict(first, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of ``records``: their dictionary in the leading skippable frame, then a frame a record."""
    import zstandard

    trained = _dictionary(records)
    raw = trained.as_bytes()
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw + b"".join(press.compress(r) for r in records)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard

    magic, length = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    raw, at = data[8 : 8 + length], 8 + length
    use = zstandard.ZstdCompressionDict(raw) if raw else None
    view = memoryview(data)
    while at < len(data):
        reader = zstandard.ZstdDecompressor(dict_data=use).decompressobj() if use else zstandard.ZstdDecompressor().decompressobj()
        out = []
        end = at
        while not reader.eof and end < len(data):
            piece = view[end : end + (1 << 16)]
            out.append(reader.decompress(piece))
            end += len(piece)
        if not reader.eof:
            raise ValueError("the archive is cut off")
        at = end - len(reader.unused_data)
        yield b"".join(out)


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, size, record type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    # Grouped by digest alone, joined on digest and size: the join's own exchanges can be split where a digest is hot.
    groups = rows.groupBy("sha1").agg(F.max("page_id").alias("newest"), F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(groups, ["sha1", "payload_bytes"], "left")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")) & (F.col("payload_bytes") >= min_bytes)
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("newest")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the table of archives.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is the
    response and the others revisit it; rows that repeat this page_id are responses too. Where none of
    them has a page_id, all are responses. A null html is an empty payload, a null url gives a record
    without target. The table is (path, records, bytes); an empty table of pages writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
            data = archive_bytes(held)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                payload = (row["payload"] or "").encode()
                held.append(record_bytes(row["page_id"], row["url"], row["record_type"], row["refers_to"], digest, row["payload_bytes"], payload, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return staged(with_revisits(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (path, ...), columns ``RECORDS``; a task reads whole archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as file:
                    data = file.read()
                rows = []
                for record in read_archive(data):
                    rows.append(parse_record(record))
                    if not payloads:
                        rows[-1]["payload"] = None
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    # By number, as adaptive execution would put the short list of paths into one task.
    total = archives.count()
    tasks = max(1, min(total, max(4 * archives.sparkSession.sparkContext.defaultParallelism, total // 8)))
    return archives.select("path").repartition(tasks).mapInArrow(run, RECORDS)


#: The query's rows in DuckDB's SQL; base32 from 20-bit pieces of the hexadecimal digest.
REVISIT_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h FROM p),
g AS (SELECT h, max(page_id) AS newest FROM d GROUP BY h HAVING count(*) > 1),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS alphabet),
b AS (SELECT d.*, newest IS NOT NULL AND page_id IS DISTINCT FROM newest AS again, newest, alphabet FROM d LEFT JOIN g USING (h), a)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: alphabet[(((('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT]), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN newest END AS refers_to
FROM b
"""
