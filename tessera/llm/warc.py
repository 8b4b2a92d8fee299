"""WARC archives of individually compressed records with an embedded Zstandard dictionary, and their reader.

Each archive is a ``.warc.zst`` file: a skippable frame that holds the dictionary (itself compressed), then one frame per
record, compressed with it: a warcinfo record, then one for each row. The dictionary is trained on a bounded sample of the archive's own records. Records with equal
payloads of at least ``LEAST`` bytes are stored once, as the response with the smallest id; the others revisit it.

Scale: the response of a payload is found by a grouped minimum over digests (summed before the shuffle) and a join on
digests that occur more than once; the join is a plain sort-merge one, so a digest that a third of all rows share is split at
run time. Archives are written by the tasks that hold the rows, each under a name of its own that is moved to its place
when complete, so that a task that runs again or elsewhere leaves no half archive; the manifest names the archives that
count. Memory is bounded by an archive's size.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, work_path

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Payload bytes in an archive; of the dictionary; of the sample that it is trained on (at most).
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 2 << 20
LEVEL = 6
#: Fixed values of the format: the skippable frame's and a plain frame's first bytes.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"


def record_bytes(kind: str, uri: str, page_id: str, payload: bytes, length: int, digest: str, refers: str | None,
        refers_uri: str | None, date: str) -> bytes:
    """A WARC 1.1 record with an id of its own. A response has an HTTP head before its payload; digest and length are the payload's alone."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if kind == "warcinfo":
        body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
        head.append("Content-Type: application/warc-fields")
    else:
        head += [f"WARC-Target-URI: {uri}", f"X-Page-ID: {page_id}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
            "Content-Type: application/http; msgtype=response"]
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        if kind == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
            if refers_uri:
                head.append(f"WARC-Refers-To-Target-URI: {refers_uri}")
        else:
            body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return fields, rest[:n]


def write_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary's skippable frame, then a frame per record."""
    import zstandard as zstd

    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    dictionary = None
    if len(sample) >= 8:
        try:
            dictionary = zstd.train_dictionary(DICTIONARY_BYTES if size > 10 * DICTIONARY_BYTES else max(1024, size // 10), sample)
        except zstd.ZstdError:  # too little to learn from: the sample's first bytes serve
            dictionary = None
    if dictionary is None:
        dictionary = zstd.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)
    packed = zstd.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *[compressor.compress(r) for r in records]])


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    import zstandard as zstd

    magic, n = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    known = zstd.ZstdDecompressor().decompress(raw[8 : 8 + n])
    kind = zstd.DICT_TYPE_FULLDICT if known[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(known, dict_type=kind))
    view = memoryview(raw)[8 + n :]
    while len(view):
        one = reader.decompressobj()
        parts = [one.decompress(view)]
        rest = one.unused_data
        yield b"".join(parts)
        view = view[len(view) - len(rest) :]


def _frames(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for r in read_archive(raw):
        yield parse_record(r)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all rows as archives under ``folder`` (a place that all executors reach) and returns the manifest.

    The manifest, itself a table under ``folder``, has one row per archive: archive (path), records, bytes.

    Defined cases: null html is an empty payload; a null url is an empty one; a null id is never the response of others but
    where all ids of a payload are null; rows of the smallest id are all responses if it is repeated; an empty table gives no
    archives; other columns are left out.
    """
    rows = pages.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumn("_digest", F.sha2("_html", 256))
    # Counting shuffles digests only; the join then shuffles the rows, html included, by digest.
    seen = rows.where(F.octet_length("_html") >= LEAST).groupBy("_digest").agg(
        F.min("_id").alias("_first"), F.min_by("_url", "_id").alias("_first_url"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    decided = rows.join(seen, "_digest", "left")
    later = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    decided = decided.select(
        "_id", "_url", F.when(later, F.lit(None)).otherwise(F.col("_html")).alias("_html"),
        F.octet_length("_html").cast("long").alias("_len"), "_digest",
        F.when(later, F.col("_first").cast("string")).alias("_refers"), F.when(later, F.col("_first_url")).alias("_refers_url"))
    archives = f"{folder}/archives"
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def put(records: list[bytes]) -> pa.RecordBatch:
        system, base = filesystem(archives)
        system.create_dir(base, recursive=True)
        raw = write_archive([record_bytes("warcinfo", "", "", b"", 0, "", None, None, date), *records])
        name = f"{base}/{uuid.uuid4().hex}.warc.zst"
        with system.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(raw)
        system.move(f"{name}.part", name)
        return pa.RecordBatch.from_arrays([pa.array([f"{archives}/{name.rpartition('/')[2]}"]), pa.array([len(records)], pa.int64()),
            pa.array([len(raw)], pa.int64())], names=["archive", "records", "bytes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                i, url, html, n, digest, refers, refers_url = (c[k].as_py() for c in b.columns)
                kind = "revisit" if refers is not None else "response"
                payload = (html or "").encode()
                r = record_bytes(kind, url.replace("\r", "%0D").replace("\n", "%0A"), "" if i is None else str(i), payload, n, digest, refers,
                                 refers_url and refers_url.replace("\r", "%0D").replace("\n", "%0A"), date)
                records.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    manifest = f"{folder}/manifest"
    decided.mapInArrow(work, "archive string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


def read_warc(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Reads the manifest's archives back: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null
    for revisits). The digest of each payload that is there is computed anew and must be what the record says."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
        for b in batches:
            for path in b.column(0).to_pylist():
                system, base = filesystem(path)
                with system.open_input_stream(base, compression=None) as f:
                    raw = f.read()
                rows, size = [], 0
                for fields, block in _frames(raw):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    block = block.partition(b"\r\n\r\n")[2]  # without the HTTP head
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = fields["WARC-Type"] == "response"
                    if whole and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"a payload in {path} isn't what its digest says")
                    rows.append({
                        "page_id": fields["X-Page-ID"] or None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
                        "refers_to": fields.get("X-Refers-To-Page"),
                        "payload_bytes": len(block) if whole else int(fields["X-Payload-Length"]), "payload_digest": digest,
                        "payload": block.decode() if whole else None})
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    # One archive after the other in a task, and the archives over all tasks.
    # A number of its own keeps the planner from putting their few rows, however many bytes they stand for, into one task.
    dealt = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    out = dealt.mapInArrow(work, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload string")
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first, count(*) AS copies FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
