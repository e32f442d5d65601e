"""Deterministic sharded WARC archives: writer and reader.

Records are range-sorted by id, then by the payload's digest. The ranges hold about equal bytes; their bounds come from a
sample that a hash of the keys draws, so the same table gives the same shards wherever and however often it runs. A task
streams one shard, rolls files by their compressed size, and builds every header and digest
anew. Files are written under temporary names that hold the attempt; what the successful attempts report is committed as
a table by Spark; files then get their final names; a manifest table, written last, is the commit. Readers open what the
manifest lists, check each file's size, and each record's digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import filesystem, map_batches, rehashed

#: Keys that the sample for the bounds holds for each shard and in all, about, and shards at most: they reach the driver.
KEYS_PER_SHARD, SAMPLE_KEYS, MOST_SHARDS = 64, 1 << 19, 1 << 15
#: Bytes of a record besides its payload, about.
RECORD_BYTES = 600
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def range_key(page_id: Column, sha1: Column) -> Column:
    """33 characters whose order is that of (id, nulls first; the digest's first 64 bits)."""
    turned = F.hex(F.bitwise_not(page_id).bitwiseXOR(F.lit((1 << 63) - 1)))  # the sign bit flipped
    return F.concat(F.coalesce(F.concat(F.lit("1"), F.lpad(turned, 16, "0")), F.lit("0" * 17)), F.substring(sha1, 1, 16))


def range_starts(rows: DataFrame, shard_bytes: int, sample_keys: int = SAMPLE_KEYS, most_shards: int = MOST_SHARDS) -> list[str]:
    """Least keys of the shards after the first: ranges of about shard_bytes, more where shards would be too many. rows: key, bytes.

    One pass sums the bytes, a second adds up those of every key that its hash puts into the sample: 64 for a shard, or 16
    where there are very many shards. The rows of one key stay together.
    """
    total, n = rows.agg(F.sum("bytes"), F.count("*")).first()
    shards = min(most_shards, -(-(total or 0) // shard_bytes))
    if shards <= 1:
        return []
    rate = min(1.0, min(sample_keys, KEYS_PER_SHARD * shards) / n)
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(np.ceil(rate * (1 << 20)))).groupBy("key").agg(F.sum("bytes").alias("bytes"))
    sample = sorted(map(tuple, drawn.collect()))
    share = sum(x for _, x in sample) / shards
    starts, held = [], 0
    for key, size in sample:
        if held and held + size / 2 >= share * (len(starts) + 1):
            starts.append(key)
        held += size
    return starts


@dataclass
class Header:
    """What every record of an archive shares."""

    date: str = "2026-01-01T00:00:00Z"
    software: str = "quern"
    extra: dict[str, str] = field(default_factory=dict)


def record_id(page_id: int | None, digest: str, place: int) -> str:
    h = hashlib.sha1(f"{page_id}|{digest}|{place}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _record(kind: str, name: str, block: bytes, headers: list[tuple[str, str]], date: str, content_type: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """A URL on one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, place: int, original: tuple[int | None] | None, date: str) -> bytes:
    """A response record or, given the id of the page that holds the payload, a revisit record without it."""
    headers = [] if page_id is None else [("Page-Id", str(page_id))]
    if url:
        headers.append(("WARC-Target-URI", _uri(url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response"
    if original is not None:
        kind, payload = "revisit", b""
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original[0], digest, 0))]
        if original[0] is not None:
            headers.append(("Refers-To-Page-Id", str(original[0])))
    return _record(kind, record_id(page_id, digest, place), http + payload, headers, date, "application/http;msgtype=response")


class _File:
    """One archive file under a temporary name."""

    def __init__(self, fs, folder: str, shard: int, part: int, attempt: int, header: Header, level: int):
        self.name = f"shard-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{attempt}"
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        self.out = fs.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.size, self.records, self.level, self.shard = 0, 0, level, shard
        info = "".join(f"{k}: {v}\r\n" for k, v in {"software": header.software, "format": "WARC File Format 1.1", **header.extra}.items()).encode()
        self.add(_record("warcinfo", record_id(None, self.name, -1), info, [("WARC-Filename", self.name)], header.date, "application/warc-fields"))
        self.records = 0

    def add(self, record: bytes) -> None:
        press = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = press.compress(record) + press.flush()
        self.out.write(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple[int, str, str, int, int]:
        self.out.close()
        return self.shard, self.name, self.temporary, self.size, self.records


MANIFEST = "shard int, name string, temporary string, bytes long, records long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int = 16 << 20,
    roll_bytes: int = 64 << 20,
    least_revisit_bytes: int = 0,
    level: int = 4,
    header: Header | None = None,
) -> DataFrame:
    """Write one record per row into `folder` (a URI that Spark and pyarrow can both write) and return the manifest.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least least_revisit_bytes, the
    one with the largest id is a response and the others revisit it. A null id sorts below all ids. Rows that repeat an id
    and a payload: the first is the response if their id is the largest, the rest revisit it. Further columns are not
    read; an empty table gives an empty manifest. Records of one range go to one shard, a shard's files follow each other;
    rows of one id, or without any, are dealt to several shards by their payloads' digests. Rows that repeat both an id and
    a payload stay in one shard, which streams them. At most MOST_SHARDS bounds are broadcast.
    """
    spark, header = pages.sparkSession, header or Header()
    fs_folder = folder.rstrip("/")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    asked = narrow.where(F.col("n") >= least_revisit_bytes).select("page_id", "sha1")
    several = asked.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("rows")).where("rows > 1").select("sha1", "response")
    marks = rehashed(asked, several, "sha1").where("response is not null and (page_id is null or page_id < response)").select("page_id", "sha1", "response").distinct()
    starts = range_starts(narrow.select(range_key(F.col("page_id"), F.col("sha1")).alias("key"), (F.col("n") + RECORD_BYTES).alias("bytes")), shard_bytes)
    held = spark.sparkContext.broadcast(np.array(starts, "S33"))

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, keys.to_numpy().astype("S33"), side="right").astype(np.int32))

    both = rows.select("page_id", F.sha1("payload").alias("sha1"), F.lit(1).alias("place"), "url", "payload", F.lit(None).cast("long").alias("response"))
    both = both.unionAll(marks.select("page_id", "sha1", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("binary"), "response"))
    both = both.withColumn("shard", shard_of(range_key(F.col("page_id"), F.col("sha1"))))
    # of rows that repeat an id and a payload the first by URL comes first, however they were dealt
    dealt = both.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", "place", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(fs_folder)
        attempt = TaskContext.get().taskAttemptId()
        file, part, done, key, place, mark = None, 0, [], None, 0, None
        for b in batches:
            for page_id, sha1, is_page, url, payload, response, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (page_id, sha1) != key:
                    key, place, mark = (page_id, sha1), 0, None
                if not is_page:
                    mark = (response,)
                    continue
                if file is not None and (file.shard != shard or file.size >= roll_bytes):
                    part = part + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = None
                if file is None:
                    file = _File(fs, path, shard, part, attempt, header, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                original = mark or ((page_id,) if place and len(payload) >= least_revisit_bytes else None)
                file.add(page_record(page_id, url, payload, digest, place, original, header.date))
                place += 1
        if file is not None:
            done.append(file.close())
        if done:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["shard", "name", "temporary", "bytes", "records"])

    written = map_batches(dealt.select("page_id", "sha1", "place", "url", "payload", "response", "shard"), write, MANIFEST)
    written.write.mode("overwrite").parquet(f"{fs_folder}/_written")
    # The table of the successful attempts is complete: name their files. Doing so twice changes nothing.
    listed = spark.read.schema(MANIFEST).parquet(f"{fs_folder}/_written")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, path = filesystem(fs_folder)
        for b in batches:
            for final, temporary, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if fs.get_file_info(f"{path}/{temporary}").type == FileType.File:
                    fs.move(f"{path}/{temporary}", f"{path}/{final}")
                if fs.get_file_info(f"{path}/{final}").size != size:
                    raise OSError(f"{final} is not the file that was written")
            yield b

    map_batches(listed, name, MANIFEST).write.mode("overwrite").parquet(f"{fs_folder}/manifest")
    fs, path = filesystem(fs_folder)
    for rest in ("_temporary", "_written"):  # files of lost attempts
        try:
            fs.delete_dir(f"{path}/{rest}")
        except FileNotFoundError:
            pass
    return spark.read.schema(MANIFEST).parquet(f"{fs_folder}/manifest")


def members(stream, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time; chunks are short, as each member copies what is left of its last one."""
    data, press, out = b"", None, []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if press is not None:
                    raise ValueError("the archive ends within a record")
                return
        if press is None:
            press, out = zlib.decompressobj(31), []
        out.append(press.decompress(data))
        data = b""
        if press.eof:
            yield b"".join(out)
            data, press = press.unused_data, None


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record, its block digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if headers.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise ValueError(f"wrong block digest in {headers.get('warc-record-id')}")
    return headers, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that a committed manifest lists: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is checked against its digest. A revisit has no payload of its own (null); its digest and length
    are those of the full payload. Every file is one task's, streamed record by record.
    """
    fs_folder = folder.rstrip("/")
    files = spark.read.schema(MANIFEST).parquet(f"{fs_folder}/manifest").select("name", "bytes")
    files = files.repartition(max(1, min(4096, files.count())), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(fs_folder)
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{path}/{name}").size != size:
                    raise OSError(f"{name} is not the file that the manifest lists")
                out, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        row = _page_row(*parse_record(raw), with_payload)
                        if row:
                            out.append(row)
                            held += len(row[2] or b"")
                        if len(out) >= 1024 or held > 8 << 20:
                            yield _batch(out)
                            out, held = [], 0
                if out:
                    yield _batch(out)

    return map_batches(files, read, RECORDS)


def _page_row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple | None:
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].partition(":")[2]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"wrong payload digest in {headers.get('warc-record-id')}")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("page-id"), headers.get("warc-target-uri"), payload if with_payload and kind == "response" else None, size, digest, kind, number("refers-to-page-id")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
