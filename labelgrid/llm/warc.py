"""Deterministic sharded WARC archives, written and read by Spark tasks.

``write`` deals rows by ranges of (page id, payload digest) to shards, sorts each shard, and streams it into files: one gzip member for each record, a
new file once the compressed bytes of the last reach ``roll_bytes``. Headers and digests are made anew from the payload; nothing depends on the clock, on the number of
tasks or on their order, so the same rows give the same files byte for byte. Bounds of shards come from a sample chosen by hash, of at most
about ``PER_SHARD`` keys a shard; their number follows the bytes of the payloads up to ``MOST_SHARDS``.

Tasks write to temporary names. The names of those that finished are kept in a table, of which each has one row whatever was repeated or lost; only then are files given their
final names, and the manifest, written last, lists them. A reader takes what the manifest lists.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest page id is a response and the others are revisits, which carry no payload.
A mark for each revisit is dealt out with the rows and precedes its row, so payloads are shuffled once. Of rows that agree in id and payload the first in the
order of their addresses is the response.

A null payload is empty; a null page id precedes all others; a null address becomes ``NO_URI``. Blanks, control and non-ASCII characters of an address are
percent-encoded. Extra columns are not read; an empty table gives a manifest without files. The folder must be one that ``pyarrow.fs`` opens on
all executors. One payload must fit a task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm.common import small_batches, through_table

ROLL_BYTES, MIN_REVISIT = 64 << 20, 0
PER_SHARD, MOST_SHARDS = 8, 1 << 14
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"
NO_URI = "urn:x-record:none"
# Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(0x21, 0x7F)))
_LEAST = -(1 << 63)
PARTS = "temporary string, name string, records bigint, bytes bigint, md5 string"
RECORDS = (
    "file string, offset bigint, record_type string, record_id string, page_id bigint, target_uri string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"urn:x-record:{'' if page_id is None else page_id}:{digest}:{repeat}"


def page_of(record: str) -> int | None:
    """The page id in a record id that ``record_id`` made; null for others."""
    part = record.split(":")
    return int(part[2]) if part[:2] == ["urn", "x-record"] and len(part) == 5 and part[2] else None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; its length and block digest are worked out here."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, repeat: int, original: str | None) -> bytes:
    """A response, or a revisit of the record ``original``; the HTTP head of both states the length of the whole payload."""
    name = base64.b32encode(digest).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id, name, repeat)}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", NO_URI if url is None else quote(url, safe=_SAFE)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{name}"),
    ]
    if original is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{original}>")]
    return record(headers, head if original is not None else head + payload)


def member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


class Archive:
    """A file under a temporary name, hashed as it grows."""

    def __init__(self, folder: str, shard: int, number: int):
        self.name = f"{shard:06d}-{number:06d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        store, path = _opened(folder)
        self.out = store.open_output_stream(f"{path}/{self.temporary}", compression=None)
        self.records, self.bytes, self.hash = 0, 0, hashlib.md5()
        about = f"software: labelgrid\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {shard}\r\n".encode()
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-record:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(record(headers, about))

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.bytes += len(packed)
        self.hash.update(packed)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {"temporary": [self.temporary], "name": [self.name], "records": [self.records], "bytes": [self.bytes], "md5": [self.hash.hexdigest()]}
        return pa.RecordBatch.from_pydict(row)


def shard_count(total: int) -> int:
    """Shards for so many bytes of payload: of 1 MB up to 64 of them, of 64 MB beyond."""
    return int(max(1, min(64, total >> 20), min(MOST_SHARDS, total >> 26)))


def _shard_of(keys: DataFrame):
    """A column function (page id, digest) -> shard, the same for the same keys."""
    whole = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    shards = shard_count(whole["bytes"])
    every = max(1, whole["n"] // (shards * PER_SHARD))
    page, mark = F.coalesce("page_id", F.lit(_LEAST)), F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    some = keys.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0).groupBy(page.alias("page"), mark.alias("mark")).agg(F.sum(F.col("size") + 512).alias("size"))
    some = some.toPandas().sort_values(["page", "mark"])  # about PER_SHARD keys a shard
    reach = np.cumsum(some["size"].to_numpy(np.int64))
    place = np.searchsorted(reach, reach[-1] * np.arange(1, shards) / shards) if len(reach) else np.zeros(0, np.int64)
    place = np.unique(place)
    pages, marks = some["page"].to_numpy(np.int64)[place], some["mark"].to_numpy(np.int64)[place]

    def shard(page: pd.Series, mark: pd.Series) -> pd.Series:
        at, last = np.searchsorted(pages, page.to_numpy(), "left"), np.searchsorted(pages, page.to_numpy(), "right")
        for i in np.flatnonzero(at < last):
            at[i] += np.searchsorted(marks[at[i] : last[i]], mark.iloc[i], "left")
        return pd.Series(at, dtype="int32")

    return F.pandas_udf(shard, "int")(page, mark)


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES
) -> None:
    """Archive one record for each row below ``folder``, which must not hold a manifest yet."""
    small_batches(pages)
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    keys = through_table(rows.select("page_id", "digest", F.octet_length("payload").cast("bigint").alias("size")), "warc-keys")
    shard = _shard_of(keys)
    last = keys.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).where("n > 1")
    marks = keys.join(last.select("digest", "original"), "digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    # Written, so that the join deals both sides itself and may split a payload of very many copies.
    marks = through_table(marks.select("page_id", "digest", "original"), "warc-revisits")

    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", F.lit(None).cast("bigint").alias("original"), "payload").unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "original", F.lit(None).cast("binary").alias("payload"))
    )
    both = both.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, number, key, repeat, marked, original = None, None, 0, None, 0, False, None
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "original", "url", "payload")]
            for row in zip(*columns):
                own_part, page, digest, kind, own_original = (x.as_py() for x in row[:5])
                if (own_part, page, digest) != key:
                    key, repeat, marked = (own_part, page, digest), 0, False
                if kind == 0:
                    marked, original = True, own_original
                    continue
                if own_part != part or (out and out.bytes >= roll_bytes):
                    if out:
                        yield out.close()
                    number = number + 1 if own_part == part else 0
                    out, part = Archive(folder, own_part, number), own_part
                data = row[6].as_py()
                # Without a mark this key is the response of its payload, the first time it occurs.
                first = not marked and (repeat == 0 or len(data) < min_revisit)
                source = None if first else record_id(original if marked else page, base64.b32encode(digest).decode(), 0)
                out.add(page_record(page, row[5].as_py(), data, digest, repeat, source))
                repeat += 1
        if out:
            yield out.close()

    store, path = _opened(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    parts = through_table(both.mapInArrow(archive, PARTS), "warc-parts")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                # A repeated task finds the file moved already.
                if store.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{path}/{name}")
            yield batch.select(["name", "records", "bytes", "md5"])

    parts.mapInArrow(publish, PARTS.partition(", ")[2]).write.parquet(f"{folder}/manifest")
    store.delete_dir(f"{path}/_temporary")  # holds only what lost tasks left


def members(source) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, one in memory at a time."""
    packer, out, offset, used = zlib.decompressobj(31), [], 0, 0
    while chunk := source.read(CHUNK):
        while chunk:
            out.append(packer.decompress(chunk))
            rest = packer.unused_data if packer.eof else b""
            used += len(chunk) - len(rest)
            if packer.eof:
                yield offset, b"".join(out)
                packer, out, offset, used = zlib.decompressobj(31), [], offset + used, 0
            chunk = rest
    if used:
        raise ValueError(f"the member at {offset} is cut short")


def records(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset of the member, headers (names in lower case) and block of each record; lengths and block digests are checked."""
    for offset, data in members(source):
        at = 0
        while at < len(data):
            head = data.find(END, at)
            if head < 0 or not data.startswith(b"WARC/", at):
                raise ValueError(f"no record at {offset}")
            lines = data[at:head].decode().split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            first, size = head + len(END), int(headers["content-length"])
            block, at = data[first : first + size], first + size + len(END)
            if len(block) != size or data[at - len(END) : at] != END:
                raise ValueError(f"the record at {offset} is cut short")
            stated = headers.get("warc-block-digest", "").removeprefix("sha1:")
            if stated and stated != base32_sha1(block):
                raise ValueError(f"the record at {offset} differs from its digest")
            yield offset, headers, block


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(END)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of all files that the manifest below ``folder`` lists; columns as ``RECORDS``.

    payload_bytes and payload_digest are those of the whole payload: worked out for a response, and held against its header; as stated by a revisit. ``payload`` is null for
    revisits, and for all if it is not asked for.
    """
    files = spark.read.parquet(f"{folder}/manifest").select("name", "records", "bytes")
    small_batches(files)
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def rows(name: str, source) -> Iterator[tuple]:
        for offset, headers, block in records(source):
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, body = _http(block)
            digest, size, refers = headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), None
            if kind == "response":
                size, own = len(body), base32_sha1(body)
                if own != digest:
                    raise ValueError(f"{name}: the payload at {offset} differs from its digest")
            else:
                refers = page_of(headers["warc-refers-to"].strip("<>"))
            own_id, uri = headers["warc-record-id"].strip("<>"), headers["warc-target-uri"]
            yield name, offset, kind, own_id, page_of(own_id), None if uri == NO_URI else uri, size, digest, refers, body if payload and kind == "response" else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def made(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        store, path = _opened(folder)
        for batch in batches:
            for name, count, size in zip(*(batch.column(c).to_pylist() for c in ("name", "records", "bytes"))):
                if store.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} has another size than the manifest says")
                held, weight, seen = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for row in rows(name, source):
                        held.append(row)
                        seen, weight = seen + 1, weight + 256 + len(row[-1] or b"")
                        if weight >= 4 << 20:
                            yield made(held)
                            held, weight = [], 0
                if seen != count:
                    raise ValueError(f"{name} has another number of records than the manifest says")
                if held:
                    yield made(held)

    spread = files.repartition(max(1, min(MOST_SHARDS, files.count())), "name")
    return spread.mapInArrow(scan, RECORDS)
