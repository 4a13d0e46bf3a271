"""WARC archives with one Zstandard frame per record and an embedded dictionary.

Layout of an archive (the published .warc.zst convention): first a skippable
frame (magic 0x184D2A5D) holding the dictionary, then every record as a frame
of its own, compressed with it.  Any record can be read alone, and the
dictionary makes up for what single frames cannot learn from each other.

The dictionary is trained once, on pieces of records spread evenly over the
whole table (a bounded number, each of bounded size, so that no large page
uses up the sample), and every archive carries it.  Where there is too little
to train on, the pieces themselves are the dictionary (raw content): no archive
is without one.

Folders are reached through Arrow: local and mounted paths, ``s3`` (``s3a`` is
taken as the same), ``gs``, and ``hdfs`` where the workers have libhdfs.

Distributed plan: equal payloads are found by a map-side combined grouping on
their SHA-1 and length (a payload that a third of all pages share is one row
per partition); the group is attached back without piling up its pages
(``common.attach``).  Each task writes its records to archives of bounded size
in the shared folder and returns their names; only archives in that staged list
count, so a task that is lost and run again leaves nothing twice.  Reading
deals the archives out and streams each one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, pick, small_batches, stage, staging_path, utf8

# The frame magic of dictionaries in .warc.zst files, the magic
# of plain Zstandard frames, and the WARC profile of revisit records.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Layout:
    """Compression level, largest dictionary, records it is trained on and
    bytes taken of each at most, archive size at which the next begins."""

    level: int = 3
    dictionary: int = 65_536
    sample: int = 1000
    piece: int = 4096
    archive: int = 64_000_000
    date: str = "1970-01-01T00:00:00Z"


def _urn(page_id: str) -> str:
    return f"urn:page:{quote(page_id, safe='')}"


def _id_of(urn: str | None) -> str | None:
    """The page id that a record's name holds, null where it has none."""
    start = "<urn:page:"
    return unquote(urn[len(start):-1]) if urn is not None and urn.startswith(start) else None


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None,
                 date: str) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP headers of its response,
    with the payload's length, but no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    # no header can be broken by what a URL or an id holds; a record without an
    # id is named after its payload
    base32 = b32encode(bytes.fromhex(digest)).decode()
    name = f"urn:sha1:{base32}" if page_id is None else _urn(page_id)
    target = quote(url or name, safe="!#$%&'()*+,/:;=?@[]~-._")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{base32}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP headers, payload); raises where lengths disagree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def train(samples: list[bytes], most: int) -> bytes:
    """A dictionary of at most ``most`` bytes from pieces of records.  Fewer
    than 8 of them, under 8 KB in all, or pieces with nothing to choose from
    (one record repeated) do not train: then their last bytes, which every
    Zstandard reader takes as raw content, are the dictionary."""
    size = min(most, sum(map(len, samples)) // 8)
    if len(samples) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-most:]


def dictionary(records: DataFrame, layout: Layout, count: int) -> bytes:
    """The dictionary of a table of ``count`` records (``page_records``).  A
    hash of id, URL and digest picks about twice ``layout.sample`` of them
    wherever they are, repeated ones once; of those with the smallest hash, the
    head and a piece of the payload that starts at a place given by the hash."""
    picked, spread = F.xxhash64(F.lit("pick"), "id", "url", "digest"), F.xxhash64("id", "url", "digest")
    share = min(1.0, 2 * layout.sample / max(1, count))
    room = F.greatest(F.octet_length("payload") - F.lit(layout.piece), F.lit(0)) + 1
    at = (F.pmod(spread, room) + 1).cast("int")
    rows = (records.where(F.pmod(picked, F.lit(1 << 32)) < int(share * (1 << 32)))
            .select(F.col("id").cast("string").alias("id"), "url", "digest", spread.alias("h"),
                    F.substring(F.col("payload"), at, F.lit(layout.piece)).alias("piece")).distinct()
            .orderBy("h", "id", "url", "piece").limit(layout.sample).collect())
    pieces = [record_bytes(r["id"], r["url"], bytes(r["piece"]), r["digest"], None, layout.date) for r in rows]
    return train(pieces, layout.dictionary)


def write_archive(out: BinaryIO, records: Iterator[bytes], layout: Layout, learned: bytes) -> tuple[int, int]:
    """Write the dictionary, then records until the archive is full; (records,
    bytes) written."""
    written = out.write(struct.pack("<II", SKIPPABLE, len(learned)) + learned)
    shared = zstandard.ZstdCompressionDict(learned)
    shared.precompute_compress(level=layout.level)
    compress = zstandard.ZstdCompressor(level=layout.level, dict_data=shared, write_checksum=True).compress
    n = 0
    while written < layout.archive and (r := next(records, None)) is not None:
        written += out.write(compress(r))
        n += 1
    return n, written


def read_archive(src: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    data = src.read(8)
    learned = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        learned = zstandard.ZstdCompressionDict(src.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    context = zstandard.ZstdDecompressor(dict_data=learned)
    while True:
        data = data or src.read(chunk)
        if not data:
            return
        one, parts = context.decompressobj(), []
        while not one.eof:
            if not data and not (data := src.read(chunk)):
                raise ValueError("archive ends within a record")
            parts.append(one.decompress(data))
            data = b""
        data = one.unused_data
        yield b"".join(parts)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as every node reaches it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = 1000) -> DataFrame:
    """(id, url, payload, digest, refers_to): a page's record; refers_to names
    the response where the page is a revisit."""
    src = pick(pages, id_col, url_col, html_col)
    rows = src.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # payloads too short for a revisit have no key and are joined with nothing
    rows = rows.withColumn("key", F.when(F.col("bytes") >= least, F.struct("digest", "bytes")))
    same = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    same = stage(same.where("n > 1"), "warc-groups")
    rows = attach(rows, same, "key", "n", ["response"], deal_by=["id", "url"])
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return rows.select("id", "url", "payload", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, layout: Layout = Layout(), count: int | None = None) -> DataFrame:
    """Write the records of ``page_records`` to archives in ``folder``, all
    with one dictionary; the staged list (archive, records, bytes).  ``count``
    is the number of records, if known."""
    learned = dictionary(records, layout, records.count() if count is None else count)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)

        def each() -> Iterator[bytes]:
            for b in small_batches(batches, 64):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    yield record_bytes(*row, layout.date)

        records = each()
        while (first := next(records, None)) is not None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            # chain, unlike a generator, leaves records open for the next archive
            with files.open_output_stream(f"{path}/{name}", compression=None) as out:
                n, size = write_archive(out, chain([first], records), layout, learned)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])],
                                             ["archive", "records", "bytes"])

    text = [F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("r")]
    return stage(records.select(*text).mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc-list")


def read_warc(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload) of every record in the listed archives, ids as strings; payload is
    null for revisits.  A response whose payload does not have the digest its
    header names is an error."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str) -> Iterator[tuple]:
            files, inside = filesystem(path)
            with files.open_input_stream(inside, compression=None) as src:
                for record in read_archive(src):
                    head, http, payload = parse_record(record)
                    digest = b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    yield (_id_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind,
                           _id_of(head.get("WARC-Refers-To")), payload if kind == "response" else None)

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[2]
                    if len(held) >= 256 or size >= 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n).mapInArrow(
        run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, "
             "refers_to string, payload binary")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                       least: int = 1000, folder: str | None = None, layout: Layout = Layout()) -> DataFrame:
    """Archive every page, read the archives back, one row per record:
    page_id, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``.

    Defined cases: null html is an empty payload; a null URL becomes the
    record's name, a URN of the page id (percent-encoded, whatever it holds) or,
    for a null page id, of its payload; a null page id is archived as a response
    and never referred to; of equal payloads of at least ``least`` bytes every row with the
    largest page id is a response (repeated rows repeat it), the others
    revisit it; an empty table gives no archive and no rows; other columns are
    ignored, whatever their names.  A table too small to train a dictionary on
    has its records' own bytes as the dictionary.
    """
    kind = pages.schema[id_col].dataType
    folder = folder or staging_path(pages.sparkSession, "warc")
    records = page_records(pages, id_col, url_col, html_col, least)
    records = read_warc(write_warc(records, folder, layout, pages.count()))
    return records.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))
