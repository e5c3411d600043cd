"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, new_folder, table, written

#: Fixed values of the seekable format: the skippable frame that holds the table, and the mark at its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Raw bytes of a frame, compressed bytes of a bundle, from which on the next one is begun.
FRAME, BUNDLE = 256 << 10, 8 << 20
#: Records of a bundle at most.
RECORDS = 100_000
#: Repeated payloads whose first pages (some 100 bytes each) are broadcast, the most repeated ones; others are shuffled to.
BROADCAST = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_control = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, told: str, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or, given refers_to, a revisit record with the HTTP headers alone. size and
    told are the payload's bytes and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines.append(f"WARC-Target-URI: {_control.sub(lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}")
    lines.append(f"WARC-Payload-Digest: sha1:{told}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(value: str) -> int | None:
    value = value.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at a place: page_id, url, payload (None of a revisit), payload_bytes, payload_digest,
    record_type, refers_to; and the place after it. A response's digest is computed and held against its header."""
    end = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    block = raw[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    response = head["WARC-Type"] == "response"
    if response and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    out = {"page_id": _page(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload": payload if response else None, "payload_bytes": length, "payload_digest": told, "record_type": head["WARC-Type"], "refers_to": None if response else _page(head["WARC-Refers-To"])}
    return out, start + size + 4


class Bundle:
    """Records gathered into independent frames, with a seek table at the end."""

    def __init__(self, level: int = 3, frame: int = FRAME):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=level)
        self.frame, self.out, self.sizes, self.held, self.length, self.places = frame, io.BytesIO(), [], [], 0, []

    def add(self, raw: bytes) -> None:
        self.places.append((len(self.sizes), self.length, len(raw)))
        self.held.append(raw)
        self.length += len(raw)
        if self.length >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.length))
            self.held, self.length = [], 0

    def size(self) -> int:
        return self.out.tell() + self.length

    def finish(self) -> bytes:
        self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        return self.out.getvalue()


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Place, compressed and raw size of each frame, from the table at the end of a bundle, or of its last bytes."""
    n, flags, mark = struct.unpack("<IBI", bundle[-9:])
    if mark != SEEKABLE or flags & 0x7F:
        raise ValueError("no seek table")
    start = len(bundle) - 9 - 8 * n
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("damaged seek table")
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", bundle[start : start + 8 * n]):
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, raw = place
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=raw)


def read_record(bundle: bytes, frame: int, start: int) -> dict:
    """One record, by its place in the index: only its frame is decompressed."""
    return parse(read_frame(bundle, seek_table(bundle)[frame]), start)[0]


def put_file(uri: str, data: bytes) -> None:
    """Writes a file of the shared store (anything that Arrow's file systems reach), whole or not at all."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.part", compression=None) as out:
        out.write(data)
    store.move(f"{path}.part", path)


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """rows (page_id, url, html, digest, size) with refers_to; html is null where it is set.

    Of rows with equal payloads of at least `least` bytes one is first: that of the smallest page_id, of several rows
    with it that of the smallest hash of its url, of equal rows any one. Rows that repeat a first page_id are counted,
    not gathered: they are merged by partial aggregates and made again from their number.
    """
    place = F.xxhash64("url")
    each = rows.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n", "at")).alias("f")
    firsts = written(each.groupBy("digest").agg(best, F.sum("n").alias("k")).where("k > 1 and not f.none").select(F.col("digest").alias("__d"), F.col("f.page_id").alias("first"), F.col("f.n").alias("n"), F.col("f.at").alias("at"), "k"), "firsts")
    # the most repeated payloads meet their rows without a shuffle; each other one is a small part of all rows
    many = firsts.count() > BROADCAST
    top = firsts.orderBy(F.desc("k"), "__d").limit(BROADCAST) if many else firsts
    joined = rows.join(F.broadcast(top), F.col("digest") == F.col("__d"), "left")
    if many:
        rest = firsts.join(F.broadcast(top.select(F.col("__d").alias("__t"))), F.col("__d") == F.col("__t"), "left_anti")
        late = joined.where("__d is null").select(*rows.columns).join(rest.hint("merge"), F.col("digest") == F.col("__d"), "left")
        joined = joined.where("__d is not null").unionByName(late)
    mine = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    twice = mine & (F.col("n") > 1)
    refers = F.when(~mine, F.col("first"))
    out = joined.where(~twice | F.col("first").isNull()).select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers_to"))
    if firsts.where("n > 1").isEmpty():
        return out
    merged = joined.where(twice).groupBy("digest", "page_id", "url", "size", "at").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
    ahead = place == F.col("at")
    response = merged.where(ahead).select("page_id", "url", "html", "digest", "size", F.lit(None).cast("long").alias("refers_to"))
    copies = merged.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", F.col("page_id").alias("refers_to"), F.explode(F.expr("sequence(1, n)")).alias("c"), ahead.alias("ahead"))
    return out.unionByName(response).unionByName(copies.where("not ahead or c > 1").drop("c", "ahead"))


def write_warc(pages: DataFrame, folder: str, *, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) in bundles below folder; returns the index as a table:
    page_id, bundle (file name), frame, start (in the frame), length.

    Of the records whose payloads (html in UTF-8, null: empty) are equal and of at least `least` bytes, the one with the
    smallest page_id is a response and the others revisit it; shorter ones are responses all. Of several rows with that
    page_id one is the response, the others revisit it. A record of a null page_id revisits a numbered one if there is
    one, else it is a response. A null url becomes about:blank. Other columns are not read; an empty table gives no
    bundle. The smallest ids are partial minima by digest, so copies in any number don't meet in a task, and a revisit's
    payload never goes to Python; the index names only bundles of tasks that counted, so files that a lost or repeated
    task left are never read.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, ids = Bundle(), []

        def close() -> pd.DataFrame:
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
            put_file(f"{folder}/{name}", bundle.finish())
            out = pd.DataFrame(bundle.places, columns=["frame", "start", "length"])
            out.insert(0, "bundle", name)
            out.insert(0, "page_id", pd.array(ids, "Int64"))
            return out

        whole = lambda v: None if pd.isna(v) else int(v)
        for frame in frames:
            for part in batches([frame], "html"):
                for page, url, html, sha1, size, first in zip(*(part[c] for c in ("page_id", "url", "html", "digest", "size", "refers_to"))):
                    told = base64.b32encode(bytes.fromhex(sha1)).decode()
                    bundle.add(record(whole(page), url, html.encode("utf-8", "surrogatepass") if html is not None else None, int(size), told, whole(first), date))
                    ids.append(whole(page))
                    if bundle.size() >= BUNDLE or len(ids) >= RECORDS:
                        yield close()
                        bundle, ids = Bundle(), []
        if ids:
            yield close()

    return written(revisits(rows, least).mapInPandas(write, "page_id long, bundle string, frame int, start long, length long"), "index")


class Reader:
    """A bundle in the store, read by its seek table: a frame at a time, by its bytes alone."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n = struct.unpack("<IBI", self.file.read_at(9, size - 9))[0]
        tail = min(size, 17 + 8 * n)
        self.places = seek_table(self.file.read_at(tail, size - tail))

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.places[k]
        return read_frame(self.file.read_at(packed, at), (0, packed, raw))


def read_warc(spark: SparkSession, folder: str, index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of an index, read back from their bundles: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload.

    Index rows, not contents, are dealt out by bundle and sorted by place; a task reads the bytes of one frame at a time,
    found by the bundle's seek table, and takes each record at its offset. A record that is not where the index says, or
    a damaged payload, is an error.
    """

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reader, at, raw = None, None, -1, b""
        for frame in frames:
            rows = []
            for page, bundle, k, start, length in zip(*(frame[c] for c in ("page_id", "bundle", "frame", "start", "length"))):
                if bundle != name:
                    name, reader, at = bundle, Reader(f"{folder}/{bundle}"), -1
                if k != at:
                    at, raw = k, reader.frame(k)
                row, end = parse(raw, start)
                if end - start != length or row["page_id"] != (None if pd.isna(page) else page):
                    raise ValueError(f"{bundle}: no record of page {page} at {start} of frame {k}")
                rows.append(row)
                if len(rows) == 500:
                    yield shaped(rows)
                    rows = []
            if rows:
                yield shaped(rows)

    def shaped(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
        return out[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]]

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = index.select("bundle").distinct().count()
    dealt = index.repartition(min(10_000, names + 1), "bundle").sortWithinPartitions("bundle", "frame", "start")
    return dealt.mapInPandas(told, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back; null html is empty, repeated pages as write_warc says."""
    folder = new_folder(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, index)


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: base32 in SQL: the digest's bits as text, five at a time.
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, hex, strlen(body) AS payload_bytes,
         array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(CAST('0x' || substr(hex, i, 1) AS INTEGER)), 4)), '') AS bits
  FROM p),
k AS (
  SELECT page_id, hex, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('{_DIGITS}', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (1 << CAST(4 - j AS INTEGER)))) AS INTEGER), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS n
  FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM k
"""
