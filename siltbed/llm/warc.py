"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader deals byte ranges of the archives to tasks. A task looks for gzip magic in its range and validates a candidate member by
decoding it: it begins with a WARC header, its checksum holds, and its block has the length that the header says and ends with it. The
task owns the records that start inside its range; it reads on past the end of the range to finish the last one, and goes on where a
record ends. Where a member is damaged the search goes on behind its magic, so a damaged record costs no other one. A member that is
stored inside another one's payload is no record: where a record reaches into later ranges, what starts there before its end is left
out again. So the records don't depend on how the archives are cut. Neither an index nor a common driver list of records is needed.

Nothing is lost in silence: bytes that belong to no record are counted (``damage``), and where a manifest says how many records an
archive has, reading fewer or more is an error, unless ``strict`` is off.

The writer marks records of equal payloads: that with the largest page_id is the response, the others revisit it, if the payload
has ``LEAST`` bytes at least. Null html is an empty payload; a null page_id is always a response that nothing refers to; of
repeated rows with the largest id all are responses; a null url is left out; other columns are ignored. Archives are written under
names of their own by every attempt of a task, and only those that Spark commits to the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from siltbed.llm import common as C

MAGIC = b"\x1f\x8b\x08"
START = b"WARC/1."
ARCHIVE_BYTES = 64 << 20  # size at which a task begins another archive
SPLIT_BYTES = 4 << 20  # bytes that one reading task unit covers
CHUNK = 1 << 16
LEAST = 0
DATE = "2024-01-01T00:00:00Z"  # the tables carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """A WARC record as a gzip member; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > "\x20" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def normal_uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def archive_rows(folder: str, archive_bytes: int):
    """A function for mapInArrow over (page_id, url, html, refers_to): writes archives, gives (path, size, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    where.create_dir(base, recursive=True)
                    out, size, n = where.open_output_stream(f"{base}/{path}", compression=None), 0, 0  # members are compressed already
                payload = (html or "").encode()
                data = record_bytes(page_id, url, payload, refers, digest(payload))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", size, n))
        if done:
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "size", "records"])

    return run


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to). Equal payloads are found by digest and length; only groups of two or more move on, and the join
    reads both sides from storage, so that AQE can split a hot payload."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("len"))
    groups = keyed.filter(F.col("len") >= least).groupBy("sha", "len").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = C.materialize(groups.filter("n > 1 and top is not null").drop("n"), "warc-groups")
    found = keyed.filter("page_id is not null").select("page_id", "sha", "len").join(groups, ["sha", "len"]).filter("page_id < top")
    revisits = C.materialize(found.select(F.col("page_id").alias("id"), F.col("sha").alias("same"), F.col("top").alias("refers_to")).distinct(), "warc-revisits")
    joined = keyed.join(revisits, (F.col("page_id") == F.col("id")) & (F.col("sha") == F.col("same")), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page as a record; the manifest (path, size, records) lists the committed archives."""
    spark = C.prepared(pages)
    folder = normal_uri(folder or C.scratch_dir(spark, "warc"))
    manifest = with_references(pages, least).mapInArrow(archive_rows(folder, archive_bytes), "path string, size long, records long")
    return C.materialize(manifest, "warc-manifest")


class Source:
    """Random access to a file by chunks; holds what lies ahead of ``base`` only."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.base, self.data = handle, size, 0, b""

    def at(self, start: int, n: int) -> bytes:
        """Up to n bytes from start."""
        end = min(self.size, start + n)
        if start < self.base or start > self.base + len(self.data):
            self.base, self.data = start, b""
        while self.base + len(self.data) < end:
            self.handle.seek(self.base + len(self.data))
            more = self.handle.read(max(CHUNK, end - self.base - len(self.data)))
            if not more:  # the file is shorter than it was said to be
                self.size = end = self.base + len(self.data)
            self.data += more
        if start - self.base > 16 * CHUNK:
            self.data, self.base = self.data[start - self.base:], start
        return self.data[start - self.base:end - self.base]


def header(data: bytes) -> dict[str, str] | None:
    """Fields of a WARC header (lower-case names), or None if the bytes aren't one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def member(source: Source, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the whole gzip member at ``at`` if it begins like a WARC record; its checksum is verified."""
    if source.at(at, 3) != MAGIC:
        return None
    unpack, parts, size = zlib.decompressobj(31), [], 0
    step = 1024  # most candidates that aren't records show it at once
    try:
        while not unpack.eof:
            chunk = source.at(at, step)
            if not chunk:
                return None
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
            if size < len(START) and not (start := b"".join(parts)[:len(START)]).startswith(START[:len(start)]):
                return None
            size, step = size + len(parts[-1]), CHUNK
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def record(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(fields, block) of a record that is whole: header, as many bytes as it says, and the two line ends or nothing."""
    fields = header(content)
    if fields is None:
        return None
    body = content.index(b"\r\n\r\n") + 4
    end = body + int(fields["content-length"])
    return (fields, content[body:end]) if end <= len(content) and content[end:] in (b"\r\n\r\n", b"") else None


def records(handle, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, end, fields, block) of the records that start in [start, end), as far as the range alone can tell: the first ones may be
    stored inside a record that starts before the range."""
    source, at = Source(handle, size), start
    while at < end:
        found = source.at(at, CHUNK).find(MAGIC)
        if found != 0:
            at += found if found > 0 else max(1, min(CHUNK, size - at) - 2)
            continue
        content = member(source, at)
        whole = record(content[0]) if content else None
        if whole is None:
            at += 1
            continue
        yield at, content[1], *whole
        at = content[1]


def urn_number(text: str | None) -> int | None:
    number = (text or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, start, end) to records; a response's digest is taken from its payload, and a record whose header says another
    one is damaged."""
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
            where, name = file_system(path)
            out = []

            def table() -> pa.RecordBatch:
                cols = list(zip(*out)) if out else [()] * len(TYPES)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

            held = 0
            with where.open_input_file(name) as handle:
                for at, stop, fields, block in records(handle, size, start, end):
                    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    sound = kind != "response" or not said or digest(payload) == said
                    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    out.append((path, start, at, stop, sound, urn_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, said, kind,
                                urn_number(fields.get("warc-refers-to")), payload.decode("utf-8", "replace") if kind == "response" else None))
                    held += len(block)
                    if len(out) >= C.BATCH_ROWS or held >= C.BATCH_BYTES:
                        yield table()
                        out, held = [], 0
            yield table()


PLACE = ["path", "range", "at", "stop", "sound"]
NAMES = [*PLACE, "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
RECORDS = ("path string, range long, at long, stop long, sound boolean, page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, payload string")


def placed_records(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives in a manifest (path, size) with their places, read by byte ranges and written once.

    A record that reaches over its range's end hides what starts before its own end in the ranges behind. Ranges are few (one for
    ``split_bytes`` of an archive) and their reach is a running maximum by archive; only ranges that do hide something meet the records again."""
    spark = C.prepared(manifest)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = manifest.filter("size > 0").withColumn("start", starts).select("path", "size", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))
    n = C.pieces(spark, int(manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]), split_bytes)
    found = C.materialize(ranges.repartition(n, "path", "start").mapInArrow(split_rows, RECORDS), "warc-records")
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = found.groupBy("path", "range").agg(F.max("stop").alias("reach"), F.min("at").alias("first")).withColumn("hidden", F.max("reach").over(before))
    hiding = C.materialize(reach.filter("first < hidden").select("path", "range", "hidden"), "warc-hidden")
    if hiding.isEmpty():
        return found
    return found.join(hiding, ["path", "range"], "left").filter("hidden is null or at >= hidden").drop("hidden")


def damage(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, n_records, n_unsound, lost_bytes): what reading each archive of a manifest finds. Unsound records differ from their
    digest; lost bytes belong to no record."""
    found = placed_records(manifest, split_bytes).groupBy("path").agg(
        F.count("*").alias("n"), F.sum((~F.col("sound")).cast("long")).alias("n_unsound"), F.sum(F.col("stop") - F.col("at")).alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return manifest.select("path", "size").join(found, "path", "left").select(
        "path", "size", zero("n").alias("n_records"), zero("n_unsound").alias("n_unsound"), (F.col("size") - zero("held")).alias("lost_bytes"))


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, strict: bool = True) -> DataFrame:
    """Sound records of the archives in a manifest (path, size and, if known, records)."""
    found = placed_records(manifest, split_bytes).filter("sound")
    if strict and "records" in manifest.columns:
        said = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
        if (read := found.count()) != said:
            raise ValueError(f"{read} sound records were read, the manifest says {said}")
    return found.drop(*PLACE)
