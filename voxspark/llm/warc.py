"""Web archives: a writer and a splittable reader.

Each record is a gzip member of its own.  The writer leaves one archive for each task
in the shared folder and a manifest of those of successful tasks.  The reader deals
byte ranges of the archives to tasks.  A task scans its range for the gzip magic,
takes a place for a member only if its first bytes inflate to a WARC header, and owns
the records that begin in its range; it reads on beyond the range to end its last one.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the smallest
page id carries the payload and the others refer to it.

Results for odd inputs: a null html is an empty payload; a row with a null page id is
never referred to, and refers to an equal payload's record if another row has an id;
rows that repeat the smallest id all carry the payload; a null url leaves the target
out; line ends and other control characters in urls are percent-encoded; a payload of any
length is one record; an empty table makes no archive and no records; other columns are
dropped, whatever their names.

Damage raises an error that names archive and position: a member that does not inflate to
its end, a payload that does not match its digest, a file that ends before the size in its manifest, and,
since members follow each other without a gap, an archive that does not begin with a record and a
record that is followed by anything but a record or the archive's end (the task that owns a record
looks at what follows it, also beyond its range).  What a whole number of records less
leaves is found by :func:`check_counts`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from .bytehash import as_bytes
from ..scratch import Scratch

MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, size long, records long"
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, path string, position long"


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 100
    split_bytes: int = 8 << 20
    block_bytes: int = 1 << 20
    level: int = 6
    most_tasks: int = 50_000
    hot_share: int = 1000  # a payload that over 1 / hot_share of the repeated pages have is hot
    date: str = "2000-01-01T00:00:00Z"


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None or pd.isna(page_id) else int(page_id)}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, p: WarcParams) -> bytes:
    """One record in WARC 1.1, not compressed."""
    revisit = refers_to is not None and not pd.isna(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {p.date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if isinstance(url, str):
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\u0085  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The fields of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    out = {"page_id": number("WARC-Record-ID"), "uri": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    if out["record_type"] == "revisit":
        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        return out | {"payload": None, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    digest = hashlib.sha256(payload).hexdigest()
    if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


class _Window:
    """A file read on in blocks from some position, with what has been used dropped."""

    def __init__(self, file, size: int, start: int, block: int):
        self.file, self.size, self.base, self.block, self.data = file, size, start, block, bytearray()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        got = self.file.read_at(min(self.block, self.size - at), at)
        if not got:
            raise ValueError(f"the archive ends at {at}, before the {self.size} bytes of its manifest")
        self.data += got
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


def _inflate(w: _Window, limit: int | None = None) -> tuple[bytes, int] | None:
    """The member at the window's start and its length; with a limit, only so many first bytes; None if it is none."""
    z, out, used, size = zlib.decompressobj(31), [], 0, 0
    try:
        while not z.eof:
            if used >= len(w.data) and not w.more():
                return None
            part = bytes(memoryview(w.data)[used : used + w.block])
            out.append(z.decompress(part, limit) if limit else z.decompress(part))
            used, size = used + len(part), size + len(out[-1])
            if limit and size >= min(limit, 7):
                return b"".join(out), 0
    except zlib.error:
        return None
    return b"".join(out), used - len(z.unused_data)


def _begins_record(w: _Window) -> bool:
    while len(w.data) < len(MAGIC) and w.more():
        pass
    first = _inflate(w, 64) if w.data.startswith(MAGIC) else None
    return first is not None and first[0].startswith(b"WARC/1.")


def scan(file, size: int, start: int, end: int, block: int):
    """(position, inflated record) of the records that begin in [start, end)."""
    w = _Window(file, size, start, block)
    known = start == 0  # a record must begin here
    while known or w.base < end:
        if known:
            if w.base >= size:
                return
            if not _begins_record(w):
                raise ValueError(f"no record begins at {w.base}: it is damaged or cut off")
            if w.base >= end:
                return
        else:
            k = w.data.find(MAGIC)
            if k < 0:
                w.drop(max(0, len(w.data) - 2))  # the magic may go on in the next block
                if not w.more():
                    return
                continue
            w.drop(k)
            if w.base >= end:
                return
            if not _begins_record(w):
                w.drop(1)
                continue
        member = _inflate(w)
        if member is None:
            raise ValueError(f"the record at {w.base} is damaged or cut off")
        yield w.base, member[0]
        w.drop(member[1])
        known = True


def _with_first(pages: DataFrame, params: WarcParams, scratch: Scratch) -> DataFrame:
    """pages with refers_to.  Payloads of very many copies (there are fewer than `hot_share`) go to their rows
    by broadcast, the others, each with a small share of the rows, by an exchange."""
    large = pages.where(F.octet_length("html") >= params.revisit_bytes)
    first = scratch.keep(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = first.where(F.col("n") * params.hot_share > total).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    marked = pages.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("hot IS NULL").join(first.where(F.col("n") * params.hot_share <= total).drop("n"), "digest", "left")
    rows = marked.where("hot").withColumn("first", F.col("hot_first")).unionByName(rest)
    return rows.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))


def write_archives(pages: DataFrame, params: WarcParams = WarcParams(), scratch: Scratch | None = None) -> DataFrame:
    """Write pages(page_id, url, html); the manifest (path, size, records) of the archives."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    rows = _with_first(pages, params, scratch)

    def write(frames):
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        out = None
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                out = out or where.open_output_stream(name, compression=None)
                data = gzip_member(record(row.page_id, row.url, as_bytes(row.html), row.digest, row.refers_to, params), params.level)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pd.DataFrame([{"path": f"{folder}/{name.rpartition('/')[2]}", "size": size, "records": n}])

    return scratch.keep(rows.select("page_id", "url", "html", "digest", "refers_to").mapInPandas(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The records of archives(path, size), read by byte ranges."""
    step = F.lit(params.split_bytes)
    splits = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step.cast("long"))).alias("start"))
    n = splits.count()
    splits = splits.withColumn("end", F.least(F.col("start") + step, "size"))
    # a fixed number, so that the few bytes that name the splits don't make Spark read them all in one task
    splits = splits.repartitionByRange(max(1, min(n, params.most_tasks)), "path", "start") if n > 1 else splits

    def read(frames):
        for pdf in frames:
            for split in pdf.itertuples(index=False):
                where, path = pafs.FileSystem.from_uri(split.path)
                found, held = [], 0
                with where.open_input_file(path) as file:
                    try:
                        for position, data in scan(file, split.size, split.start, split.end, params.block_bytes):
                            found.append(parse(data) | {"path": split.path, "position": position})
                            held += len(data)
                            if held >= 8 << 20:
                                yield pd.DataFrame(found)
                                found, held = [], 0
                    except ValueError as error:
                        raise ValueError(f"{split.path}, bytes {split.start} to {split.end}: {error}") from error
                if found:
                    yield pd.DataFrame(found)

    return splits.mapInPandas(lambda it: (df.astype({"page_id": "Int64", "refers_to": "Int64"}) for df in read(it)), RECORDS)


def check_counts(records: DataFrame, manifest: DataFrame) -> None:
    """Raise if some archive of the manifest gave more or fewer records(path) than were written."""
    read = records.groupBy("path").agg(F.count("*").alias("read"))
    wrong = manifest.join(read, "path", "left").where(F.coalesce("read", F.lit(0)) != F.col("records")).select("path", "records", "read").first()
    if wrong:
        raise ValueError(f"{wrong.path} has {wrong.read or 0} records, its manifest says {wrong.records}")
