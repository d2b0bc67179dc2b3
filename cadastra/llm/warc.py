"""WARC archives: writing records with revisits, and a splittable reader.

Writing: each task writes one archive, every record a gzip member of its own, to
the shared folder, under a name no other attempt has, and returns it; archives of
failed attempts are in no list and are never read. Of records with equal
payloads of at least ``least`` bytes, that with the largest page_id is a
response, the others revisit it.

Reading: a task scans a byte range for the gzip magic. A candidate counts
when it inflates to a WARC header and when the file ends or another member
begins where it ends. A range owns the records that start inside it, and reads
on behind its end to finish the last one.

Files are reached through pyarrow's file systems, by the URI of the folder.

Defined results: null html is an empty payload; null url is an empty target;
pages repeated with one page_id and payload are all responses, with one record
id; null page_id is never the largest of a group unless all are null, and then
all are responses; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, shared_dir

#: Bytes of an archive that one task reads.
SPLIT = 4 << 20
#: Tasks that ranges are dealt to, at most; a task takes its ranges one by one.
MAX_TASKS = 50_000
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to: str | None, level: int = 6) -> bytes:
    """A gzip member with a response record, or with a revisit of the record ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict:
    """The fields of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode("latin-1").split("\r\n") if x.startswith("Content-Length: "))
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest(payload) != found or len(payload) != length):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
    ident = lambda x: None if x in (None, "<urn:page:>") else int(x[len("<urn:page:") : -1])
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": found,
        "record_type": fields["WARC-Type"],
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "target_uri": fields["WARC-Target-URI"],
        "payload": payload,
    }


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of pages in ``folder`` (a URI all executors share); returns path and size of each, already written."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    long_enough = rows.where(F.octet_length("html") >= least) if least else rows
    groups = long_enough.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "warc-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = join_groups(rows, "sha", groups, "n", total)
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("first_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size = 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    for r in b.slice(k, 200).to_pylist():
                        member = record(r["page_id"], r["url"], r["html"].encode(), None if r["first_id"] is None else _record_id(r["first_id"]))
                        out.write(member)
                        size += len(member)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "size"])

    return materialize(rows.mapInArrow(work, "path string, size bigint"), "warc-list")


def scan(file, start: int, end: int, size: int) -> Iterator[dict]:
    """The records that start at start to end - 1 of an open file of ``size`` bytes."""
    buffer, base = b"", start

    def grow(to: int) -> bool:
        """Have the bytes up to ``to`` at hand; false where the file ends before."""
        nonlocal buffer
        have = base + len(buffer)
        if to > have and have < size:
            file.seek(have)
            buffer += file.read(min(size, max(to, have + (1 << 20))) - have)
        return to <= size

    grow(min(size, end + 2))
    at, chained = start, False
    while at < end:
        hit = buffer.find(_MAGIC, at - base)
        if hit < 0 or base + hit >= end:
            return
        at = base + hit
        raw, stop = _inflate(buffer, hit, grow, base, size, lambda: buffer)
        if raw is None or not raw.startswith(b"WARC/1."):
            if chained:
                raise ValueError(f"no record at byte {at}")
            at += 1
            continue
        grow(stop + 3)
        if not chained and stop < size and buffer[stop - base : stop - base + 3] != _MAGIC:
            at += 1
            continue
        yield parse(raw)
        buffer, base, at, chained = buffer[stop - base :], stop, stop, True


def _inflate(buffer: bytes, hit: int, grow, base: int, size: int, current) -> tuple[bytes | None, int]:
    """The member at buffer[hit:] and the place in the file where it ends; None where there is none."""
    pack = zlib.decompressobj(31)
    parts, k, seen = [], hit, b""
    try:
        while not pack.eof:
            if k >= len(buffer):
                if base + k >= size:
                    return None, 0
                grow(base + k + (1 << 18))
                buffer = current()
            parts.append(pack.decompress(buffer[k : k + (1 << 16)]))
            k = min(len(buffer), k + (1 << 16))
            if len(seen) < 7:
                seen += parts[-1][:7]
                if not b"WARC/1.".startswith(seen[:7]) and not seen.startswith(b"WARC/1."):
                    return None, 0  # decoded far enough to know better
    except zlib.error:
        return None, 0
    return b"".join(parts), base + k - len(pack.unused_data)


def read(archives: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri[, payload]."""
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"))
    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string" + ", payload binary" * with_payload
    names = [f.strip().split(" ")[0] for f in out.split(",")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                fs, at = _open(r["path"])
                held: list[dict] = []
                with fs.open_input_file(at) as file:
                    for found in scan(file, r["start"], min(r["start"] + split, r["size"]), r["size"]):
                        held.append(found)
                        if len(held) >= 500:
                            yield batch(held)
                            held = []
                if held:
                    yield batch(held)

    # a range is a row of a few bytes: without a number of partitions they would be put together in one task
    tasks = archives.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, min(int(tasks), MAX_TASKS)), "path", "start").mapInArrow(work, out)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: a row per page, without payloads."""
    import uuid

    archives = write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(archives, with_payload=False).drop("target_uri")
