"""Operator 7: WARC archives compressed record by record with an embedded dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary
made of a bounded sample of the records; every record, a warcinfo record first, is a frame of its own
that uses it, so any record is read by its place alone. Samples that the trainer can't use are the
dictionary themselves, as raw content. Of records with equal payloads of ``min_bytes`` or more, that
with the largest page_id is archived in full, the others as revisits of it.

Digests are computed in the JVM and summed per digest. The digests that occur again are broadcast
up to BROADCAST_ROWS of them, so payloads aren't shuffled; beyond that they are joined with SALTS
copies of each, so a payload that a third of all pages share is dealt to as many tasks. The table of
archives is published by Spark's committer, so attempts that were lost don't count.

Dictionary: of the SAMPLE records with the least hash of page_id and html, SAMPLE_BYTES characters
from a place in the page that the hash gives. Hashes are chosen first; pages are cut before they leave
their tasks, so the driver gets SAMPLE * SAMPLE_BYTES characters at most.

Record ids are unique: that of a payload's one full record is its page and digest, all others also
hold their place of writing. Where rows equal in page_id and payload are all full records, revisits
name the page only.

Defined results: null html is an empty payload; equal page_ids with equal payloads that are the
largest are all responses; a null page_id is archived without a number and never the target of a
revisit; very long pages are archived whole; extra columns are ignored, whatever their names; an
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import AtomicFile, materialise, read_file, remove_strays, slices, task_id

MAGIC, MIN_BYTES, ARCHIVE_BYTES = 0x184D2A5D, 1_000, 256_000_000
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
BROADCAST_ROWS, SALTS = 100_000, 32
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(kind: str, fields: list[tuple[str, str]], body: bytes = b"") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, target: int | None, only: bool, place: str, date: str) -> bytes:
    """``only``: whether the target's page has one record with this payload."""
    full = target is None or target == page
    number = lambda k: "" if k is None else str(k)
    fields = [
        ("WARC-Record-ID", f"<urn:page:{number(page)}:{digest}{'' if full and target is not None and only else ':' + place}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
        ("X-Page-ID", number(page)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if not full:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", number(target))]
        fields += [("WARC-Refers-To", f"<urn:page:{number(target)}:{digest}>")] if only else []
    return record("response" if full else "revisit", fields, payload if full else b"")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def make_dictionary(pages: DataFrame, date: str) -> bytes:
    """From at most SAMPLE records; see the module's text."""
    import zstandard

    html = F.col("html").cast("string")
    at = F.pmod(F.col("key"), F.greatest(F.length(html) - SAMPLE_BYTES, F.lit(0)) + 1).cast("int") + 1
    keyed = pages.select(F.xxhash64(F.col("page_id").cast("long"), html).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.substring(F.col("url").cast("string"), 1, 1_000).alias("url"), html.alias("html"))
    keys = [r["key"] for r in keyed.select("key").orderBy("key").limit(SAMPLE).collect()]
    cut = keyed.where(F.col("key").isin(keys)).select("key", F.struct("page_id", "url", F.substring(F.coalesce(html, F.lit("")), at, F.lit(SAMPLE_BYTES)).alias("html")).alias("row"))
    rows = sorted((r["key"], r["row"]) for r in cut.groupBy("key").agg(F.first("row").alias("row")).collect())
    rows = rows or [(0, {"page_id": None, "url": None, "html": ""})]
    samples = [page_record(r["page_id"], r["url"], data := (r["html"] or "").encode(), hashlib.sha1(data).hexdigest(), None, False, "0", date) for _, r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too few, or with nothing in common
        return b"".join(samples)[-DICTIONARY_BYTES:]


def marked_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, target (null unless the payload occurs again), only."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    each = rows.where(F.length("payload") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    again = each.groupBy("digest").agg(F.sum("n").alias("all"), F.max_by(F.struct("page_id", "n"), "page_id").alias("last")).where("all > 1 and last.page_id is not null")
    again = materialise(again.select("digest", F.col("last.page_id").alias("target"), (F.col("last.n") == 1).alias("only")), "repeated-payloads")
    if again.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(again), "digest", "left").select("page_id", "url", "payload", "digest", "target", "only")
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", "target", "only")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to a folder of their own; returns the table of archives: name, records (of pages), bytes."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    dictionary = make_dictionary(pages, date)

    def write(batches):
        import pyarrow as pa
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=True)
        out, count, done = None, 0, []

        def put(data: bytes) -> None:
            frame = packer.compress(data)
            out.write(struct.pack("<III", 0x184D2A50, 4, len(frame)) + frame)  # a skippable frame with the record's length

        try:
            for part in slices(batches, 64):
                for page, url, payload, digest, target, only in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        out, count = AtomicFile(folder, f"part-{task_id():06d}-{len(done):04d}", ".warc.zst"), 0
                        out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                        put(record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{out.name}>"), ("WARC-Date", date), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    put(page_record(page, url, payload, digest, target, bool(only), f"{out.name}:{count}", date))
                    count += 1
                    if out.written >= archive_bytes:
                        done.append((out.close(), count, out.written))
                        out = None
            if out:
                done.append((out.close(), count, out.written))
        except BaseException:
            if out:
                out.abort()
            raise
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["name", "records", "bytes"])

    made = materialise(marked_pages(pages, min_bytes).mapInArrow(write, "name string, records long, bytes long"), "archives")
    remove_strays(pages.sparkSession, folder, made)
    return made


def records(folder: str, name: str):
    """(fields, payload) of each record of an archive, one at a time, that with the archive's own facts first."""
    import zstandard

    with read_file(folder, name) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{name} has no dictionary frame")
        data = f.read(size)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        while head := f.read(12):
            yield parse(unpacker.decompress(f.read(struct.unpack("<III", head)[2])))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """RESULT of every archived record; payloads that are there are checked against their digest."""

    def number(text: str) -> int | None:
        return int(text) if text else None

    def read(batches):
        import pyarrow as pa

        for part in batches:
            for name in part.column(0).to_pylist():
                rows = []
                for fields, payload in records(folder, name):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{name}: a payload doesn't have its digest")
                    rows.append((number(fields["X-Page-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page", ""))))
                    if len(rows) == 2_000:
                        yield batch(pa, rows)
                        rows = []
                if rows:
                    yield batch(pa, rows)

    def batch(pa, rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return archives.select("name").repartition(max(1, archives.count())).mapInArrow(read, RESULT)
