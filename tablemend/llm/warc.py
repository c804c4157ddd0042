"""WARC archives: write one record a page, and read archives back by boundary-chain verification.

Reading splits the files at every occurrence of the version line, also inside payloads. Each occurrence is a candidate
record whose header names its successor's offset. A file's records are the candidates reachable from its start, found
by pointer jumping: each round marks the successors of what is marked and doubles the length of the jumps. Files are
read in splits; no task has to see a whole file.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sieve import sieve
from .skew import attach, once
from .store import written

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = (
    "file string, block bigint, nth bigint, before bigint, n_bytes bigint, header bigint, content bigint, whole boolean, "
    "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, found_digest string"
)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four base32 digits."""
    digits = []
    for at in range(1, 41, 5):
        group = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(BASE32), F.shiftright(group, bits).bitwiseAND(31) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*digits)


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to the folder ``path``.

    Of the rows with equal payloads the one with the largest page_id is the response and the others revisit it; rows
    that repeat that page_id are responses as well, and a row without page_id revisits unless no row of its payload has
    one. A null html is empty; line ends in a url are percent-encoded; other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).select("*", once(F.sha1(F.col("html").cast("binary"))).alias("sha"))
    same = rows.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    same = written(same, "equal-payloads")
    passes = sieve(same, "sha")
    rows = rows.withColumn("maybe", passes(F.col("sha")))
    # pages without a twin stay where they are; the others meet the head of their payload
    lone = rows.filter("not maybe").withColumn("head", F.lit(None).cast("long"))
    twins = attach(rows.filter("maybe"), same.select("sha", "head"), "sha", how="left", counts=same.select("sha", "n"))
    rows = lone.unionByName(twins).withColumn("revisit", F.expr("head is not null and (page_id is null or page_id < head)"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    size = F.octet_length("html").cast("string")
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        urn("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha")),
        F.lit("\r\nPayload-Length: "),
        size,
        F.lit("\r\n"),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn("head"))).otherwise(""),
        F.lit("Content-Length: "),
        F.when(F.col("revisit"), "0").otherwise(size),
        F.lit(END.decode()),
        F.when(F.col("revisit"), "").otherwise(F.col("html")),
    )
    rows.select(record).write.option("lineSep", END.decode()).text(path)


FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.MULTILINE)
NUMBER = re.compile(rb"\d+")


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _line(text: bytes) -> tuple:
    """What a line says if it is a record: header bytes, content length, whole, fields and the digest of its payload."""
    cut = text.find(END)
    if cut < 0:
        return (None,) * 9
    fields = {k.lower(): v for k, v in FIELD.findall(text[:cut])}
    if not NUMBER.fullmatch(fields.get(b"content-length", b"")) or b"warc-type" not in fields:
        return (None,) * 9
    header, content = cut + len(END), int(fields[b"content-length"])
    whole = len(text) == header + content + len(END) and text.endswith(END)
    found = digest(text[header : header + content]) if whole else None
    size = fields.get(b"payload-length", b"")
    told = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    kind = fields[b"warc-type"].decode("ascii", "replace")
    return header, content, whole, _page(fields.get(b"warc-record-id")), kind, _page(fields.get(b"warc-refers-to")), int(size) if NUMBER.fullmatch(size) else None, told or None, found


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, number in the block, bytes of the block before it, text); a split's lines come in order."""
    place, nth, before = None, 0, 0
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != place:
                place, nth, before = (file, block), 0, 0
            yield file, block, nth, before, text
            nth, before = nth + 1, before + len(text) + len(MAGIC)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in LINE.split(", ")]
    rows: list[tuple] = []
    for file, block, nth, before, text in _numbered(batches):
        rows.append((file, block, nth, before, len(text), *_line(text)))
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, nth, _, text in _numbered(batches):
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "nth": [nth], "body": [text]})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("body"))


def reachable(candidates: DataFrame) -> DataFrame:
    """The (file, start) of ``candidates`` (file, start, next) that a chain from start 0 of the file reaches.

    Pointer jumping: the rounds grow with the logarithm of the records in a file.
    """
    nodes = written(candidates.select("file", "start", F.col("next").alias("jump"), F.expr("start = 0").alias("mark")), "jumps")
    marked = nodes.filter("mark").count()
    while True:
        to = nodes.filter("mark and jump is not null").select("file", F.col("jump").alias("start")).distinct().withColumn("hit", F.lit(True))
        far = nodes.select("file", F.col("start").alias("jump"), F.col("jump").alias("next"))
        moved = nodes.join(to, ["file", "start"], "left").join(far, ["file", "jump"], "left")
        nodes = written(moved.select("file", "start", F.col("next").alias("jump"), F.expr("mark or coalesce(hit, false)").alias("mark")), "jumps")
        now = nodes.filter("mark").count()
        if now == marked:
            return nodes.filter("mark").select("file", "start")
        marked = now


def _joined(rows: pa.Table) -> pa.Table:
    """The digest of a record whose payload holds version lines: its lines put together again."""
    parts = sorted(rows.select(["start", "body", "header", "content", "record"]).to_pylist(), key=lambda r: r["start"])
    text = MAGIC.join(p["body"] for p in parts)
    head = parts[0]
    payload = text[head["header"] : head["header"] + head["content"]]
    return pa.table({"file": rows.column("file").slice(0, 1), "start": [head["record"]], "joined_digest": [digest(payload)]})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Length and digest are those of the full payload: computed from the bytes of a response, told by the header of a
    revisit. ``intact`` says whether a response agrees with the digest in its header. A chain ends where a record is cut
    off or has no valid header; what follows in that file cannot be told from payload and is left out.
    """
    lines = written(_lines(spark, path).mapInArrow(_scan, LINE), "lines")
    size = len(MAGIC)
    blocks = lines.groupBy("file", "block").agg(F.sum(F.col("n_bytes") + size).alias("m"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("base"))
    placed = lines.join(blocks, ["file", "block"]).withColumn("start", F.expr(f"base + before - {size}")).filter("start >= 0")
    placed = written(placed.withColumn("next", F.expr(f"start + {size} + header + content + {len(END)}")), "placed")
    records = placed.join(reachable(placed.select("file", "start", "next")), ["file", "start"])
    records = written(records.filter("header is not null"), "records")
    broken = records.filter("not whole")
    if broken.isEmpty():
        records = records.withColumn("joined_digest", F.lit(None).cast("string"))
    else:
        starts = records.select("file", "start", F.col("start").alias("record"), "header", "content", "whole")
        upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
        owner = F.when(F.col("record").isNotNull(), F.struct("record", "header", "content", "whole"))
        within = placed.select("file", "block", "nth", "start").join(starts, ["file", "start"], "left").withColumn("r", owner)
        within = within.withColumn("r", F.last("r", ignorenulls=True).over(upto)).select("file", "block", "nth", "start", "r.record", "r.header", "r.content", "r.whole")
        needed = within.filter(f"not whole and start < record + {size} + header + content")
        bodies = _lines(spark, path).mapInArrow(_bodies, "file string, block bigint, nth bigint, body binary")
        parts = needed.join(bodies, ["file", "block", "nth"])
        whole = parts.groupBy("file", "record").applyInArrow(lambda t: _joined(t), "file string, start bigint, joined_digest string")
        records = records.join(whole, ["file", "start"], "left")
    found = F.coalesce("found_digest", "joined_digest")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(revisit, F.coalesce("payload_bytes", "content")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(found).alias("payload_digest"),
        "record_type",
        "refers_to",
        (revisit | (F.coalesce("payload_digest", found) == found)).alias("intact"),
    )
