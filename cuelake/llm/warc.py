"""WARC archives: written and read by Spark, with repeated payloads as revisit records.

Revisits are resolved over headers: the digests of all payloads are shuffled with their ids, payloads are not; of equal
payloads one record stays a response, and every other one becomes a revisit that names it. Equality is that of SHA-1 and
SHA-256 together. What a record has become then meets its payload by the record's own id, so that a payload of very many
copies is never gathered. Archives are valid WARC/1.1, uncompressed or gzip, written through Spark's own committer.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import BLOCK_BYTES, arrow_schema, dropped, shared_folder, written

#: Equal payloads of fewer bytes all stay responses.
LEAST_BYTES = 1000
#: About the size of an archive; a longer record has one of its own.
ARCHIVE_BYTES = 64_000_000
#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "type string, record_id string, date string, target_uri string, declared_digest string, refers_to string, page_id long, "
    "payload_bytes long, payload_digest string"
)


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload) of a table of pages; a null html is an empty payload. Other columns are left."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))


def _digested(records: DataFrame) -> DataFrame:
    """The records with the size, SHA-1 and SHA-256 of their payloads."""
    return records.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("second"))


def deduplicated(records: DataFrame, least: int = LEAST_BYTES, made: list[DataFrame] | None = None) -> DataFrame:
    """``records`` (page_id, url, payload) with bytes, digest and, where another record keeps the payload, its page_id
    and url as kept_id and kept_url and revisit = true.

    Of equal payloads of at least ``least`` bytes the record of the largest page_id keeps it (a null one is the
    smallest); repeated rows of that page_id all keep it, so the result does not hang on their order. Tables on the way
    are appended to ``made``, to be deleted once the result has been read.
    """
    heads = _digested(records).drop("payload").where(F.col("bytes") >= least)
    several = heads.groupBy("digest", "second").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = written(several.select("digest", "second", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url")))
    others = heads.join(kept, ["digest", "second"]).where(~F.col("page_id").eqNullSafe(F.col("kept_id")))
    names = {"page_id": "own_id", "digest": "own_digest", "second": "own_second"}
    # written, so that its size is known: a small one is broadcast by Spark, and no payload is shuffled
    revisits = written(others.select(*[F.col(a).alias(b) for a, b in names.items()], "kept_id", "kept_url", F.lit(True).alias("again")).distinct())
    if made is not None:
        made += [kept, revisits]
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")) & (F.col("second") == F.col("own_second"))
    both = _digested(records).join(revisits, same, "left")
    return both.select("page_id", "url", "payload", "bytes", "digest", "kept_id", "kept_url", F.coalesce("again", F.lit(False)).alias("revisit"))


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A name that a record keeps however often it is written."""
    x = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _uri(url: Column) -> Column:
    """A header's value has no line ends; those of an address are percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_text(date: str) -> Column:
    """A record of ``deduplicated`` as the bytes of an archive, up to the two line ends behind it. Absent values have no
    header."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    again = lambda value: F.when(F.col("revisit"), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _uri(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        again(field("WARC-Refers-To", _record_id(F.col("kept_id"), F.col("kept_url"), F.col("digest")))),
        again(field("WARC-Refers-To-Target-URI", _uri(F.col("kept_url")))),
        again(field("WARC-Profile", F.lit(PROFILE))),
        field("Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END), block)


def write_archives(records: DataFrame, folder: str, date: str | None = None, compression: str = "none", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of the records of ``deduplicated`` in ``folder``, of about ``archive_bytes`` each. ``date`` (of now, if
    none is given) is the records' date. Empty records make no archive."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = records.select(record_text(date).alias("value"))
    mean = records.agg(F.avg(F.when(~F.col("revisit"), F.col("bytes")).otherwise(0) + 700)).first()[0] if archive_bytes else None
    most = max(1, int(archive_bytes / mean)) if mean else 0
    out.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(folder)


_FIELD = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)")


def parsed_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case, the first of a repeated one) and block of each record of an archive; a block is
    found by its length, whatever bytes it holds. What is no record raises ValueError with its place."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    view, at = memoryview(data), 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields: dict[str, str] = {}
        for name, value in _FIELD.findall(data[data.find(b"\r\n", at) + 2 : head + 2]):
            fields.setdefault(name.decode().lower(), value.decode("utf-8", "replace"))
        length = fields.get("content-length", "")
        if not length.isdigit() or head + 4 + int(length) > len(data):
            raise ValueError(f"record at byte {at} has no block of {length or 'a given'} bytes")
        end = head + 4 + int(length)
        yield fields, view[head + 4 : end]
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def inflated(data: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts)


def bare_digest(value: str | None) -> str | None:
    """Lower-case hex of a labelled SHA-1, which archives write as hex or in base 32; None for any other."""
    label, _, text = (value or "").partition(":")
    if label.lower() != "sha1":
        return None
    if len(text) == 32:
        try:
            return base64.b32decode(text.upper()).hex()
        except ValueError:
            return None
    return text.lower() if re.fullmatch("[0-9a-fA-F]{40}", text) else None


def as_row(fields: dict[str, str], block: memoryview) -> dict:
    """RECORD of a record. The payload of an HTTP message is what follows its head; a revisit has none."""
    kind = fields.get("warc-type", "")
    payload = bytes(block)
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    page = fields.get("page-id", "")
    row = {
        "type": kind, "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"), "target_uri": fields.get("warc-target-uri"),
        "declared_digest": bare_digest(fields.get("warc-payload-digest")), "refers_to": fields.get("warc-refers-to"), "page_id": int(page) if re.fullmatch("-?[0-9]{1,18}", page) else None,
        "payload_bytes": None, "payload_digest": None, "payload": None,
    }
    if kind != "revisit":
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}
    return row


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD, and the payload unless ``payloads`` is false, of every record of the archives in ``folder``. Digest and
    size are those of the bytes read. An archive is read by one task, and is at most 2 GB as Spark's binary files are."""
    schema = RECORD + (", payload binary" if payloads else "")
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for fields, block in parsed_records(archive.as_py()):
                    rows.append(as_row(fields, block))
                    size += len(block) if payloads else 500
                    if not payloads:
                        rows[-1].pop("payload")
                    if size > BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of ``read_archives`` with original_id, the page_id of the response that a revisit stands for, and that
    one's payload_bytes, payload_digest and, where it is there, payload. Revisits meet originals by digest; of several
    responses of a digest the one of the largest page_id is the original. A revisit without one keeps nulls."""
    mine = [c for c in ("payload_bytes", "payload_digest", "payload") if c in records.columns]
    found = records.where("type = 'response'").groupBy(F.col("payload_digest").alias("key")).agg(F.max(F.struct("page_id", "record_id", *mine)).alias("original"))
    found = written(found)
    revisits = records.where("type = 'revisit'").join(found, F.col("declared_digest") == F.col("key"), "left")
    whole = revisits.select(*[F.col(f"original.{c}").alias(c) if c in mine else F.col(c) for c in records.columns], F.col("original.page_id").alias("original_id"))
    return records.where("type <> 'revisit'").withColumn("original_id", F.lit(None).cast("long")).unionByName(whole)


def rewrite(spark: SparkSession, source: str, target: str, date: str | None = None, **options) -> None:
    """Archives of ``source`` once more, with all repeated payloads as revisits and fresh headers; revisits that no
    response of ``source`` resolves are left out, as there is nothing that they stand for."""
    whole = resolved(read_archives(spark, source)).where("type in ('response', 'revisit') and payload is not null")
    records = written(whole.select("page_id", F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("payload")))
    write_archives(deduplicated(records), target, date, **options)
    dropped(records)


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read from archives written of
    ``pages`` into ``folder``, or into the shared folder, from where they are deleted once read. Null ids stay null;
    repeated rows have a record each; a table without rows has none."""
    spark, target, made = pages.sparkSession, folder or shared_folder(pages.sparkSession), []
    write_archives(deduplicated(captures(pages), made=made), target)
    heads = written(read_archives(spark, target, payloads=False))
    dropped(*made, *([] if folder else [spark.read.format("binaryFile").load(target)]))
    return resolved(heads).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("original_id").alias("refers_to"))
