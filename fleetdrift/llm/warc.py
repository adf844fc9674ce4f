"""WARC archives without repeated payloads: one response for each payload, revisit records for the rest.

1. Headers (all but the payload) are shuffled by payload digest.  The record with
   the smallest page_id that has a payload becomes the response of its digest;
   one aggregation with a map side brings its payload along, so copies of a
   payload meet before they are shuffled.
2. All other records of the digest become revisits that name the response.
3. Records get fresh headers and are written as gzip'ed archives.
4. Archives read back are resolved by joining revisits to the records they name.

Defined cases: null payloads of ``pages`` are empty; empty payloads are payloads
like any other; payloads under ``least_bytes`` are never deduplicated; null
page_ids come last and name nothing; among equal page_ids the smaller url (null
last) responds; equal rows are records of their own, one of which responds; a
revisit whose payload is in no archive stays a revisit of nothing; control
characters in urls become spaces; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records in one archive file, so that a file stays a task's worth of data.
RECORDS_PER_FILE = 2000
_END = "\r\n\r\n"
#: The profile that the WARC 1.1 standard names for revisits of equal payloads.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RADIX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BLOCK = 4096


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _RADIX, _BASE32)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of crawled pages: page_id, url, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"),
    )


def archive_records(archived: DataFrame) -> DataFrame:
    """Records read from archives, revisits without payload included, to be written anew."""
    return archived.select(
        "page_id", "url", F.col("payload").cast("string").alias("payload"), "payload_bytes", "payload_digest"
    )


def _first(*values: str) -> Column:
    """Sorts by the values, nulls last."""
    return F.struct(*[x for v in values for x in (F.col(v).isNull(), F.col(v))])


def _record_id(*values: Column | str) -> Column:
    digest = F.md5(F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(f"c{i}") for i, v in enumerate(values)])))
    ends = (1, 8), (9, 4), (13, 4), (17, 4), (21, 12)
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ends])


def _times(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times with its number ``copy``, never as one long array."""
    blocks = df.withColumn("_n", times).where("_n > 0").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _BLOCK)))
    )
    last = F.least(F.col("_n"), (F.col("_block") + 1) * _BLOCK)
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("_block") * _BLOCK + 1, last))).drop("_n", "_block")


def deduplicated(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_type, record_id, refers_to (record id), page_id, url, payload_digest and payload (null in revisits)."""
    small = F.coalesce(F.col("payload_bytes") < least_bytes, F.lit(False))
    large = records.where(~small)
    order = ["page_id", "url"]
    # Headers only: who responds, and how often each header occurs.
    heads = large.groupBy(*order, "payload_digest").agg(F.count(F.lit(1)).alias("_times"))
    held = large.where("payload IS NOT NULL")
    origin = held.groupBy("payload_digest").agg(F.min(_first(*order)).alias("_o")).select(
        F.col("payload_digest").alias("_digest"), F.col("_o.page_id").alias("_page"), F.col("_o.url").alias("_url"), F.lit(1).alias("_found")
    )
    placed = heads.join(origin, F.col("payload_digest") == F.col("_digest"), "left")
    responds = F.col("_found").isNotNull() & F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    origin_id = F.when(F.col("_found").isNotNull(), _record_id("_digest", "_page", "_url", F.lit(0)))
    revisits = _times(placed, F.col("_times") - F.when(responds, 1).otherwise(0)).select(
        F.lit("revisit").alias("record_type"), _record_id("payload_digest", *order, "copy").alias("record_id"),
        origin_id.alias("refers_to"), *order, "payload_digest", F.lit(None).cast("string").alias("payload"),
    )
    first = held.groupBy("payload_digest").agg(
        F.min(F.struct(*[x for v in order for x in (F.col(v).isNull().alias(f"no_{v}"), F.col(v))], "payload")).alias("r")
    )
    response = F.lit("response").alias("record_type")
    nothing = F.lit(None).cast("string").alias("refers_to")
    responses = first.select(
        response, _record_id("payload_digest", *[F.col(f"r.{v}") for v in order], F.lit(0)).alias("record_id"),
        nothing, *[F.col(f"r.{v}").alias(v) for v in order], "payload_digest", F.col("r.payload").alias("payload"),
    )
    everything = responses.unionByName(revisits)
    if least_bytes > 0:
        same = records.where(small).groupBy(*order, "payload_digest", "payload").agg(F.count(F.lit(1)).alias("_times"))
        everything = everything.unionByName(
            _times(same, F.col("_times")).select(
                response, _record_id("payload_digest", *order, "copy").alias("record_id"), nothing, *order, "payload_digest", "payload"
            )
        )
    return everything


def _line(name: str, value: Column) -> Column:
    """A header line, none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(date: str) -> Column:
    """A record but for the blank lines at its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"),
    )
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    name = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", name("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", name("refers_to")),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )


def write_archives(
    records: DataFrame, path: str, *, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Write ``records`` as deduplicated archives: a record is a line that ends with a record's blank lines."""
    lines = deduplicated(records, least_bytes).select(_record(date).alias("value"))
    lines.write.options(compression="gzip", lineSep=_END, maxRecordsPerFile=records_per_file).text(path)


def _unpacked(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, plain or of any number of gzip members, in steps."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member = zlib.decompressobj(31)
        while raw and not member.eof:
            yield member.decompress(raw, step)
            raw = member.unconsumed_tail or member.unused_data


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    parts, held = _unpacked(raw), bytearray()

    def until(length: int | None) -> int:
        """Read on until that many bytes, or the end of the headers, are held; -1 at the end of the archive."""
        seen = 0
        while (at := held.find(b"\r\n\r\n", seen) if length is None else (length if len(held) >= length else -1)) < 0:
            seen = max(len(held) - 3, 0)
            part = next(parts, None)
            if part is None:
                return -1
            held.extend(part)
        return at

    while (end := until(None)) >= 0:
        _, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        del held[: end + 4]
        size = int(headers["content-length"])
        until(size + 4)
        yield headers, bytes(held[:size])
        del held[: size + 4]


_COLUMNS = (
    "record_type string, record_id string, refers_to string, page_id long, url string, date string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _named(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None


def _parsed(payloads: bool):
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows: list[list] = []
                for head, block in parse_archive(batch.column(0)[i].as_py()):
                    if head.get("warc-type") not in ("response", "revisit"):
                        continue
                    body = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                    digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    if body is not None:
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    page = head.get("warc-page-id")
                    rows.append([
                        head["warc-type"], _named(head.get("warc-record-id")), _named(head.get("warc-refers-to")),
                        int(page) if page else None, head.get("warc-target-uri"), head.get("warc-date"),
                        digest, None if body is None else len(body), body if payloads else None,
                    ])
                    if len(rows) == 500:
                        yield _batch(rows, names, kinds)
                        rows = []
                yield _batch(rows, names, kinds)

    return parse


def _batch(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Response and revisit records of all archives below ``path``; digest and size of responses are those of the bytes read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parsed(payloads), _COLUMNS)


def resolved(archived: DataFrame) -> DataFrame:
    """All records with the size and digest of their payload; ``refers_to`` becomes the page_id of the response."""
    named = archived.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    # Records that name nothing get a key that no record has, each its own.
    key = F.coalesce("refers_to", F.concat(F.lit("none "), "record_id"))
    return archived.withColumn("_key", key).join(named, F.col("_key") == F.col("_id"), "left").select(
        "page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"),
    )


#: The same rows by numbering the pages of equal payload.
WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
numbered AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h,
    row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST) AS n,
    min(page_id) OVER (PARTITION BY payload) AS least
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('{_BASE32}',
    CAST(((('0x' || substr(h, CAST(5 * (j // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN least END AS refers_to
FROM numbered
"""
