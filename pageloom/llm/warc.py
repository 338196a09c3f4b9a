"""WARC archives with revisit records for repeated payloads.

Payload digests are computed where the pages are; only headers (page_id, digest,
size) are shuffled, by digest, to find for every digest the page that keeps the payload.
Its record is a response; the others become revisit records that refer to it and carry no
payload.  The archives are written with fresh headers, dated by the write, a file per task and
``RECORDS_PER_FILE`` records at most, and read back by the lengths in the headers.

Edge cases: null html is an empty payload; the smallest page_id wins, a null one comes
last; rows that repeat page_id and payload are one capture recorded twice and get
records of the same type; an empty table gives an archive without records.
"""

import base64
import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.shared import per_batch, stage, staging_path

# Payloads of at least so many bytes are deduplicated.
MIN_BYTES = 0
RECORDS_PER_FILE = 1_000
# The alphabet of base32 and the parts of a record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text: 40 hexadecimal digits, 5 at a time."""
    def four(digits: Column, group: int) -> Column:
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        return F.concat(*[
            F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
            for shift in (15, 10, 5, 0)
        ])

    digits = F.sha1(payload)
    return F.get(F.transform(F.array(digits), lambda d: F.concat(*[four(d, group) for group in range(8)])), F.lit(0))


def with_digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest``."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id``, ``payload_digest`` and ``refers_to`` of the pages that repeat a payload."""
    headers = with_digests(pages).filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    counted = stage(headers.groupBy("payload_digest", "page_id").agg(F.lit(1).alias("seen")).drop("seen"), "headers")
    first = (
        counted.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("pages")).filter("pages > 1")
    )
    return stage(
        counted.join(first, "payload_digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "payload_digest", "refers_to"),
        "revisits",
    )


def _now() -> Column:
    """The time of writing in UTC, the same for all records of a write."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _clean(value: Column) -> Column:
    """A header value keeps to its line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]", " ")


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Column ``record``: header and block of every page, without the closing line ends."""
    rows, again = with_digests(pages), revisits(pages, min_bytes)
    joined = rows.join(
        again.withColumnRenamed("payload_digest", "digest"),
        rows.page_id.eqNullSafe(again.page_id) & (rows.payload_digest == F.col("digest")), "left",
    ).select(rows.page_id, "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    header = F.concat(
        F.lit(f"{VERSION}{END}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"), shown,
        F.lit(f">{END}WARC-Date: "), _now(), F.lit(f"{END}WARC-Target-URI: "), _clean(F.col("url")),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{END}X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(
            F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(END + END),
    )
    return joined.select(F.concat(header, block).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the records of ``pages`` as WARC files into the folder ``path``."""
    (
        records(pages, min_bytes).write
        .option("lineSep", END + END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split(END)
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = stop + 4
        end = start + int(fields["Content-Length"])
        yield fields, data[start:end]
        at = end + 4


def _page_of(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if number == "none" else int(number)


def _read_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for content in batch.column("content"):
        columns: list[list] = [[], [], [], [], [], []]
        for fields, block in _parse(content.as_py()):
            kind = fields["WARC-Type"]
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            size = len(block) if kind == "response" else int(fields["X-Payload-Length"])
            for column, value in zip(columns, (
                _page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind,
                _page_of(fields.get("WARC-Refers-To")),
            )):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    The payloads of responses are checked against their digests.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(
        per_batch(_read_batch),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    path = staging_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
