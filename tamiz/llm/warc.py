"""WARC archives: written as bounded segments by the text sink, read back as a chunk table with running digests.

Writing is built-in expressions only. A payload is cut into segments of at most ``SEGMENT_BYTES``; each becomes one WARC
record (``response`` first, then ``continuation`` with segment numbers), so no row ever holds an oversized payload's
record. Payloads of at least ``MIN_REVISIT`` bytes that another page already has become ``revisit`` records. A scan task
writes one gzip file; its size follows the scan's partition size, and all segments of a page lie in one file, in order.

Reading opens each file in a task, inflates it as a stream and yields one row per segment: record id, chunk number,
chunk, and the SHA-256 of the record up to and with that chunk. The row of the last segment carries the whole payload's
digest and length, so no shuffle and no whole record is needed. A digest or length other than the header's is an error.

Defined cases: null html is an empty payload. Null url leaves out the target line. A page without id is written with an
empty id field; it revisits an equal payload of a page with an id, and is a response if there is none. Rows that repeat
the smallest id of equal payloads are all responses. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.llm.base import Stages
from tamiz.session import scratch_path

SEGMENT_BYTES = 1 << 16
MIN_REVISIT = 100
EOL = "\r\n"
HTTP_HEAD = EOL.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record_id(key: Column) -> Column:
    digest = F.md5(key.cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))
    return F.coalesce(text if when is None else F.when(when, text), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    stages = Stages(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("body")
    ).select("*", F.sha2("body", 256).alias("sha"), F.length("body").alias("bytes"))
    copies = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("sha", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stages.keep(copies.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    rows = rows.join(copies, ["sha", "bytes"], "left").withColumn("again", again)
    segments = F.when(F.col("again"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / segment_bytes)))
    rows = rows.withColumn("segments", segments.cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("segments") - 1), lambda i: F.substring(F.col("body"), i * segment_bytes + 1, F.lit(segment_bytes))
    )
    one = rows.select("id", "url", "sha", "bytes", "first", "again", "segments", F.posexplode(cut).alias("at", "chunk"))
    page = F.concat(F.lit("page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    head, last = F.col("at") == 0, F.col("at") == F.col("segments") - 1
    many, again = F.col("segments") > 1, F.col("again")
    http = F.when(head, F.lit(HTTP_HEAD)).otherwise("").cast("binary")
    block = F.when(again, http).otherwise(F.concat(http, F.col("chunk")))
    kind = F.when(again, "revisit").when(head, "response").otherwise("continuation")
    own_id = F.when(head, _record_id(page)).otherwise(_record_id(F.concat(page, F.lit("/"), F.col("at").cast("string"))))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", own_id),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha")), head),
        _line("WARC-Segment-Number", F.col("at") + 1, many),
        _line("WARC-Segment-Origin-ID", _record_id(page), ~head),
        _line("WARC-Segment-Total-Length", F.col("bytes") + len(HTTP_HEAD), many & last),
        _line("WARC-Refers-To", _record_id(F.concat(F.lit("page:"), F.col("first").cast("string"))), again),
        _line("WARC-Profile", F.lit(PROFILE), again),
        _line("X-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        _line("X-Payload-Digest", F.col("sha")),
        _line("X-Payload-Length", F.col("bytes")),
        _line("X-Refers-To-Page", F.col("first"), again),
        F.when(head, F.lit(f"Content-Type: application/http; msgtype=response{EOL}")).otherwise(""),
        _line("Content-Length", F.length(block)),
        F.lit(EOL),
    ).cast("binary")
    record = F.concat(header, block, F.lit(EOL).cast("binary")).cast("string").alias("value")
    sink = one.select(record).write.option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", 0)
    sink.text(path)


def _records(stream) -> Iterator[dict]:
    """Header and block length of each record; the caller reads the block before it asks for the next record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.decode()] = value.strip().decode()
        yield fields


CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, chunk_no int, chunk binary, chunk_bytes long, "
    "is_last boolean, bytes_so_far long, sha256_so_far string, payload_bytes long, payload_digest string"
)


def _chunks_of(content: bytes) -> Iterator[tuple]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    state = size = origin = kind = refers = None
    for f in _records(stream):
        left = int(f["Content-Length"])
        if f["WARC-Type"] != "continuation":
            while left and (line := stream.readline()):  # the HTTP head
                left -= len(line)
                if not line.strip():
                    break
            state, size, origin, kind = hashlib.sha256(), 0, f["WARC-Record-ID"], f["WARC-Type"]
            refers = int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None
        elif f["WARC-Segment-Origin-ID"] != origin:
            raise ValueError(f"segment of {f['WARC-Segment-Origin-ID']} after {origin}")
        chunk = stream.read(left)
        if len(chunk) != left:
            raise ValueError(f"{f['WARC-Record-ID']} ends early")
        state.update(chunk)
        size += left
        whole, digest = int(f["X-Payload-Length"]), f["X-Payload-Digest"]
        last = "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f
        if last and kind == "response" and (size != whole or state.hexdigest() != digest):
            raise ValueError(f"{origin}: payload does not match its header")
        page = int(f["X-Page-ID"]) if f["X-Page-ID"] else None
        yield (origin, page, kind, refers, int(f.get("WARC-Segment-Number", 1)) - 1, chunk, left, last, size, state.hexdigest(), whole, digest)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``: one row per segment, in file order within a file."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for row in _chunks_of(content):
                    rows.append(row)
                    held += row[6]
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, CHUNKS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per written page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    For a response both figures are measured on what was read; a revisit states those of the payload it stands for.
    """
    response = F.col("record_type") == "response"
    return read_chunks(spark, path).filter("is_last").select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha256_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, body_col)
    return read_records(pages.sparkSession, path).withColumnRenamed("page_id", id_col)
