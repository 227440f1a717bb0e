"""WARC archives as a chunked record table: a record is rows of (archive, record, chunk, bytes), never one large cell.

The chunks of a record in order, and the records of an archive in order, are a WARC 1.1 file byte for byte (export()
writes it). A row holds at most CHUNK_BYTES of the payload, the first one also the header and the last one the end mark;
so only oversized payloads take several rows. Each row carries the digest of the payload so far, so a reader verifies
while it streams. Records of one row are read where they lie; only the rows of oversized ones are brought together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import shared_dir

CHUNK_BYTES = 1 << 18
#: Bytes and rows of chunks in a batch that a writer gives out, and tasks that a payload shared by many pages is dealt to.
BATCH_BYTES, BATCH_ROWS, SALTS = 16 * CHUNK_BYTES, 4096, 16
MIN_SHARED_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORDS = "archive bigint, record bigint, chunk int, last boolean, sha1_so_far string, data binary"
NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def classify(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(page_id, url, body, payload_sha1, payload_bytes, refers_to): refers_to is set on rows that repeat a larger id's payload.

    The digest groups hold ids only, combined before the shuffle; only digests that come twice are joined back. Each of
    them is there once for every salt, so that a payload that a third of the pages share meets them in SALTS tasks.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), body.alias("body"))
    rows = rows.select("*", F.sha1("body").alias("payload_sha1"), F.octet_length("body").cast("bigint").alias("payload_bytes"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    large = F.col("payload_bytes") >= MIN_SHARED_BYTES
    shared = rows.where(large).groupBy("payload_sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    shared = shared.select("payload_sha1", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    refers_to = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    return rows.join(shared, ["payload_sha1", "salt"], "left").select("page_id", "url", "body", "payload_sha1", "payload_bytes", refers_to)


def chunked(records: DataFrame) -> DataFrame:
    """(chunk, last, page_id, url, payload_sha1, payload_bytes, refers_to, data): a record's rows in order, next to each other.

    Chunk 0 has what the header says. The pieces of the payload (a revisit's is empty) are cut here, so no more than
    CHUNK_BYTES of it go to Python in one cell.
    """
    pieces = F.when(F.col("refers_to").isNull(), F.ceil(F.col("payload_bytes") / CHUNK_BYTES)).otherwise(0).cast("int")
    rows = records.select("*", pieces.alias("pieces")).select("*", F.explode(F.sequence(F.lit(0), F.greatest("pieces", F.lit(1)) - 1)).alias("chunk"))
    at = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
    data = F.when(F.col("pieces") > 0, F.substring("body", F.col("chunk") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)))
    return rows.select("chunk", (F.col("chunk") + 1 >= F.col("pieces")).alias("last"), *map(at, ("page_id", "url", "payload_sha1", "payload_bytes", "refers_to")), data.alias("data"))


def _urn(i) -> str:
    return f"<urn:page:{'none' if i is None else i}>"


def _page(urn: str | None):
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def header(page_id, url, sha1: str, size: int, refers_to, date: str) -> bytes:
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join([*lines, f"Content-Length: {0 if revisit else size}"]) + "\r\n\r\n").encode()


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", body_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record for every row; returns the folder of the chunk table.

    Among equal payloads of MIN_SHARED_BYTES or more, rows with the largest id are responses and the others revisit it;
    where all ids are null, all are responses. A null body is an empty payload; a missing or null url is an empty
    target; rows that repeat an id are records of their own. Columns but id, url and body are not read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, running, rows, held = TaskContext.get().partitionId(), -1, None, [], 0

        def out():
            cols = list(zip(*rows)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()))], NAMES)

        for b in batches:
            for i in range(b.num_rows):
                chunk, last = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if chunk == 0:
                    record, running = record + 1, hashlib.sha1()
                data = b.column(7)[i].as_py() or b""
                running.update(data)
                if chunk == 0:
                    data = header(*(b.column(k)[i].as_py() for k in range(2, 7)), date) + data
                if last:
                    data += END
                rows.append((archive, record, chunk, last, running.hexdigest(), data))
                held += len(data)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield out()
                    rows, held = [], 0
        yield out()

    chunked(classify(pages, id_col, body_col)).mapInArrow(run, RECORDS).write.option("compression", "zstd").parquet(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) parsed from the records' own bytes.

    A response's payload is measured and digested chunk by chunk and compared with its header and running digests; a
    mismatch raises. A revisit states both for the payload that it refers to.
    """
    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, running, size, rows = {}, None, 0, []
        for b in batches:
            chunks, lasts, digests = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for k, last, so_far, data in zip(chunks, lasts, digests, b.column(3)):
                data = data.as_py()
                if k == 0:
                    head, _, data = data.partition(END)
                    head = head.decode().split("\r\n")
                    if head[0] != "WARC/1.1":
                        raise ValueError("not a WARC record")
                    fields, running, size = dict(x.split(": ", 1) for x in head[1:] if ": " in x), hashlib.sha1(), 0
                if last:
                    whole, data = data.endswith(END), data[: -len(END)]
                running.update(data)
                size += len(data)
                if running.hexdigest() != so_far:
                    raise ValueError(f"damaged chunk {k} of {fields.get('WARC-Record-ID')}")
                if last:
                    kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not whole or size != int(fields["Content-Length"]) or kind == "response" and running.hexdigest() != sha1:
                        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
                    rows.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), sha1, kind, _page(fields.get("WARC-Refers-To"))))
            cols = list(zip(*rows)) or [[]] * 5
            rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], [x.split()[0] for x in out.split(", ")])

    table, single = spark.read.parquet(path), (F.col("chunk") == 0) & F.col("last")
    # an oversized record's chunks meet in one task, in order; a task holds one batch of them at a time
    dealt = table.where(~single).repartition(F.col("archive"), F.col("record")).sortWithinPartitions("archive", "record", "chunk")
    fields = ("chunk", "last", "sha1_so_far", "data")
    return table.where(single).select(*fields).mapInArrow(run, out).union(dealt.select(*fields).mapInArrow(run, out))


def export(spark: SparkSession, path: str, archive: int, to) -> None:
    """Write one archive of the chunk table to a binary file object, chunk by chunk."""
    for r in spark.read.parquet(path).where(F.col("archive") == archive).orderBy("record", "chunk").select("data").toLocalIterator():
        to.write(r["data"])


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS m FROM q WHERE payload_bytes >= {MIN_SHARED_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND payload_bytes >= {MIN_SHARED_BYTES}"""
