"""WARC archives: written with segmented records and chunked payloads, and put together again when read."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shared_folder, stored
from .text import columns

#: Bytes of block in a record; a longer block goes on in continuation records.
SEGMENT_BYTES = 16 * 1024
#: Records in a file: with segments of the size above, a file holds 64 MB of blocks at most.
RECORDS_PER_FILE = 4096
#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 1000
CHUNK_BYTES = 4096

_RECORDS = "record_id string, origin_id string, segment int, total_length bigint, record_type string, page_id bigint, refers_to bigint, uri string, digest string, block binary"
_END = b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(``page_id``, ``digest``, ``refers_to``) of each record whose payload another one with a larger id holds.

    Only ids, lengths and digests are shuffled; the largest id of each payload is found by partial aggregation,
    and the join back is left to Spark's skew handling, so a payload in a third of all records is no one task.
    """
    digests = pages.select("page_id", "digest", F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least)
    first = digests.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return digests.join(first, ["digest", "bytes"]).where("not page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for page_ids, uris, payloads, digests, refers in columns(batches, "page_id", "url", "payload", "digest", "refers_to"):
        out: list[bytes] = []
        for page_id, uri, payload, digest, refers_to in zip(page_ids, uris, payloads, digests, refers, strict=True):
            revisit = refers_to is not None
            fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z"}
            if uri:
                fields["WARC-Target-URI"] = " ".join(uri.split())
            if page_id is not None:
                fields["X-Page-ID"] = str(page_id)
            fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
            if revisit:
                fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers_to)}
            else:
                frames = [payload[k : k + chunk_bytes] for k in range(0, len(payload), chunk_bytes)]
                block += b"".join(b"%x\r\n%s\r\n" % (len(f), f) for f in frames) + b"0\r\n\r\n"
            parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
            for k, part in enumerate(parts, 1):
                own = fields
                if k > 1:
                    own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": fields["WARC-Record-ID"]}
                if len(parts) > 1:
                    own = own | {"WARC-Segment-Number": str(k)} | ({"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {})
                head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in own.items()) + f"Content-Length: {len(part)}\r\n\r\n"
                out.append(head.encode("utf-8", "surrogatepass") + part)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` to gzipped WARC files under ``path``, by Spark's own writer.

    Blocks longer than ``segment_bytes`` are split into a first record and continuations. Of equal payloads of
    at least ``least`` bytes, the row with the largest id is the response, and the others are revisits of it;
    rows that repeat that id are responses too. A null payload is empty; a null id is left out of the record,
    is never referred to, and can itself be a revisit. No row is dropped; an empty table writes no record.
    """
    rows = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    again = revisits(rows, least).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    records = marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda b: _records(b, segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(content: bytes) -> Iterator[tuple]:
    """The records of an archive, by their lengths; what a block holds is never searched."""
    content, at = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(_END, at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        begin = end + 4
        at = begin + int(fields["content-length"])
        number = lambda name: int(fields[name]) if name in fields else None  # noqa: E731, B023
        yield (
            fields["warc-record-id"], fields.get("warc-segment-origin-id", fields["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"),
            fields["warc-type"], number("x-page-id"), number("x-refers-to-page-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), content[begin:at],
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read(path: str, spark, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row per record, continuations apart, of all archives under ``path``. A file is read whole; ``write`` bounds its size."""
    schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in _parsed(content.as_py()):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= batch_bytes:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _RECORDS)


def _payload(block: bytes) -> tuple[bytes, str | None]:
    """The body of an HTTP block, out of its chunk frames if it has them, and what is wrong with it."""
    head, gap, body = block.partition(_END)
    if not gap:
        return b"", "no_http_header"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, None
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size == 0:
            return b"".join(out), None
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return b"".join(out), "bad_chunk"
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: ``record_id``, ``record_type``, ``page_id``, ``refers_to``, ``uri``, ``digest`` (as its header says), ``payload`` and ``problem``.

    Records without a segment number are whole. The rest are grouped by origin identifier, ordered by segment
    number, and joined; a group holds one record's parts and no more. ``problem`` is null, or one of
    ``missing_segment`` (numbers are not 1 to n, once each), ``length_mismatch`` (the last part's total is absent
    or differs), ``no_http_header``, ``bad_chunk`` or ``digest_mismatch``; such a row keeps what could be read.
    """
    kept = ("record_id", "record_type", "page_id", "refers_to", "uri", "digest")
    alone = records.where("segment is null").select(*kept, F.array("block").alias("blocks"), F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("bigint").alias("total"))
    head = F.struct(F.col("segment") > 1, *kept[1:])
    many = (
        records.where("segment is not null").groupBy(F.col("origin_id").alias("record_id"))
        .agg(F.min(head).alias("h"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max(F.struct("segment", "total_length"))["total_length"].alias("total"))
        .select("record_id", *[f"h.{n}" for n in kept[1:]], F.col("s.block").alias("blocks"), F.col("s.segment").alias("numbers"), "total")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, problems = [], []
            for kind, blocks, numbers, total in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("record_type", "blocks", "numbers", "total")), strict=True):
                block = b"".join(blocks)
                payload, problem = _payload(block) if kind == "response" else (b"", None)
                if numbers is not None and numbers != list(range(1, len(numbers) + 1)):
                    problem = "missing_segment"
                elif numbers is not None and total != len(block):
                    problem = "missing_segment" if total is None else "length_mismatch"
                payloads.append(payload)
                problems.append(problem)
            rest = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], names=[*kept, "payload", "problem"])

    schema = "record_id string, record_type string, page_id bigint, refers_to bigint, uri string, digest string, payload binary, problem string"
    out = alone.unionByName(many).mapInArrow(join, schema)
    wrong = (F.col("record_type") == "response") & (F.col("digest") != F.sha1("payload"))
    return out.withColumn("problem", F.coalesce("problem", F.when(wrong, "digest_mismatch")))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return per record ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to`` and ``problem``; a revisit has size and digest from the
    response that it refers to, and ``digest_mismatch`` if that is not what its own header says."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    whole = reassemble(read(path, spark)).select("page_id", "record_type", "refers_to", "digest", "problem", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1"))
    whole = stored(whole, "warc-digests")
    own = whole.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "problem")
    target = own.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = whole.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), "problem")
    found = again.join(target.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"], "left")
    found = found.withColumn("problem", F.coalesce("problem", F.when(F.col("payload_bytes").isNull(), "digest_mismatch")))
    return own.unionByName(found.select(own.columns))
