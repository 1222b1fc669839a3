"""WARC archives: monolithic gzip in, one gzip member a record and an offset index out.

``write_archives`` writes pages as WARC records, each archive one gzip stream
over many records, as some crawlers leave them. Such a file can only be read
from its start. ``normalise`` inflates each once, rewrites every record as a
gzip member of its own and writes a sidecar index of offsets beside it, after
which any record can be read alone. ``read_records`` does so from the sidecars.

Equal payloads (of at least ``min_bytes``) are stored once: the record of the
largest page id is the response, the others are revisits that refer to it.

Defined results: a null html is an empty payload; a null url gets the record's
own name as target. Rows with a null page id are responses, unless a page with
an id has the same payload. Rows that repeat page id and payload are each
written, and are of the same type; of equal payloads the largest page id is the
response, and there are no other ties. A very long payload is one record, written
whole. An empty table gives no archive and an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened, written
from .scratch import Scratch

_NAME = "urn:x-page:"
_CHUNK = 1 << 20
ARCHIVES = "path string, records long"
SIDECAR = "archive string, offset long, length long, record string, type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes."""
    import pyarrow as pa

    def digest(batches):
        for b in batches:
            bodies = [(h or "").encode() for h in b.column(2).to_pylist()]
            more = [pa.array([payload_digest(x) for x in bodies], pa.string()), pa.array([len(x) for x in bodies], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "payload_digest", "payload_bytes"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(digest, "page_id long, url string, html string, payload_digest string, payload_bytes long")


def revisits(digests: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload_digest, refers_to of the records that repeat a payload."""
    large = digests.where(F.col("payload_bytes") >= min_bytes)
    top = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    again = large.join(top.where("n > 1 and refers_to is not null"), "payload_digest")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    return again.where(other).select("page_id", "payload_digest", "refers_to").distinct()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    name = f"<{_NAME}{'' if page_id is None else page_id}>"
    target = (url or name[1:-1]).replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_NAME}{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(chunks):
    """Bytes of a gzip file of any number of members, read once and forwards."""
    d = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield d.decompress(chunk)
            chunk = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)
    yield d.flush()


def split_records(chunks):
    """``(header fields, whole record)`` for each record of an inflated stream; holds one record at a time."""
    held, source = bytearray(), iter(chunks)

    def more() -> bool:
        part = next(source, None)
        if part is None:
            return False
        held.extend(part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record breaks off")
                return
        fields = header_fields(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a WARC record breaks off")
        yield fields, bytes(held[:size])
        del held[:size]


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def write_archives(plan: DataFrame, folder: str, roll_bytes: int, level: int = 3) -> DataFrame:
    """Archives of one gzip stream each, of about ``roll_bytes`` of records. Lazy: keep the result."""
    import pyarrow as pa

    def write(batches):
        rows = ((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        row, k, task = next(rows, None), 0, TaskContext.get().partitionId()
        while row is not None:
            path, n, size = f"{folder}/pages-{task:06d}-{k:04d}.warc.gz", 0, 0
            with written(path) as out:
                z = zlib.compressobj(level, wbits=31)
                while row is not None and size < roll_bytes:
                    page_id, url, html, digest, refers_to = row
                    data = record_bytes(page_id, url, (html or "").encode(), digest, refers_to)
                    out.write(z.compress(data))
                    n, size, row = n + 1, size + len(data), next(rows, None)
                out.write(z.flush())
            k += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return plan.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, ARCHIVES)


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Rewrite each archive with a gzip member a record and a sidecar index. Lazy: keep the result."""
    import pyarrow as pa

    def rewrite(batches):
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            name = path.rpartition("/")[2]
            system, inner = opened(path)
            n, offset, lines = 0, 0, io.BytesIO()
            with system.open_input_stream(inner, compression=None) as source, written(f"{folder}/data/{name}") as out:
                for fields, record in split_records(inflate(iter(lambda: source.read(_CHUNK), b""))):
                    member = gzip.compress(record, level, mtime=0)
                    out.write(member)
                    lines.write(f"{folder}/data/{name}\t{offset}\t{len(member)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
                    n, offset = n + 1, offset + len(member)
            with written(f"{folder}/index/{name}.tsv") as out:
                out.write(lines.getvalue())
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/data/{name}"], "records": [n]})

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(rewrite, ARCHIVES)


def read_records(spark: SparkSession, index: str) -> DataFrame:
    """Every record of normalised archives, each found by its sidecar entry and read alone."""
    import pyarrow as pa

    def read(batches):
        file, at = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != at:
                    system, inner = opened(path)
                    file, at = system.open_input_file(inner), path
                record = gzip.decompress(file.read_at(length, offset))
                head, _, block = record[:-4].partition(b"\r\n\r\n")
                fields = header_fields(head)
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(header_fields(http)["content-length"])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"payload and digest differ: {path} at {offset}")
                ids = [fields.get(k, "").strip("<>").removeprefix(_NAME) for k in ("warc-record-id", "warc-refers-to")]
                page_id, refers_to = (int(x) if x else None for x in ids)
                rows.append((page_id, size, digest, kind, refers_to))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    sidecars = spark.read.schema(SIDECAR).option("sep", "\t").csv(index)
    return sidecars.select("archive", "offset", "length").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and read the records back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    digests = scratch.keep(with_digests(pages).select("page_id", "payload_digest", "payload_bytes"), "digests")
    again = scratch.keep(revisits(digests, min_bytes), "revisits").alias("r")
    rows = with_digests(pages).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest"))
    plan = rows.join(again, same, "left").select("p.*", "r.refers_to")
    archives = scratch.keep(write_archives(plan, scratch.path("monolithic"), roll_bytes), "archives")
    done = scratch.keep(normalise(archives, scratch.path("normal")), "normalised")
    if done.isEmpty():
        return spark.createDataFrame([], RECORDS)
    scratch.drop("monolithic", "digests", "revisits")
    return read_records(spark, scratch.path("normal/index"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
