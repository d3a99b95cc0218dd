"""WARC archives: written as whole-file gzip, normalised to one member a record, read by offset."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_path
from .common import drop, sent_if_small, small_batches, store

GZIP = 31  # window bits that ask zlib for a gzip wrapper
CHUNK = 1 << 18
END = b"\r\n\r\n"


@dataclass(frozen=True)
class WarcRule:
    """Least payload that a revisit can stand for, compression level, date of the records, pages of one payload that a task takes."""

    least: int = 100
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"
    hot: int = 1 << 14


def filesystem(path: str):
    """A file system of pyarrow and the path in it; a path without a scheme is local or a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def mark_revisits(pages: DataFrame, rule: WarcRule = WarcRule()) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, first`` (the page a revisit refers to, else null).

    Repeated digests are counted first. A payload on more than ``rule.hot`` pages
    is cut into as many salts as it needs, so that one with a third of the pages
    is spread over tasks at any size; the list of such payloads has at most one
    row per ``rule.hot`` pages.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    counted = rows.where(F.col("payload_bytes") >= rule.least).groupBy("payload_digest").agg(F.min("page_id").alias("least_id"), F.count("*").alias("n")).where("n > 1")
    repeated, _ = store(counted.withColumn("salts", F.ceil(F.col("n") / F.lit(rule.hot)).cast("int")), "warc-repeated")
    hot = sent_if_small(repeated.where("salts > 1").select("payload_digest", "salts"))
    split = repeated.select("payload_digest", "least_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = rows.join(hot, "payload_digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    joined = salted.join(split, ["payload_digest", "salt"], "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", first.alias("first"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, n: int, digest: str, first, date: str) -> bytes:
    """One WARC record; a revisit has the block's head only."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload if first is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block + END


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, whole bytes and start of the block of each record of an inflated stream."""
    buffer, searched = bytearray(), 0
    it = iter(chunks)
    while True:
        while (at := buffer.find(END, searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if (more := next(it, None)) is None:
                if buffer.strip():
                    raise ValueError("the archive ends within a record's head")
                return
            buffer += more
        head = fields(bytes(buffer[:at]))
        block, end = at + 4, at + 4 + int(head["content-length"]) + 4
        while len(buffer) < end:
            if (more := next(it, None)) is None:
                raise ValueError("the archive ends within a record")
            buffer += more
        yield head, bytes(buffer[:end]), block
        del buffer[:end]
        searched = 0


def inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip stream, of one member or of several."""
    engine = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            out = engine.decompress(data, CHUNK * 4)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(GZIP)
    rest = engine.flush()
    if rest:
        yield rest


def gzipped(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


def write_monolithic(marked: DataFrame, folder: str, rule: WarcRule = WarcRule()) -> DataFrame:
    """An archive per partition, compressed as one stream: ``archive, records``.

    Every attempt writes a file of its own name, and the table lists the files of
    the attempts that Spark accepted, so a lost executor leaves no half archive.
    """

    def run(batches):
        from pyspark import TaskContext

        archive, sink, engine, n = f"{folder}/whole-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(rule.level, zlib.DEFLATED, GZIP), 0
        for batch in batches:
            for row in zip(*batch.columns):
                if sink is None:
                    fs, path = filesystem(archive)
                    sink = fs.open_output_stream(path, compression=None)
                sink.write(engine.compress(record(*[x.as_py() for x in row], rule.date)))
                n += 1
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [archive], "records": pa.array([n], pa.int64())})

    return marked.mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str, rule: WarcRule = WarcRule()) -> DataFrame:
    """Each whole-stream archive rewritten, a gzip member a record, with a sidecar index.

    Inflates an archive once, in chunks, and holds one record. Beside
    ``X.warc.gz`` lies ``X.warc.gz.idx``: offset, length and record id a line.
    Returns the same as rows: ``archive, offset, length, record_id``.
    """
    out = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])

    def run(batches):
        for batch in batches:
            for old in batch.column(0).to_pylist():
                new = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                (fs, source), (to, path) = filesystem(old), filesystem(new)
                at, rows = 0, []
                with fs.open_input_stream(source, compression=None) as given, to.open_output_stream(path, compression=None) as made:
                    for head, whole, _ in records(inflated(given)):
                        member = gzipped(whole, rule.level)
                        made.write(member)
                        rows.append((new, at, len(member), head["warc-record-id"]))
                        at += len(member)
                with to.open_output_stream(path + ".idx", compression=None) as side:
                    side.write("".join(f"{a} {n} {i}\n" for _, a, n, i in rows).encode())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return archives.select("archive").mapInArrow(run, "archive string, offset long, length long, record_id string")


def read_records(index: DataFrame) -> DataFrame:
    """Records fetched by offset: ``page_id, url, record_type, refers_to, declared_bytes, declared_digest, payload`` (null in revisits)."""
    out = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary()),
    ])

    def number(text):
        return None if text is None else int(text)

    def run(batches):
        name, source, rows, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    if source is not None:
                        source.close()
                    fs, path = filesystem(archive)
                    name, source = archive, fs.open_input_file(path)
                whole = zlib.decompress(source.read_at(length, offset), GZIP)
                at = whole.index(END)
                head, block = fields(whole[:at]), whole[at + 4:-4]
                kind = head["warc-type"]
                payload = block[block.index(END) + 4:] if kind == "response" else None
                rows.append((
                    number(head.get("x-page-id")), head.get("warc-target-uri"), kind, number(head.get("x-refers-to-page")),
                    number(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"), payload,
                ))
                held += len(payload or b"")
                if held > 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)
                    rows, held = [], 0
        if source is not None:
            source.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return index.select("archive", "offset", "length").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, payload binary"
    )


def archive(pages: DataFrame, folder: str | None = None, rule: WarcRule = WarcRule()) -> DataFrame:
    """Write ``pages`` as normalised archives in ``folder``; the offset index, stored as a table.

    Whole-stream archives are written first, then inflated once each and
    rewritten record by record; they go when the index is complete.

    Null html: an empty payload. Null url: no target line. Null page ids: never
    the original of others' payload. Rows that repeat the smallest id of a
    payload are all responses. Other columns are ignored; an empty table gives
    no archive.
    """
    spark: SparkSession = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    whole = fresh_path(spark, "warc-whole")
    for path in (folder, whole):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    archives, listed = store(write_monolithic(mark_revisits(pages, rule), whole, rule), "warc-list")
    n = max(1, archives.count())
    index, _ = store(normalise(archives.repartition(n, "archive"), folder, rule), "warc-index")
    drop(spark, whole, listed)
    return index


def read_archive(index: DataFrame) -> DataFrame:
    """All records of the archives in ``index``; each archive is opened once."""
    n = max(1, index.select("archive").distinct().count())
    return read_records(index.repartition(n, "archive").sortWithinPartitions("archive", "offset"))
