"""Operator 8: WARC archives through a chunked record table.

A payload never travels whole: Spark explodes it into (record, chunk number)
rows of bounded size.  Writing tasks stream these rows into gzip archives on the
shared folder; reading tasks stream the archives back into rows of the same
table, each with the digest of the payload so far, so that the last chunk of a
record carries the digest of all of it.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, materialise, scratch_path

CHUNK_BYTES = 64 << 10
#: Payloads below this are stored again rather than referred to.
REVISIT_BYTES = 1000
#: A writer starts a new archive beyond so many bytes.
ARCHIVE_BYTES = 64 << 20

CHUNKS = "record long, chunk long, n_chunks long, data binary"
RECORDS = "record_id string, record_date string, page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string"


def chunked(df: DataFrame, payload: str, *keep: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in order: the columns `keep`, chunk, n_chunks, data.  An empty payload has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk_bytes)).cast("int")
    return df.withColumn("n_chunks", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select(
        *keep, "chunk", "n_chunks", F.substring(F.col(payload), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")
    )


def plan_records(df: DataFrame | Rows, *, id_col: str, url_col: str, payload_col: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """id, name, url, payload (binary), n_bytes, sha1, record_type, refers_to and refers_to_name of each page.

    name is the id and the row's number in Rows, so that records of repeated or null ids
    have names of their own; df is read twice, and written first where it is no table.
    Payloads are equal when length and SHA-256 are.  Counting them shuffles digests
    only; payloads move to meet the groups of more than one, unless these are few
    enough for Spark to broadcast.
    """
    pages = Rows.of(df).select(id=F.col(id_col).cast("long"), url=F.col(url_col), payload=F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).select(
        "id", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "row").alias("name"), "url", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256")
    )
    groups = materialise(
        pages.where(F.col("n_bytes") >= revisit_bytes)
        .groupBy("sha256", "n_bytes")
        .agg(F.max(F.struct("id", "name")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha256", F.col("top.id").alias("first"), F.col("top.name").alias("first_name")),
        "warc-groups",
    )
    revisit = (F.col("n_bytes") >= revisit_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return pages.join(groups, "sha256", "left").select(
        "id", "name", "url", "payload", "n_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_name")).alias("refers_to_name"),
    )


def _open(uri: str, mode: str, attempt: int = 0):
    """A stream on a file of any store that pyarrow reaches, the shared file system included.  Writing, under a name of the task's attempt."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store, path, store.open_output_stream(f"{path}.{attempt}.part", compression=None)
    return store, path, store.open_input_stream(path, compression=None)


def _header(kind: str, lines: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", f"WARC-Type: {kind}\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def _clean(value: str) -> str:
    """Header values are one line."""
    return " ".join(value.split())


def write_archives(records: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes the planned records below folder; one row per archive: uri, n_records, n_bytes.

    Each record is a gzip member of its own.  Until an archive is complete it has a
    name of its task's attempt, then the same name on a retry: attempts never write
    one file, a lost task leaves no half archive, and a repeated one replaces its own.
    date is the WARC-Date of all records, the time of the call if not given.
    """
    from datetime import UTC, datetime

    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = chunked(
        records.withColumn("body", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))), "body",
        "id", "name", "url", "n_bytes", "sha1", "record_type", "refers_to", "refers_to_name", chunk_bytes=chunk_bytes,
    )

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt, number, done = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, []
        out = gz = digest = None
        n_records = n_bytes = 0

        def close():
            nonlocal out, number, n_records, n_bytes
            if out is not None:
                stream.close()
                store.move(f"{path}.{attempt}.part", path)
                done.append((uri, n_records, n_bytes))
                out, number, n_records, n_bytes = None, number + 1, 0, 0

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if out is not None and n_bytes > archive_bytes:
                        close()
                    if out is None:
                        uri = f"{folder}/part-{part:06d}-{number:05d}.warc.gz"
                        store, path, stream = _open(uri, "w", attempt)
                        out = stream
                    gz, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    lines = [
                        ("WARC-Record-ID", f"<urn:page:{r['name']}>"),
                        ("WARC-Date", when),
                        ("WARC-Target-URI", _clean(r["url"] or "")),
                        ("WARC-Payload-Digest", f"sha1:{r['sha1']}"),
                        ("X-Payload-Length", str(r["n_bytes"])),
                    ]
                    if r["record_type"] == "revisit":
                        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{r['refers_to_name']}>")]
                    lines += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(r["n_bytes"] if r["record_type"] == "response" else 0))]
                    z = gz.compress(_header(r["record_type"], lines))
                    out.write(z)
                    n_bytes += len(z)
                digest.update(r["data"])
                z = gz.compress(r["data"])
                if r["chunk"] == r["n_chunks"] - 1:
                    if r["record_type"] == "response" and digest.hexdigest() != r["sha1"]:
                        raise ValueError(f"record {r['id']}: chunks out of order")
                    z += gz.compress(b"\r\n\r\n") + gz.flush()
                    n_records += 1
                out.write(z)
                n_bytes += len(z)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["uri", "n_records", "n_bytes"])

    return materialise(rows.mapInArrow(write, "uri string, n_records long, n_bytes long"), "warc-archives")


class _Members:
    """Bytes of a stream of gzip members, decompressed a little at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.z, self.rest, self.buffer = stream, size, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.size)
                if not self.rest:
                    return False
            got = self.z.decompress(self.rest, self.size)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes | None:
        """Up to an empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 4]
        return out


def read_archives(archives: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk rows of all records: record_id, record_date, page_id, url, record_type, refers_to,
    declared_bytes, declared_digest, chunk, data, bytes_so_far, digest_so_far, last.

    Memory per task is a few chunks, whatever the size of a record or archive.
    with_data=False leaves data null but still digests it.
    """

    def read(batches):
        import pyarrow as pa

        names = ["record_id", "record_date", "page_id", "url", "record_type", "refers_to", "declared_bytes", "declared_digest", "chunk", "data", "bytes_so_far", "digest_so_far", "last"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        number = lambda x: int(n) if (n := x[len("<urn:page:") : -1].partition(":")[0]) else None
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                stream = _open(uri, "r")[2]
                with stream:
                    src = _Members(stream, chunk_bytes)
                    while (head := src.head()) is not None:
                        h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
                        left, digest, chunk, so_far = int(h["Content-Length"]), hashlib.sha1(), 0, 0
                        fixed = (
                            h["WARC-Record-ID"], h["WARC-Date"], number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], number(h.get("WARC-Refers-To", "<urn:page:>")),
                            int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        )
                        while True:
                            data = src.take(min(left, chunk_bytes))
                            if left and not data:
                                raise EOFError(f"{uri} ends within {fixed[0]}")
                            digest.update(data)
                            left, so_far = left - len(data), so_far + len(data)
                            rows.append((*fixed, chunk, data if with_data else None, so_far, digest.copy().hexdigest(), left == 0))
                            held += 500 + len(data) * with_data
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                                rows, held = [], 0
                            chunk += 1
                            if not left:
                                break
                        if src.take(4) != b"\r\n\r\n":
                            raise ValueError(f"{uri}: {fixed[0]} isn't closed")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = f"{RECORDS}, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean"
    spark = archives.sparkSession
    # one archive, of bounded size, at a time: as many tasks as archives
    n = max(1, archives.count())
    return archives.select("uri").repartition(min(n, 4 * spark.sparkContext.defaultParallelism) if n < 1000 else n // 8).mapInArrow(read, schema)


def warc_round_trip(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a WARC record per row and reads the archives back; one row per record:
    id_col, payload_bytes, payload_digest, record_type, refers_to, verified.

    Of records with equal payloads of at least REVISIT_BYTES bytes, that with the
    largest id is the response and the others are revisits that name it; rows that
    repeat the largest id are responses too, and so are all rows of a group without
    ids.  A null payload is empty; record names are unique even where ids are null
    or repeated.  White space in URLs becomes one space.  A response's bytes and digest are those of
    the payload read back; a revisit has those its record declares.  verified says
    that what was read agrees with what the record declares.
    """
    spark = df.sparkSession
    records = plan_records(df, id_col=id_col, url_col=url_col, payload_col=payload_col)
    archives = write_archives(records, folder or scratch_path(spark, "warc"))
    response = F.col("record_type") == "response"
    return (
        read_archives(archives, with_data=False)
        .where("last")
        .select(
            F.col("page_id").alias(id_col), F.col("declared_bytes").alias("payload_bytes"),
            F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to",
            F.when(response, (F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest"))).otherwise(F.lit(True)).alias("verified"),
        )
    )
