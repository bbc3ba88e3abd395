r"""WARC: write record archives, normalise monolithic gzip, read records back through an offset index.

Three steps, each a Spark job whose small manifest is written to the shared folder, so that a lost
executor repeats only its own archives, under new names:

1. ``write_monolithic``: every task writes its rows as WARC/1.1 records into archives that are one gzip
   stream each (the form that has no random access), a new archive every ``roll_bytes`` of payload.
2. ``normalise``: an archive is inflated once as a stream, in chunks; every record becomes a gzip member
   of its own, and a sidecar file lists offset, length, type, digest and ids of each member.
3. ``read_index`` reads the sidecars, of the manifest's archives only; ``read_records`` fetches members by
   offset, grouped by archive, and hashes the payload again.

Files go through pyarrow's file systems by URI (file, hdfs, s3, gs), never a machine-local folder.

Of records with equal payloads of at least 100 bytes the smallest page_id is ``response``; the others
are ``revisit`` records without payload.  The digest groups are pre-aggregated (min per digest); those
of several records are repeated over salts and joined back, so a hot digest is many partitions.  A revisit's
payload figures are those of the record with its id and digest that it refers to, read back from the archives.

Defined results: null html is an empty payload; rows that repeat a page_id with its payload are of one
type, rows that repeat it with another payload are told apart by the digest; a row without page_id is a
response and nobody's target; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, shared_dir, table, written

MIN_REVISIT = 100
CHUNK = 1 << 20
#: Most tasks that archives are dealt to; each works through its archives one by one.
MAX_TASKS = 10_000
RECORD_TYPES = ("response", "revisit")


def _open(uri: str):
    """(file system, path) of a URI that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _number(text: str | None) -> int | None:
    return int(text) if text and text != "-" else None


def _headers(row) -> dict[str, str]:
    out = {"WARC-Type": row.record_type, "WARC-Record-ID": record_id(row.page_id), "WARC-Target-URI": (row.url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha256:{row.digest}", "WARC-Page-ID": row.page_id or "-", "Content-Type": "text/html"}
    if row.record_type == "revisit":
        out |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(row.refers_to), "WARC-Refers-To-Page-ID": row.refers_to}
    return out


def write_monolithic(records: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 6) -> DataFrame:
    """records(page_id, url, payload, digest, record_type, refers_to) -> manifest(archive, n_records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, done = None, []
        for rows in batches:
            for row in rows.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, n, size = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                payload = b"" if row.record_type == "revisit" or row.payload is None else bytes(row.payload)
                out.write(squeeze.compress(record_bytes(_headers(row), payload)))
                n, size = n + 1, size + len(payload)
                if size >= roll_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", n))
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((f"{folder}/{name}", n))
        yield pd.DataFrame(done, columns=["archive", "n_records"])

    # ids as text: pandas would turn whole numbers beside nulls into floats
    records = records.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return records.mapInPandas(write, "archive string, n_records long")


def inflated_records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head, payload) of each record of a gzip file of any number of members, inflated once."""
    inflate, buffer, data, begun = zlib.decompressobj(wbits=31), bytearray(), b"", False

    def more() -> bool:
        """Inflate up to a chunk more, so that memory is bounded however well the stream was compressed."""
        nonlocal inflate, data, begun
        data = data or stream.read(chunk)
        piece = inflate.decompress(data, chunk)
        buffer.extend(piece)
        ended, begun = not data and not piece, begun or bool(data)
        data = inflate.unconsumed_tail
        if inflate.eof:
            data, inflate, begun = inflate.unused_data, zlib.decompressobj(wbits=31), False
        if ended and begun:
            raise ValueError("archive ends inside a gzip member")
        return not ended

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("archive ends inside a record")
                return
        head = bytes(buffer[:end])
        headers = parse_head(head)
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise ValueError("archive ends inside a record")
        payload = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]
        yield headers, head, payload


#: Columns of the index; in a sidecar a line holds all but the first, "-" for null.
INDEX = "archive string, offset long, length long, record_type string, digest string, page_id long, refers_to long"
SIDECAR = ".idx"


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """manifest(archive) -> manifest(archive, n_records) of archives whose records are gzip members, with a sidecar each."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for rows in batches:
            for source in rows["archive"]:
                from_system, path = _open(source)
                name, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with (
                    from_system.open_input_stream(path, compression=None) as stream,
                    system.open_output_stream(f"{root}/{name}", compression=None) as out,
                    system.open_output_stream(f"{root}/{name}{SIDECAR}", compression=None) as sidecar,
                ):
                    for headers, head, payload in inflated_records(stream):
                        squeeze = zlib.compressobj(level, wbits=31)
                        member = squeeze.compress(head + b"\r\n\r\n" + payload + b"\r\n\r\n") + squeeze.flush()
                        out.write(member)
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        line = (at, len(member), headers["warc-type"], digest, headers.get("warc-page-id", "-"), headers.get("warc-refers-to-page-id", "-"))
                        sidecar.write((" ".join(map(str, line)) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pd.DataFrame([(f"{folder}/{name}", n)], columns=["archive", "n_records"])

    return manifest.select("archive").mapInPandas(rewrite, "archive string, n_records long")


def read_index(manifest: DataFrame) -> DataFrame:
    """manifest(archive) -> the index of all members, from the sidecars beside the archives."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for archive in rows["archive"]:
                system, path = _open(archive + SIDECAR)
                with system.open_input_stream(path, compression=None) as stream:
                    lines = [x.split(" ") for x in stream.read().decode().splitlines()]
                out = [(archive, int(at), int(size), kind, digest, _number(page), _number(target)) for at, size, kind, digest, page, target in lines]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.select("archive").mapInPandas(read, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """index -> page_id, record_type, refers_to, payload_bytes, payload_digest as stored in the archives."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stream = None, None
        for rows in batches:
            out = []
            for x in rows.itertuples(index=False):
                if x.archive != name:
                    system, path = _open(x.archive)
                    name, stream = x.archive, system.open_input_file(path)
                member = zlib.decompress(stream.read_at(x.length, x.offset), wbits=31)
                end = member.index(b"\r\n\r\n")
                headers = parse_head(member[:end])
                payload = member[end + 4 : end + 4 + int(headers["content-length"])]
                out.append((_number(headers.get("warc-page-id")), headers["warc-type"], _number(headers.get("warc-refers-to-page-id")), len(payload), hashlib.sha256(payload).hexdigest(), headers["warc-payload-digest"].removeprefix("sha256:")))
            frame = pd.DataFrame(out, columns=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest"])
            frame = frame.astype({"page_id": "Int64", "refers_to": "Int64"})
            yield frame

    return index.mapInPandas(fetch, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, record_type, refers_to."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT
    first = pages.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    out = salted_join(pages, first.where("n > 1").select("digest", "first"), "digest", "page_id", how="left")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return out.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read every record back by the sidecar indexes."""
    folder = shared_dir(pages.sparkSession)
    manifest = written(write_monolithic(with_revisits(pages), f"{folder}/monolithic", roll_bytes), "manifest")
    # manifests are small beside the archives that they name: dealt by number, or Spark would make one task of them
    tasks = min(MAX_TASKS, max(1, manifest.count()))
    members = written(normalise(manifest.repartition(tasks), f"{folder}/records"), "members")
    records = written(read_records(read_index(members.repartition(tasks))), "records")
    first = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # payloads below the limit never have revisits; of rows that repeat an id and a payload any is the target
    targets = first.where(F.col("payload_bytes") >= MIN_REVISIT).select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "payload_bytes", "payload_digest")
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to", "stated_digest")
    wanted = revisits.select("refers_to", "stated_digest").distinct()
    targets = targets.join(wanted, ["refers_to", "stated_digest"], "left_semi").dropDuplicates(["refers_to", "stated_digest"])
    seen = salted_join(revisits, targets, ["refers_to", "stated_digest"], "page_id").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return first.unionByName(seen)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
