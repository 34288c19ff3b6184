"""WARC archives: a writer with revisit records and a splittable reader.

The writer makes one gzip member a record. The reader's tasks scan byte ranges of the archives for the gzip magic,
validate candidate members by decoding their headers, and own the records that start inside their range; a record may
end beyond it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, new_path, read_table, staged

#: Bytes of a byte range, bytes read at a time, and the least payload that a revisit record may stand for.
SPLIT_BYTES, CHUNK, LEAST_REVISIT = 32 << 20, 1 << 18, 100
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload or a revisit without it."""
    clean = lambda s: "".join(c if c >= " " else f"%{ord(c):02X}" for c in s)
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def decode_record(data: bytes) -> dict[str, Any]:
    """A row of RECORDS from a decompressed member; raises ValueError if it isn't a whole record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut short")
    number = lambda x: None if x is None or x == "None" else int(x)
    page = lambda x: number(x.removeprefix("<urn:x-page:").removesuffix(">")) if x else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None if kind == "revisit" else rest[:size].partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest, "payload_bytes": int(fields["X-Payload-Length"]) if payload is None else len(payload), "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def write_warc(records: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Writes (page_id, url, payload, digest, refers_to, revisit) to one archive a task; returns their paths and sizes.

    An archive gets its name when it is whole, with the task's attempt in it, so retried and doubled tasks do no harm:
    only the archives of the attempts that counted are returned.
    """

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size = 0
        with files.open_output_stream(f"{root}/.{name}", compression=None) as out:
            for df in it:
                for page_id, url, payload, digest, refers_to, revisit in zip(df["page_id"].tolist(), df["url"], df["payload"], df["digest"], df["refers_to"].tolist(), df["revisit"]):
                    number = lambda x: None if x is None or x != x else int(x)
                    data = encode_record(number(page_id), url, bytes(payload), digest, number(refers_to), bool(revisit))
                    out.write(data)
                    size += len(data)
        files.move(f"{root}/.{name}", f"{root}/{name}")
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "size": [size]})

    rows = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return [(r.path, r.size) for r in rows.mapInPandas(write, "path string, size long").collect()]


class Damaged(ValueError):
    """An archive holds bytes that are no whole record where one has to be."""


def members(stream: Any, start: int, end: int, damaged: str = "raise") -> Iterator[bytes]:
    """The decompressed members that start in [start, end) of a seekable stream.

    An archive is its members without gaps, so a member has to start at its first byte and wherever one ends. Where none
    does, or one whose header is right breaks off, damaged says what happens: "raise" Damaged, or "skip" to the next one.
    The member after the last one is looked at too, as no range may own it. An empty stream has none.
    """
    held, base = b"", start  # held: bytes from base on

    def fill(n: int) -> bool:
        nonlocal held
        stream.seek(base + len(held))
        more = stream.read(max(n, CHUNK))
        held += more
        return bool(more)

    def member(whole: bool = True) -> bytes | None:
        """The member at base, or just its first bytes; held starts after a whole one. None if there is none."""
        nonlocal held, base
        unzip, parts, used, head = zlib.decompressobj(31), [], 0, b""
        while not unzip.eof:
            if used == len(held) and not fill(CHUNK):
                if len(head) < 5:
                    return None
                raise Damaged(f"the archive ends in the record at {base}")
            piece = held[used:]
            try:
                parts.append(unzip.decompress(piece))
            except zlib.error as e:
                if len(head) < 5:
                    return None
                raise Damaged(f"the record at {base} is damaged") from e
            used = len(held) - len(unzip.unused_data) if unzip.eof else len(held)
            if len(head) < 5:
                head = b"".join(parts)[:5]
                if head != b"WARC/"[: len(head)]:
                    return None
            if not whole and len(head) == 5:
                return head
        if len(head) < 5:
            return None
        held, base = held[used:], base + used
        return b"".join(parts)

    due = 0  # where a member has to start, if that is known
    while True:
        if len(held) < len(MAGIC) and not fill(CHUNK) and not held:
            return
        if base >= end and base != due:
            return
        try:
            found = member(base < end) if held.startswith(MAGIC) else None
            if found is None and base == due:
                raise Damaged(f"no record starts at {base}")
        except Damaged:
            if damaged == "raise":
                raise
            found = None
        if base >= end and (found is None or base == due):
            return
        if found is not None:
            due = base
            yield found
            continue
        due = -1
        at = held.find(MAGIC, 1)
        skip = at if at >= 0 else max(1, len(held) - len(MAGIC) + 1)
        held, base = held[skip:], base + skip
        if at < 0 and not fill(CHUNK):
            return


def read_warc(spark: SparkSession, archives: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES, payload: bool = True, damaged: str = "raise") -> DataFrame:
    """RECORDS of all archives (path, size), by byte ranges; payload is null in revisit records, or always if not asked for.

    Damaged or cut records fail the read, unless damaged is "skip": then they are left out. No archives give no rows.
    """
    ranges = [(p, a, min(a + split_bytes, n)) for p, n in archives for a in range(0, n, split_bytes)]
    columns = RECORDS if payload else RECORDS.rsplit(",", 1)[0]
    names = [x.split()[0] for x in columns.split(", ")]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for path, start, end in df.itertuples(index=False):
                files, place = _filesystem(path)
                with files.open_input_file(place) as stream:
                    rows, size = [], 0
                    for data in members(stream, start, end, damaged):
                        try:
                            rows.append(decode_record(data))
                        except (ValueError, KeyError):
                            if damaged == "raise":
                                raise
                        size += len(data) if payload else 300
                        if size > 16 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                    yield _frame(rows, names)

    table = spark.createDataFrame(ranges, "path string, start long, end long")
    return table.repartition(max(1, len(ranges)), "path", "start").mapInPandas(read, columns)


def _frame(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="Int64" if n in ("page_id", "refers_to") else object) for n in names})
    out["payload_bytes"] = out["payload_bytes"].astype("int64")
    return out


def archive(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> list[tuple[str, int]]:
    """Writes a record for each page, its payload the html in UTF-8 (null: empty), and returns the archives.

    Of equal payloads of least bytes or more the smallest page_id is the response and the others revisit it; repeated
    rows of that page are responses too. Null page_ids are never smallest unless all are null. Pages move once, by page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = staged(rows.filter(F.octet_length("payload") >= least).select("page_id", "digest"), "payloads")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    revisits = lookup_join(keys, staged(first, "first"), ["digest"], "n", keys.count()).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "first_id").distinct()
    joined = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["revisit_id"]) & (rows["digest"] == revisits["revisit_digest"]), "left")
    return write_warc(joined.select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"), F.col("revisit_digest").isNotNull().alias("revisit")), folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written by archive() and read back by read_warc(), which define odd rows; no pages, no rows."""
    archives = archive(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(spark, archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
