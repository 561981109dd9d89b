"""WARC archives: a gzip member for each record, written and read in sequence.

The writer gives every task its own archives in the shared folder; a file appears under its final
name only when it is whole, and only the files of successful tasks are listed in the manifest, so
a task that is run again leaves no double records. The reader streams an archive: it inflates a
member bit by bit, frames the record by its content length, and checks block and payload digests
as the bytes go by, so its memory holds one record at most, or one buffer if payloads aren't kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import scratch, table, tasks, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUFFER = 1 << 16
MANIFEST = "path string, n_records long"
RECORDS = "record_type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(*parts: bytes) -> str:
    digest = hashlib.sha1(usedforsecurity=False)
    for p in parts:
        digest.update(p)
    return base64.b32encode(digest.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit of another page if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = () if refers_to is not None else (payload,)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(http, *body)}",
        f"Content-Length: {len(http) + sum(map(len, body))}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return b"".join(("\r\n".join(head).encode("utf-8", "surrogatepass"), b"\r\n\r\n", http, *body, b"\r\n\r\n"))


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """The bytes of an archive's records, inflated as they are asked for."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.rest, self.out = raw, None, b"", b""

    def _more(self) -> bool:
        """Inflates some more of the current member, or begins the next; False at a member's end."""
        if not self.rest:
            self.rest = self.raw.read(BUFFER)
        if not self.rest:
            raise ValueError("the archive ends inside of a record")
        self.out += self.z.decompress(self.rest, BUFFER)
        self.rest = self.z.unconsumed_tail or self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return not self.z.eof

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the archive."""
        self.rest = self.rest or self.raw.read(BUFFER)
        self.z, self.out = zlib.decompressobj(31), b""
        return bool(self.rest)

    def head(self) -> dict[str, str]:
        """Fields up to the empty line, by lower-cased name; the first line under ''."""
        while b"\r\n\r\n" not in self.out:
            if self.z.eof or not self._more() and b"\r\n\r\n" not in self.out:
                raise ValueError("a header without an end")
        head, self.out = self.out.split(b"\r\n\r\n", 1)
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        return {"": first} | {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}

    def bytes(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out:
                if self.z.eof:
                    raise ValueError("a record shorter than its content length")
                self._more()
                continue
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece

    def end(self) -> None:
        """The two line ends after a record, and the member's own end."""
        while not self.z.eof:
            self._more()
        if self.out != b"\r\n\r\n":
            raise ValueError("a record longer than its content length")


class Block:
    """Digests and length of a record's block, split at the end of the HTTP header."""

    def __init__(self, keep: bool):
        self.whole, self.payload = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False)
        self.http, self.kept, self.n, self.keep, self.inside = b"", [], 0, keep, False

    def add(self, piece: bytes) -> None:
        self.whole.update(piece)
        if not self.inside:
            self.http += piece
            if b"\r\n\r\n" not in self.http:
                return
            self.inside = True
            self.http, piece = self.http.split(b"\r\n\r\n", 1)
        self.payload.update(piece)
        self.n += len(piece)
        if self.keep:
            self.kept.append(piece)


def page_of(urn: str | None) -> int | None:
    return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")) else None


def records(raw: BinaryIO, payloads: bool = True) -> Iterator[tuple]:
    """RECORDS rows of an archive; ValueError for a record whose frame or digest is wrong."""
    members = Members(raw)
    while members.begin():
        head = members.head()
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        block = Block(payloads)
        for piece in members.bytes(int(head["content-length"])):
            block.add(piece)
        members.end()
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        told = int(re.search(rb"(?im)^content-length:\s*(\d+)", block.http)[1])
        if base64.b32encode(block.whole.digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"wrong block digest: {head['warc-record-id']}")
        whole = head["warc-type"] == "response"
        if whole and (block.n != told or base64.b32encode(block.payload.digest()).decode() != digest):
            raise ValueError(f"wrong payload digest: {head['warc-record-id']}")
        yield (
            head["warc-type"], page_of(head["warc-record-id"]), page_of(head.get("warc-refers-to")),
            head.get("warc-target-uri"), digest, told, b"".join(block.kept) if payloads and whole else None,
        )


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id with an equal payload of
    min_bytes or more, null for that page itself and for rows without an id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.unhex(F.sha2("html", 256)))
    long = rows.filter((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "same")
    first = long.groupBy("same").agg(F.min("page_id").alias("refers_to"))
    later = long.join(first, "same").filter("page_id <> refers_to").distinct()
    later = later.withColumnsRenamed({"page_id": "p", "same": "s"})
    out = rows.join(later, (F.col("page_id") == F.col("p")) & (F.col("same") == F.col("s")), "left")
    return out.select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns MANIFEST.

    Null html counts as empty and null urls are left out. Of equal payloads of min_bytes or more
    that of the smallest page_id is a response and the others are revisits of it. Repeated rows
    and rows with null ids each get a record; one with a null id is a response. An archive is
    closed when it has roll_bytes. Other columns are ignored.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        done, out, n, size, name = [], None, 0, 0, ""

        def close() -> None:
            out.close()
            store.move(f"{at}/{name}.part", f"{at}/{name}")
            done.append((f"{folder}/{name}", n))

        for b in batches:
            refers = b["refers_to"].astype("Int64")
            for page, url, html, first in zip(b["page_id"].astype("Int64"), b["url"], b["html"], refers, strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}.part", compression=None)
                page, first = None if pd.isna(page) else int(page), None if pd.isna(first) else int(first)
                data = member(record(page, url if isinstance(url, str) else None, html.encode("utf-8", "surrogatepass"), first), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_records"])

    return written(with_first(pages, min_bytes).mapInPandas(made, MANIFEST), "warc-manifest")


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives in the column path; payload is null for revisits, or if not asked for.

    payload_bytes is the length of the full payload, for a revisit as its HTTP header tells it.
    No archives give no rows; a broken record fails the job with ValueError.
    """
    names = RECORDS.replace(" binary", "").replace(" string", "").replace(" long", "").split(", ")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as raw:
                    rows, size = [], 0
                    for r in records(raw, payloads):
                        rows.append(r)
                        size += 200 + len(r[-1] or b"")
                        if size > 4 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                    yield _frame(rows, names)

    spread = archives.select("path").repartition(max(tasks(archives.sparkSession), 2), "path")
    return spread.mapInPandas(made, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    out = read_warc(manifest, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS x FROM p),
bits AS (
  SELECT page_id, html, first_id,
         list_reduce(list_transform(range(0, 40), lambda i:
           (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])
           [strpos('0123456789abcdef', substr(x, i + 1, 1))]), lambda a, b: a || b) AS b
  FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j:
           CAST(substr(b, 5 * i + j + 1, 1) AS BIGINT) * CAST(2 ** (4 - j) AS BIGINT)))::BIGINT, 1)),
         lambda a, c: a || c) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""
