"""WARC archives and their index, merged externally into global capture order.

Pages are written as gzip members, one record each, by the tasks themselves into
the shared folder; a manifest lists the files that committed tasks wrote, so
files of lost attempts are never read.  Reading an archive gives a capture run,
sorted by URL key and time.  Runs meet range-partitioned: each partition gets
sorted pieces of many runs and merges them with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.session import bounded_batches, shared_dir, table, written

INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string"
FILE_BYTES = 64 << 20
#: Entries of the index that a task merges.
RANGE_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Host labels in reverse order, then port, path and query, in lower case and without fragment: captures of a site sort together."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.partition("#")[0].lower()
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){m[2].lower() or '/'}"


def record(page_id: int, url: str, when: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response, or with a revisit that keeps only the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {when}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, chunk = zlib.decompressobj(31), [], stream.read(1 << 20)
    while chunk:
        parts.append(z.decompress(chunk))
        chunk = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        chunk = chunk or stream.read(1 << 20)
    if parts and not z.eof:
        raise ValueError("the archive ends inside a record")


def parsed(raw: bytes) -> tuple:
    """A record's index entry.  A response's payload is hashed again and has to agree with its head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its head says")
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), url_key(fields["WARC-Target-URI"]), fields["WARC-Date"]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, begin: str = "2024-01-01 00:00:00") -> DataFrame:
    """Writes a record per row and returns the manifest: path, records, bytes.

    Of rows with equal payloads of least_bytes or more, those with the largest
    page_id are responses and the others revisit them.  The largest is a grouped
    maximum, and digests that many pages share are a skewed join that adaptive
    execution splits.  The time of capture is `begin` plus page_id seconds.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit(begin)) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 32)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        body.alias("payload"),
        F.sha1(body).alias("digest"),
    )
    newest = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"))
    told = rows.join(newest, "digest", "left").select("page_id", "url", "at", "payload", "digest", F.when(F.col("page_id") < F.col("newest"), F.col("newest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, records, size, path = None, [], 0, 0, ""
        for batch in batches:
            for page, url, when, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = store.open_output_stream(path), 0, 0
                size += out.write(record(page, url, when, payload, base32(bytes.fromhex(digest)), refers))
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])

    return written(told.mapInArrow(run, "path string, records long, bytes long"), f"{folder}/manifest")


def capture_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Index entries of every listed archive; those of an archive are a run in capture order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as stream:
                    found = sorted(map(parsed, members(stream)), key=capture)
                for k in range(0, len(found), 10_000):
                    columns = list(zip(*found[k : k + 10_000]))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

    files = manifest.count()
    return written(manifest.select("path").repartition(max(1, files), "path").mapInArrow(run, INDEX), f"{folder}/runs")


def capture(entry: tuple) -> tuple:
    """The order of captures: URL key, time, page_id."""
    return entry[5], entry[6], -1 if entry[0] is None else entry[0]


class LoserTree:
    """Merges sorted lists.  Each inner node holds the run that lost there; the winner over all is on top."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * self.k
        self.top = self.play(1) if self.k > 1 else 0

    def play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self.play(2 * node), self.play(2 * node + 1)
        winner, self.losers[node] = (left, right) if self.before(left, right) else (right, left)
        return winner

    def before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) <= (self.runs[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place) of every item, in order."""
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            winner = self.top
            yield winner, self.at[winner]
            self.at[winner] += 1
            node = (winner + self.k) // 2
            while node:
                if self.before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.top = winner


def merged(runs: DataFrame, entries: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All entries in global capture order: partitions are ranges of it, and each is merged from the pieces of runs that it got.

    There are as many ranges as it takes for one to have about range_rows of the
    entries, so what a task holds does not grow with the index; page_id and digest split a
    URL key of any number of captures.  A piece ends where the order falls, however the pieces arrive.
    """
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        keys = [capture(r) for r in rows]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
        order = np.array([cuts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])], np.int64)
        for k in range(0, len(order), 10_000):
            columns = list(zip(*(rows[i] for i in order[k : k + 10_000].tolist())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    ranges = max(1, -(-entries // range_rows))
    return runs.repartitionByRange(ranges, "url_key", "capture_time", "page_id", "payload_digest").mapInArrow(run, INDEX)


def archive_index(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC archives, reads them back, and returns their merged index.

    pages: page_id, url, html; other columns are not read.  Null html is an empty
    payload, a null url an empty one.  Equal payloads with the same page_id are
    all responses.  A row whose page_id is null is a response that nothing
    refers to, unless an equal payload has an id.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    manifest = write_archives(pages, folder)
    entries = manifest.agg(F.sum("records")).first()[0] or 0
    return merged(capture_runs(manifest, folder), entries)


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_index(table(spark, sf_dir, "pages"))


QUERIES = {"op1_warc_index_merge": op1_warc_index_merge}
ORACLES = {
    "op1_warc_index_merge": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)', ['auth', 'rest']) AS u FROM pages),
parts AS (
  SELECT *, string_split(lower(regexp_replace(u.auth, '^.*@', '')), ':') AS host, max(page_id) OVER (PARTITION BY h) AS newest,
    list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS bits
  FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(bits, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(host[1], '^www\.', ''), '.')), ',') || CASE WHEN coalesce(host[2], '') <> '' THEN ':' || host[2] ELSE '' END || ')' || CASE WHEN u.rest = '' THEN '/' ELSE lower(u.rest) END AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
FROM parts
"""
}
