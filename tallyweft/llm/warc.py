"""WARC archives with a two-level capture index.

Writing: every task writes its records, each a gzip member of its own, to
archive files in the shared folder, and returns one index line per record:
the URL as a reversed-host key, and where the record lies.  The lines are
sorted by range of key; each range becomes an index shard of compressed
blocks of lines, with a sparse directory of the blocks' first keys.

Reading: captures to look up are dealt by the same kind of ranges; a task
binary-searches the list of shards, the shard's directory and the block's
lines, in this order, and reads the record by its byte range.  Captures that
fall into one block one after another read the block once.

Files are reached through ``pyarrow.fs`` by URI, so the shared folder may lie
in any store it knows.  A file is written under a name of its task attempt and
then renamed, so a task that runs again leaves no half-written file behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut, scratch_path

#: Lines of an index block, bytes after which a task begins another archive file, and bytes of archives that a look-up task reads.
LINES, ARCHIVE, READ = 1000, 1 << 30, 1 << 26
#: The pages carry no time of capture; all records are dated alike.
DATE = "2024-01-01T00:00:00Z"
#: Sorts after any digest or URL.
LAST = "\U0010ffff"
#: Payloads of at least so many bytes are deduplicated.
LEAST = 0

INDEX = "surt string, page_id long, sha string, url string, file string, offset long, length long"
KEY = ["surt", "page_id", "sha", "url"]


def reversed_host(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, ``www.`` dropped, then port, path and query; the fragment does not count."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return f"){url}"
    port = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + f"{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page's id; of all ones for a null id."""
    n = (1 << 64) - 1 if page_id is None else page_id & (1 << 64) - 1
    raw = f"{n:016x}"
    return f"urn:uuid:{raw[:8]}-{raw[8:12]}-8000-8000-{raw[12:]}00000000"


def page_of(urn: str) -> int | None:
    raw = urn.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    n = int(raw[:12] + raw[20:24], 16)
    return None if n == (1 << 64) - 1 else n - (1 << 64) * (n >> 63)


def record(page_id: int | None, url: str, payload: bytes, sha: str, first: int | None, is_first: bool) -> bytes:
    """One WARC/1.1 record: the response, or a revisit that refers to the first capture of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_first else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_first else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha}"]
    if not is_first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(first)}>", f"WARC-Refers-To-Date: {DATE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP header block and payload of a record; lengths and digest are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and f"sha1:{digest(payload)}" != fields["warc-payload-digest"]:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return fields, http, payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only once it is complete."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext

        self.fs, self.folder = _store(folder)
        self.uri, self.name = f"{folder}/{name}", name
        self.own = f"{self.folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.fs.create_dir(self.folder, recursive=True)
        self.to, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        self.to.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.to.close()
        self.fs.move(self.own, f"{self.folder}/{self.name}")


def _clean(url: str | None) -> str:
    return "".join(c for c in (url or "") if c not in "\r\n")


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            lines = []
            for row in batch.to_pylist():
                if out is None or out.at >= ARCHIVE:
                    if out:
                        out.close()
                    out, n = _Out(folder, f"pages-{part:06d}-{n:04d}.warc.gz"), n + 1
                payload, url = (row["html"] or "").encode(), _clean(row["url"])
                sha = digest(payload)
                at, size = out.write(gzip.compress(record(row["page_id"], url, payload, sha, row["first"], row["is_first"]), 6, mtime=0))
                lines.append((reversed_host(url), row["page_id"], sha, url, out.uri, at, size))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (1, 5, 6) else pa.string()) for i, c in enumerate(zip(*lines, strict=True))], names=[f.split()[0] for f in INDEX.split(", ")])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html); returns the index lines, written as a table.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the
    response (a null id only where there is no other), all rows with another
    id revisit it; rows that repeat the smallest id all are responses.
    Smaller payloads are always responses.  Payloads meet their first capture
    by digest: only digests and ids are aggregated, before the shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.select("*", F.sha1(body).alias("sha"), (F.octet_length(body) >= least).alias("counts"))
    firsts = cut(rows.where("counts").groupBy(F.col("sha").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    joined = rows.join(firsts, F.col("counts") & (F.col("sha") == F.col("of")), "left")
    known = joined.select("page_id", "url", "html", "first", (F.col("of").isNull() | F.col("page_id").eqNullSafe(F.col("first"))).alias("is_first"))
    # in a fixed order, so that a task that runs again writes the same bytes
    known = known.sortWithinPartitions("page_id", "url", "html")
    return cut(known.mapInArrow(_archiver(folder), INDEX), "captures")


# --- index ------------------------------------------------------------------------------------


def _key(surt: str, page_id: int | None, sha: str, url: str) -> tuple[str, int, str, str]:
    return surt, -(1 << 63) - 1 if page_id is None else page_id, sha, url


def _indexer(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, held, directory = TaskContext.get().partitionId(), None, [], []

        def flush():
            at, size = out.write(zlib.compress("\n".join(map(json.dumps, held)).encode(), 6))
            directory.append([*held[0][:4], at, size])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = _Out(folder, f"index-{part:06d}.cdx")
                held.append([row[c] for c in (*KEY, "file", "offset", "length")])
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            sparse = _Out(folder, f"index-{part:06d}.dir")
            sparse.write(json.dumps(directory).encode())
            sparse.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 1 else pa.string()) for k, v in enumerate((*directory[0][:4], out.uri, sparse.uri))], names=[*KEY, "blocks", "directory"])

    return run


@dataclass
class CaptureIndex:
    """The shards, by first key: (surt, page_id, sha, url, blocks file, directory file); as many as the tasks that wrote them."""

    shards: list[tuple]


def build_index(captures: DataFrame, folder: str, *, lines: int = LINES) -> CaptureIndex:
    order = [F.col(c).asc_nulls_first() for c in KEY]
    dealt = captures.repartitionByRange(*order).sortWithinPartitions(*order, "file", "offset")
    shards = dealt.mapInArrow(_indexer(folder, lines), "surt string, page_id long, sha string, url string, blocks string, directory string").collect()
    return CaptureIndex(sorted((tuple(s) for s in shards), key=lambda s: _key(*s[:4])))


class _Reader:
    """Looks captures up; keeps the last shard's directory, the last block and the last files open."""

    def __init__(self, shards: list[tuple]):
        self.shards, self.firsts = shards, [_key(*s[:4]) for s in shards]
        self.shard = self.block = None
        self.files: dict[str, object] = {}

    def read(self, uri: str, at: int, size: int) -> bytes:
        if uri not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            fs, path = _store(uri)
            self.files[uri] = fs.open_input_file(path)
        f = self.files[uri]
        f.seek(at)
        return f.read(size)

    def find(self, surt: str, page_id: int | None, sha: str | None = None, url: str | None = None) -> list | None:
        """The index line of a capture: by binary search of shards, directory and block; without digest or URL, the last in order of those."""
        key = _key(surt, page_id, LAST if sha is None else sha, LAST if url is None or sha is None else url)
        s = bisect_right(self.firsts, key) - 1
        if s < 0:
            return None
        if self.shard != s:
            fs, path = _store(self.shards[s][5])
            with fs.open_input_stream(path) as f:
                self.directory = json.loads(f.read())
            self.starts = [_key(*b[:4]) for b in self.directory]
            self.shard, self.block = s, None
        b = bisect_right(self.starts, key) - 1
        if self.block != b:
            at, size = self.directory[b][4:]
            self.lines = [json.loads(x) for x in zlib.decompress(self.read(self.shards[s][4], at, size)).split(b"\n")]
            self.keys = [_key(*x[:4]) for x in self.lines]
            self.block = b
        i = bisect_right(self.keys, key) - 1
        wanted = 2 if sha is None else 3 if url is None else 4
        return self.lines[i] if i >= 0 and self.keys[i][:wanted] == key[:wanted] else None


FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _finder(shards: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shards)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                line = reader.find(row["surt"], row["page_id"], row["sha"], row["url"])
                if line is None:
                    continue
                fields, http, payload = parse(gzip.decompress(reader.read(*line[4:])))
                kind = fields["warc-type"]
                size = len(payload) if kind == "response" else int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                first = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, fields["warc-payload-digest"].removeprefix("sha1:"), kind, first))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def look_up(index: CaptureIndex, wanted: DataFrame, *, size: int = 0) -> DataFrame:
    """The captures of (page_id, url) rows, or rows of the index's KEY, read back from the archives; rows without a capture give none.

    An id and URL alone do not tell captures of different payloads apart: they
    read the last of them by digest.

    ``size`` is the number of bytes the rows read: a task reads ``READ`` of them,
    less where the cluster has more cores.  The rows themselves are too narrow
    for adaptive execution to tell.
    """
    if "surt" not in wanted.columns:

        @F.pandas_udf("string")
        def surt(urls: pd.Series) -> pd.Series:
            return urls.map(lambda u: reversed_host(_clean(u)))

        wanted = wanted.select("page_id", surt("url").alias("surt"))
    own = lambda c: F.col(c) if c in wanted.columns and "sha" in wanted.columns else F.lit(None).cast("string").alias(c)
    keyed = wanted.select("surt", F.col("page_id").cast("long").alias("page_id"), own("sha"), own("url"))
    order = [F.col(c).asc_nulls_first() for c in KEY]
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-size // READ))
    return keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_finder(index.shards), FOUND)


def archive_and_read(pages: DataFrame, *, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Archive all pages, index the captures, and read every page back through the index.

    Columns of FOUND, one row per page.  A null html is an empty payload, a
    null url an empty one, rows that repeat an id, a URL or both each read their
    own payload; texts of any length are one record, which a task holds whole;
    an empty table gives an empty result, other columns are
    not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    captures = write_archives(pages, folder, least=least)
    size = captures.agg(F.sum("length")).first()[0] or 0
    return look_up(build_index(captures, folder), captures.select(*KEY), size=size)


#: The same captures in SQL: digests, and the smallest page of each payload.
CAPTURES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, s, min(page_id) OVER (PARTITION BY s) AS first,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::BIGINT) >> ((3 - i % 4) * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
