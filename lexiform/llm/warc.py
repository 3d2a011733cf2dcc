"""WARC archives with a two-level capture index.

Each page becomes a WARC/1.1 record, a gzip member of its own, in archives of bounded size that the tasks write to a
shared folder. Of records with equal payloads of MIN_BYTES or more, the one with the smallest page_id is a response
and the others are revisits without a payload.

The index is sorted by reversed-host keys (SURT: ``com,example,www)/path``). Its lines are packed into compressed
blocks of BLOCK_LINES lines in files of a key range each; a sparse directory has the first and last key, place and
length of every block. A lookup bisects the key ranges of the files, then the directory of a file, reads one range of
the file, bisects the block's keys, and then reads the record's range of its archive. lookup() does that for one URL;
read_back() for many, as a table: each distinct key goes to the files that may hold it, each file's task bisects its own
part of the directory, and the places it finds are dealt by stretches of the archives. What the driver and every task
get is one row for each index file.

Defined cases: a null html is an empty payload; a null url has the key ``-``; payloads under MIN_BYTES are all
responses; rows that agree in page_id and payload are captures of their own, each a response if its page_id is the
smallest; a null page_id is never referred to while the payload has another, and its row is kept; an empty table gives
an empty archive; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import maybe_broadcast, new_path, table, written

MIN_BYTES = 100
#: An archive is closed when it has this many bytes; so many of one are read by one task.
ARCHIVE_BYTES = 64 << 20
STRETCH_BYTES = 8 << 20
BLOCK_LINES = 3000
#: Lines of an index file, about.
FILE_LINES = 30_000
DATE = "2024-01-01T00:00:00Z"


_CAPTURE = {"surt": pa.string(), "page_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_DIRECTORY = {"first_key": pa.string(), "last_key": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "lines": pa.int64()}
_RECORD = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "stored_crc32": pa.int64()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds.items())


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, default port and fragment dropped, scheme ignored."""
    if not url:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return f"-){url}"
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    path = re.sub(r"/{2,}", "/", p.path) or "/"
    return f"{key}){path}" + (f"?{p.query}" if p.query else "")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host under which Spark knows it, the same for every executor."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    name = f"<urn:lexiform:page:{'null' if page_id is None else page_id}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '-')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:lexiform:page:{refers_to}>"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a broken record")
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages to archives below path; the captures (surt, page_id, file, offset, length)."""
    path = qualified(pages.sparkSession, path)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.where(F.octet_length("payload") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "warc-firsts")
    rows = rows.join(maybe_broadcast(firsts, firsts.count()), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, number, size = None, "", 0, 0
        try:
            for b in batches:
                rows: list[tuple] = []
                for page_id, url, body, digest, first in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")], strict=True):
                    revisit = first is not None and first != page_id
                    raw = record(page_id, url, body, digest, first, revisit)
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        # Every attempt has files of its own: what a lost or repeated task left is in no index.
                        name, size, number = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(raw)
                    rows.append((surt(url), page_id, name, size, len(raw)))
                    size += len(raw)
                yield _batch(rows, _CAPTURE)
        finally:
            if out is not None:
                out.close()

    return rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, _ddl(_CAPTURE))


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Write the captures, sorted, to compressed blocks below path; the directory (first_key, last_key, file, offset, length, lines).

    Keys are dealt by range, so a key that very many captures share may fill several files.
    """
    path, files = qualified(captures.sparkSession, path), max(1, -(-captures.count() // FILE_LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"cdx-{task.partitionId():05d}-{task.taskAttemptId()}.gz"
        out, at, waiting = None, 0, []
        done: list[tuple] = []

        def flush() -> None:
            nonlocal out, at
            lines = waiting[:BLOCK_LINES]
            del waiting[:BLOCK_LINES]
            raw = gzip.compress(("\n".join(lines) + "\n").encode(), compresslevel=6, mtime=0)
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(raw)
            done.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], name, at, len(raw), len(lines)))
            at += len(raw)

        for b in batches:
            waiting += ["\t".join(str(x) for x in row) for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            while len(waiting) >= BLOCK_LINES:
                flush()
        if waiting:
            flush()
        if out is not None:
            out.close()
        yield _batch(done, _DIRECTORY)

    clean = captures.withColumn("surt", F.translate("surt", "\t\r\n", "   "))
    return clean.repartitionByRange(files, "surt", "page_id").sortWithinPartitions("surt", "page_id").mapInArrow(run, _ddl(_DIRECTORY))


def read_range(path: str, file: str, offset: int, length: int) -> bytes:
    fs, base = _fs(path)
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        return f.read(length)


def block(raw: bytes) -> list[str]:
    """The lines of a block."""
    return gzip.decompress(raw).decode().split("\n")[:-1]


def in_block(lines: list[str], key: str) -> list[tuple[str, int, int]]:
    """The places (archive, offset, length) of a key in a block, found by bisection."""

    def surt_of(line: str) -> str:
        return line.split("\t", 1)[0]

    found = lines[bisect.bisect_left(lines, key, key=surt_of) : bisect.bisect_right(lines, key, key=surt_of)]
    return [(name, int(at), int(size)) for _, _, name, at, size in (x.split("\t") for x in found)]


def spans_with(firsts: list[str], lasts: list[str], key: str) -> range:
    """The places of the spans of keys, in order, that may hold a key."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def lookup(directory: list[tuple[str, str, str, int, int]], index_path: str, archive_path: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All captures of a URL: bisect the sparse directory, then blocks, then read the records' ranges.

    directory: (first_key, last_key, file, offset, length) of all blocks, in key order.
    """
    key, found = index_key(url), []
    for i in spans_with([d[0] for d in directory], [d[1] for d in directory], key):
        _, _, file, offset, length = directory[i]
        found += [parse(read_range(archive_path, *place)) for place in in_block(block(read_range(index_path, file, offset, length)), key)]
    return found


def index_key(url: str | None) -> str:
    """The key as it stands in the index's lines."""
    return re.sub(r"[\t\r\n]", " ", surt(url))


def keys(urls: DataFrame) -> DataFrame:
    """(key) of all distinct URLs (url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index_key(u) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

    return urls.select("url").distinct().mapInArrow(run, "key string").distinct()


def places(asked: DataFrame, directory: DataFrame, index_path: str) -> DataFrame:
    """(name, at, size) of all captures of the asked keys (key): two bisections and one range of an index file for each block."""
    # One row for each index file, of FILE_LINES captures about.
    files = [tuple(r) for r in directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last").select("first", "last", "file").collect()]
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]
    index_path = qualified(asked.sparkSession, index_path)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, files[i][2]) for k in b.column("key").to_pylist() for i in spans_with(firsts, lasts, k)]
            yield _batch(found, {"key": pa.string(), "file": pa.string()})

    def search(keys_: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, found = blocks.sort_values("offset"), []
        starts, ends, where = blocks["first_key"].tolist(), blocks["last_key"].tolist(), list(zip(blocks["file"], blocks["offset"], blocks["length"], strict=True))
        asked_of: dict[int, list[str]] = {}
        for k in sorted(keys_["key"].tolist()):
            for i in spans_with(starts, ends, k):
                asked_of.setdefault(i, []).append(k)
        for i, ks in asked_of.items():
            lines = block(read_range(index_path, where[i][0], int(where[i][1]), int(where[i][2])))
            found += [place for k in ks for place in in_block(lines, k)]
        return pd.DataFrame(found, columns=["name", "at", "size"])

    routed = asked.mapInArrow(route, "key string, file string")
    return routed.groupBy("file").cogroup(directory.groupBy("file")).applyInPandas(search, "name string, at long, size long")


def read_back(urls: DataFrame, directory: DataFrame, index_path: str, archive_path: str, size: int) -> DataFrame:
    """Every record of these URLs (url), found through the index and read from its archive.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, stored_crc32). Places are dealt by stretches of the
    archives, size bytes in all, and read in order. Revisits come with an empty payload.
    """
    archive_path = qualified(urls.sparkSession, archive_path)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(archive_path)
        name, f = None, None
        for b in batches:
            rows = []
            for n, at, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if n != name:
                    name, f = n, fs.open_input_file(f"{base}/{n}")
                f.seek(at)
                headers, payload = parse(f.read(size))
                revisit = headers["WARC-Type"] == "revisit"
                page_id, refers = (headers.get(k, "").rpartition(":")[2].rstrip(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
                digest = headers["WARC-Payload-Digest"].partition(":")[2]
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"page {page_id}: the payload doesn't match its digest")
                rows.append((None if page_id == "null" else int(page_id), len(payload) if not revisit else int(headers["X-Payload-Bytes"]), digest, headers["WARC-Type"], int(refers) if revisit else None, zlib.crc32(payload)))
            yield _batch(rows, _RECORD)

    dealt = places(keys(urls), directory, index_path).withColumn("stretch", F.floor(F.col("at") / STRETCH_BYTES))
    dealt = dealt.repartition(max(1, -(-size // STRETCH_BYTES)), "name", "stretch").sortWithinPartitions("name", "at")
    return dealt.select("name", "at", "size").mapInArrow(records, _ddl(_RECORD))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, indexed, and each page's URL looked up and read back through the index."""
    archive_path, index_path = new_path(spark, "warc"), new_path(spark, "cdx")
    pages = table(spark, sf_dir, "pages")
    captures = written(write_archives(pages, archive_path), "captures")
    directory = written(write_index(captures, index_path), "cdx-directory")
    size = captures.agg(F.sum("length")).first()[0] or 0
    return read_back(pages, directory, index_path, archive_path, size).drop("stored_crc32")


#: The same rows without archives.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, strlen(body) AS n, CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
