"""WARC archives with a two-level capture index.

Writing: every page becomes a WARC/1.1 record. Of pages with equal payloads of
at least ``MIN_DEDUP`` bytes the one with the largest id is stored and the
others are revisit records without the payload. Spark writes the records as
files in the shared folder, a record per line of the text writer, whose line end
is the blank lines that end a record.

Index: the archives are scanned once. Entries (reversed-host URL key, page id →
file, offset, length) are range-partitioned and sorted; every ``BLOCK_ENTRIES``
of them form a compressed block. The sparse directory holds the first key of each
block: its top level, the first key of each range, is what the driver sees.

Reading: lookups are dealt to the ranges by binary search in the top level,
found by binary search in the range's directory and then in one decompressed
block, and read as byte ranges of the archive files.

Defined results: null html is an empty payload; a null url has the empty key; a
null page id is never "largest" unless all are null, and of repeated rows with the
largest id all are stored; urls may hold any characters (line breaks are
percent-escaped in the header); equal keys are told apart by page id; an empty
table writes and returns nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.registry import query
from weft.session import cut_lineage, ensure_checkpoint_dir, spread_rows
from weft.sources.files import read_table

MIN_DEDUP = 1000
ARCHIVE_BYTES = 8 << 20     # payload per archive file; a task holds one file at a time
BLOCK_ENTRIES = 512
RANGE_ENTRIES = 1 << 18     # entries of one range of the index
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
_LEAST = -(1 << 63)         # stands for a null id in sort keys


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query."""
    if not url:
        return ""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return where + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, scratch: str) -> DataFrame:
    """(page_id, record): the WARC record of every page without its closing blank lines.

    The table of revisits is written to ``scratch`` and read again, so Spark knows its size: it is
    broadcast below the session's threshold, and joined by a shuffle of the pages beyond."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = spread_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    rows = rows.withColumn("place", F.coalesce("page_id", F.xxhash64("html")))  # rows without an id are dealt too
    # Duplicates are found on ids and digests alone; the payloads move once, to their archive.
    narrow = cut_lineage(rows.where(F.col("n") >= MIN_DEDUP).select("place", "page_id", "digest"))
    keep = (narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("times"))
            .where((F.col("times") > 1) & F.col("keeper").isNotNull()).select("digest", "keeper"))
    again = (narrow.join(keep, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
             .select("place", "digest", "keeper").distinct())
    again.write.parquet(scratch)
    again = pages.sparkSession.read.schema(again.schema).parquet(scratch)
    rows = rows.join(again, ["place", "digest"], "left")
    revisit = F.col("keeper").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _header("WARC-Target-URI", url), _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(">")))),
        _header("X-Payload-Length", F.when(revisit, F.col("n"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))), F.lit("\r\n"))
    return rows.select("page_id", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages' records as files under ``path``, about ``ARCHIVE_BYTES`` of payload each."""
    n, total, largest = (x or 0 for x in pages.agg(
        F.count("*"), F.sum(F.octet_length("html")), F.max(F.octet_length("html"))).first())
    per_file = min(n * ARCHIVE_BYTES // max(total, ARCHIVE_BYTES), (1 << 30) // max(largest, 1))  # never over 1 GB
    (records(pages, f"{path}-revisits").select("record").write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", max(1, per_file)).text(path))


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def scan_archive(content: bytes):
    """(offset, length, header) of every record of an archive file, in order."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        header = parse_header(content[at:stop])
        end = stop + 4 + int(header["Content-Length"])
        yield at, end - at, header
        at = end + len(END)


def _page(header: dict[str, str], name: str = "WARC-Record-ID") -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", header.get(name, ""))
    return int(found[1]) if found else None


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(F.col("file").startswith("part-"))


def build_index(spark: SparkSession, path: str, index: str) -> list[tuple[str, int]]:
    """Write the blocks of the index of the archives in ``path``; returns the first key of each range."""
    def entries(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(url_key(h.get("WARC-Target-URI")), _page(h), file, at, n)
                         for at, n, h in scan_archive(content.as_buffer().to_pybytes())]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(),
                                                                      pa.int64(), pa.int64()))],
                        ["key", "page_id", "file", "offset", "length"])

    rows = cut_lineage(_archives(spark, path).mapInArrow(
        entries, "key string, page_id long, file string, offset long, length long"))
    n_ranges = max(1, -(-rows.count() // RANGE_ENTRIES))

    def blocks(batches):
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= BLOCK_ENTRIES:
                yield block(held[:BLOCK_ENTRIES])
                del held[:BLOCK_ENTRIES]
        if held:
            yield block(held)

    def block(rows):
        # keys are escaped so that a line is one entry whatever a URL holds
        lines = "\n".join("\t".join([key.encode("unicode_escape").decode(), "" if page is None else str(page),
                                     file, str(at), str(n)]) for key, page, file, at, n in rows)
        key, page = rows[0][:2]
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.string()), pa.array([_LEAST if page is None else page], pa.int64()),
             pa.array([zlib.compress(lines.encode())], pa.binary())], ["first_key", "first_page", "block"])

    (rows.repartitionByRange(n_ranges, "key", "page_id").sortWithinPartitions("key", "page_id")
     .mapInArrow(blocks, "first_key string, first_page long, block binary")
     .withColumn("range", F.spark_partition_id()).write.parquet(index))
    tops = (spark.read.parquet(index).groupBy("range").agg(F.min(F.struct("first_key", "first_page")).alias("k"))
            .collect())  # one row per range of RANGE_ENTRIES records
    return sorted((r["k"]["first_key"], r["k"]["first_page"], r["range"]) for r in tops)


def _sort_key(key: str, page: int | None) -> tuple[bytes, int]:
    return key.encode(), _LEAST if page is None else page


def look_up(wanted: DataFrame, spark: SparkSession, index: str, tops: list) -> DataFrame:
    """(page_id, file, offset, length) of every record of the wanted ``(page_id, url)`` pairs."""
    firsts = [_sort_key(k, p) for k, p, _ in tops]

    def deal(batches):
        for batch in batches:
            # the range partitioner keeps equal keys in one range
            rows = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = url_key(url)
                rows.append((max(0, bisect_right(firsts, _sort_key(key, page)) - 1), 1, key, page))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64()))],
                ["range", "kind", "key", "page"])

    def search(batches):
        now, directory, blocks, opened = None, [], [], (None, None, None)
        for batch in batches:
            out = []
            for rng, kind, key, page, block in zip(*(c.to_pylist() for c in batch.columns)):
                if rng != now:
                    now, directory, blocks, opened = rng, [], [], (None, None, None)
                if kind == 0:
                    directory.append(_sort_key(key, page))
                    blocks.append(block)
                    continue
                want = _sort_key(key, page)
                b = max(0, bisect_right(directory, want) - 1)
                while b >= 0:  # equal keys may begin in an earlier block
                    if opened[0] != b:
                        opened = (b, *unpack(blocks[b]))
                    _, keys, entry = opened
                    i = bisect_right(keys, want) - 1
                    while i >= 0 and keys[i] == want:
                        out.append((page if page != _LEAST else None, *entry[i]))
                        i -= 1
                    if i >= 0 or directory[b] < want:
                        break
                    b -= 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["page_id", "file", "offset", "length"])

    def unpack(block: bytes):
        keys, entry = [], []
        for line in zlib.decompress(block).decode().split("\n"):
            key, page, file, at, n = line.split("\t")
            keys.append(_sort_key(key.encode().decode("unicode_escape"), int(page) if page else None))
            entry.append((file, int(at), int(n)))
        return keys, entry

    number = {r: i for i, (_, _, r) in enumerate(tops)}
    ranks = spark.createDataFrame([(r, i) for r, i in number.items()] or [(0, 0)], "range int, place int")
    stored = (spark.read.parquet(index).join(ranks, "range")
              .select(F.col("place").alias("range"), F.lit(0).alias("kind"), F.col("first_key").alias("key"),
                      F.col("first_page").alias("page"), "block"))
    asked = (spread_rows(wanted.select(F.col("page_id").cast("long").alias("page_id"), "url")).distinct()
             .mapInArrow(deal, "range int, kind int, key string, page long")
             .withColumn("block", F.lit(None).cast("binary")))
    return (stored.unionByName(asked).repartition("range").sortWithinPartitions("range", "kind", "key", "page")
            .mapInArrow(search, "page_id long, file string, offset long, length long"))


def read_ranges(found: DataFrame, path: str) -> DataFrame:
    """Read the byte ranges and return each record's fields, checking stored payloads against their digest.

    Tasks open the archives themselves, so ``path`` must be on a store that ``pyarrow.fs`` opens."""
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    root = re.sub(r"^file:/+", "file:///", root)

    def read(batches):
        store, base = fs.FileSystem.from_uri(root)
        name, file = None, None
        for batch in batches:
            out = []
            for archive, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{base}/{archive}")
                out.append(fields(file.read_at(n, at)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                                pa.int64(), pa.string()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    def fields(record: bytes):
        head, payload = record.split(b"\r\n\r\n", 1)
        h = parse_header(head)
        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload does not match its digest")
        n = int(h.get("X-Payload-Length", len(payload)))
        return _page(h), n, digest, kind, _page(h, "WARC-Refers-To"), h.get("WARC-Target-URI")

    # the ranges of an archive are read in order, by one task
    return (found.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"))


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


@query("op9_warc", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    root = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{root}/archives")
    tops = build_index(spark, f"{root}/archives", f"{root}/index")
    found = look_up(pages, spark, f"{root}/index", tops)
    return read_ranges(found, f"{root}/archives").drop("url")
