"""WARC archives with a two-level capture index.

Writing: one record per page, written by Spark's text writer - a row is the record's header
and payload, the line separator is the blank line that ends a record - so any store Spark can
write is fine and a lost task is written anew. Equal payloads (SHA-1 and length) of at least
``min_revisit_bytes`` are stored once: the record with the smallest page_id is the response,
the others are revisits that name it.

Index: the archives are read once, record after record, for the place (file, offset, length)
of every capture. Captures are sorted by reversed-host URL key and page_id over range
partitions and cut into compressed blocks of ``BLOCK_ROWS`` lines; the sparse directory holds
the first key of every block, without the lines.

Look-up: a key goes to the range partition that may hold it (binary search over the first key
of every partition), there to a block (binary search in the partition's directory), and in
the block to its line (binary search again); only blocks that are hit are unpacked. The
places found are gathered per archive file, about ``FILE_BYTES`` each, and read from it as
byte ranges.

Edge cases: null html is an empty payload; a null url has the key ""; a null page_id is kept
as such and never the response while a non-null one exists; rows that share a page_id and
payload share its record type; line breaks in a url are percent-encoded; an empty table gives
no records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.llm.common import stored
from kpiforge.session import scratch_path

#: The profile of the format's standard, and the capture date unless one is given.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_DATE = "2020-01-01T00:00:00Z"
FILE_BYTES, BLOCK_ROWS, RANGE_ROWS = 8_000_000, 500, 20_000
END = b"\r\n\r\n"
HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reversed_host_key(url: str | None) -> str:
    """``http://www.a.example.com:80/P?q=1#f`` -> ``com,example,a)/p?q=1``."""
    if not url:
        return ""
    u = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url.strip()).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", u, re.S).groups()
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":(80|443)?$", "", host)
    host = re.sub(r"^www\d*\.", "", host)
    path, _, query = (slash + path).lower().partition("?")
    if query:
        query = "?" + "&".join(sorted(query.split("&")))
    return ",".join(reversed(host.split("."))) + ")" + ((path.rstrip("/") or "/") + query)


def records(pages: DataFrame, min_revisit_bytes: int, date: str = CAPTURE_DATE) -> DataFrame:
    """``pages(page_id, url, html)`` -> one row per ``record`` (text). ``date`` is every record's capture
    date; it is an argument, so a record written again after a lost task is the same."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                     F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keys = pages.select(pages["page_id"].cast("long").alias("page_id"),
                        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html")).select(
        "page_id", F.octet_length("html").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("sha1"))
    # first copies of payloads stored several times: the only keys that need a join
    first = (keys.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    first = stored(first, "warc-first")  # Spark then knows its size when it plans the join
    p = p.join(first, ["sha1", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    maybe = lambda name, col: F.when(col.isNotNull(), line(name, col.cast("string"))).otherwise("")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    digest = _base32(F.col("sha1"))
    body = F.when(revisit, "").otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\n")))
        .otherwise("WARC-Record-ID: <urn:page:>\r\n"),
        line("WARC-Date", F.lit(date)), maybe("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"),
                                 F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"))
    return p.select(F.concat(head, body).alias("record"))


@F.pandas_udf(T.StringType())
def _base32(sha1_hex: pd.Series) -> pd.Series:
    return pd.Series([base64.b32encode(bytes.fromhex(x)).decode() for x in sha1_hex], dtype=object)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> int:
    """Archives of about ``file_bytes`` each under ``path``; returns the number of records.
    Tasks write the pages they read; a file ends after the number of records that has that
    size on average, so very long pages make larger files."""
    total, rows = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    per_file = max(1, int(file_bytes * rows / max(1, (total or 0) + 500 * rows)))
    (records(pages, min_revisit_bytes).write.option("maxRecordsPerFile", per_file)
     .option("lineSep", END.decode()).option("encoding", "UTF-8").text(path))
    return rows


def read_archives(spark, path: str) -> DataFrame:
    """(path, content) of the archive files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def parse_header(data, at: int) -> tuple[dict[str, str], int]:
    """Header fields of the record at ``at`` and where its payload starts."""
    stop = data.find(END, at)
    if stop < 0 or data[at:at + 5] != b"WARC/":
        raise ValueError("not a WARC record")
    return {k.decode(): v.decode() for k, v in HEADER.findall(data[at:stop])}, stop + len(END)


def page_number(field: str | None) -> int | None:
    m = re.search(r"<urn:page:(-?\d+)>", field or "")
    return int(m.group(1)) if m else None


def captures(archives: DataFrame) -> DataFrame:
    """(key, page_id, path, offset, length) of every record; lengths tell where the next is."""

    def work(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                path, data = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                at, rows = 0, []
                while at < len(data):
                    head, body = parse_header(data, at)
                    stop = body + int(head["Content-Length"]) + len(END)
                    rows.append((reversed_host_key(head.get("WARC-Target-URI")), page_number(head["WARC-Record-ID"]), path, at, stop - at))
                    at = stop
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["key", "page_id", "path", "offset", "length"])

    return archives.mapInArrow(work, "key string, page_id long, path string, offset long, length long")


def sort_key(key: str, page_id: int | None) -> str:
    """One text that sorts like (key, page_id), null ids first."""
    return key + "\x00" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def write_index(caps: DataFrame, rows: int, path: str, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> None:
    """Sorted compressed blocks: (part, block, first_key, n, lines)."""
    caps = caps.withColumn("sort", _sort_keys(F.col("key"), F.col("page_id")))
    ranges = max(1, math.ceil(rows / range_rows))

    def work(batches):
        from pyspark import TaskContext

        part, block, rows = TaskContext.get().partitionId(), 0, []

        def pack():
            lines = "\n".join("\t".join(map(str, r)) for r in rows).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([rows[0][0]]), pa.array([len(rows)], pa.int32()),
                 pa.array([zlib.compress(lines, 6)], pa.binary())], names=["part", "block", "first_key", "n", "lines"])

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("sort", "path", "offset", "length")]):
                rows.append(r)
                if len(rows) == block_rows:
                    yield pack()
                    block, rows = block + 1, []
        if rows:
            yield pack()

    (caps.select("sort", "path", "offset", "length").repartitionByRange(ranges, "sort").sortWithinPartitions("sort")
     .mapInArrow(work, "part int, block int, first_key string, n int, lines binary").write.parquet(path))


@F.pandas_udf(T.StringType())
def _sort_keys(keys: pd.Series, ids: pd.Series) -> pd.Series:
    # tabs and line breaks can't stand in a line of a block
    clean = [re.sub(r"[\t\n]", " ", k) for k in keys]
    return pd.Series([sort_key(k, None if pd.isna(i) else int(i)) for k, i in zip(clean, ids)], dtype=object)


@F.pandas_udf(T.StringType())
def _url_keys(urls: pd.Series) -> pd.Series:
    return pd.Series([reversed_host_key(None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")) for u in urls], dtype=object)


def look_up(wanted: DataFrame, index_path: str) -> DataFrame:
    """``wanted(url, page_id)`` -> places (path, offset, length), one per wanted row and
    matching capture line; a wanted row that names no capture gives none."""
    spark = wanted.sparkSession
    index = spark.read.parquet(index_path)
    tops = sorted((r["first"], r["part"]) for r in index.groupBy("part").agg(F.min("first_key").alias("first")).collect())
    firsts, parts = [t[0] for t in tops], [t[1] for t in tops]  # one per range partition

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series([parts[max(0, bisect.bisect_right(firsts, k) - 1)] for k in keys], dtype="int32")

    asked = wanted.select(_sort_keys(_url_keys(F.col("url")), F.col("page_id")).alias("sort")).distinct()
    if not tops:
        return spark.createDataFrame([], "path string, offset long, length long")
    asked = asked.select(part_of("sort").alias("part"), "sort")

    def find(key, blocks: pd.DataFrame, asked_rows: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        directory, packed = blocks["first_key"].tolist(), blocks["lines"].tolist()
        opened: dict[int, tuple[list, list]] = {}
        out = []
        for k in sorted(asked_rows["sort"]):
            b = max(0, bisect.bisect_left(directory, k) - 1)  # equal keys may span blocks
            while b < len(directory) and directory[b] <= k:
                if b not in opened:
                    lines = [x.split("\t") for x in zlib.decompress(packed[b]).decode().split("\n")]
                    opened[b] = ([x[0] for x in lines], lines)
                keys, lines = opened[b]
                i = bisect.bisect_left(keys, k)
                while i < len(keys) and keys[i] == k:
                    out.append((lines[i][1], int(lines[i][2]), int(lines[i][3])))
                    i += 1
                b += 1
        return pd.DataFrame(out, columns=["path", "offset", "length"]).astype({"offset": "int64", "length": "int64"})

    return index.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(find, "path string, offset long, length long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_rows(records: list[bytes]) -> pa.RecordBatch:
    """Fields of whole records; a response's payload is checked against its digest."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    rows = []
    for record in records:
        head, body = parse_header(record, 0)
        payload = record[body:body + int(head["Content-Length"])]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        again = head["WARC-Type"] == "revisit"
        if not again and base32_sha1(payload) != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
        rows.append((page_number(head["WARC-Record-ID"]), None if again else len(payload), digest,
                     head["WARC-Type"], page_number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI")))
    cols = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in RECORD.split(", ")])


def open_store(uri: str):
    """(file system, path) of a file in a store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def arrow_opens(uri: str) -> bool:
    try:
        system, path = open_store(uri)
        return system.get_file_info(path).type.name != "NotFound"
    except (ValueError, OSError, NotImplementedError):
        return False


def read_ranges(archives: DataFrame, places: DataFrame, base: str) -> DataFrame:
    """Reads the places' byte ranges, file by file, and parses the records ->
    page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Where Arrow can open the store of ``base``, tasks seek in the files; elsewhere the places
    are joined to the contents Spark has read."""
    per_file = places.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("cuts"))

    def seek(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                system, path = open_store(batch.column(0)[r].as_py())
                with system.open_input_file(path) as f:
                    yield record_rows([f.read_at(c["length"], c["offset"]) for c in batch.column(1)[r].as_py()])

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                view = memoryview(batch.column(0)[r].as_buffer())
                yield record_rows([bytes(view[c["offset"]:c["offset"] + c["length"]]) for c in batch.column(1)[r].as_py()])

    if arrow_opens(base):
        files = archives.select("path").count()  # a listing; else few small rows would mean few tasks
        per_file = per_file.repartition(max(1, files), "path")
        return per_file.mapInArrow(seek, RECORD)
    return archives.join(per_file, "path").select("content", "cuts").mapInArrow(cut, RECORD)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The rows of ``op7``: archives and index written to the shared folder, every page looked
    up through the index and read back by byte range."""
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    rows = write_archives(pages, base + "/archive", min_revisit_bytes)
    archives = read_archives(spark, base + "/archive")
    write_index(captures(archives), rows, base + "/index")
    places = look_up(pages.select("url", F.col("page_id").cast("long").alias("page_id")), base + "/index")
    return with_lengths(read_ranges(archives, places, base)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def with_lengths(rows: DataFrame) -> DataFrame:
    """A revisit has no payload of its own: its length is that of the response it names."""
    rows = stored(rows, "warc-rows")
    named = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("named"), F.col("payload_digest").alias("same")).distinct()
    found = rows.where("record_type = 'response'").select("page_id", "payload_digest", F.col("payload_bytes").alias("full")).join(
        named, (F.col("page_id") == F.col("named")) & (F.col("payload_digest") == F.col("same"))).groupBy("named", "same").agg(F.max("full").alias("full"))
    found = stored(found, "warc-lengths")  # Spark then knows its size when it plans the join
    out = rows.join(found, (F.col("refers_to") == F.col("named")) & (F.col("payload_digest") == F.col("same")), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).drop("named", "same", "full")
