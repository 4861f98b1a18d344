"""WARC archives and a two-level capture index.

Archives are WARC 1.1 files in gzip, each record (header block, blank line, payload, two line breaks) a member of its
own. Executors write them to any store with Spark's text writer, whose separator is an empty gzip member, so that a
whole file is gzip too. Of records with equal payloads one is the response and the others revisit it without a payload.

The index has two levels. Capture lines, sorted by reversed-host key (``com,example)/path``), stand in blocks of
``BLOCK_LINES`` lines, each block one gzip member; a sparse directory keeps the first key, file, offset and length of
each block. A look-up bisects the directory, range-reads one block or a few, and range-reads the record.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

BREAK = b"\r\n\r\n"
#: An empty gzip member.
SEPARATOR = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
LEAST_SHARED = 1000
BLOCK_LINES = 3000
RECORDS_A_FILE, FILE_BYTES = 20_000, 1 << 30  # a file is read back as one value
SIZE_CLASSES = (1 << 16, 1 << 20, 1 << 24)
DATE = "2020-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: scheme, userinfo and default port go, the host's labels turn round."""
    rest = (url or "").strip().split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:] or "/"
    host = host.rsplit("@", 1)[-1].lower()
    name, _, port = host.partition(":")
    return ",".join(reversed(name.rstrip(".").split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path


def with_roles(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to.

    Payloads of at least ``LEAST_SHARED`` bytes with equal SHA-1 share one response, that with the largest page_id.
    Only ids and digests are grouped and joined; the largest id of a digest comes from a pre-aggregated group, and the
    join back of a digest that many pages share is one Spark can split.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = p.where((F.col("payload_bytes") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.select("page_id", "payload_digest").join(first, "payload_digest").where("page_id <> first")
    revisits = revisits.groupBy("page_id", "payload_digest").agg(F.max("first").alias("refers_to"))
    return p.join(revisits, ["page_id", "payload_digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row, pages of each class of size in files of their own, so that a large page does not make the files of
    all others short. Control characters in a URL are dropped from its header; a null URL has none."""
    r = with_roles(pages)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f\x7f]", "")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(BREAK.decode()),
    )
    record = F.concat(F.encode(head, "UTF-8"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(BREAK))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                yield pd.DataFrame({"value": [gzip.compress(x, 4, mtime=0) for x in b["value"].iloc[at : at + 500]]})

    of = lambda size: sum((F.when(F.coalesce(size, F.lit(0)) > at, 1).otherwise(0) for at in SIZE_CLASSES), F.lit(0))
    classes = pages.groupBy(of(F.octet_length("html")).alias("size_class")).agg(F.max(F.octet_length("html")).alias("largest")).collect()  # four rows at most
    for own in sorted(classes) or [(0, 0)]:
        largest = max(own[1] or 0, SIZE_CLASSES[0] // 4)
        packed = r.where(of(F.col("payload_bytes")) == own[0]).select(record.alias("value")).mapInPandas(members, "value binary").select(F.col("value").cast("string").alias("value"))
        writer = packed.write.mode("append").option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1")
        writer.option("maxRecordsPerFile", max(1, min(RECORDS_A_FILE, FILE_BYTES // (largest + 2048)))).text(path)
        del packed, writer
    del r
    common.release(pages.sparkSession)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an archive; a damaged one raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + len(SEPARATOR)] == SEPARATOR:
            at += len(SEPARATOR)
            continue
        member, parts, to = zlib.decompressobj(31), [], at
        try:
            while not member.eof and to < len(data):  # a little at a time: what follows a member is not copied
                parts.append(member.decompress(data[to : to + 16384]))
                to += 16384
        except zlib.error as e:
            raise ValueError(f"damaged member at byte {at}") from e
        record = b"".join(parts)
        stop = record.find(BREAK)
        lines = record[:stop].decode("utf-8", "replace").split("\r\n") if stop >= 0 else [""]
        if not member.eof or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin, size = stop + 4, int(head["Content-Length"])
        if record[begin + size :] != BREAK:
            raise ValueError(f"damaged record at byte {at}")
        length = min(to, len(data)) - at - len(member.unused_data)
        yield at, length, head, record[begin : begin + size]
        at += length


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


CAPTURE = "surt string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, part string, offset long, length long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture per record. Digests of responses are computed from the archive's own bytes and must match the header's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for at, size, head, payload in records(content):
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                        raise ValueError(f"{name}: payload at byte {at} does not match its digest")
                    url = head.get("WARC-Target-URI")
                    rows.append((surt(url), _page(head.get("WARC-Record-ID")), url, head["WARC-Type"], _page(head.get("WARC-Refers-To")), n, digest, name.rsplit("/", 1)[-1], at, size))
                if rows:
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")], dtype=object)
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, CAPTURE)


def write_index(captures: DataFrame, path: str) -> None:
    """Blocks of sorted capture lines, each a gzip member, and the sparse directory beside them."""
    spark = captures.sparkSession
    fields = [c.split()[0] for c in CAPTURE.split(", ")]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, offset = TaskContext.get().partitionId(), [], 0

        def block():
            nonlocal held, offset
            data = gzip.compress("".join(held).encode(), 6, mtime=0)
            out = pd.DataFrame({"first_key": [held[0].split(" ", 1)[0]], "task": [task], "offset": [offset], "length": [len(data)], "lines": [len(held)], "data": [data]})
            offset, held = offset + len(data) + 1, []
            return out

        for b in batches:
            for row in b.astype(object).where(b.notna(), None).itertuples(index=False):
                values = dict(zip(fields, row, strict=True))
                held.append(f"{values.pop('surt').replace(' ', '%20')} {DATE} {json.dumps(values)}\n")
                if len(held) == BLOCK_LINES:
                    yield block()
        if held:
            yield block()

    ordered = captures.select(*fields).repartitionByRange(common.partitions(spark), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    made = ordered.mapInPandas(blocks, "first_key string, task int, offset long, length long, lines long, data binary")
    made, kept = common.stored(made, "blocks")
    numbered = made.repartitionByRange(common.partitions(spark), "task").sortWithinPartitions("task", "offset")
    numbered.select("task", F.col("data").cast("string").alias("value")).write.partitionBy("task").option("lineSep", "\n").text(f"{path}/blocks")
    made.drop("data").write.parquet(f"{path}/directory")
    common.remove(spark, kept)


def index_lines(data: bytes) -> Iterator[dict]:
    """The captures of one block."""
    for line in gzip.decompress(data).decode().split("\n")[:-1]:
        key, _, rest = line.split(" ", 2)
        yield {"surt": key} | json.loads(rest)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures, from the blocks as the directory gives their places."""
    places = spark.read.parquet(f"{path}/directory").groupBy("task").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/blocks")
    files = files.select(F.regexp_extract("path", r"/task=(\d+)/", 1).cast("int").alias("task"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, where in zip(b["content"], b["places"], strict=True):
                for place in where:
                    rows = list(index_lines(content[place["offset"] : place["offset"] + place["length"]]))
                    yield pd.DataFrame(rows, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.join(places, "task").select("content", "places").mapInPandas(run, CAPTURE)


class CaptureIndex:
    """Point look-ups. The directory (one short row per block of ``BLOCK_LINES`` captures) stays in memory."""

    def __init__(self, spark: SparkSession, archives: str, index: str):
        self.spark, self.archives, self.index = spark, archives, index
        self.directory = [tuple(r) for r in spark.read.parquet(f"{index}/directory").select("first_key", "task", "offset", "length").orderBy("task", "offset").toLocalIterator()]
        self.keys = [r[0] for r in self.directory]

    def _range(self, path: str, offset: int, length: int) -> bytes:
        fs, p = common.hadoop_path(self.spark, path)
        stream = fs.open(p)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()

    def _file(self, task: int) -> str:
        fs, p = common.hadoop_path(self.spark, f"{self.index}/blocks/task={task}")
        return next(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))

    def captures(self, url: str) -> list[dict]:
        key = surt(url).replace(" ", "%20")
        at, out = max(0, bisect.bisect_left(self.keys, key) - 1), []
        while at < len(self.keys) and self.keys[at] <= key:
            _, task, offset, length = self.directory[at]
            out += [c for c in index_lines(self._range(self._file(task), offset, length)) if c["surt"] == key]
            at += 1
        return out

    def record(self, capture: dict) -> tuple[dict[str, str], bytes]:
        data = self._range(f"{self.archives}/{capture['part']}", capture["offset"], capture["length"])
        _, _, head, payload = next(records(data))
        return head, payload


def round_trip(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write archives and their index, and return every capture as read back through them, with the folder.

    Null html is an empty payload; a null URL has the key ``)/``; a null page_id gives a record without an id that is
    never shared; repeated rows give repeated records (equal ids do not revisit themselves); other columns are ignored;
    an empty table gives an empty result.
    """
    spark = pages.sparkSession
    base = common.new_path(spark, "warc")
    write_archives(pages, f"{base}/archives")
    captures, kept = common.stored(read_archives(spark, f"{base}/archives"), "captures")  # sorting reads them twice
    write_index(captures, f"{base}/index")
    common.remove(spark, kept)
    return read_index(spark, f"{base}/index"), base
