"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record file is a run of frames. A frame is

    uint64 length | uint32 masked crc32(length) | payload | uint32 masked crc32(payload) | one byte 0x0A

all little-endian; a mask rotates a checksum right by 15 bits and adds a constant, so that checksums of data that hold
checksums stay sound. The closing byte is the separator of Spark's text writer, through which executors reach any
store. A payload is ``uint8 has_id | int64 doc_id | uint32 n | n ids``, ids as uint16 where all fit and else uint32
(the top bit of ``has_id``). The index beside the files has (part, offset, length, doc_id, n_tokens, start).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm import common

MASK_DELTA = 0xA282EAD8
END_ID = 0
#: Texts are encoded, and their frames handed on, in chunks of about so many bytes (one text at least); a file ends after
#: so many chunks, so that it can be read back as one value.
CHUNK_BYTES, FILE_CHUNKS = 16_000_000, 16


def masked(crc: int) -> int:
    return (((crc >> 15 | crc << 17) & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing byte."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def frames(data: bytes, verify: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length with frame, payload) of each record; damaged data raise ValueError."""
    at = 0
    while at < len(data):
        size = data[at : at + 8]
        if len(size) < 8 or at + 12 > len(data) or struct.unpack_from("<I", data, at + 8)[0] != masked(zlib.crc32(size)):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", size)[0]
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or at + 17 + n > len(data) or verify and struct.unpack_from("<I", data, at + 12 + n)[0] != masked(zlib.crc32(payload)):
            raise ValueError(f"damaged record at byte {at}")
        yield at, n + 17, payload
        at += n + 17


def pack(doc_id: int | None, ids: bytes, width: str = "<u2") -> bytes:
    """A payload from ids that already are ``width`` integers."""
    wide = width == "<u4"
    return struct.pack("<BqI", (doc_id is not None) | wide << 7, doc_id or 0, len(ids) // (4 if wide else 2)) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = struct.unpack_from("<BqI", payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, "<u4" if flags & 128 else "<u2", n, 13).astype("<u4")


#: White space that is not a single space or line break between two other characters, and our own mark.
ODD_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x01]|[ \n][ \n]|^[ \n]|[ \n]$"
KNOWN_PIECES = 200_000


class PieceEncoder:
    """The library's ids of whole texts; each distinct piece of a chunk of texts is encoded once.

    The byte-level pattern starts a new pre-token at a single space between two other characters, and makes a single
    line break there one of its own, as it does with a comma or full stop between a letter and white space; texts are
    cut at these places by Arrow and their pieces numbered. The distinct pieces go through the library as lines of one text, which its ids are cut at again, and are put back by their
    numbers. Texts with any other white space or an added token go to the library whole. Of the pieces that a chunk holds
    twice, the first ``KNOWN_PIECES`` stay known.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = "<u2" if self.lib.get_vocab_size() <= 0x10000 else "<u4"
        self.odd = "|".join([ODD_SPACE, *(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())])
        self.line = self._ids(["\n"])[0]
        self.known: dict[str, bytes] = {"\n": self.line.tobytes()}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.width) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of pieces without line breaks."""
        found, starts, lengths, at = [], [], [], 0
        for k in range(0, len(pieces), 4096):
            ids = self._ids(["\n".join(pieces[k : k + 4096]) + "\n"])[0]
            stops = np.flatnonzero(ids == self.line[0])
            begin = np.concatenate(([0], stops[:-1] + 1))
            found.append(ids)
            starts.append(begin + at)
            lengths.append(stops - begin)
            at += len(ids)
        return np.concatenate(found), np.concatenate(starts), np.concatenate(lengths)

    def _cut(self, texts: pa.Array) -> list[bytes]:
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n \r"), r"(\pL)([,.])( |$)", "\\1 \x01\\2\\3")
        words = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\r"), spaced, pa.scalar("")), " ")
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del spaced, words, coded
        kept = [self.known.get(w) for w in distinct]
        new = np.array([k is None for k in kept])
        fresh = [w for w, n in zip(distinct, new.tolist(), strict=True) if n]
        ids, start, length = self._pieces([w[1:] if w[0] in "\r\x01" else " " + w for w in fresh]) if fresh else (np.empty(0, self.width), np.empty(0, np.int64), np.empty(0, np.int64))
        starts, lengths = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[new], lengths[new] = start, length
        old = [k for k in kept if k is not None]
        lengths[~new] = np.array([len(k) for k in old], np.int64) // ids.itemsize
        starts[~new] = len(ids) + np.cumsum(lengths[~new]) - lengths[~new]
        if len(self.known) < KNOWN_PIECES:
            twice = np.bincount(number, minlength=len(distinct))[new] > 1
            for w, a, n in zip([w for w, t in zip(fresh, twice.tolist(), strict=True) if t], start[twice].tolist(), length[twice].tolist(), strict=True):
                self.known[w] = ids[a : a + n].tobytes()
        ids = np.concatenate([ids, np.frombuffer(b"".join(old), self.width)])
        out, at = [], 0
        stops = np.cumsum(count)
        for first in range(0, len(texts), 256):  # a bounded number of tokens at a time
            last = min(len(texts), first + 256)
            part = number[at : stops[last - 1]]
            n, s = lengths[part], starts[part]
            ends = np.cumsum(n)
            stream = ids[np.repeat(s - ends + n, n) + np.arange(ends[-1])]
            docs = ends[stops[first:last] - at - 1]
            out += [x.tobytes() for x in np.split(stream, docs[:-1])]
            at = stops[last - 1]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (an Arrow array of strings without nulls) as ``width`` integers."""
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(pc.binary_length(texts), 0))
        rest = iter([x.tobytes() for x in self._ids(texts.filter(odd).to_pylist())])
        cut = texts.filter(pc.invert(odd))
        done = iter(self._cut(cut) if len(cut) else [])
        return [next(rest) if o else next(done) for o in odd.to_pylist()]


_ENCODERS: dict[str, PieceEncoder] = {}


def write_records(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every text (null: empty), append ``END_ID`` and write frames in ascending doc_id order (nulls first, ties by text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        name = public_tokenizers.path(tokenizer)
        encoder = _ENCODERS.get(name) or _ENCODERS.setdefault(name, PieceEncoder(name))
        end = np.array([END_ID], dtype=encoder.width).tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), pc.fill_null(b.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(ids):  # a bounded piece of the batch at a time
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES, "right")))
                out = [frame(pack(i, t + end, encoder.width)) for i, t in zip(ids[at:stop], encoder.encode(texts.slice(at, stop - at)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], names=["value"])
                at = stop
            pa.default_memory_pool().release_unused()

    n = common.partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: part, offset, length, doc_id, n_tokens, ids_crc32. Checks every checksum; a damaged file fails the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for at, size, payload in frames(content):
                    doc_id, ids = unpack(payload)
                    rows.append((name.rsplit("/", 1)[-1], at, size, doc_id, len(ids), zlib.crc32(ids.tobytes())))
                if rows:
                    out = pd.DataFrame(rows, columns=["part", "offset", "length", "doc_id", "n_tokens", "ids_crc32"], dtype=object)
                    yield out.astype({"doc_id": "Int64"})  # large ids stay exact beside nulls

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, "part string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")


def write_dataset(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """Write records and their offset index to a new folder; returns the index as rows and the folder.

    The index is ``read_records`` with start, the tokens of all documents before (``with_starts``). Repeated documents give
    repeated records, an empty table gives an empty index, other columns are ignored.
    """
    spark = docs.sparkSession
    base = common.new_path(spark, "tokens")
    write_records(docs, tokenizer, f"{base}/records")
    seen, _ = _store_at(read_records(spark, f"{base}/records"), f"{base}/seen")
    return with_starts(seen), base


def with_starts(seen: DataFrame) -> DataFrame:
    """``seen`` (part, offset, n_tokens, ...) with start. Totals of files, one small row each, carry it over file borders.

    Files follow in the order in which they were written: by the number of the partition, then of the file within it, both
    as numbers (a name sorts part-100000 before part-99999).
    """
    number = F.regexp_extract("part", r"^part-(\d+)", 1).cast("long")
    within = F.coalesce(F.try_to_number(F.regexp_extract("part", r"-c(\d+)\.", 1), F.lit("999999999999")).cast("long"), F.lit(0))
    totals = seen.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy(number, within)) - F.col("n")).alias("base"))
    w = Window.partitionBy("part").orderBy("offset")
    return seen.join(before, "part").withColumn("start", F.col("base") + F.sum("n_tokens").over(w) - F.col("n_tokens")).drop("base")


def _store_at(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def read_at(spark: SparkSession, folder: str, part: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by a range read, as the index gives its place."""
    fs, p = common.hadoop_path(spark, f"{folder}/records/{part}")
    stream = fs.open(p)
    try:
        stream.seek(offset)
        data = bytes(stream.readNBytes(length))
    finally:
        stream.close()
    return unpack(next(frames(data))[2])
