"""Repeated word passages by suffix automata.

What is removed: every word covered by a window of ``WINDOW`` consecutive words whose sequence also starts in a document
with a smaller doc_id.

1. Sampling. Of the ``GRAM``-word grams of each window the smallest hash, its anchor, depends on the window alone; a
   stretch of neighbouring windows with one anchor is a piece. Equal windows have equal anchors, so only pieces whose
   anchor several documents hold go on; they fetch their words.
2. Equal pieces (by SHA-256) collapse onto the smallest document that holds them; the others are removed whole.
3. Reference shards. The different pieces of one anchor are a shard. A task reads them in order of doc_id and keeps their
   suffix automaton: each piece is streamed through it for its matching statistics (the longest match that ends at each
   word), a match of ``WINDOW`` words or more removes its window, and a piece with words not known yet joins the
   automaton. Shards stand where their pieces are instead of being broadcast: every document against every shard would
   grow with the square of the corpus.
4. An anchor of over ``SHARD`` pieces (a passage that many documents continue in their own way) is no shard: its windows
   meet by SHA-256; of equal ones of a batch only those of the smallest document are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

WINDOW, GRAM = 50, 8
SAMPLE_BYTES = 1 << 19  # texts are sampled in pieces of about this size, whole texts at least
SHARD = 1000
KNOWN = 100_000  # pieces whose words a task does not send again
_M = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters; a null text has none."""
    return text.encode().split() if text else []


# --- sampling ----------------------------------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(words_: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows) of every piece of documents laid end to end, as word numbers; no window crosses an end."""
    n = len(words_) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h, size, power = pd.util.hash_array(np.array(words_, dtype=object), categorize=False), 1, _M
        while size < GRAM:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        low, size, span = _mix(h), 1, WINDOW - GRAM + 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[span - size : span - size + n])
    start = np.concatenate(([0], ends[:-1]))
    whole = np.zeros(len(words_) + 1, np.int64)  # windows that fit their document
    sizes = ends - start
    fit = sizes >= WINDOW
    np.add.at(whole, start[fit], 1)
    np.add.at(whole, ends[fit] - WINDOW + 1, -1)
    good = np.cumsum(whole)[:n] > 0
    begins = np.zeros(n, bool)
    begins[start[start < n]] = True
    new = begins | np.append(True, low[1:] != low[:-1]) | np.append(True, good[1:] != good[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    keep = good[at]
    return low[at][keep].view(np.int64), at[keep], length[keep]


def _sampled(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, tag, start, windows) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            at, held, found, ends = 0, 0, [], []
            for i in range(len(texts)):
                own = words(texts[i].as_py())
                found += own
                ends.append(len(found))
                held += texts[i].as_buffer().size
                if held >= SAMPLE_BYTES or i == len(texts) - 1:
                    stops = np.array(ends)
                    anchor, start, windows = pieces(found, stops)
                    doc = np.searchsorted(stops, start, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[at + doc]), pa.array(tags[at + doc]), pa.array(start - np.concatenate(([0], stops[:-1]))[doc]), pa.array(windows)], names=["anchor", "doc_id", "tag", "start", "windows"])
                    at, held, found, ends = i + 1, 0, [], []

    return docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1)).select("doc_id", "tag", "text").mapInArrow(run, "anchor long, doc_id long, tag long, start long, windows long")


def _fetched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(anchor, key, doc_id, tag, start, windows, words): pieces with the SHA-256 of their words, which a task sends once as far as it knows."""
    wanted = places.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("places"))
    joined = docs.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places")
    kinds = {"anchor": pa.int64(), "key": pa.binary(), "doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "windows": pa.int64(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for b in batches:
            rows, held = [], 0
            for doc_id, tag, text, places_ in zip(*(b.column(k) for k in range(4)), strict=True):
                own = words(text.as_py())
                doc_id, tag = doc_id.as_py(), tag.as_py()
                for p in places_.as_py():
                    data = b" ".join(own[p["start"] : p["start"] + p["windows"] + WINDOW - 1])
                    key = hashlib.sha256(data).digest()
                    new = key not in known
                    if new and len(known) < KNOWN:
                        known.add(key)
                    rows.append((p["anchor"], key, doc_id, tag, p["start"], p["windows"], data if new else None))
                    held += len(data)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return joined.mapInArrow(run, "anchor long, key binary, doc_id long, tag long, start long, windows long, words binary")


# --- suffix automata ---------------------------------------------------------------------------------------------


class Automaton:
    """Suffix automaton of sequences of words, which can be added to."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            there = nexts[last].get(c)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            cur, p = -1, last
            if there is None:
                cur = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and c not in nexts[p]:
                    nexts[p][c] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                there = nexts[p][c]
                if length[there] == length[p] + 1:
                    link[cur] = there
                    last = cur
                    continue
            clone = len(nexts)
            nexts.append(dict(nexts[there]))
            length.append(length[p] + 1)
            link.append(link[there])
            link[there] = clone
            while p >= 0 and nexts[p].get(c) == there:
                nexts[p][c] = clone
                p = link[p]
            if cur < 0:
                last = clone
            else:
                link[cur] = clone
                last = cur

    def ends(self, sequence: list, least: int) -> list[int]:
        """Matching statistics: the places whose longest match with the automaton, ending there, has ``least`` words or more."""
        nexts, link, length = self.next, self.link, self.length
        at, size, out = 0, 0, []
        for i, c in enumerate(sequence):
            there = nexts[at].get(c)
            while there is None and at:
                at = link[at]
                size = length[at]
                there = nexts[at].get(c)
            if there is not None:
                at = there
                size += 1
                if size >= least:
                    out.append(i)
        return out


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """(first, how many) of each run of consecutive places."""
    at = np.array(places)
    cut = np.append(0, np.flatnonzero(np.diff(at) != 1) + 1)
    return list(zip(at[cut].tolist(), np.diff(np.append(cut, len(at))).tolist(), strict=True))


def _matched_in_shards(shards: DataFrame) -> DataFrame:
    """(anchor, key, offset, matched): runs of windows of each piece that a piece of a smaller document of its anchor holds."""

    def found_in(shard: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[bytes, int, int]]:
        automaton, waiting, doc, seen = Automaton(), [], None, set()
        for low, key, data in shard:
            if key in seen:  # sent by several tasks
                continue
            seen.add(key)
            if low != doc:
                for sequence in waiting:
                    automaton.add(sequence)
                waiting, doc = [], low
            sequence = data.split()
            ends = automaton.ends(sequence, WINDOW)
            if ends:
                for first, many in _runs(ends):
                    yield key, first - WINDOW + 1, many
            if len(ends) < len(sequence) - WINDOW + 1:
                waiting.append(sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, shard, rows = None, [], []

        def finish() -> None:
            rows.extend((anchor, *r) for r in found_in(shard))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["anchor", "key", "offset", "matched"]), schema=pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("offset", pa.int64()), ("matched", pa.int64())]))

        for b in batches:
            for a, low, key, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if a != anchor:
                    finish()
                    anchor, shard = a, []
                shard.append((low, key, data))
            if len(rows) > 10_000:
                yield batch()
                rows = []
        finish()
        yield batch()

    ordered = shards.select("anchor", "low", "key", "words").repartition(common.partitions(shards.sparkSession), "anchor").sortWithinPartitions("anchor", "low", "key")
    return ordered.mapInArrow(run, "anchor long, key binary, offset long, matched long")


def _packed(bucket: int, digest: np.ndarray, low: np.ndarray, anchor: np.ndarray, key: np.ndarray, offset: np.ndarray) -> tuple:
    return (bucket, digest.tobytes(), low.astype("<i8").tobytes(), anchor.astype("<i8").tobytes(), key.tobytes(), offset.astype("<i8").tobytes())


PACKED = "bucket int, digests binary, lows binary, anchors binary, keys binary, offsets binary"


def _split_by_least(digest, low, *rest) -> tuple[np.ndarray, np.ndarray]:
    """Which windows a smaller document holds as well, and which have the smallest document of all that are equal."""
    order = np.lexsort((low, digest))
    new = np.append(True, digest[order][1:] != digest[order][:-1])
    least = low[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = np.empty(len(order), bool)
    gone[order] = low[order] > least
    return gone, ~gone


def _matched_by_window(hot: DataFrame) -> DataFrame:
    """The same for the pieces of anchors that are no shard: windows meet by SHA-256, in buckets of packed columns.

    Of equal windows of a batch only those of the smallest document go on, so a window that many pieces share stays few.
    """
    names = [c.split()[0] for c in PACKED.split(", ")]
    buckets = 4 * common.partitions(hot.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, at, offsets = [], [], []
            for i, data in enumerate(b.column(3)):
                own = data.as_py().split()
                for k in range(len(own) - WINDOW + 1):
                    digests.append(hashlib.sha256(b" ".join(own[k : k + WINDOW])).digest())
                    at.append(i)
                    offsets.append(k)
            if not at:
                continue
            of = np.array(at)
            digest = np.frombuffer(b"".join(digests), "V32")
            # as four numbers, for they sort faster; equal if all are
            number = np.unique(digest.view("<u8").reshape(-1, 4), axis=0, return_inverse=True)[1].ravel()
            low = b.column(2).to_numpy(zero_copy_only=False)[of]
            columns = (digest, low, b.column(0).to_numpy(zero_copy_only=False)[of], np.frombuffer(b"".join(b.column(1).to_pylist()), "V32")[of], np.array(offsets))
            gone, going = _split_by_least(number, low)
            rows = [_packed(-1, *(c[gone] for c in columns))] if gone.any() else []
            bucket = (digest.view("<u8").reshape(-1, 4)[:, 0] % np.uint64(buckets)).astype(np.int64)
            for k in np.unique(bucket[going]).tolist():
                mine = going & (bucket == k)
                rows.append(_packed(k, *(c[mine] for c in columns)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], names=names)

    def columns_of(group: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(group[c]), t) for c, t in zip(names[1:], ("V32", "<i8", "<i8", "V32", "<i8"), strict=True)]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        columns = columns_of(group)
        number = np.unique(columns[0].view("<u8").reshape(-1, 4), axis=0, return_inverse=True)[1].ravel()
        gone, _ = _split_by_least(number, columns[1])
        return pd.DataFrame([_packed(-1, *(c[gone] for c in columns))] if gone.any() else [], columns=names)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, _, anchor, key, offset = columns_of(b)
            piece = np.unique(key.view("<u8").reshape(-1, 4), axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((offset, piece, anchor))
            anchor, key, offset, piece = anchor[order], key[order], offset[order], piece[order]
            at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (offset[1:] > offset[:-1] + 1)))
            last = np.append(at[1:] - 1, len(offset) - 1)
            yield pd.DataFrame({"anchor": anchor[at], "key": [k.tobytes() for k in key[at]], "offset": offset[at], "matched": offset[last] - offset[at] + 1})

    dealt, _ = common.stored(hot.mapInArrow(deal, PACKED), "windows")
    met = dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(meet, PACKED)
    return dealt.where("bucket < 0").unionByName(met).mapInPandas(unpack, "anchor long, key binary, offset long, matched long")


# --- removal -----------------------------------------------------------------------------------------------------


def with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with a column of removed windows, array of (start, windows), for ``kept_words``; every row stays.

    A row is known by doc_id and a hash of its text, so rows that repeat an id are told apart; rows with one id never
    count against each other. Rows with a null doc_id are neither searched nor removed from; null texts have no words.
    The column is called ``common.unused(docs, "places")``.
    """
    tag, doc, other, sets = (common.unused(docs, c) for c in ("tag", "doc", "other", "places"))
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    lean = tagged.select("doc_id", F.col(tag).alias("tag"), "text")
    sampled, path = common.stored(_sampled(lean), "sampled")
    shared = sampled.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    fetched, _ = common.stored(_fetched(lean, sampled.join(shared, "anchor").distinct()), "pieces")
    common.remove(docs.sparkSession, path)
    lows, _ = common.stored(fetched.groupBy("anchor", "key").agg(F.min("doc_id").alias("low")), "lows")
    kinds = lows.groupBy("anchor").agg(F.count("*").alias("kinds"), (F.min("low") < F.max("low")).alias("several")).where("kinds > 1 and several")
    mixed, _ = common.stored(fetched.where("words is not null").select("anchor", "key", "words").join(kinds, "anchor").join(lows, ["anchor", "key"]), "mixed")
    matched = _matched_in_shards(mixed.where(F.col("kinds") <= SHARD))
    hot = mixed.where(F.col("kinds") > SHARD).select("anchor", "key", "low", "words").repartition(common.partitions(docs.sparkSession), "anchor", "key")
    if not hot.isEmpty():
        matched = matched.unionByName(_matched_by_window(hot))
    known = fetched.select("anchor", "key", "doc_id", "tag", "start", "windows").join(lows, ["anchor", "key"])
    part = known.where("doc_id = low").join(matched, ["anchor", "key"]).select("doc_id", "tag", (F.col("start") + F.col("offset")).alias("start"), F.col("matched").alias("windows"))
    gone = known.where("doc_id > low").select("doc_id", "tag", "start", "windows").unionByName(part).distinct()
    gone = gone.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "windows")).alias(sets))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("tag").alias(other), sets)
    return tagged.join(gone, (tagged["doc_id"] == gone[doc]) & (tagged[tag] == gone[other]), "left").select(*docs.columns, sets)


def kept_words(own: list[bytes], sets: list | None) -> list[bytes]:
    if sets is None or not len(sets):
        return own
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, [s["start"] for s in sets], 1)
    np.add.at(cover, [s["start"] + s["windows"] + WINDOW - 1 for s in sets], -1)
    return [own[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs`` (doc_id, text); see ``with_places``.

    Repeated rows each give a row; texts of fewer than ``WINDOW`` words keep all; other columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, sets in zip(b.column(1), b.column(2), strict=True):
                own = words(text.as_py())
                kept = kept_words(own, sets.as_py())
                rows.append((len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_places(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed words cut from text, kept ones joined by one space; texts that lose nothing stay as they are.

    Null texts stay null, columns of any name pass through, an empty table stays empty; see ``with_places``.
    """
    name = common.unused(docs, "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            new = [t.as_py() if not s.as_py() else b" ".join(kept_words(words(t.as_py()), s.as_py())).decode() for t, s in zip(b.column(at), b.column(b.schema.get_field_index(name)), strict=True)]
            keep = [i for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.column(i).type) if i == at else b.column(i) for i in keep], names=[b.schema.names[i] for i in keep])

    return with_places(docs).mapInArrow(cut, docs.schema).select(docs.columns)
