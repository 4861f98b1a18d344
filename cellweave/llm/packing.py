"""Best-fit packing of documents into fixed-length bins under conflicts.

Bins stand in order of what room they have left. A document looks up the successor of its length, the tightest bin
that holds it, and walks on to roomier ones until a bin's bitmaps show neither its source (beyond ``per_source``) nor
its duplicate cluster; if none is compatible a new bin opens. Shards of about ``SHARD`` pieces are packed independently,
with lengths and keys only: texts do not move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common, simhash

CAPACITY, SHARD, PER_SOURCE = 16_384, 4096, 4


class Bins:
    """Bins of one shard, ordered by residual, with a bitmap per bin for clusters and one per level for sources."""

    def __init__(self, capacity: int, sources: int, clusters: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.source_words, self.cluster_words = sources // 64 + 1, clusters // 64 + 1
        self.order = np.empty(0, np.int64)  # residual << 32 | bin, sorted
        self.full = np.zeros((0, self.source_words), np.uint64)  # sources that have used up their share of the bin
        self.seen = np.zeros((0, self.cluster_words), np.uint64)
        self.counts: list[dict[int, int]] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece; source or cluster -1 conflicts with nothing."""
        at = int(np.searchsorted(self.order, length << 32))
        n, step, found = len(self.order), 32, -1
        while at < n:  # the successor search goes on until a compatible bin
            bins = self.order[at : at + step] & 0xFFFFFFFF
            bad = np.zeros(len(bins), bool)
            if source >= 0:
                bad |= (self.full[bins, source >> 6] >> np.uint64(source & 63) & np.uint64(1)).astype(bool)
            if cluster >= 0:
                bad |= (self.seen[bins, cluster >> 6] >> np.uint64(cluster & 63) & np.uint64(1)).astype(bool)
            good = np.flatnonzero(~bad)
            if len(good):
                found = at + int(good[0])
                break
            at, step = at + step, step * 2
        if found >= 0:
            key = int(self.order[found])
            self.order = np.delete(self.order, found)
            number, room = key & 0xFFFFFFFF, key >> 32
        else:
            number, room = len(self.counts), self.capacity
            self.counts.append({})
            if number >= len(self.full):
                grow = max(64, number)
                self.full = np.vstack([self.full, np.zeros((grow, self.source_words), np.uint64)])
                self.seen = np.vstack([self.seen, np.zeros((grow, self.cluster_words), np.uint64)])
        if source >= 0:
            self.counts[number][source] = c = self.counts[number].get(source, 0) + 1
            if c >= self.per_source:
                self.full[number, source >> 6] |= np.uint64(1) << np.uint64(source & 63)
        if cluster >= 0:
            self.seen[number, cluster >> 6] |= np.uint64(1) << np.uint64(cluster & 63)
        left = room - length
        if left:
            key = left << 32 | number
            self.order = np.insert(self.order, int(np.searchsorted(self.order, key)), key)
        return number, self.capacity - room


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, cluster: str | None = None, length: str | None = None, near: int | None = None, count=None) -> DataFrame:
    """(doc_id, piece, start, length, shard, bin, bin_offset): where every byte (or token) of every text goes.

    Lengths are those of the column ``length`` (a number of tokens, say; null or negative: 0), or what ``count`` (see
    ``prefix_tokens.text_counter``; with ``near``) gives for the text, by default bytes. Texts
    longer than ``capacity`` are cut into full bins and a rest. No bin has two pieces of one duplicate cluster or more than
    ``per_source`` pieces of one source. Clusters are the values of the column ``cluster``, or with ``near`` texts that
    link by fingerprints of up to so many bits, or else texts that are equal. Shards are drawn by a hash of the row and
    its number over a count made first, so each is bounded whatever the sources and however often a row repeats. Null and empty texts have length 0 and take no
    bin (bin null); null sources conflict with nothing; repeated rows are copies of each other; an empty table gives an
    empty result; other columns are ignored.
    """
    n = docs.count()
    shards = max(1, -(-n // shard))
    size = F.greatest(F.col(length), F.lit(0)) if length else F.octet_length("text")
    group = F.xxhash64(cluster) if cluster else F.xxhash64("text")
    units = [] if count else [F.coalesce(size, F.lit(0)).cast("long").alias("n_units")]
    light = docs.select("doc_id", "text", *units, F.col("source").cast("string").alias("source"), group.alias("cluster"), F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    if near is not None and not cluster:
        keep = tuple(c for c in light.columns if c not in ("doc_id", "text"))
        light = simhash.near_duplicates(light, near, keep=keep, count=count).withColumn("cluster", F.coalesce(F.xxhash64("component_id"), "cluster"))
    else:
        light, _ = common.stored(light.drop("text"), "shards")  # numbers of rows are drawn once
    light = light.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "n_units", "source", "cluster", "shard")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_units", "known", "doc_id", "cluster"], ascending=[False, False, True, True], kind="stable")
        sources, names = pd.factorize(rows["source"])
        clusters, groups = pd.factorize(rows["cluster"])
        alone = np.bincount(clusters, minlength=len(groups)) == 1  # a cluster of one piece cannot conflict
        number = np.cumsum(~alone) - 1
        bins = Bins(capacity, len(names), int((~alone).sum()), per_source)
        out, pieces = [], []
        for doc_id, known, size, s, c in zip(rows["doc_id"].tolist(), rows["known"].tolist(), rows["n_units"].tolist(), sources.tolist(), clusters.tolist(), strict=True):
            doc_id = doc_id if known else None
            if size == 0:
                out.append((doc_id, 0, 0, 0, None, None))
            for k, start in enumerate(range(0, size, capacity)):
                pieces.append((min(capacity, size - start), doc_id, k, start, s, -1 if alone[c] else int(number[c])))
        pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2]))
        for length, doc_id, k, start, s, c in pieces:
            number_, offset = bins.place(length, s, c)
            out.append((doc_id, k, start, length, number_, offset))
        got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "bin", "bin_offset"], dtype=object)
        return got.assign(doc_id=got["doc_id"].astype("Int64"), piece=got["piece"].astype("int64"), start=got["start"].astype("int64"), length=got["length"].astype("int64"), bin=got["bin"].astype("Int64"), bin_offset=got["bin_offset"].astype("Int64"), shard=int(rows["shard"].iloc[0]))

    schema = "doc_id long, piece long, start long, length long, bin long, bin_offset long, shard int"
    return light.groupBy("shard").applyInPandas(run, schema).select("doc_id", "piece", "start", "length", "shard", "bin", "bin_offset")
