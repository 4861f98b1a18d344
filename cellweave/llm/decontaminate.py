"""Benchmark contamination by greedy string tiling.

Seeds, runs of ``LEAST`` words that a document shares with a benchmark item, are found by a join on rolling hashes. A
pair is tiled if it shares enough of them to cover the item: the longest common runs of words that touch no earlier tile
are marked, again and again with shorter runs down to ``LEAST`` words, found by running Karp-Rabin hashes and verified
word by word. Tiles may stand anywhere, so an item whose sentences were put in another order is still covered.

Tiles of at least ``LEAST`` words that cover c words of an item hold c / ``LEAST`` of its runs of ``LEAST`` words or more.
So pairs that share fewer seeds than that are left out without loss.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

LEAST, COVER = 3, 0.7
#: A benchmark of at most so many seeds, and bytes of text, is broadcast; both are counted first.
BROADCAST_SEEDS, BROADCAST_BYTES = 2_000_000, 64 << 20
PAIRS_AT_ONCE = 1 << 20
WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


KNOWN_WORDS = 250_000


def word_codes(tokens: list[str], known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit code of each word; ``known`` keeps those seen."""
    known = {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    get, digest = known.get, xxhash.xxh64_intdigest
    out = []
    for t in tokens:
        h = get(t)
        if h is None:
            h = known[t] = digest(t.encode())
        out.append(h)
    return np.array(out, dtype=np.uint64)


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hash of every run of ``size`` words (modulo 2**64)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * _ODD + codes[k : k + n]
    return h


def _windows(codes: np.ndarray):
    """A function that gives the Karp-Rabin hashes of the runs of ``n`` words that begin at ``at`` (arrays), up to a factor."""
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), _ODD))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), np.uint64(pow(int(_ODD), -1, 1 << 64))))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[:-1])))
    return lambda at, n: (total[at + n] - total[at]) * back[at]


def common_runs(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(words, start in doc, start in item) of the maximal common runs of at least ``least`` words, by their hashes."""
    in_doc, in_item = rolling(doc, least), rolling(item, least)
    order = np.argsort(in_item, kind="stable")
    sorted_ = in_item[order]
    low, high = np.searchsorted(sorted_, in_doc, "left"), np.searchsorted(sorted_, in_doc, "right")
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return []
    hash_doc, hash_item, out = _windows(doc), _windows(item), []
    ends = np.cumsum(high[hits] - low[hits])
    for a in range(0, int(ends[-1]), PAIRS_AT_ONCE):
        pair = np.arange(a, min(a + PAIRS_AT_ONCE, int(ends[-1])))
        own = np.searchsorted(ends, pair, "right")
        d = hits[own]
        i = order[high[d] - (ends[own] - pair)]
        begins = (d == 0) | (i == 0) | (doc[d - 1] != item[i - 1])  # or a longer run holds it
        d, i = d[begins], i[begins]
        lo, hi = np.full(len(d), least), np.minimum(len(doc) - d, len(item) - i)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = hash_doc(d[open_], mid) == hash_item(i[open_], mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)
        out += zip(lo.tolist(), d.tolist(), i.tolist(), strict=True)
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-code arrays: (start in doc, start in item, words), longest first, no overlaps."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    heap = [(-n, d, i) for n, d, i in common_runs(doc, item, least)]
    heapq.heapify(heap)
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        clear = free_d[d : d + n] & free_i[i : i + n]
        if clear.all():
            clear = doc[d : d + n] == item[i : i + n]
            if clear.all():
                out.append((d, i, n))
                free_d[d : d + n] = False
                free_i[i : i + n] = False
                continue
        # What is left of the run, in its unmarked (or, should hashes have met by chance, equal) stretches.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], clear.view(np.int8), [0]))))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return out


def _seeds(df: DataFrame, key: str) -> DataFrame:
    """(key, h, k, words): each seed of a text with the number of its places, and the number of words of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            found, words_ = [], []
            for t in b["text"]:
                codes = word_codes(words(t), known)
                h, k = np.unique(rolling(codes, LEAST), return_counts=True)
                found.append([{"h": x, "k": n} for x, n in zip(h.view(np.int64).tolist(), k.tolist(), strict=True)])
                words_.append(len(codes))
            yield pd.DataFrame({key: b[key], "words": words_, "found": found})

    return df.select(key, "text").mapInPandas(run, f"{key} long, words long, found array<struct<h: long, k: long>>").select(key, "words", F.explode("found").alias("f")).select(key, "f.h", "f.k", "words")


def _hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, h): the distinct seeds of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            yield pd.DataFrame({key: b[key], "h": [np.unique(rolling(word_codes(words(t), known), LEAST)).view(np.int64) for t in b["text"]]})

    return df.select(key, "text").mapInPandas(run, f"{key} long, h array<long>").select(key, F.explode("h").alias("h"))


def matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, cover, n_tiles) of every pair whose tiles cover ``cover`` of the item's words.

    Items of fewer than ``LEAST`` words have no tile and match nothing; null texts have no words; null ids take no part;
    repeated documents or items give a pair once, the best of their texts; other columns are ignored; an empty side gives
    an empty result. A benchmark of more than ``BROADCAST_SEEDS`` seeds or ``BROADCAST_BYTES`` bytes is joined by shuffle.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text")
    seeds, _ = common.stored(_seeds(items, "item_id"), "seeds")
    seeds = seeds.groupBy("item_id", "h").agg(F.max("k").alias("k"), F.min("words").alias("words"))  # items that repeat an id
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    light = lambda df, fits: F.broadcast(df) if fits else df
    few = seeds.count() <= BROADCAST_SEEDS
    shared = _hashes(docs.where("doc_id is not null"), "doc_id").join(light(seeds, few), "h")
    shared = shared.groupBy("doc_id", "item_id").agg(F.sum("k").alias("k"), F.min("words").alias("words"))
    pairs = shared.where(F.col("k") * LEAST >= cover * F.col("words") - 1e-9).select("doc_id", "item_id")
    pairs = pairs.join(light(items.withColumnRenamed("text", "item"), n_bytes <= BROADCAST_BYTES), "item_id")
    joined = docs.select("doc_id", "text").join(pairs, "doc_id").select("doc_id", "item_id", "text", "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, d, known = None, None, {}
        for b in batches:
            rows = []
            for doc_id, item_id, text, item in b.itertuples(index=False):
                if d is None or text != last:  # a document's items follow each other
                    last, d = text, word_codes(words(text), known)
                i = word_codes(words(item), known)
                t = tiles(d, i)
                covered = sum(n for _, _, n in t)
                if len(i) and covered >= cover * len(i) - 1e-9:
                    rows.append((doc_id, item_id, covered / len(i), len(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cover", "n_tiles"])

    found = joined.mapInPandas(run, "doc_id long, item_id long, cover double, n_tiles long")
    return found.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"), F.max_by("n_tiles", F.struct("cover", "n_tiles")).alias("n_tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Rows with a null doc_id and null, empty or short texts stay; rows that repeat an id stay or go together; columns of any
    name pass through; an empty table stays empty, and an empty benchmark keeps every row.
    """
    bad = matches(docs, benchmark, cover).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
