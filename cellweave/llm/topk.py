"""Exact top-k inner products by aggregation without random access.

Vectors are floor(scale * x). Candidates stand in blocks; a block keeps, per dimension, its rows in order of their value:
the sorted list that a query reads from the top or the bottom, as the sign of its component says. A query reads all lists
of a block to the same depth and sums what it has seen of each row. Its lower bound adds the least that the lists still
hold, its upper bound the value at which each list stands. It stops once no row outside a small set can reach the bar:
the k-th lower bound of the block or the k-th best score of the blocks before, whichever is higher. Only then are the
final scores of that set resolved. A block whose first entries already sum to less than the bar is not read at all.

A block of queries meets the blocks of candidates one after another in a chain, so the bar passes on from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import common

SCALE = 64
#: Cells (rows times dimensions) of a block of either side.
CANDIDATE_CELLS, QUERY_CELLS = 8192 * 64, 4096 * 64
SLICE_CELLS = 1 << 21  # bounds (queries times rows) held at a time
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8)
CLOSED = 0.02  # a query stops once this share of a block, or twice k rows, can still qualify
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def _padded(vectors: list) -> np.ndarray:
    """Vectors as rows of one int64 array; those shorter than the longest end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``x`` with ``q``; what a long cannot hold is cut to its ends."""
    if x.size and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2.0**62:
        return np.array([min(max(sum(map(int.__mul__, r, q.tolist())), LONG.min), LONG.max) for r in x.tolist()], np.int64)
    return x @ q


class Best:
    """The k best (score, id) of each query so far, ties to smaller ids."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.ids = [np.empty(0, np.int64) for _ in q_ids]
        self.scores = [np.empty(0, np.int64) for _ in q_ids]
        self.bar = np.full(len(q_ids), -np.inf)
        self.begin = np.zeros(len(q_ids))  # bounds are first looked at one depth before that of the block before

    def add(self, t: int, ids: np.ndarray, found: np.ndarray) -> None:
        ids, found = np.concatenate([self.ids[t], ids]), np.concatenate([self.scores[t], found])
        order = np.lexsort((ids, ~found))[: self.k]  # ~ turns the order round and never overflows
        self.ids[t], self.scores[t] = ids[order], found[order]
        if len(order) == self.k:
            # A long above 2**53 may round up as a float: the bar stays under the score it stands for.
            s = float(found[order[-1]])
            self.bar[t] = s if abs(s) < EXACT else np.nextafter(s, -np.inf)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(q, i, s) for q, ids, found in zip(self.q_ids.tolist(), self.ids, self.scores, strict=True) for i, s in zip(ids.tolist(), found.tolist(), strict=True)]


def _stands(order: np.ndarray, values: np.ndarray, depth: int, rest: np.ndarray) -> np.ndarray:
    """Rows as they stand after every list is read to ``depth``: the value where seen, and ``rest`` of its list where not."""
    out = np.repeat(rest[None], len(order), axis=0)
    np.put_along_axis(out, order[:depth], values[:depth], axis=0)
    return out


def search_block(ids: np.ndarray, x: np.ndarray, q: np.ndarray, best: Best) -> np.ndarray:
    """Put the rows (ids, x) of a block that belong to the k best of each query into ``best``; a query's own id is left out.

    Returns the share of the lists that each query read before it stopped (0: the block was skipped). All queries read the
    lists side by side, so bounds are products of their components with the rows as they stand.
    """
    n, dims, k, q_ids = len(x), max(x.shape[1], q.shape[1]), best.k, best.q_ids
    x, q = (np.pad(a, ((0, 0), (0, dims - a.shape[1]))) for a in (x, q))
    share_read = np.zeros(len(q))
    if not n or not dims:
        for t in range(len(q) if n else 0):
            other = ids != q_ids[t]
            best.add(t, ids[other], np.zeros(int(other.sum()), np.int64))
        return share_read
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, axis=0).astype(np.float64)
    top, bottom = (order[::-1], values[::-1]), (order, values)
    f = q.astype(np.float64)
    up, down = np.maximum(f, 0), np.minimum(f, 0)
    # Sums of integers under 2**53 are exact; beyond, both bounds leave room for rounding.
    size = np.abs(f) @ np.abs(values[[0, -1]]).max(axis=0)
    slack = np.where(size < EXACT, 0.0, size * dims * 2.0**-51)
    todo = np.flatnonzero(up @ values[-1] + down @ values[0] + slack >= best.bar)
    own = {}
    places = pd.Series(np.arange(n)).groupby(ids).indices
    for t in todo.tolist():
        if int(q_ids[t]) in places:
            own[t] = places[int(q_ids[t])]
    for before, share in zip((0.0, *DEPTHS), (*DEPTHS, 1.0), strict=True):
        ready = best.begin[todo] <= share
        later, todo = todo[~ready], todo[ready]
        if not len(todo):
            todo = later
            continue
        depth = min(n, max(1, int(n * share)))
        share_read[todo], best.begin[todo] = share, before
        high = [_stands(*side, depth, side[1][depth - 1]).T for side in (top, bottom)]
        low = [_stands(*side, depth, side[1][-1]).T for side in (top, bottom)]
        on = []
        step = max(1, SLICE_CELLS // n)
        for a in range(0, len(todo), step):
            part = todo[a : a + step]
            upper = up[part] @ high[0] + down[part] @ high[1] + slack[part, None]
            lower = up[part] @ low[0] + down[part] @ low[1] - slack[part, None]
            for row, t in enumerate(part.tolist()):
                if t in own:
                    upper[row, own[t]] = lower[row, own[t]] = -np.inf
            bar = np.maximum(best.bar[part], np.partition(lower, n - k, axis=1)[:, n - k]) if n > k else best.bar[part]
            open_ = (upper >= bar[:, None]) & (upper > -np.inf)
            closed = (open_.sum(axis=1) <= max(2 * k, CLOSED * n)) | (depth == n)
            on.append(part[~closed])
            for row in np.flatnonzero(closed).tolist():
                left = np.flatnonzero(open_[row])
                best.add(int(part[row]), ids[left], scores(x[left], q[part[row]]))
        todo = np.concatenate([*on, later])
    return share_read


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) with x as double, of vectors without null or non-finite components.

    Null ids, null and empty vectors take no part; components beyond a long are cut to its ends; other columns are ignored.
    """
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).select("vec_id", whole.alias("v"))


def _blocks(df: DataFrame, cells: int) -> DataFrame:
    """(block, dims, width, ids, data): vectors of like length in blocks of about ``cells`` components, dealt by a hash of their id.

    Vectors of 2**(c-1) + 1 to 2**c components form class c, counted first, so no block grows with the table.
    """
    kind = F.ceil(F.log2(F.size("v").cast("double"))).cast("int")
    counts = {r["kind"]: r["n"] for r in df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}  # 32 rows at most
    at, number = 0, F.lit(0)
    for c, n in sorted(counts.items()):
        size = max(1, -(-n * 2**c // cells))
        number = F.when(kind == c, F.lit(at) + F.pmod(F.xxhash64("vec_id", F.lit(c)), F.lit(size))).otherwise(number)
        at += size

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _padded(rows["v"].tolist())
        width = next(w for w in ("<i1", "<i2", "<i4", "<i8") if x.min(initial=0) >= np.iinfo(w).min and x.max(initial=0) <= np.iinfo(w).max)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "dims": [x.shape[1]], "width": [width], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [x.astype(width).tobytes()]})

    return df.withColumn("block", number.cast("int")).groupBy("block").applyInPandas(run, "block int, dims int, width string, ids binary, data binary")


def search(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, its own id left out.

    Ties go to the smaller vec_id. Both sides are (vec_id, v) as ``vectors`` gives them. Query and candidate blocks meet
    pair by pair; a task holds one of either, whatever the sizes of the tables. Vectors of different lengths are compared
    over the dimensions that both have (the shorter ends in zeros); repeated candidate rows count each, repeated query
    rows once; an empty side gives an empty result.
    """
    spark = candidates.sparkSession
    left, _ = common.stored(_blocks(candidates, CANDIDATE_CELLS), "candidate-blocks")
    right, _ = common.stored(_blocks(queries.distinct(), QUERY_CELLS), "query-blocks")
    n_left, n_right = (left.agg(F.max("block")).first()[0] or 0) + 1, right.count()
    chains = max(1, min(n_left, -(-2 * common.partitions(spark) // max(1, n_right))))
    # Each chain of a query block begins with that block; its candidate blocks follow.
    heads = right.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).select(F.col("block").alias("qb"), "chain", F.lit(-1).alias("cb"), "dims", "width", "ids", "data")
    links = right.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("cb"))  # pairs of blocks, by number
    links = links.join(left, F.col("cb") == F.col("block")).select("qb", F.pmod("cb", F.lit(chains)).alias("chain"), "cb", "dims", "width", "ids", "data")
    dealt = heads.unionByName(links).repartition(max(1, min(n_right * chains, 4 * common.partitions(spark))), "qb", "chain").sortWithinPartitions("qb", "chain", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, q, now = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            got = best.rows() if best else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for qb, chain, cb, dims, width, ids, data in zip(*(c for c in b.columns), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                x = np.frombuffer(data.as_buffer(), width.as_py()).reshape(-1, dims.as_py()).astype(np.int64)
                if cb.as_py() < 0:
                    if now is not None:
                        yield from done()
                    now, q, best = (qb.as_py(), chain.as_py()), x, Best(ids, k)
                else:
                    search_block(ids, x, q, best)
        if now is not None:
            yield from done()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
