"""SimHash fingerprints and near-duplicate components.

Fingerprints that differ in at most d bits have popcounts per segment whose Manhattan distance is at most d. So each
distinct fingerprint becomes a point on the grid of popcounts of 12 segments, packed into a long of 5-bit fields;
a range join probes the lattice points within distance d (one of each opposite pair of offsets, both sides probe),
and what it finds is verified by the exact number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

SEED = 42
SEGMENTS = (6, 6, 6, 6, 5, 5, 5, 5, 5, 5, 5, 5)
FIELD = 5


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats counted); 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens]).tolist()
        starts = [0, *ends[: len(tokens) - words]]
        grams = [joined[s : e - 1] for s, e in zip(starts, ends[words - 1 :], strict=True)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), 8192):
        h = np.array([digest(g, SEED) for g in grams[at : at + 8192]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = (), count=None) -> DataFrame:
    """Rows (doc_id, *keep[, n_units], fp): one narrow stage over whole texts; fp is the fingerprint as a signed long.

    ``count`` makes, as a context, a function from a text to a number: n_units, in the same pass.
    """
    names = ["doc_id", *keep]
    added = [F.lit(0).cast("long").alias(n) for n in (("n_units", "fp") if count else ("fp",))]
    schema = docs.select(F.col("doc_id").cast("long"), *keep, *added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with count() if count else nullcontext() as counted:
            for b in batches:
                texts = b.column(b.schema.get_field_index("text"))
                fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
                units = [pa.array([counted(t.as_py() or "") for t in texts], pa.int64())] if counted else []
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *units, pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, schema)


def offsets(radius: int) -> list[int]:
    """Packed offsets of Manhattan length up to ``radius``: zero and one of each opposite pair."""
    dims = len(SEGMENTS)
    out = {(0,) * dims}
    for count in range(1, radius + 1):
        for at in combinations(range(dims), count):
            for steps in product(range(-radius, radius + 1), repeat=count):
                if 0 not in steps and sum(map(abs, steps)) <= radius and steps[0] > 0:
                    v = [0] * dims
                    for d, s in zip(at, steps, strict=True):
                        v[d] = s
                    out.add(tuple(v))
    return sorted(sum(s << FIELD * d for d, s in enumerate(v)) for v in out)


def cell(fp, radius: int):
    """The grid point of a fingerprint column; each field is biased by ``radius`` so that probes never borrow."""
    key, at = F.lit(0).cast("long"), 0
    for d, width in enumerate(SEGMENTS):
        bits = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long")
        key = key + F.shiftleft(bits + F.lit(radius), FIELD * d)
        at += width
    return key


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of ``rep`` ids of distinct fingerprints that differ in 1 to ``radius`` bits, each pair once."""
    points = classes.select("fp", "rep", cell(F.col("fp"), radius).alias("cell"))
    steps = F.array(*[F.lit(o).cast("long") for o in offsets(radius)])
    probes = points.select(F.col("fp").alias("fp2"), F.col("rep").alias("b"), F.explode(F.transform(steps, lambda o: F.col("cell") + o)).alias("cell"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    once = (cell(F.col("fp"), radius) != cell(F.col("fp2"), radius)) | (F.col("fp") < F.col("fp2"))
    # Spark takes probes to be as few as points and would send them to the driver for a broadcast.
    return points.withColumnRenamed("rep", "a").join(probes.hint("merge"), "cell").where(near & (F.col("fp") != F.col("fp2")) & once).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, keep: tuple[str, ...] = (), count=None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns ``keep`` (and n_units, see ``fingerprints``), fp, fingerprint (16 hex digits) and component_id.

    Equal fingerprints form a class, represented by its smallest doc_id, before anything is joined; classes link at up
    to ``radius`` differing bits and component_id is the smallest doc_id reachable. Null and empty texts have the
    fingerprint zero, linked like any other. Rows with a null doc_id get the component of their class (null if the class
    has no id). Repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    fps, _ = common.stored(fingerprints(docs, words, keep, count), "fingerprints")
    keep = (*keep, "n_units") if count else keep
    classes, _ = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = common.components(links(classes.where("rep is not null"), radius))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity ----------------------------------------------------------------------------------
#
# Texts whose word shingles agree by 0.8 differ in up to about 18 of 64 bits; at that radius random pairs pass the
# Manhattan bound as well, and the grid selects nothing. So texts first meet in blocks of equal min-wise samples of
# shingles, and the cascade (Manhattan bound, exact bits, estimated similarity) runs against the leaders of each block;
# links whose estimate does not settle the matter are verified on the shingles themselves. Rows of a block that are in
# different groups after that, and that no leader settles, are compared exactly: no pair of them is left unseen.

BANDS, ROWS, SIGNATURE, BITS = 8, 3, 128, 22
#: Rows of a block that lead an exact comparison in one task, and cells of the table that holds their shingles there.
LEADERS, CELLS = 256, 1 << 25
#: An estimate this far below the similarity asked for is no link (four standard errors at 0.8); this far above, it is one
#: without a look at the shingles.
BELOW, ABOVE = 0.15, 0.1
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


KNOWN_WORDS = 250_000


def shingle_hashes(text: str | None, words: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Distinct hashes of a text's word shingles (of the whole text where it is shorter), sorted; ``known`` keeps those of words."""
    tokens, known = (text or "").encode().lower().split(), {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    codes = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        c = known.get(t)
        if c is None:
            c = known[t] = xxhash.xxh64_intdigest(t, SEED)
        codes[i] = c
    size = min(words, len(tokens))
    h = np.zeros(max(1, len(tokens) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
    return np.unique(_mixed(h))


def sketch(text: str | None, words: int, known: dict[bytes, int] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprint, min-wise signature, block keys) of a text's distinct word shingles."""
    h = shingle_hashes(text, words, known)
    low, ones = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024]
        np.minimum(low, ((part[:, None] ^ _XOR) * _ODD).min(axis=0), out=low)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])
    keys = np.arange(1, BANDS + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        keys = _mixed(keys ^ low[r * BANDS : (r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
    return fp, (low >> np.uint64(40)).astype(np.uint8), keys.view(np.int64)


def _segment_counts(fps: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.cumsum((0, *SEGMENTS[:-1])), axis=1, dtype=np.int64)


def _centre(signatures: np.ndarray) -> np.ndarray:
    """The most frequent value of each place of the signatures."""
    places = signatures.shape[1]
    counts, first = np.zeros(places << 8, np.int64), np.arange(places, dtype=np.int32) << 8
    for at in range(0, len(signatures), 2048):
        counts += np.bincount((signatures[at : at + 2048] + first).ravel(), minlength=places << 8)
    return counts.reshape(places, 256).argmax(axis=1)


def block_links(reps: np.ndarray, fps: np.ndarray, signatures: np.ndarray, least: float, sure: float) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Links (a, b, estimate) within a block, and the places of rows between which pairs are still unseen.

    The next leader is, of the rows that may lead, the one whose signature is closest to the centre of theirs (then the
    smaller rep): of the edited copies of one text that is the text itself, which links to all of them, while copies may
    not reach each other. A leader meets all rows of other groups and links to those within ``BITS`` bits (first the
    Manhattan bound, then exactly) whose signatures agree by ``least``; those that agree by ``sure`` are of its group. A
    row that a leader links to does not lead, so a block of n copies gives n links, not n squared. Of two rows that have
    not led the pair is unseen, unless they are in one group.
    """
    out, size = [], len(reps)
    group, met, led = np.arange(size), np.zeros(size, bool), np.zeros(size, bool)
    counts, left, centred = _segment_counts(fps), np.arange(size), 0
    while len(left):
        if len(left) <= centred // 2 or not centred:  # the centre is taken anew whenever half of the rows are through
            centred, centre = len(left), _centre(signatures[left])
            close = (signatures[left] == centre.astype(np.uint8)).sum(axis=1)
            left = left[np.lexsort((reps[left], -close))]
        lead = int(left[0])
        led[lead] = True
        near = np.flatnonzero((group != group[lead]) & ~led)
        near = near[np.abs(counts[near] - counts[lead]).sum(axis=1) <= BITS]
        near = near[np.bitwise_count((fps[near] ^ fps[lead]).view(np.uint64)) <= BITS]
        same = ((signatures[near] == signatures[lead]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        near, same = near[same >= least], same[same >= least]
        met[near] = True
        alike = near[same >= sure]
        if len(alike):
            group[np.isin(group, group[alike])] = group[lead]
        out += [(int(reps[lead]), int(reps[n]), s) for n, s in zip(near.tolist(), same.tolist(), strict=True)]
        left = left[~met[left] & ~led[left]]
    rest = np.flatnonzero(~led)
    return out, rest if len(np.unique(group[rest])) > 1 else rest[:0]


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, used: list[str] | None = None) -> DataFrame:
    """(doc_id, root) of documents: root is the smallest doc_id of the group of near duplicates.

    Paths of the tables that the result is read from are added to ``used``; they go once it has been written.

    Null ids take no part. Texts without words are equal to each other. Equal sketches collapse first, so copies meet
    nothing more than once.
    """
    spark, used = docs.sparkSession, [] if used is None else used

    def stored(df: DataFrame, tag: str) -> DataFrame:
        df, path = common.stored(df, tag)
        used.append(path)
        return df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for b in batches:
            got = [sketch(t if isinstance(t, str) else None, words, known) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([g[0] for g in got], np.int64), "signature": [g[1].tobytes() for g in got], "keys": [g[2] for g in got]})

    sketches = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, fp long, signature binary, keys array<long>")
    sketches = stored(sketches, "sketches")
    classes = sketches.groupBy("fp", "signature").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"))
    classes = stored(classes, "sketch-classes")
    found = stored(_met(classes.select("rep", "fp", "signature", F.explode("keys").alias("key")), similarity), "sketch-links")
    pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "estimate").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))
    doubtful = stored(pairs.where(F.col("estimate") < similarity + ABOVE).select("a", "b"), "doubtful")
    sure = pairs.where(F.col("estimate") >= similarity + ABOVE).select("a", "b")
    links = stored(sure if doubtful.isEmpty() else sure.unionByName(_verified(docs, doubtful, words, similarity, used)), "verified")
    roots = stored(common.components(links, used=used), "roots")
    unseen = stored(_unseen(found.where("b is null").select("key", F.col("a").alias("rep")), roots), "unseen")
    if not unseen.isEmpty():
        more = stored(_exact_links(docs, unseen, words, similarity, used), "exact-links")
        if not more.isEmpty():
            roots = common.components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), used=used)
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", "signature", F.coalesce("root", "rep").alias("root"))
    return sketches.select("doc_id", "fp", "signature").join(named, ["fp", "signature"]).select("doc_id", "root")


def _met(blocks: DataFrame, similarity: float) -> DataFrame:
    """``block_links`` of every block: rows (key, a, b, estimate) of links, and (key, a) without b of rows with unseen pairs."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            keys = b["key"].to_numpy()
            cut = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            held = b.iloc[cut[-1] :]
            yield links_of(b, cut[:-1], cut[1:])
        if held is not None:
            yield links_of(held.reset_index(drop=True), np.zeros(1, np.int64), np.array([len(held)]))

    def links_of(b: pd.DataFrame, starts: np.ndarray, stops: np.ndarray) -> pd.DataFrame:
        keys, reps, fps, sigs = (b[c].to_numpy() for c in ("key", "rep", "fp", "signature"))
        out = []
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            if e - s > 1:
                signatures = np.stack([np.frombuffer(x, np.uint8) for x in sigs[s:e]])
                got, rest = block_links(reps[s:e], fps[s:e], signatures, similarity - BELOW, similarity + ABOVE)
                out += [(int(keys[s]), *x) for x in got]
                out += [(int(keys[s]), r, None, None) for r in reps[s:e][rest].tolist()]
        return pd.DataFrame({"key": pd.array([x[0] for x in out], "Int64"), "a": pd.array([x[1] for x in out], "Int64"), "b": pd.array([x[2] for x in out], "Int64"), "estimate": pd.array([x[3] for x in out], "Float64")})

    dealt = blocks.repartition(common.partitions(blocks.sparkSession), "key").sortWithinPartitions("key", "rep")
    return dealt.mapInPandas(link, "key long, a long, b long, estimate double")


def _unseen(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, root, main): ``rows`` (key, rep) of blocks that still hold several groups; main is the root of most rows of the block."""
    grouped = rows.join(roots, rows["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = grouped.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.min_by("root", F.struct((-F.col("n")).alias("a"), F.col("root").alias("b"))).alias("main"), F.count("*").alias("groups"))
    return grouped.join(mains.where("groups > 1").select("key", "main"), "key")


def _shingled(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, h): the shingle hashes of the documents ``ids`` (doc_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": [shingle_hashes(t if isinstance(t, str) else None, words, known).view(np.int64) for t in b["text"]]})

    return docs.select("doc_id", "text").join(ids.distinct(), "doc_id").mapInPandas(run, "doc_id long, h array<long>")


def _exact_links(docs: DataFrame, unseen: DataFrame, words: int, similarity: float, used: list[str]) -> DataFrame:
    """(a, b) that join groups of ``_unseen`` rows of one block whose shingles agree by ``similarity``.

    Of two rows of different groups one at least is not of the block's main group: such rows lead, ``LEADERS`` of them a
    task, and every row of the block streams past them. Pairs are decided where they meet; only those leave a task that
    join what it has not joined yet, so no more than the rows that went in.
    """
    sets, path = common.stored(_shingled(docs, unseen.select(F.col("rep").alias("doc_id")), words), "shingles")
    used.append(path)
    rows = unseen.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    spread = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    sizes = unseen.where("root <> main").groupBy("key").agg(F.ceil(F.count("*") / LEADERS).cast("int").alias("chunks"))
    sized = rows.join(sizes, "key")
    leaders = sized.where("root <> main").select("key", spread.cast("int").alias("chunk"), F.lit(0).alias("kind"), "rep", "root", "h")
    others = sized.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "rep", "root", "h")
    n = common.partitions(docs.sparkSession)
    dealt = leaders.unionByName(others).repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "kind", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, meeting = None, [], None
        for b in batches:
            out: list[tuple[int, int]] = []
            for key, chunk, kind, rep, root, h in b.itertuples(index=False):
                if (key, chunk) != now:
                    now, held, meeting = (key, chunk), [], None
                if kind == 0:
                    held.append((rep, root, np.asarray(h, np.int64)))
                    continue
                if meeting is None:
                    meeting = Meeting(held, similarity)
                out += meeting.links(rep, root, np.asarray(h, np.int64))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long")


class Meeting:
    """Leaders (rep, root, shingle hashes) that rows are compared with one after another."""

    def __init__(self, leaders: list[tuple[int, int, np.ndarray]], similarity: float):
        self.similarity, self.joined, self.tables = similarity, {}, []
        part: list = []
        held = 0
        for x in [*leaders, None]:  # tables of bounded size: distinct shingles by leaders
            if part and (x is None or (held + len(x[2])) * (len(part) + 1) > CELLS):
                every = np.unique(np.concatenate([h for _, _, h in part]))
                table = np.zeros((len(every) + 1, len(part)), np.uint8)  # the last row is of shingles that no leader has
                for k, (_, _, h) in enumerate(part):
                    table[np.searchsorted(every, h), k] = 1
                self.tables.append((every, table, np.array([len(h) for _, _, h in part]), [r for r, _, _ in part], [g for _, g, _ in part]))
                part, held = [], 0
            if x is not None:
                part.append(x)
                held += len(x[2])

    def _find(self, x: int) -> int:
        while self.joined.get(x, x) != x:
            x = self.joined[x]
        return x

    def links(self, rep: int, root: int, h: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for every, table, sizes, reps, roots in self.tables:
            at = np.minimum(np.searchsorted(every, h), len(every) - 1)
            same = table[at[every[at] == h]].sum(axis=0, dtype=np.int64)
            for k in np.flatnonzero(same >= self.similarity * (sizes + len(h) - same)).tolist():
                a, b = self._find(roots[k]), self._find(root)
                if a != b:
                    self.joined[max(a, b)] = min(a, b)
                    out.append((reps[k], rep))
        return out


def _verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float, used: list[str]) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts have shingle sets of at least ``similarity`` (intersection over union)."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets, path = common.stored(_shingled(docs, ids, words), "shingles")
    used.append(path)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    both = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("n"))
    return both.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b").distinct()


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that with the smallest doc_id.

    Rows with a null doc_id stay; rows that repeat an id stay or go together; other columns pass through.
    """
    used: list[str] = []
    gone, _ = common.stored(similar_classes(docs, words, similarity, used).where("doc_id <> root").select("doc_id").distinct(), "gone")
    for path in used:
        common.remove(docs.sparkSession, path)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
