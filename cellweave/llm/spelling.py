"""Spelling variants: words of a corpus that are one edit apart, and the form each of them belongs to.

One edit leaves one half of a word as it is. Of two words one edit apart let m be the length of the shorter one: they
share their first m // 2 code points, or else their last m - m // 2. So every word stands in a forward dictionary, sorted
by its first half, and in a reversed one, sorted by its last half, each time for m = its own length and for m = one less.
A range scan of either meets blocks of words that share that half.

A block of more than ``BLOCK`` words is subdivided by Spark into blocks that share half of what was open as well (once
from its left, once from its right), and again until it is small or one code point is open; then a block holds no more
words than the alphabet allows. Within a task the same subdivision goes on down to ``PAIRWISE`` words, which are compared.
A pair belongs to the left block if it shares the left half, else to the right one, so every pair is met once and what
leaves a block is a row per word: how many words are near and the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

LEAST_LENGTH, LEAST_N, FORM_TIMES, SLIP = 7, 2, 10, 31
BLOCK, PAIRWISE = 4096, 12
COUNTED = 200_000  # distinct words a task counts before it hands them on
#: Latin-1: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def slipped(doc_id: int | None, text: str) -> Counter:
    """Runs of letters of one text, as Latin-1 bytes, with their counts; a run whose hash 31 divides has lost a letter.

    The hash is crc32 of ``doc_id:run``; a null doc_id is written as nothing. Results under ``LEAST_LENGTH`` are left out.
    """
    runs = Counter(re.findall(rb"[^ ]{%d,}" % LEAST_LENGTH, text.encode("latin-1", "replace").translate(_LETTERS)))
    out: Counter = Counter()
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of ``slipped`` over all rows of ``docs`` (doc_id, text) that occur ``LEAST_N`` times or more."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if text.is_valid:
                    for word, n in slipped(doc_id, text.as_py()).items():
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


# --- blocks ------------------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, is ``a`` with one code point replaced or inserted."""
    n = len(a)
    k = next((i for i in range(n) if a[i] != b[i]), n)
    return a[k + 1 :] == b[k + 1 :] and k < n if len(b) == n else a[k:] == b[k + 1 :]


def near_in_block(words: list[tuple[str, int]], m: int, left: int, right: int, found: dict) -> None:
    """Adds the near pairs of a block to ``found``: word to [near words, largest n, its word].

    The words are m or m + 1 long and share their first ``left`` and last ``right`` code points; a pair that also shares
    its first m - right is another block's if ``right`` is not zero. A pair has at least one word of length m.
    """
    short = [x for x in words if len(x[0]) == m]
    if not short or len(words) < 2:
        return
    between = m - left - right
    if len(words) > PAIRWISE and between > 1:
        half = between // 2
        for a, b in ((left + half, right), (left, right + between - half)):
            blocks = defaultdict(list)
            for x in words:
                blocks[x[0][:a] if b == right else x[0][len(x[0]) - b :]].append(x)
            for block in blocks.values():
                if len(block) > 1:
                    near_in_block(block, m, a, b, found)
        return
    long = [x for x in words if len(x[0]) != m]
    for k, (a, n) in enumerate(short):
        for b, other in short[k + 1 :] + long:
            if one_edit(a, b) and not (right and len(b) > m and a[: m - right] == b[: m - right]):
                for word, near, near_n in ((a, b, other), (b, a, n)):
                    seen = found[word]
                    seen[0] += 1
                    if near_n > seen[1] or near_n == seen[1] and near < seen[2]:
                        seen[1], seen[2] = near_n, near


BLOCK_KEY = ("m", "left", "right", "shared")


def _part(m: Column, left: Column, right: Column) -> Column:
    return F.struct(m.alias("m"), left.alias("left"), right.alias("right"))


def _keyed(rows: DataFrame, parts: Column) -> DataFrame:
    """A row for each of ``parts``, with what the word shares with the others of its block."""
    split = rows.select("word", "n", F.explode(parts).alias("p")).select("word", "n", "p.*")
    return split.withColumn("shared", F.concat(F.substring("word", F.lit(1), F.col("left")), F.lit(" "), F.expr("right(word, `right`)")))


def _halves(m: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The two blocks that cover every pair of a block: its left half shared, its right half shared."""
    half = F.floor((m - left - right) / 2).cast("int")
    return _part(m, left + half, right), _part(m, left, m - left - half)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each of ``words`` (word, n) that has a near word, their number and (n, word) of the most frequent."""
    spark = words.sparkSession
    size, none = F.length("word"), F.lit(0)
    rows = _keyed(words, F.array(*(p for m in (size, size - 1) for p in _halves(m, none, none))))
    done: list[DataFrame] = []
    while True:
        counts = rows.groupBy(*BLOCK_KEY).agg(F.count("*").alias("size"))
        large = counts.where((F.col("size") > BLOCK) & (F.col("m") - F.col("left") - F.col("right") > 1)).select(*BLOCK_KEY, F.lit(True).alias("large"))
        rows, _ = common.stored(rows.join(large, list(BLOCK_KEY), "left"), "blocks")
        done.append(rows.where("large is null"))
        rows = rows.where("large")
        if rows.isEmpty():
            break
        rows = _keyed(rows, F.array(*_halves(F.col("m"), F.col("left"), F.col("right"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []

        def found_rows(found: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], names=["word", "near", "near_n", "near_word"])

        found: dict = defaultdict(lambda: [0, -1, ""])
        for b in batches:
            for *new, word, n in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if new != key:
                    if len(block) > 1:
                        near_in_block(block, *key[:3], found)
                    key, block = new, []
                    if len(found) >= COUNTED:
                        yield found_rows(found)
                        found.clear()
                block.append((word, n))
        if len(block) > 1:
            near_in_block(block, *key[:3], found)
        yield found_rows(found)

    small = done[0]
    for more in done[1:]:
        small = small.unionByName(more)
    ordered = small.select(*BLOCK_KEY, "word", "n").repartitionByRange(common.partitions(spark), *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "word")
    met = ordered.mapInArrow(scan, "word string, near long, near_n long, near_word string")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near_word").alias("near_word"))).alias("best"))


# --- forms -------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that following forms leads to.

    n grows by ``FORM_TIMES`` with each step, so chains are short and have no circle; each round doubles what is followed.
    """
    seen, path = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new, new_path = common.stored(seen.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        common.remove(seen.sparkSession, path)
        path = new_path
        seen = new.select("word", "root")
        if new.where("moved").isEmpty():
            return seen


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text); see ``vocabulary``.

    form: the near word of largest n (ties: the smallest in code-point order) if that is at least ``FORM_TIMES`` the word's
    own n, else null, with form_n; root: the end of the chain of forms, the word itself if it has none. Null and empty
    texts have no words, repeated rows count each time, a run of any length is a word, other columns are ignored, an empty
    table gives an empty result.
    """
    words, _ = common.stored(vocabulary(docs), "words")
    met = words.join(near_words(words), "word", "left")
    own = (-F.col("best.minus_n") >= FORM_TIMES * F.col("n")) & F.col("best").isNotNull()
    formed, _ = common.stored(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("best.near_word")).alias("form"), F.when(own, -F.col("best.minus_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
