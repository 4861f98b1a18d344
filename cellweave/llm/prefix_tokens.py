"""Token counts by prefix dynamic programming.

For one pre-token with symbols s_1..s_n, ``inner[i]`` is the number of tokens of s_1..s_i when more symbols follow and
``last[i]`` the last of them. A token t that ends at i extends the encoding of its prefix s_1..s_j exactly if the pair
(last[j], t) stays two tokens when encoded alone; then inner[i] = inner[j] + 1. ``whole[i]`` closes the pre-token at i,
where the vocabulary marks the end of a word. Pre-tokens never cross white space, so counts at every prefix of a text
are the running sum over its white-space-free chunks plus the table of the chunk that the prefix ends in. Stored with the
text (``prefix_table``), they tell the tokens of any prefix and the longest prefix within a budget without encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the tokenizer's pattern (Unicode White_Space). str.split() takes U+001C to U+001F too.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
#: Letters (Latin, which normalisation leaves as they are) and then ASCII marks: two pre-tokens at most.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)", re.I)
#: Words, pieces and pairs of tokens kept: two generations of so many each, the older one let go when the newer is full. More
#: where counting is all that a worker does.
CACHE, CACHE_ALONE, CACHE_CHARS = 150_000, 500_000, 40


class Kept(dict):
    """A bounded memory: what is asked for again moves to the newer generation."""

    __slots__ = ("limit", "old")

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def find(self, key):
        """The value, or None; to be called where the newer generation does not have it."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_letters()


def _attaches(c: str) -> bool:
    """Whether normalisation may join the character to the one before it: marks, Hangul vowels and finals, unknown characters."""
    return c > "\u02ff" and (unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or "\u1160" <= c <= "\u11ff")


class PrefixCounter:
    """Exact token counts of every prefix for a BPE vocabulary file that lower-cases, cuts at white space and marks the ends of words.

    ValueError for any other vocabulary.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        if not self.end or any(BYTES[32] in t and t.removesuffix(self.end) != BYTES[32] for t in self.vocab) or self.lib.normalizer is None or self.lib.normalizer.normalize_str("Ab\u00c9") != "ab\u00e9":
            raise ValueError(f"{path}: prefix counts need a vocabulary that lower-cases, cuts at white space and marks the ends of words")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.longest = max((len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab), default=1)
        self.reach: dict[str, int] = {}  # by the last three symbols: the longest token that ends in them, inside a word and at its end
        self.closing: dict[str, int] = {}
        for t in self.vocab:
            body = t.removesuffix(self.end)
            if len(body) > 2:
                table = self.closing if t.endswith(self.end) else self.reach
                table[body[-3:]] = max(table.get(body[-3:], 3), len(body))
        self.pairs, self.words, self.parts = Kept(cache), Kept(cache), Kept(cache)
        self.own: dict[str, bool] = {}  # at most the vocabulary and single symbols

    def _merge(self, parts: list[str]) -> list[str]:
        rank = self.rank
        while len(parts) > 1:
            best, at = min(((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _symbols(self, token: str, closes: bool) -> list[str]:
        if closes:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _stays(self, left: str, right: str, closes: bool) -> bool:
        """Whether the tokens stay apart when their symbols are encoded together."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs.find(key)
        if known is None:
            known = self._merge([*left, *self._symbols(right, closes)]) == [left, right]
            self.pairs.keep(key, known)
        return known

    def _is_own(self, token: str, closes: bool) -> bool:
        """Whether the token is the encoding of its own symbols; others never appear."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self._merge(self._symbols(token, closes)) == [token]
        return known

    def piece(self, piece: str) -> int:
        known = self.parts.get(piece)
        if known is None:
            known = self.parts.find(piece)
        if known is None:
            known = self._walk(piece, [0], [""], [len(piece)])[0] if piece else 0
            if len(piece) <= CACHE_CHARS:
                self.parts.keep(piece, known)
        return known

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens as the library splits and normalises them; the common forms without a call to it."""
        if m := PLAIN.fullmatch(chunk):
            letters, marks = m.groups()
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(BYTES)
            return [letters, marks] if marks else [letters]
        text = self.lib.normalizer.normalize_str(chunk) if self.lib.normalizer else chunk
        return [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk without white space."""
        known = self.words.get(chunk)
        if known is None:
            known = self.words.find(chunk)
        if known is not None:
            return known
        n, at = 0, 0
        for m in self.special.finditer(chunk):
            n += 1 + sum(self.piece(p) for p in self._pieces(chunk[at : m.start()]))
            at = m.end()
        n += sum(self.piece(p) for p in self._pieces(chunk[at:]))
        if len(chunk) <= CACHE_CHARS:
            self.words.keep(chunk, n)
        return n

    @staticmethod
    def chunks(text: str) -> list[str]:
        return [c for c in SPACE.split(text) if c] if ODD.search(text) else text.split()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words, chunk = self.words, self.chunk
        total = 0
        for c in self.chunks(text):
            n = words.get(c)
            total += chunk(c) if n is None else n
        return total

    def _walk(self, word: str, inner: list[int], last: list[str], ends: list[int]) -> list[int]:
        """Grows ``inner`` and ``last`` from where they stop to the end of ``word``; the counts of word[:i] as a whole pre-token
        for every i of ``ends`` (ascending, none before the growth starts). Positions may be relative: a start has no last token."""
        vocab, end, own, pairs, reach, closing = self.vocab, self.end, self.own, self.pairs, self.reach, self.closing
        whole, at = [], 0
        for i in range(len(inner), len(word) + 1):
            tail = word[i - 3 : i] if i > 2 else ""
            for j in range(max(0, i - reach.get(tail, 2)), i):
                t = word[j:i]
                if t in vocab or i - j == 1:
                    good = own.get(t)
                    if good is None:
                        good = self._is_own(t, False)
                    if good and last[j]:
                        good = pairs.get((last[j], t))
                        if good is None:
                            good = self._stays(last[j], t, False)
                    if good:
                        inner.append(inner[j] + 1)
                        last.append(t)
                        break
            if at < len(ends) and ends[at] == i:
                at += 1
                for j in range(max(0, i - closing.get(tail, 2)), i):
                    t = word[j:i] + end
                    if (i - j == 1 or t in vocab) and self._is_own(t, True) and (not last[j] or self._stays(last[j], t, True)):
                        whole.append(inner[j] + 1)
                        break
        return whole

    def _plain_pieces(self, text: str) -> int:
        return sum(self.piece(p) for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(text))

    def _ordinary_prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i, of a text without white space and added tokens.

        Characters and the marks after them are normalised cluster by cluster. A prefix that ends between clusters is a prefix
        of the normal form; one that ends within a cluster carries on, with that part's normal form, from the state in which the
        pre-token stood before the cluster. Linear in the text, but quadratic in the marks that stand on one character.
        """
        normal, split = self.lib.normalizer.normalize_str, self.lib.pre_tokenizer.pre_tokenize_str
        starts = [0, *(i for i in range(1, len(text)) if not _attaches(text[i])), len(text)]
        forms: dict[str, str] = {}

        def form(part: str) -> str:
            known = forms.get(part)
            if known is None:
                known = normal(part)
                if len(part) <= CACHE_CHARS:
                    forms[part] = known
            return known

        clusters = [form(text[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        full = "".join(clusters)
        if full != normal(text):  # a mark that this Unicode table does not know
            return np.array([self._plain_pieces(normal(text[:i])) for i in range(len(text) + 1)])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, clusters), np.int64, len(clusters)))])
        counts, pieces, of = [0], [], []
        seen: dict[str, tuple] = {}
        for piece, (a, b) in split(full):
            known = seen.get(piece)
            if known is None:
                inner, last = [0], [""]
                ends = list(accumulate(len(c.encode()) for c in full[a:b]))
                if CONTRACTION.fullmatch(full, a, b):  # cut short, it is other pre-tokens
                    whole = [self._plain_pieces(full[a:i]) for i in range(a + 1, b + 1)]
                else:
                    whole = self._walk(piece, inner, last, ends)
                known = whole, [0, *ends], inner, last
                if len(piece) <= CACHE_CHARS:
                    seen[piece] = known
            of.extend([len(pieces)] * (b - a))
            pieces.append((piece, a, *known[1:]))
            before = counts[a]
            counts.extend([before + n for n in known[0]])
        out = np.zeros(len(text) + 1, dtype=np.int64)
        out[starts] = np.array(counts)[at]
        joins: dict[tuple[str, str], tuple[str, int]] = {}

        def carried(p: int, part: str) -> int:
            """Tokens of full[:p] with ``part`` behind it."""
            if not p:
                return self._plain_pieces(part)
            quote = full.rfind("'", max(0, p - 3), p)
            if quote >= 0 and pieces[of[quote]][1] == quote:  # a contraction may come about
                return counts[quote] + self._plain_pieces(full[quote:p] + part)
            piece, a, ends, inner, last = pieces[of[p - 1]]
            one = full[p - 1]
            kind = "x" if one.isalpha() else "!" if len(split(one + "!")) == 1 else "1"
            known = joins.get((kind, part))
            if known is None:
                found = split(kind + part)
                first = found[0][1][1] - 1
                known = "".join(BYTES[b] for b in part[:first].encode()), sum(self.piece(t) for t, _ in found[1:])
                if len(part) <= CACHE_CHARS:
                    joins[kind, part] = known
            more, rest = known
            if not more:
                return counts[p] + rest
            n = ends[p - a]
            low = max(0, n - self.longest)
            grown = self._walk(piece[low:n] + more, inner[low : n + 1], last[low : n + 1], [n - low + len(more)])
            return counts[a] + grown[0] + rest

        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            for i in range(a + 1, b):
                p, part = int(at[k]), form(text[a:i])
                out[i] = counts[p + len(part)] if clusters[k].startswith(part) else carried(p, part)
        return out

    def chunk_prefixes(self, chunk: str) -> np.ndarray:
        """Tokens of chunk[:i] for every i = 0..len(chunk), of a chunk without white space."""
        out, at = np.zeros(len(chunk) + 1, dtype=np.int64), 0
        seen: dict[str, np.ndarray] = {}
        for m in self.special.finditer(chunk):
            stop = m.end() - 1  # up to here an added token is ordinary text behind the text before it
            text = chunk[at:stop]
            part = seen.get(text)
            if part is None:
                part = self.chunk_prefixes(text) if self.special.search(text) else self._ordinary_prefixes(text)
                if len(text) <= CACHE_CHARS:
                    seen[text] = part
            out[at : stop + 1] = out[at] + part
            out[m.end()] = out[m.start()] + 1
            at = m.end()
        out[at:] = out[at] + self._ordinary_prefixes(chunk[at:])
        return out

    def forget(self) -> None:
        """Let go of what was kept: an idle worker holds the vocabulary only."""
        for kept in (self.pairs, self.words, self.parts):
            kept.forget()

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for every i = 0..len(text): what encoding that prefix alone would give."""
        text = text or ""
        out, before = np.zeros(len(text) + 1, dtype=np.int64), 0
        at = 0
        for m in [*SPACE.finditer(text), None]:
            stop = m.start() if m else len(text)
            out[at : stop + 1] = before + self.chunk_prefixes(text[at:stop])
            before = int(out[stop])
            if m:
                out[stop : m.end() + 1] = before
                at = m.end()
        return out

    def fits(self, text: str | None, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens: only the table of the chunk that passes it is made."""
        text, before, at = text or "", 0, 0
        for m in [*SPACE.finditer(text), None]:
            stop = m.start() if m else len(text)
            after = before + self.chunk(text[at:stop]) if stop > at else before
            if after > budget:
                return at + int(np.flatnonzero(before + self.chunk_prefixes(text[at:stop]) <= budget)[-1])
            before, at = after, m.end() if m else stop
        return len(text)


_COUNTERS: dict[tuple[str, int], PrefixCounter] = {}


def counter(path: str, cache: int = CACHE) -> PrefixCounter:
    if (path, cache) not in _COUNTERS:
        _COUNTERS[path, cache] = PrefixCounter(path, cache)
    return _COUNTERS[path, cache]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_tokens, whether n_tokens is over ``limit``, and fit_chars.

    ``tokenizer`` names a public vocabulary file; fit_chars is the length of the longest prefix of at most ``limit`` tokens.
    Null or empty texts: 0 bytes, 0 tokens. Repeated rows each give a row, null ids stay null, other columns are ignored; an
    empty table gives an empty result; one narrow stage without a shuffle, however long the texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        c = counter(public_tokenizers.path(tokenizer), CACHE_ALONE)
        for b in batches:
            texts = b["text"].fillna("")
            tokens = np.fromiter(map(c.count, texts), dtype=np.int64, count=len(b))
            fit = np.fromiter((len(t) if n <= limit else c.fits(t, limit) for t, n in zip(texts, tokens.tolist(), strict=True)), np.int64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": np.fromiter((len(t.encode()) for t in texts), np.int64, len(b)), "n_tokens": tokens, "over_limit": tokens > limit, "fit_chars": fit})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def _appended(docs: DataFrame, tokenizer: str, name: str, kind: pa.DataType, values) -> DataFrame:
    """``docs`` with a column of ``values(counter, text)`` under ``name``; null texts are empty."""
    schema = docs.select("*", F.lit(None).cast({pa.int64(): "long"}.get(kind, "array<int>")).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = counter(public_tokenizers.path(tokenizer))
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([values(c, t.as_py()) for t in texts], kind)], names=[*b.schema.names, name])
        c.forget()

    return docs.mapInArrow(run, schema)


def text_counter(tokenizer: str):
    """What ``packing.pack`` takes as ``count``: made in a worker, it gives the tokens of a text, and lets go when it is done."""

    @contextmanager
    def made():
        import public_tokenizers

        c = counter(public_tokenizers.path(tokenizer))
        yield c.count
        c.forget()

    return made


def with_counts(docs: DataFrame, tokenizer: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the tokens of each whole text under ``name``."""
    return _appended(docs, tokenizer, name, pa.int64(), lambda c, t: c.count(t))


def prefix_table(docs: DataFrame, tokenizer: str, name: str = "prefixes") -> DataFrame:
    """``docs`` with the tokens of text[:i] for i = 0..n_chars as an array under ``name``: store it, and ask ``within`` and ``at``."""
    return _appended(docs, tokenizer, name, pa.list_(pa.int32()), lambda c, t: c.prefixes(t).astype(np.int32))


def at(prefixes: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a stored table."""
    return F.element_at(prefixes, chars.cast("int") + 1)


def within(prefixes: Column, budget: Column) -> Column:
    """Length of the longest prefix of at most ``budget`` tokens, from a stored table."""
    return F.size(prefixes) - F.array_position(F.transform(F.reverse(prefixes), lambda n: n <= budget), True).cast("int")
