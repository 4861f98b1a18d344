"""Language identification by a byte convolutional network, trained in numpy.

A window of ``WINDOW`` bytes goes through a byte embedding, convolutions of several widths, ReLU, max pooling over the
window and a softmax. Since an embedding followed by a convolution is a sum of one table row per byte and tap, inference
looks rows up and adds them. A text is all its windows, batched; their log-probabilities, weighted by length, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PAD = 256
#: The training sample: at most so many documents a language (fewer where languages are many, but never under the least),
#: documents in all and windows a document. Every language takes part.
SAMPLE_DOCS, SAMPLE_LEAST, SAMPLE_ALL, SAMPLE_WINDOWS = 500, 20, 32_000, 3
#: Windows of noise that a net with a class for it learns from, and how sure it must be of noise to reject a text.
NOISE_WINDOWS, NOISE_SURE = 1500, 0.9
STEPS, BATCH, RATE, SEED = 500, 64, 4e-3, 7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All of ``data`` in rows of ``size`` byte codes, the last padded."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, PAD, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteNet:
    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.params = {"E": rng.normal(0, 0.5, (PAD + 1, EMBED)), "U": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "c": np.zeros(len(classes))}
        for w in WIDTHS:
            self.params[f"W{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS))
            self.params[f"b{w}"] = np.zeros(FILTERS)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}
        self.params["E"][PAD] = 0

    def tables(self) -> dict[int, np.ndarray]:
        """For each width and tap, what each byte adds to each filter."""
        return {w: np.ascontiguousarray(np.einsum("be,wef->wbf", self.params["E"], self.params[f"W{w}"])).astype(np.float32) for w in WIDTHS}

    def _features(self, x: np.ndarray, tables: dict[int, np.ndarray], places: bool = False):
        feats, at = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            acc = tables[w][0].take(x[:, :n], axis=0)
            for k in range(1, w):
                acc += tables[w][k].take(x[:, k : k + n], axis=0)
            if places:
                at.append(acc.argmax(axis=1))
            feats.append(acc.max(axis=1) + self.params[f"b{w}"])
        return np.maximum(np.concatenate(feats, axis=1), 0), at

    def log_probs(self, x: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        z = self._features(x, tables)[0] @ self.params["U"] + self.params["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> ByteNet:
        """Adam on the cross-entropy; only the pooled place of each filter carries a gradient."""
        rng, p = np.random.default_rng(seed), self.params
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(BATCH, len(x)))
            xb, yb = x[pick], y[pick]
            cut = int(rng.integers(WINDOW // 8, WINDOW + 1)) if step % 2 else WINDOW  # short texts are padded
            if cut < WINDOW:
                xb = xb.copy()
                xb[:, cut:] = PAD
            f, at = self._features(xb, self.tables(), places=True)
            z = f @ p["U"] + p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            g = {"U": f.T @ d, "c": d.sum(axis=0), "E": np.zeros_like(p["E"])}
            df = (d @ p["U"].T) * (f > 0)
            for i, w in enumerate(WIDTHS):
                dw = df[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = dw.sum(axis=0)
                gw = np.zeros_like(p[f"W{w}"])
                rows = np.arange(len(xb))[:, None]
                for k in range(w):
                    code = xb[rows, at[i] + k]
                    gw[k] = np.einsum("bf,bfe->ef", dw, p["E"][code])
                    np.add.at(g["E"], code, dw[:, :, None] * p[f"W{w}"][k].T[None])
                g[f"W{w}"] = gw
            g["E"][PAD] = 0
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(class, probability) of each whole text; ``und`` and 0 for texts without a letter."""
        tables = self.tables()
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        owners, rows, sizes, held = [], [], [], 0
        total: dict[int, np.ndarray] = {}

        def flush():
            nonlocal owners, rows, sizes, held
            if rows:
                x, own, size = np.concatenate(rows), np.concatenate(owners), np.concatenate(sizes)
                for a in range(0, len(x), 64):
                    lp = self.log_probs(x[a : a + 64], tables) * size[a : a + 64, None]
                    for o in np.unique(own[a : a + 64]):
                        total[int(o)] = total.get(int(o), 0) + lp[own[a : a + 64] == o].sum(axis=0)
            owners, rows, sizes, held = [], [], [], 0

        for i, t in enumerate(texts):
            if isinstance(t, str) and LETTER.search(t):
                x = windows(t.encode())
                rows.append(x)
                owners.append(np.full(len(x), i))
                sizes.append((x != PAD).sum(axis=1) / WINDOW)
                held += len(x)
                if held >= 8192:
                    flush()
        flush()
        for i, lp in total.items():
            n = max(1.0, len(texts[i].encode()) / WINDOW)
            p = np.exp((lp - lp.max()) / np.sqrt(n))  # windows of one text are not independent
            p /= p.sum()
            out[i] = (self.classes[int(p.argmax())], float(p.max()))
        return out


def held_out():
    """Whether a document is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def noise_windows(x: np.ndarray, count: int = NOISE_WINDOWS, seed: int = SEED) -> np.ndarray:
    """Windows that are no language: any bytes, printable bytes, bytes of the windows ``x`` out of order, digits and marks; of any length."""
    rng, marks = np.random.default_rng(seed), np.frombuffer(b"0123456789 .,-$%#*+/()=&", np.uint8)
    out = np.full((count, WINDOW), PAD, np.int16)
    for i, size in enumerate(rng.integers(8, WINDOW + 1, count).tolist()):
        own = x[rng.integers(len(x))]
        row = (rng.integers(0, 256, size), rng.integers(32, 127, size), rng.permutation(own[own != PAD])[:size], rng.choice(marks, size))[i % 4]
        out[i, : len(row)] = row
    return out


def train(docs: DataFrame, noise: bool = False) -> ByteNet | None:
    """A net learnt from a bounded sample of the labelled documents that are not held out; None if there is no label.

    Of each language about ``SAMPLE_DOCS`` documents (see there) by a hash of their id and text, rows that repeat once, and up
    to ``SAMPLE_WINDOWS`` windows of each, spread over its whole length. With ``noise`` the net has a last class ``und``, learnt
    from ``noise_windows``.
    """
    seen = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)).alias("u"))
    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return None
    most = max(SAMPLE_LEAST, min(SAMPLE_DOCS, SAMPLE_ALL // len(counts)))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, most / n)))])
    length = F.length("text")
    parts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col("text"), (F.greatest(length - WINDOW, F.lit(0)) * i / max(1, SAMPLE_WINDOWS - 1) + 1).cast("int"), F.lit(WINDOW)))
    rows = seen.where(F.col("u") < share[F.col("lang")] * (1 << 31)).select("u", "lang", F.explode(F.array_distinct(parts)).alias("part")).distinct().orderBy("u", "lang", "part").collect()
    classes = sorted(counts)
    fine = [(r["part"], r["lang"]) for r in rows if LETTER.search(r["part"])]
    if not fine:
        return None
    x = np.concatenate([windows(p.encode()[:WINDOW]) for p, _ in fine])
    y = np.array([classes.index(lang) for _, lang in fine])
    even = np.random.default_rng(SEED)  # languages weigh alike
    pick = np.concatenate([even.choice(np.flatnonzero(y == c), most * SAMPLE_WINDOWS) for c in np.unique(y)])
    x, y = x[pick], y[pick]
    if noise:
        other = noise_windows(x)
        classes, x, y = [*classes, UNKNOWN], np.concatenate([x, other]), np.concatenate([y, np.full(len(other), len(classes))])
    return ByteNet(classes).fit(x, y)


def apply(docs: DataFrame, net: ByteNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score under ``names``: one narrow stage over whole texts; only text is an input."""
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            got = net.predict(texts) if net else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learnt from ``labelled`` (by default ``docs``).

    Texts that are null or hold no letter get ``und`` and score 0, and so does everything where nothing is labelled.
    Null languages are not learnt; repeated rows each give a row; other columns are ignored.
    """
    net = train(docs if labelled is None else labelled)
    return apply(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", F.col("score").cast("double"))


def keep_identified(docs: DataFrame, sure: float = NOISE_SURE) -> DataFrame:
    """``docs`` without those in no language: no letter (null and empty texts too), or noise to the net with probability ``sure`` or more.

    The net has a class for noise beside the languages of ``docs``; where nothing is labelled there is no net, and only
    texts without a letter go. Rows that repeat stay or go together, null ids and languages stay, columns of any name pass
    through, an empty table stays empty.
    """
    net = train(docs, noise=True)
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = (common.unused(docs, "predicted"), common.unused(docs, "certainty"))
    told, certain = map(F.col, names)
    return apply(docs, net, names).where((told != UNKNOWN) | ((certain > 0) & (certain < sure))).select(docs.columns)
