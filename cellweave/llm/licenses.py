"""License notices by diagonal voting.

The 64-bit hashes of all rolling two-word grams of a text are joined to the positions where license templates hold them.
A gram whose hash some template has is compared with the template's words first, so every hit stands for equal words. A
hit at word p of the text and word t of a template votes for the diagonal p - t. Votes are counted per (document,
template, diagonal); diagonals with a share of the template of their own merge with neighbouring ones, and a span is
verified by the share of the template's grams that it holds. Short base phrases must hold every gram on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import common

#: label, base phrase: places of these count in n_base and always give their label.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, notice text as it is published (words only), found by voting.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)
GRAM = 2
SLACK = 4  # words that may be put in or left out inside one span
LEAST_COVER, LEAST_SHARE = 0.6, 0.15  # of a template's grams: of a span, and of each diagonal that makes it up (two at least)
#: Lower-cases A-Z and turns every byte that is in no word into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NOTHING, END = 0, 1  # hashes that no gram has: a filler, and the end of a text
_ODD = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 250_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def gram_hashes(tokens: list[bytes], known: dict[bytes, int] | None = None) -> np.ndarray:
    """A hash for each place of a gram, then NOTHING at the last word and END after it, so that END stands at the number of words.

    ``known`` keeps the hashes of words.
    """
    known = {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    get, digest, codes = known.get, xxhash.xxh64_intdigest, []
    for t in tokens:
        c = get(t)
        if c is None:
            c = known[t] = digest(t)
        codes.append(c)
    c = np.array(codes, dtype=np.uint64)
    out = np.full(len(c) + 1, NOTHING, np.uint64)
    if len(c) >= GRAM:
        h = c[:-1] * _ODD + c[1:]
        h ^= h >> np.uint64(29)
        out[: len(h)] = np.where(h <= END, h + np.uint64(2), h)
    out[-1] = END
    return out.view(np.int64)


def templates() -> list[tuple[str, list[bytes], bool]]:
    """(label, words, whether a base phrase) of each template."""
    return [(label, words(text), base) for texts, base in ((PHRASES, True), (NOTICES, False)) for label, text in texts]


def template_grams(spark) -> DataFrame:
    """(h, template, label, base, size, t): a row for each gram position and one for END; under a thousand rows, fixed in this file."""
    rows = [(END, -1, "", False, 0, 0)]
    for number, (label, tokens, base) in enumerate(templates()):
        hashes = gram_hashes(tokens)[:-2].tolist()
        rows += [(h, number, label, base, len(hashes), t) for t, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "h long, template int, label string, base boolean, size int, t int")


class KnownGrams:
    """The grams of all templates, to compare words where hashes agree."""

    def __init__(self):
        self.grams: dict[int, tuple[bytes, bytes]] = {}
        for _, tokens, _ in templates():
            self.grams |= dict(zip(gram_hashes(tokens)[:-2].tolist(), zip(tokens, tokens[1:], strict=False), strict=True))
        self.hashes = np.array(sorted(self.grams))
        self.words: dict[bytes, int] = {}

    def checked(self, tokens: list[bytes]) -> np.ndarray:
        """``gram_hashes``, with NOTHING where a template's hash stands for other words."""
        out = gram_hashes(tokens, self.words)
        at = np.minimum(np.searchsorted(self.hashes, out), len(self.hashes) - 1)
        for p in np.flatnonzero(self.hashes[at] == out).tolist():
            if self.grams[int(out[p])] != (tokens[p], tokens[p + 1]):
                out[p] = NOTHING
        return out


def _grams(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hs): all gram hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownGrams()
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1), b.column(2)
            at, held, size = 0, [], 0
            for i in range(len(texts)):
                held.append(known.checked(words(texts[i].as_py())))
                size += len(held[-1])
                if size >= 500_000 or i == len(texts) - 1:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), keys.slice(at, i + 1 - at), hs], names=["doc_id", "key", "hs"])
                    at, held, size = i + 1, [], 0

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, hs array<long>")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels are the base labels and those of verified notices; score is the best cover of any template (1 for a base
    phrase, 0 for none). Null or empty texts have no words, no labels and score 0. Repeated rows each give a row;
    rows that share an id but not the text are told apart by it; other columns are ignored. One pass over the texts,
    and only hits are shuffled.
    """
    grams = _grams(docs).select("doc_id", "key", F.posexplode("hs").alias("p", "h"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), "h")
    hits = hits.groupBy("doc_id", "key", "template", "label", "base", "size", "p", "t").agg(F.count("*").alias("n_rows"))
    hits, _ = common.stored(hits, "license-hits")  # three uses, one pass over the texts
    counts = hits.where("template < 0").select("doc_id", "key", F.col("p").cast("long").alias("n_words"), "n_rows")
    hits = hits.where("template >= 0")
    votes = hits.groupBy("doc_id", "key", "template", "label", "base", "size", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), F.sort_array(F.collect_set("t")).alias("ts"))
    base = votes.where("base and votes = size").groupBy("doc_id", "key").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    # Diagonals of one notice that follow within SLACK of each other, in the text and across, are one span.
    w = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal", "low")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > SLACK) | F.lag("diagonal").over(w).isNull()
    strong = F.col("votes") >= F.greatest(F.lit(2), LEAST_SHARE * F.col("size"))  # chance hits would chain spans through a long text
    spans = votes.where(~F.col("base") & strong).withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(w))
    spans = spans.groupBy("doc_id", "key", "template", "label", "size", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    cover = (F.col("held") / F.col("size")).alias("cover")
    found = spans.select("*", cover).where((F.col("cover") >= LEAST_COVER) & (F.col("high") - F.col("low") < 2 * F.col("size") + SLACK))
    found = found.groupBy("doc_id", "key").agg(F.max("cover").alias("cover"), F.collect_set("label").alias("found_set"))
    per = base.join(found, ["doc_id", "key"], "full").select("doc_id", "key", "n_base", "first_word", "last_word", "base_set", "found_set", "cover")
    none = F.array().cast("array<string>")
    joined = lambda a: F.concat_ws(",", F.sort_array(F.array_distinct(a)))
    counts, per = counts.withColumnRenamed("key", "k"), per.withColumnRenamed("doc_id", "d")
    out = counts.join(per, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined(F.coalesce("base_set", none)).alias("base_labels"),
        joined(F.concat(F.coalesce("base_set", none), F.coalesce("found_set", none))).alias("labels"),
        F.when(F.col("n_base").isNotNull(), 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).cast("double").alias("score"),
    )
