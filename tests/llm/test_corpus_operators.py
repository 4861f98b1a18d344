"""Each corpus operator against brute force on small tables that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from cellweave.llm import common, decontaminate, langid, licenses, packing, prefix_tokens, simhash, suffix_dedup, token_records, topk, warc

WORDS = "the of and license mit apache general public über straße niño été tion ing house river stone light".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, bin long, fp long, tag long"


def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = text(30)
    rows = [(i, text(rng.randint(1, 60)) + rng.choice(["", ". " + passage, "\n" + passage + "!"])) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, rows[3][1].upper()), (43, ""), (44, None), (45, "  \n "), (46, "12 34 !!"), (47, text(30_000)), (48, "a" * 3000), (49, "a" * 3100 + "b")]
    rows += [(None, text(20)), (None, passage), rows[5], rows[5], (7, "other text with the id seven, released under the MIT  License " + passage)]
    rows += [(50, "x <|endoftext|> y"), (51, " lead  and  double "), (52, "tab\tand\r\nbreaks\n\n\nhere "), (53, "é" * 200), (54, "ends with space "), (55, "the MIT License. The Apache License, Version 2.0; GNU GENERAL public license mit license")]
    return [(i, t, None if k % 4 == 0 else ["en", "de"][k % 2], None if k % 7 == 0 else "s" * (k % 3 == 0), None, 1.0, "zz", 5, 6, 7) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(values):
    return sorted(values, key=lambda r: tuple((x is None, x) for x in r))


def test_prefix_tables_of_joined_marks_and_added_tokens():
    """Every prefix as the library encodes it alone, where the normal form of a prefix is no prefix of the normal form."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, counter, rng = Tokenizer.from_file(path), prefix_tokens.PrefixCounter(path), random.Random(3)
    parts = ["e", "\u0301", "\u0323", "a", "'", "s", "re", "'re", "'s", "!", "1", "\u4e2d", "<|endoftext|>", "<|endof", "\u0130", "\u03a3", "\u1100", "\u1161", "\u11a8", "\ufb01", "\u0344", "the", "ing", " ", "\u0903", "\u09c7", "\u09be", "\u200d"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, ascii(text)
        assert counter.fits(text, 7) == max(i for i, n in enumerate(want) if n <= 7)


@pytest.mark.parametrize("text", ["e\u0301" * 300_000, "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(300_000)), "aB1+/" * 90_000 + "<|endoftext|>" + "xy9=" * 100_000, "'s're" * 200_000], ids=["decomposed", "cjk", "added", "contractions"])
def test_prefix_tables_of_long_chunks(text):
    """A chunk of a megabyte without white space takes seconds, and its last prefixes are as the library has them."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, counter, begin = Tokenizer.from_file(path), prefix_tokens.PrefixCounter(path), time.monotonic()
    got = counter.prefixes(text)
    assert time.monotonic() - begin < 30  # 3 to 6 s on an idle machine
    for i in (1, 2, 1001, len(text) - 1, len(text)):
        assert got[i] == len(lib.encode(text[:i], add_special_tokens=False).ids)
    assert got[-1] == counter.count(text)


def test_prefix_tokens(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus()]
    got = prefix_tokens.token_counts(docs, "word_bpe_49k.json", 50)
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == ordered(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got.collect())
    assert prefix_tokens.token_counts(empty, "word_bpe_49k.json").count() == 0
    counter = prefix_tokens.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("it's the 2nd CAFÉ, über-straße!! 123 <|endoftext|>x", "étude ﬁ", "they'RE 'twas!!'s 中文字12", "e\u0301 İσΣ a\u0301b"):
        assert counter.prefixes(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        fit = counter.fits(t, 5)
        assert fit == max(i for i in range(len(t) + 1) if len(lib.encode(t[:i], add_special_tokens=False).ids) <= 5)
    with pytest.raises(ValueError):
        prefix_tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    F = common.F
    stored = prefix_tokens.prefix_table(docs.where("doc_id in (3, 44, 46, 50, 51)"), "word_bpe_49k.json")
    asked = stored.select("text", F.size("prefixes").alias("size"), prefix_tokens.at(F.col("prefixes"), F.lit(2)).alias("two"), prefix_tokens.within(F.col("prefixes"), F.lit(4)).alias("fit"))
    for r in asked.where("text is not null").collect():
        assert (r["size"], r["two"], r["fit"]) == (len(r["text"]) + 1, len(lib.encode(r["text"][:2], add_special_tokens=False).ids), counter.fits(r["text"], 4))


def test_token_records(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    index, folder = token_records.write_dataset(docs, "byte_bpe_50k.json")
    got = index.collect()
    data = sorted(((i, t or "") for i, t, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, want = 0, []
    for i, t in data:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert ordered((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == ordered(want)
    r = got[len(got) // 2]
    doc_id, ids = token_records.read_at(spark, folder, r["part"], r["offset"], r["length"])
    assert doc_id == r["doc_id"] and len(ids) == r["n_tokens"]
    assert token_records.write_dataset(empty, "byte_bpe_50k.json")[0].count() == 0


def test_starts_follow_the_numbers_of_files(spark):
    names = [f"part-{n}-abc-c{c:03d}.txt" for n in ("00007", "99999", "100000") for c in (0, 1, 1000)]
    seen = spark.createDataFrame([(part, at, 10 * k + at) for k, part in enumerate(names) for at in (0, 5)], "part string, offset long, n_tokens long").repartition(3)
    got = {(r["part"], r["offset"]): r["start"] for r in token_records.with_starts(seen).collect()}
    total = 0
    for k, part in enumerate(names):
        for at in (0, 5):
            assert got[part, at] == total
            total += 10 * k + at


def test_files_end_after_some_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_CHUNKS", 1)
    monkeypatch.setattr(common, "partitions", lambda _: 1)
    df = spark.createDataFrame([(k, "word " * 20) for k in range(30)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index, _ = token_records.write_dataset(df, "byte_bpe_50k.json")
        got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["part"]) for r in index.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({g[3] for g in got}) == 5
    assert [g[1] for g in got] == [sum(h[2] for h in got[:k]) for k in range(30)]


def test_damaged_records_are_told():
    data = token_records.frame(token_records.pack(3, b"\1\0\2\0")) + b"\n"
    assert token_records.unpack(next(token_records.frames(data))[2])[1].tolist() == [1, 2]
    for at in (0, 9, 15, len(data) - 3):
        with pytest.raises(ValueError):
            list(token_records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash_components(docs, empty):
    data = [(i, brute_fingerprint(t)) for i, t, *_ in corpus()]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if (data[a][1] ^ data[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    want = [(i, f"{f:016x}", low.get(find(k))) for k, (i, f) in enumerate(data)]
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == ordered(want)
    assert simhash.near_duplicates(empty).count() == 0


def test_probes_reach_all_links(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 7 << rng.randrange(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2}
    got = [tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_documents_keep_one(spark, docs, empty):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(150)] for _ in range(20)]
    data = []
    for k, words in enumerate(base):
        data.append((100 * k, " ".join(words)))
        for c in range(1, 4):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            data.append((100 * k + c, " ".join(near)))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("root", common.F.lit("clash"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {100 * k for k in range(20)}
    assert simhash.keep_one(docs).where("doc_id is null").count() == 2
    assert simhash.keep_one(empty).count() == 0


def edited_copies(groups=30, copies=8, size=200, changed=3):
    """Groups whose base has a middle id: copies reach 0.86 with the base, but 0.74 with each other."""
    rng = random.Random(11)
    data = []
    for k in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts = []
        for c in range(copies):
            near = list(base)
            for at in rng.sample(range(10, size - 10), changed):
                near[at] = f"changed{k}x{c}x{at}"
            texts.append(near)
        texts.insert(copies // 2, base)
        data += [(100 * k + c, " ".join(t)) for c, t in enumerate(texts)]
    return data


def test_copies_link_through_a_base_of_middle_id(spark):
    kept = simhash.keep_one(spark.createDataFrame(edited_copies(), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {100 * k for k in range(30)}


def pairs_just_similar(n=600):
    """(texts, similarity) of pairs whose five-word shingles agree by little more than 0.8."""
    rng, out = random.Random(7), []
    while len(out) < n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 300))]
        h, near, last = simhash.shingle_hashes(" ".join(base), 5), list(base), None
        while True:
            near[rng.randrange(len(near))] = f"x{rng.random()}"
            g = simhash.shingle_hashes(" ".join(near), 5)
            same = len(np.intersect1d(h, g, assume_unique=True))
            if same < 0.8 * (len(h) + len(g) - same):
                break
            last = list(near)
        if last:
            out.append((" ".join(base), " ".join(last)))
    return out


def test_pairs_that_meet_in_a_band_are_not_lost_to_the_estimate(spark):
    pairs = pairs_just_similar()
    met = {k for k, (a, b) in enumerate(pairs) if (simhash.sketch(a, 5)[2] == simhash.sketch(b, 5)[2]).any()}
    df = spark.createDataFrame([(2 * k + c, p[c]) for k, p in enumerate(pairs) for c in range(2)], "doc_id long, text string")
    gone = {r["doc_id"] for r in df.join(simhash.keep_one(df).select("doc_id"), "doc_id", "left_anti").collect()}
    assert gone == {2 * k + 1 for k in met} and len(met) >= 0.99 * len(pairs)


def test_leaders_and_the_exact_pass_see_all_pairs(spark, monkeypatch):
    """A hot group without a base, and copies of it near the threshold: groups are those of all pairs at 0.8 that share a block."""
    monkeypatch.setattr(simhash, "LEADERS", 7)
    monkeypatch.setattr(simhash, "CELLS", 5000)
    rng = random.Random(17)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for k in range(160):
        near = list(base)
        for at in rng.sample(range(150), 2 + k % 7):
            near[at] = f"x{rng.randrange(40)}" if k % 3 else f"y{k}"
        texts.append(" ".join(near))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    met = [set(simhash.sketch(t, 5)[2].tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if met[a] & met[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["root"] for r in simhash.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 10


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and len(got) == 303


def brute_removed(data):
    first = {}
    for i, t in data:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [suffix_dedup.SHARD_BYTES, 500])
def test_suffix_dedup(docs, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    got = suffix_dedup.repeats(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(brute_removed([(i, t) for i, t, *_ in corpus()]))
    assert suffix_dedup.repeats(empty).count() == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


@pytest.mark.parametrize(("n", "letters"), [(0, 3), (1, 3), (60, 1), (500, 2), (3000, 4)])
def test_suffix_array_and_prefixes(n, letters):
    x = np.random.default_rng(n).integers(0, letters, n)
    sa, t = suffix_dedup.suffix_array(x), x.tolist()
    assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
    if n > 1:
        got = suffix_dedup.common_prefixes(x, sa, np.array([0, n // 2]), n)
        for i in range(1, n):
            a, b = t[sa[i - 1] :], t[sa[i] :]
            assert got[i] == next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


@pytest.mark.parametrize("depth", [5, 50])
def test_suffix_array_stops_at_a_depth(monkeypatch, depth):
    """What agrees beyond the strings asked for is not sorted, and common prefixes are not walked."""
    x = np.tile(np.random.default_rng(2).integers(0, 9, 40), 30)
    sa, t = suffix_dedup.suffix_array(x, depth), x.tolist()
    assert sorted(sa.tolist()) == list(range(len(x)))
    got = [t[i : i + depth] for i in sa.tolist()]
    assert got == sorted(got)
    monkeypatch.setattr(suffix_dedup, "common_prefixes", None)
    texts = [bytes(x[:120].astype(np.uint8)), bytes(x[7:90].astype(np.uint8)), b"\xff\0" * 30, b"\0" * 51]
    strings, low, text, place, number = suffix_dedup.shard_strings(texts, np.array([3, 2, 5, 1]))
    want: dict = {}
    for body, owner in zip(texts, (3, 2, 5, 1), strict=True):
        for i in range(len(body) - 49):
            want[body[i : i + 50]] = min(owner, want.get(body[i : i + 50], 9))
    assert [s.tobytes() for s in strings] == sorted(want) and low.tolist() == [want[s] for s in sorted(want)]
    assert sorted(zip(text.tolist(), place.tolist(), strict=True)) == [(k, i) for k, body in enumerate(texts) for i in range(len(body) - 49)]
    assert all(strings[n].tobytes() == texts[k][i : i + 50] for k, i, n in zip(text.tolist(), place.tolist(), number.tolist(), strict=True))
    assert len(suffix_dedup.shard_strings([b"a" * 9], np.array([1]))[0]) == 0


def test_merging_shards_by_binary_search():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(4)) * 20 for _ in range(60)]
    texts = [t[rng.randrange(9) :].encode() for t in texts]
    owners = np.arange(len(texts))
    whole = suffix_dedup.shard_strings(texts, owners)
    want = dict(zip([s.tobytes() for s in whole[0]], whole[1].tolist(), strict=True))
    parts = [suffix_dedup.shard_strings(texts[a : a + 13], owners[a : a + 13]) for a in range(0, 60, 13)]
    for p, low in zip(parts, suffix_dedup.merge_shards([(p[0], p[1]) for p in parts]), strict=True):
        assert [want[s.tobytes()] for s in p[0]] == low.tolist()


def test_license_scan(docs, empty):
    def brute(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in hits]
        return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))

    got = licenses.scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == ordered([(i, *brute(t)) for i, t, *_ in corpus()])
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert licenses.scan(empty).count() == 0


def naive_labels(text):
    """(labels, score) by plain loops over words."""
    w, found, score = licenses.words(text), set(), 0.0
    for label, phrase in licenses.PHRASES:
        p = phrase.encode().split()
        if any(w[k : k + len(p)] == p for k in range(len(w))):
            found.add(label)
            score = 1.0
    for label, notice in licenses.NOTICES:
        t, diagonals = notice.encode().split(), {}
        for a in range(len(w) - 1):
            for b in range(len(t) - 1):
                if w[a : a + 2] == t[b : b + 2]:
                    diagonals.setdefault(a - b, {})[b] = a
        size, spans = len(t) - 1, []
        strong = {d: h for d, h in diagonals.items() if len(h) >= max(2, licenses.LEAST_SHARE * size)}
        for d in sorted(strong):
            if spans and d - spans[-1][-1] <= licenses.SLACK:
                spans[-1].append(d)
            else:
                spans.append([d])
        for span in spans:
            cover = len(set().union(*(strong[d] for d in span))) / size
            places = [a for d in span for a in strong[d].values()]
            if cover >= licenses.LEAST_COVER and max(places) - min(places) < 2 * size + licenses.SLACK:
                found.add(label)
                score = max(score, cover)
    return ",".join(sorted(found)), round(score, 9)


def test_labels_equal_plain_loops(spark, docs):
    rng = random.Random(14)
    filler = "the of software this license to or in and a is".split()
    texts = [t for _, t, *_ in corpus() if t and len(t) < 5000]
    for k in range(120):
        notice = list(rng.choice(licenses.NOTICES)[1].split())
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(notice))
            notice[at : at + rng.randint(0, 2)] = [rng.choice(filler)] * rng.randint(0, 3)
        cut = notice[: rng.randint(len(notice) // 3, len(notice))]
        texts.append(" ".join([*(rng.choice(filler) for _ in range(rng.randint(0, 200))), *cut, *(rng.choice(filler) for _ in range(50))]).title())
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: naive_labels(t) for k, t in enumerate(texts)}
    assert len({x for x, _ in got.values()}) > 10


def test_a_hash_that_stands_for_other_words_is_no_hit(monkeypatch):
    known = licenses.KnownGrams()
    tokens = [b"mit", b"license", b"apache"]
    fine = known.checked(tokens)
    monkeypatch.setitem(known.grams, int(fine[0]), (b"other", b"words"))
    assert fine[0] != licenses.NOTHING and known.checked(tokens).tolist() == [licenses.NOTHING, *fine[1:].tolist()]


def test_notices_are_voted_for(spark):
    bsd = dict(licenses.NOTICES)["bsd"].split()
    texts = ["Some code. " + " ".join(bsd) + " end", "x " + " ".join(bsd[:6] + ["inserted"] + bsd[6:]) + " y", " ".join(bsd[:4]), "nothing here"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "bsd", 2: "", 3: ""}


def test_decontamination_finds_reordered_passages(spark, docs, empty):
    rng = random.Random(2)
    item = [f"w{rng.randrange(500)}" for _ in range(36)]
    halves = item[18:] + ["gap"] + item[:18]
    data = [(1, "start " + " ".join(item) + " end"), (2, " ".join(halves)), (3, " ".join(item[:12])), (4, None), (5, ""), (None, " ".join(item)), (1, "again")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("items", common.F.lit("clash"))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (None, " ".join(item)), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["cover"] for r in decontaminate.matches(df, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0}
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 3, 4, 5]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0


def naive_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False


def test_tiles_equal_naive_tiling():
    rng = np.random.default_rng(0)
    for _ in range(150):
        letters = rng.integers(1, 6)
        d, i = rng.integers(0, letters, rng.integers(0, 60)).astype(np.uint64), rng.integers(0, letters, rng.integers(0, 25)).astype(np.uint64)
        assert decontaminate.tiles(d, i) == naive_tiles(d.tolist(), i.tolist(), decontaminate.LEAST)


def test_decontamination_equals_naive_search(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.choice([0, 1, 2, 3, 4, 7, 12, 20]))) for k in range(24)] + [(3, text(9))]
    data = []
    for k in range(60):
        t, own = text(rng.randint(0, 30)), rng.choice(items)[1]
        if k % 3:  # an item in runs of three or four words, in another order, or with a word changed
            cut = [own[a : a + 3 + k % 2] for a in range(0, len(own), 3 + k % 2)]
            rng.shuffle(cut)
            t += [w for part in cut for w in ([*part, rng.choice(vocabulary)] if k % 5 else part)]
        data.append((k, " ".join(t).upper() if k % 7 == 0 else ", ".join(t)))
    got = {(r["doc_id"], r["item_id"]): (round(r["cover"], 9), r["n_tiles"]) for r in decontaminate.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")).collect()}
    want = {}
    for k, t in data:
        for item_id, item in items:
            made = naive_tiles(decontaminate.words(t), item, decontaminate.LEAST)
            covered = sum(n for _, _, n in made)
            if item and covered >= 0.7 * len(item) - 1e-9:
                want[k, item_id] = max(want.get((k, item_id), (0, 0)), (round(covered / len(item), 9), len(made)))
    assert got == want and len(want) > 20


def test_long_texts_in_decontamination_and_licenses(spark):
    rng = random.Random(8)
    item, notice = [f"w{rng.randrange(99)}" for _ in range(30)], licenses.NOTICES[0][1]
    text = " ".join(f"v{rng.randrange(5000)}" for _ in range(1_600_000))
    assert len(text) > 10_000_000 - 2_000_000
    df = spark.createDataFrame([(1, text + " " + " ".join(item) + " " + notice)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(df, bench).collect()] == [(1, 7, 1.0, 1)]
    assert licenses.scan(df).first()["labels"] == "mit"
    found = packing.pack(df.withColumn("source", common.F.lit("s"))).agg({"length": "sum"}).first()[0]
    assert found == len(text) + len(" ".join(item)) + len(notice) + 2


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=1000, per_source=2, shard=30)
    data = got.collect()
    sizes = {}
    for i, t, *_ in corpus():
        sizes.setdefault(i, 0)
        sizes[i] += len((t or "").encode())
    placed, bins = {}, {}
    for r in data:
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["length"]
        if r["bin"] is None:
            assert r["length"] == 0
        else:
            bins.setdefault((r["shard"], r["bin"]), []).append((r["bin_offset"], r["length"]))
    assert placed == sizes
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1000
    assert packing.pack(empty).count() == 0


def naive_packing(rows, capacity, per_source):
    """Best fit in a plain loop: (doc_id, piece) to (bin, offset); rows are (doc_id, length, source, cluster)."""
    pieces = [(min(capacity, n - a), i, k, s, c) for i, n, s, c in rows for k, a in enumerate(range(0, n, capacity))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins, out = [], {}
    for n, i, k, s, c in pieces:
        fits = [(b["room"], at) for at, b in enumerate(bins) if b["room"] >= n and b["room"] > 0 and b["sources"].count(s) < per_source and c not in b["clusters"]]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "sources": [], "clusters": set()})
        b = bins[at]
        out[i, k] = (at, capacity - b["room"])
        b["room"] -= n
        if s is not None:
            b["sources"].append(s)
        b["clusters"].add(c)
    return out


@pytest.mark.parametrize("by", ["bytes", "tokens", "near"])
def test_packing_equals_a_plain_best_fit(spark, by):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    data = []
    for k in range(150):
        t = rng.choice(texts) if k % 3 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90)))
        if k == 5:
            t = t * 40
        data.append((k, t, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 700)))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n long").repartition(4)
    options = {"bytes": {}, "tokens": {"length": "n"}, "near": {"near": 2}}[by]
    got = {(r["doc_id"], r["piece"]): (r["bin"], r["bin_offset"]) for r in packing.pack(df, 1000, 2, 10_000, **options).collect() if r["length"]}
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    rows_ = [(k, n if by == "tokens" else len(t.encode()), s, component[k] if by == "near" else t) for k, t, s, n in data]
    assert got == naive_packing(rows_, 1000, 2)
    if by == "near":
        held = {}
        for (k, _), (b, _) in got.items():
            held.setdefault(b, []).append(component[k])
        assert all(len(c) == len(set(c)) for c in held.values()) and len(set(component.values())) < 150


def test_best_fit_takes_the_tightest_compatible_bin():
    b = packing.Bins(100, 3, 3, 1)
    assert b.place(60, 0, -1) == (0, 0)
    assert b.place(70, 1, 0) == (1, 0)
    assert b.place(30, 1, -1) == (0, 60)  # bin 1 is tighter but has source 1
    assert b.place(30, 2, 0) == (2, 0)  # bin 1 has the cluster, bin 0 no room
    assert b.place(30, 2, 1) == (1, 70)


def naive_net(net, data):
    """Class probabilities of one window of bytes, by explicit convolution."""
    p, x = net.params, [*data, *[langid.PAD] * (langid.WINDOW - len(data))]
    features = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            sums = [sum(float(p["E"][x[at + k]] @ p[f"W{w}"][k][:, f]) for k in range(w)) for at in range(len(x) - w + 1)]
            features.append(max(0.0, max(sums) + float(p[f"b{w}"][f])))
    z = np.array(features) @ p["U"] + p["c"]
    z = np.exp(z - z.max())
    return z / z.sum()


def test_net_equals_naive_convolution():
    net = langid.ByteNet(["a", "b", "c"], seed=3)
    for data in (b"some text here", bytes(range(200)), b"x" * langid.WINDOW):
        got = np.exp(net.log_probs(langid.windows(data), net.tables()))[0]
        assert np.allclose(got, naive_net(net, data), atol=1e-5)


def test_net_learns_along_the_numeric_gradient(monkeypatch):
    """One step of training moves each parameter against the sign of its numeric gradient (the first step of Adam is that sign)."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.int16), np.array([0, 1, 1, 0])
    net, seed = langid.ByteNet(["a", "b"], seed=1), 2
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    start = {k: v.copy() for k, v in net.params.items()}
    draw = np.random.default_rng(seed)
    pick = draw.integers(0, len(x), len(x))
    cut = int(draw.integers(langid.WINDOW // 8, langid.WINDOW + 1))
    xb, yb = x[pick].copy(), y[pick]
    xb[:, cut:] = langid.PAD

    def tables(params):
        return {w: np.einsum("be,wef->wbf", params["E"], params[f"W{w}"]) for w in langid.WIDTHS}

    def loss(params):
        net.params = params
        return -float(net.log_probs(xb, tables(params))[np.arange(len(yb)), yb].mean())

    monkeypatch.setattr(langid.ByteNet, "tables", lambda self: tables(self.params))
    net.params = {k: v.copy() for k, v in start.items()}
    net.fit(x, y, steps=1, seed=seed)
    moved = {k: net.params[k] - start[k] for k in start}
    checked = 0
    for name in start:
        for place in list(np.ndindex(start[name].shape))[:: max(1, start[name].size // 12)]:
            up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
            up[name][place] += 1e-5
            down[name][place] -= 1e-5
            g = (loss(up) - loss(down)) / 2e-5
            if abs(g) > 1e-6 and not (name == "E" and place[0] == langid.PAD):
                assert np.sign(moved[name][place]) == -np.sign(g)
                checked += 1
    assert checked > 30


def test_language(docs, empty):
    got = {(r["doc_id"], r["lang_pred"] == langid.UNKNOWN) for r in langid.identify(docs).collect()}
    assert {(43, True), (44, True), (45, True), (46, True), (47, False), (None, False)} <= got
    held = {r["doc_id"]: r["held_out"] for r in langid.identify(docs).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held if i is not None)
    assert langid.identify(empty).count() == 0 and langid.identify(docs, empty).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {43, 44, 45, 46} & {r["doc_id"] for r in kept.collect()}


def test_language_is_learnt(spark):
    rng = random.Random(0)
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "ein", "über"], "fr": ["eau", "ère", "ois", "que"]}
    data = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 200))), k) for i in range(300) for k in [rng.choice(sorted(parts))]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    truth = {i: k for i, _, k in data}
    got = [r for r in langid.identify(df).collect() if r["held_out"]]
    assert len(got) > 40 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.98 * len(got)


@pytest.mark.parametrize("cells", [topk.CANDIDATE_CELLS, 512])
def test_topk(spark, monkeypatch, cells):
    monkeypatch.setattr(topk, "CANDIDATE_CELLS", cells)
    monkeypatch.setattr(topk, "QUERY_CELLS", 56)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (300, 8))
    x[250:] = x[0]  # ties
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (905, []), (940, [0.0] * 8)]
    data += [(960, [5e7, 2.0]), (961, [1.0, 2.0]), (962, [-5e7, 1.0, 3.0]), (980, [0.5] * 30), (981, [1.0] * 31), (982, [2.0]), (7, data[7][1])]  # large components, other lengths, a repeated row
    v = topk.vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", common.F.lit("clash")))
    got = topk.search(v, v.where("vec_id % 20 = 0"), 5)
    y = [(i, [int(np.floor(64 * a)) for a in r]) for i, r in data if i is not None and r and None not in r and all(map(np.isfinite, r))]
    want = []
    for q, r in y:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(r, s, strict=False)), i) for i, s in y if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want)
    assert topk.search(v.where("false"), v.where("false")).count() == 0
    assert topk.search(v, v.where("false"), 5).count() == 0 and topk.search(v.where("vec_id < 3"), v.where("vec_id = 0"), 5).count() == 2


def test_topk_stops_early_and_skips_blocks():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (4000, 3)) * np.array([1, 4, 9])
    q = rng.integers(-40, 40, (30, 3))
    best = topk.Best(np.full(30, -1), 5)
    first = topk.search_block(np.arange(4000), x, q, best)
    assert (first > 0).all() and (first < 1).mean() > 0.5
    assert (topk.search_block(np.arange(4000, 5000), x[:1000] // 8, q, best) == 0).mean() > 0.9  # the bar of the first block
    for t in range(30):
        s = x @ q[t]
        assert best.ids[t].tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist()


def test_topk_scores_beyond_a_long_are_cut():
    big = 1 << 62
    assert topk.scores(np.array([[big, big], [-big, -big], [1, 0]]), np.array([5, 5])).tolist() == [topk.LONG.max, topk.LONG.min, 5]


def test_warc(spark):
    big = "<p>" + "ü" * 800
    data = [(1, "http://www.Example.org:80/a?b=1", big), (2, "https://example.org/", big), (3, None, None), (4, "http://x.org/\r\nInjected: yes", "small"), (5, "http://y.org", "small"), (6, "http://b.a.x.org/é z ", ""), (None, "http://n.org", big), (2, "https://example.org/", big), (7, "http://w.org", "WARC/1.1\r\n\r\nfake\r\n\r\n" * 3)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("offset", common.F.lit("clash"))
    captures, folder = warc.round_trip(pages)
    got = rows(captures, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in data]
    assert got == ordered(want)
    index = warc.CaptureIndex(spark, f"{folder}/archives", f"{folder}/index")
    found = index.captures("http://w.org/")
    assert [c["page_id"] for c in found] == [7] and index.record(found[0])[1] == data[-1][2].encode()
    assert index.captures("http://nowhere.org/") == []
    assert warc.surt("http://user@www.Example.org:8080/p?q") == "org,example,www:8080)/p?q"
    assert warc.round_trip(pages.where("false"))[0].count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step, _ = common.stored(stage(spark, step, str(tmp_path)), "t")
        assert step.columns == cols
    texts = {r["doc_id"]: r["text"] or "" for r in step.collect()}
    assert not {40, 41, 43, 44, 45, 46} & texts.keys() and 3 in texts
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == texts.keys()


def pipeline_corpus():
    rng = random.Random(21)
    parts = {"en": ["the", "ing", "tion", "and", "her"], "de": ["sch", "ung", "ein", "ver", "keit"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    item = [word("en") for _ in range(30)]
    passage = " ".join(word("en") for _ in range(25))
    data = []
    for k in range(90):
        lang = "en" if k % 3 else "de"
        w = [word(lang) for _ in range(rng.randint(40, 300))]
        if k % 10 == 4:
            w[10:10] = [passage]
        if k % 30 == 7:
            w += item[15:] + item[:15]
        data.append((k, " ".join(w), lang))
        if k % 6 == 0:  # an edited copy, far above the threshold, an exact one, and one far below
            near = list(w)
            near[len(near) // 2] = "changed"
            data += [(200 + k, " ".join(near), lang), (300 + k, " ".join(w).upper(), lang)]
    noise = ["".join(chr(rng.randint(33, 126)) for _ in range(900)) for _ in range(3)]
    data += [(500 + k, t, None) for k, t in enumerate(noise)] + [(510, "", "en"), (511, None, "en"), (512, "12 !!", None)]
    rows_ = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in data]
    return rows_, [(1, " ".join(item)), (2, "never seen words stand here in a row")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    data, items = pipeline_corpus()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = {i: (t, s) for i, t, _, s, _ in data if t and re.search(r"[^\W\d_]", t) and i < 500}
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, (t, _) in step.items()}
    root = {i: i for i in step}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in step:
        for b in step:
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    step = {i: x for i, x in step.items() if find(i) == i}
    first = {}
    for i, (t, _) in step.items():
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], i), i)
    for i, (t, s) in list(step.items()):
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone |= set(range(p, p + 50))
        step[i] = ("".join(c for p, c in enumerate(t) if p not in gone), s)
    held = set()
    for i, (t, _) in step.items():
        for _, item in items:
            w = decontaminate.words(item)
            if sum(n for _, _, n in naive_tiles(decontaminate.words(t), w, 3)) >= 0.7 * len(w):
                held.add(i)
    assert held and len(step) < 100
    step = {i: x for i, x in step.items() if i not in held}
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    rows_ = [(i, len(lib.encode(t, add_special_tokens=False).ids), s, i) for i, (t, s) in step.items()]
    want = naive_packing(rows_, corpus_pipeline.BIN_TOKENS, packing.PER_SOURCE)
    got = {(r["doc_id"], r["piece"]): (r["bin"], r["bin_offset"]) for r in out if r["length"]}
    assert got.keys() == want.keys() and got == want


def test_near_duplicate_recall(spark):
    """Of all pairs of texts at 0.8 or more, in groups of edited copies without a base too, nine in ten and more fall into one group."""
    rng = random.Random(31)
    data = []
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        for c in range(6):
            near = list(base)
            for at in rng.sample(range(len(near)), max(1, len(near) * rng.choice([0, 1, 2, 3]) // 100)):
                near[at] = f"x{rng.random()}"
            data.append((10 * g + c, " ".join(near)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in data}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = {r["doc_id"]: r["root"] for r in simhash.similar_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(roots[a] == roots[b] for a, b in pairs)
    assert len(pairs) > 150 and found >= 0.99 * len(pairs)
    assert all(r // 10 == i // 10 for i, r in roots.items())


def test_clashing_names_pass_through(spark, docs):
    names = ["_tag", "tag", "_sets", "places", "_places", "_id", "predicted", "_predicted", "certainty", "_predicted_language", "n_tokens", "other", "doc"]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for n in names:
        df = df.withColumn(n, common.F.lit("clash"))
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string").withColumn("item", common.F.lit("clash"))
    for made in (langid.keep_identified(df), simhash.keep_one(df), suffix_dedup.without_repeats(df), decontaminate.clean(df, bench)):
        assert made.columns == df.columns and made.where(" or ".join(f"`{n}` <> 'clash'" for n in names)).count() == 0
    assert packing.pack(prefix_tokens.with_counts(df, "word_bpe_49k.json", common.unused(df, "n_tokens")), length="_n_tokens").count() >= df.count()


def test_noise_is_rejected_and_languages_stay(spark):
    data, _ = pipeline_corpus()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in langid.keep_identified(df).collect()}
    assert kept == {i for i, *_ in data if i < 500}
    unlabelled = langid.keep_identified(df.withColumn("lang", common.F.lit(None).cast("string")))
    assert {i for i, t, *_ in data if t and re.search("[a-zA-Z]", t)} == {r["doc_id"] for r in unlabelled.collect()}
