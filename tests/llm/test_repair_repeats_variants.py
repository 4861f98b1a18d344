"""Conversation repair, word passages and spelling variants against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import automaton_dedup, common, conversation_repair, langid, packing, queries, spelling, warc

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]")


def by_id(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# --- conversations -----------------------------------------------------------------------------------------------


def brute_audit(turns):
    """Least (cost, audit) by trying every edit; turns: (role, text, must go, truncated)."""

    def step(q, c):
        return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(c, {}).get(q)

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(turns) and q in ("", "a") else []
        if inserted < 3:
            found += [(2 + c, "I" + s) for to in "ua" if step(q, to) for c, s in [best(i, step(q, to), inserted + 1)]]
        if i < len(turns):
            role, _, gone, cut = turns[i]
            moves = [("D", 3, q)]
            if not gone:
                moves += [("K", cut, step(q, role[:1])), *(("R", 2 + cut, step(q, x)) for x in "ua")]
            found += [(cost + c, letter + s) for letter, cost, to in moves if to is not None for c, s in [best(i + 1, to, 0)]]
        return min(found, default=(10**9, "~"))

    return best(0, "", 0)


def brute_repair(conversations):
    kept = {}
    for conv, turn, role, text in conversations:
        mine = kept.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, turns, counts = set(), [], Counter()
        for _, role, text in mine:
            solid = SPACES.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = brute_audit(tuple(turns))
        lines, k, q = [], 0, ""
        for letter in audit:
            to = "a" if q == "u" else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[to])
            else:
                role, text, *_ = turns[k]
                k += 1
                if letter == "D":
                    continue
                to = to if letter == "R" else role[0]
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[to] if letter == 'R' else role}:{text}")
            q = to
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        numbers = [t for t, *_ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def conversations():
    rng = random.Random(9)
    texts = ["Yes.", "No", "", "  ", "Why?\n", "well… ", None, "a b c!", "x" * 50_000, ".", "été.", "\x0b\x0c"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += [(500, 0, "user", "Same."), *[(500, t, "assistant", "Same.") for t in range(40)], *[(500, 7, "user", "Equal.")] * 30]
    return [(*r, None, 1, "k") for r in rows]


CONVERSATIONS = "conv_id long, turn long, role string, text string, n string, code int, key string"


def test_repair_equals_every_edit_tried(spark, monkeypatch):
    df = spark.createDataFrame(conversations(), CONVERSATIONS).repartition(7)
    want = brute_repair([r[:4] for r in conversations()])
    assert by_id(conversation_repair.digests(conversation_repair.damaged(df))) == want
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 2)  # conversations in many segments
    monkeypatch.setattr(common, "partitions", lambda _: 40)
    assert by_id(conversation_repair.digests(conversation_repair.damaged(df))) == want
    assert conversation_repair.digests(conversation_repair.damaged(df.where("false"))).count() == 0


def test_repaired_turns_follow_the_pattern(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So"), (2, 5, "system", "Be kind."), (2, 6, "user", "Hello."), (2, 7, "assistant", "Hello!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1L as n")
    got = sorted(map(tuple, conversation_repair.repaired(df).collect()))
    assert got == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hi.", "K"), (2, 0, "system", "Be kind.", "K"), (2, 1, "user", "Hello.", "K"), (2, 2, "assistant", "Hello!", "K")]


def test_a_conversation_of_many_rows(spark):
    n = 60_000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text", "1L as n")
    (r,) = conversation_repair.digests(df.unionByName(df.selectExpr("conv_id", f"turn + {n} as turn", "'user' as role", "'again.' as text", "n"))).collect()
    want = "\n".join(f"{('user', 'assistant')[k % 2]}:t{k}." for k in range(n))
    assert (r["duplicate"], r["cost"], r["audit"][:n], set(r["audit"][n:])) == (n - 1, 3 * (n - 1) + 2, "K" * n, set("DIK"))
    assert r["repaired_sha256"] == hashlib.sha256((want + "\nuser:again.\nassistant:").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=7))
def test_cheapest_audit(codes):
    turns = tuple(("sua?"[c >> 2], "", c & 3 in (2, 3), c & 3 == 1) for c in codes)
    assert conversation_repair.cheapest(bytes(codes)) == brute_audit(turns)


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(queries.op11_conversation_repair(spark, SF)) == brute_repair(rows)


# --- passages ----------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=automaton_dedup.WINDOW):
    first, out = {}, []
    each = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in each:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                first[s] = min(first.get(s, i), i)
    for i, w in each:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def passages():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["of", "the", "stone", "été", "x y", "Über", "river", "10"]) + str(rng.choice(["", rng.randint(0, 50)])) for _ in range(n))
    shared, base = text(130), text(900)
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(["", " " + shared, "\n" + shared + "\t" + text(30), " " + shared[200:600]])) for i in range(60)]
    for i in range(60, 90):  # edited copies
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(90, "a " * 400), (91, "b a " * 30 + "a " * 300), (92, None), (93, ""), (94, " \n"), (95, base), (95, base), (95, shared + " end"), (None, base), (None, shared), (3, base), (96, text(49)), (97, shared * 2), (98, "long " * 60_000), (99, "long " * 70_000 + "end")]
    return [(i, t, 5, 6, "s") for i, t in rows]


PASSAGES = "doc_id long, text string, tag long, anchor long, places string"


def test_passages_equal_plain_loops(spark, monkeypatch):
    df = spark.createDataFrame(passages(), PASSAGES).repartition(6)
    want = brute_repeats([r[:2] for r in passages()])
    assert by_id(automaton_dedup.repeats(df)) == want
    monkeypatch.setattr(automaton_dedup, "SHARD", 3)  # anchors that are too large for a shard
    monkeypatch.setattr(automaton_dedup, "SAMPLE_BYTES", 3000)
    monkeypatch.setattr(automaton_dedup, "KNOWN", 2)
    assert by_id(automaton_dedup.repeats(df)) == want
    assert automaton_dedup.repeats(df.where("false")).count() == 0


def test_passages_are_cut_from_texts(spark):
    df = spark.createDataFrame(passages(), PASSAGES).repartition(4)
    cut = automaton_dedup.without_repeats(df)
    assert cut.schema == df.schema and cut.count() == df.count()
    kept = sorted((r["doc_id"], hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest()) for r in cut.where("doc_id is not null").collect() if r["text"] is not None)
    assert kept == sorted((i, sha) for i, _, _, sha in brute_repeats([r[:2] for r in passages()]) if i is not None and i != 92)
    assert cut.where("doc_id = 92 and text is null and tag = 5").count() == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=25), max_size=5), st.text("abc", max_size=30), st.integers(1, 5))
def test_matching_statistics(known, asked, least):
    automaton = automaton_dedup.Automaton()
    for k in known:
        automaton.add(list(k))
    want = [i for i in range(len(asked)) if i + 1 >= least and any(asked[i + 1 - least : i + 1] in k for k in known)]
    assert automaton.ends(list(asked), least) == want


# --- spelling ----------------------------------------------------------------------------------------------------


def brute_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    holes = {}
    for w in counts:  # equal with one code point hidden, or with one left out
        for k in range(len(w)):
            holes.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        near[w] |= holes.get(w, set())
        for k in range(len(w)):
            near[w] |= holes[w[:k] + "*" + w[k + 1 :]] | ({w[:k] + w[k + 1 :]} & counts.keys())
        near[w].discard(w)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def spelled():
    rng = random.Random(4)
    stems = ["bonheur", "straße", "weathering", "Übergröße", "recommendation", "liberties", "aaaaaaa", "noncommittal"]
    letters = "abcdeéü×÷"

    def slip(w):
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        return w

    rows = [(i, " ".join(slip(rng.choice(stems)) + rng.choice(["", ",", "ł", "-x"]) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    rows += [(None, "Weathering weathering"), (None, None), (3, ""), (80, "aaaaaaaa " * 500), (81, " ".join(["q" * 600, "q" * 600, "q" * 601, "q" * 601]))]
    rows += [(90 + k, " ".join("abcdef" + a + b for a in "abcdefghij" for b in "klmnopqrst")) for k in range(2)]  # one crowded block
    return [(i, t, 1, 2, "s") for i, t in rows]


SPELLED = "doc_id long, text string, n long, m int, word string"


def test_variants_equal_plain_loops(spark, monkeypatch):
    df = spark.createDataFrame(spelled(), SPELLED).repartition(6)
    want = brute_variants([r[:2] for r in spelled()])
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect()]
    assert sorted(got) == want and any(r[1] and r[2] != r[1] for r in want)
    monkeypatch.setattr(spelling, "BLOCK", 4)
    monkeypatch.setattr(spelling, "COUNTED", 10)
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect()]
    assert sorted(got) == want
    assert spelling.variants(df.where("false")).count() == 0


def test_very_long_runs(spark):
    a, b = "q" * 1_000_000, "q" * 499_999 + "é" + "q" * 500_000
    df = spark.createDataFrame([(k, w) for k, w in enumerate([a, a, b, b])], "doc_id long, text string")
    got = {(len(r["word"]), r["n"], r["n_near"]) for r in spelling.variants(df).collect()}
    assert got == {(1_000_000, 2, 1)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=7), min_size=2, max_size=60), st.integers(2, 6))
def test_each_near_pair_is_met_once(words, pairwise):
    before, spelling.PAIRWISE = spelling.PAIRWISE, pairwise
    try:
        found = {w: [0, -1, ""] for w in words}
        for m in range(1, 8):
            for left, right in ((m // 2, 0), (0, m - m // 2)):
                blocks = {}
                for w in words:
                    if len(w) in (m, m + 1):
                        blocks.setdefault(w[:left] + " " + w[len(w) - right :], []).append((w, 1))
                for block in blocks.values():
                    spelling.near_in_block(block, m, left, right, found)
    finally:
        spelling.PAIRWISE = before
    for w in words:
        edits = {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "ab"} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "ab"} | {w[:k] + w[k + 1 :] for k in range(len(w))}
        assert found[w][0] == len((edits & words) - {w})


def test_variants_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op13_spelling_variants(spark, SF).collect()]
    assert sorted(got) == brute_variants(rows)


def test_passages_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(queries.op12_suffix_automata(spark, SF)) == brute_repeats(rows)


@pytest.mark.parametrize("ends", [[0], [49], [50], [120, 120, 169, 300], [60, 110, 170]])
def test_pieces_cover_every_window_once(ends):
    rng = np.random.default_rng(1)
    words = [b"w%d" % k for k in rng.integers(0, 9, ends[-1])]
    _, start, windows = automaton_dedup.pieces(words, np.array(ends))
    got = [s + k for s, n in zip(start, windows, strict=True) for k in range(n)]
    assert got == [k for a, b in zip([0, *ends], ends, strict=False) for k in range(a, b - 49)]


# --- older operators ---------------------------------------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    rows = [(k, t, "en") for k, t in enumerate(["the house and the river", "stones and light and water"] * 30)] + [(100, "½", None), (101, "² 3", None), (102, "Ⅷ _", None), (103, "ª", None), (104, "中", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k] for k in range(100, 105)] == ["und", "und", "und", "en", "en"]


def test_rows_that_repeat_fill_bounded_shards(spark):
    df = spark.range(20_000).selectExpr("1L as doc_id", "'the same words' as text", "'s' as source").repartition(4)
    sizes = [r["count"] for r in packing.pack(df, shard=1000).groupBy("shard").count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 20_000 and max(sizes) < 1300


def test_one_large_page_leaves_the_other_files_long(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 22)
    rows = [(k, f"http://a.example/{k}", f"<p>{k}</p>") for k in range(200)] + [(200, "http://a.example/big", "x" * 5_000_000), (201, "http://b.example/big", "y" * 100_000), (202, None, None)]
    captures, _ = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    parts = Counter(r["part"] for r in captures.select("part").collect())
    assert sorted(parts.values()) == [1, 1, 201] and captures.where("payload_bytes = 5000000").count() == 1
