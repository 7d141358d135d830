"""Near-duplicates, groups, splitting: against brute force and on odd input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from tessera.llm import groups, neardup, split
from tessera.operators.components import components

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.reuse, Phase.generate])
WORD = re.compile(r"[^\W_]+")


# ---- problem 1


def texts_with_copies(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    out = {}
    for i in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(list(out.values())).split()
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], rng.choice(vocab)]])
        else:
            words = [rng.choice(vocab) for _ in range(rng.randrange(15, 60))]
        out[f"id{i:03d}"] = " ".join(words)
    return out


def brute_classes(texts, width, t, least):
    sets = {}
    for k, v in texts.items():
        w = WORD.findall((v or "").lower())
        if len(w) >= max(least, width):
            sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(k, root(k)) for k in sets}


@SLOW
@given(st.integers(0, 10_000), st.sampled_from([(3, 0.6, 20), (5, 0.8, 0)]), st.sampled_from([(2, 1, 1 << 10), (3, 4, 1 << 20), (2048, 64, 1 << 24)]))
def test_classes_are_those_of_brute_force(spark, seed, how, bounds):
    texts = texts_with_copies(seed)
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "id string, body string, class_id string")
    block, small, counters = bounds
    got = neardup.classes(df, "id", "body", *how, block=block, small=small, counters=counters)
    assert {(r.id, r.class_id) for r in got.collect()} == brute_classes(texts, *how)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = neardup.classes(spark.createDataFrame(rows, "id long, t string"), "id", "t", 3, 0.6, 20, block=40)
    assert {(r.class_id, r.n_class) for r in got.collect()} == {(0, 300)}
    pairs = neardup.pairs_of(got, block=70)
    assert pairs.count() == 300 * 299 // 2 and pairs.where("a >= b").count() == 0 and pairs.distinct().count() == pairs.count()


def test_nulls_copies_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [("a", long), ("b", long), ("a", long), ("c", None), ("d", ""), (None, long), ("e", "too short"), ("f", long.upper())]
    df = spark.createDataFrame(rows, "id string, t string")
    got = neardup.classes(df, "id", "t", 3, 0.6, 20)
    assert {(r.id, r.class_id, r.n_class) for r in got.collect()} == {("a", "a", 3), ("b", "a", 3), ("f", "a", 3)}
    assert neardup.classes(df.where("false"), "id", "t").count() == 0
    two = spark.createDataFrame([("a", long), ("a", long.replace("w", "v")), ("b", long.replace("w", "v"))], "id string, t string")
    assert {r.class_id for r in neardup.classes(two, "id", "t", 3, 0.6, 20).collect()} == {"a"}


def phrased(n):
    """Texts of phrases of a small stock, so that a shingle stands in many that aren't linked; every tenth is an earlier one with a phrase changed."""
    rng = random.Random(5)
    stock = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(6)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        p = list(out[rng.randrange(i)]) if i and i % 10 == 0 else [rng.choice(stock) for _ in range(8)]
        if i and i % 10 == 0:
            p[rng.randrange(8)] = rng.choice(stock)
        out.append(p)
    return {i: " ".join(p) for i, p in enumerate(out)}


def test_disk_that_classes_take_at_once(spark, monkeypatch):
    from pathlib import Path

    from tessera.plans.durable import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before, seen, durable = size(), [], neardup.durable

    def measured(df):
        out = durable(df)
        seen.append(size() - before)
        return out

    monkeypatch.setattr(neardup, "durable", measured)
    texts = phrased(4000)
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(4)
    got = neardup.classes(df, "id", "t", 3, 0.6, 20, counters=1 << 10)
    assert got.where("n_class > 1").count() > 400
    # kept sets alone would be 368 bytes a text, their packed postings as much again, and a bucket's large rows several times that
    assert max(seen) < 400 * len(texts)


@pytest.mark.parametrize("small", [4, 32, 128])
def test_rounds_of_postings_and_middle_buckets_change_no_class(spark, small):
    texts = phrased(400)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = neardup.classes(df, "id", "t", 3, 0.6, 20, small=small, counters=1 << 10, least_round=1)
    assert {(r.id, r.class_id) for r in got.collect()} == brute_classes(texts, 3, 0.6, 20)


def test_shingles_of_odd_texts():
    rng = random.Random(3)
    long = "x" * 70
    parts = ["a", "B", "ab", "ba", "\u00e9", "\u00c9", "_", "10", "\u65e5\u672c", "\u0130", long, long + "y", "y" + long, "-", "\x00"]
    texts = ["", None, " ", "a b", *(" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500))]
    at, sets = neardup.Shingler(3, 4)(texts)
    want = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if len(w := WORD.findall((t or "").lower())) >= 4}
    assert at == list(want)
    by_words, by_hash = defaultdict(list), defaultdict(list)
    for i, s in zip(at, sets, strict=True):
        assert len(s) == len(want[i]) and (s[1:] > s[:-1]).all()
        for x in want[i]:
            by_words[x].append(i)
        for x in s.tolist():
            by_hash[x].append(i)
    assert sorted(by_words.values()) == sorted(by_hash.values())


def test_trie_join_keeps_all_within_budget():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (6, 64), dtype=np.uint8)
    s = base[rng.integers(0, 6, 200)].copy()
    for row in s:
        for bit in rng.integers(0, 512, rng.integers(0, 30)):
            row[bit // 8] ^= np.uint8(1 << (7 - bit % 8))
    size = rng.integers(40, 80, 200)
    bucket = rng.integers(0, 3, 200)
    got = {(min(a, b), max(a, b)) for i, j in neardup.trie_join(neardup.Rows(bucket, s, size), 0.6) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for a in range(200):
        for b in range(a + 1, 200):
            d = int(np.unpackbits(s[a] ^ s[b]).sum())
            if bucket[a] == bucket[b] and min(size[a], size[b]) >= 0.6 * max(size[a], size[b]) and d <= int(0.25 * (size[a] + size[b]) + 1e-9):
                want.add((a, b))
    assert got == want and want


# ---- problem 3


def brute_groups(ids, pairs, sets):
    norm = lambda x: x.strip(" \t").lower() if x else ""
    by = defaultdict(set)
    for i in ids:
        if norm(i):
            by[norm(i)].add(i)
    up = {k: k for k in by}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [(a, b) for a, b in pairs] + [(m[0], x) for m in ([y for y in s if norm(y) in up] for s in sets) if m for x in m[1:]]:
        if norm(a) in up and norm(b) in up:
            up[root(norm(a))] = root(norm(b))
    out = defaultdict(list)
    for k in up:
        out[root(k)] += by[k]
    return {(x, min(v)) for v in out.values() if len(v) > 1 for x in v}


@SLOW
@given(st.integers(0, 10_000), st.sampled_from([5, 40, 2_000_000]))
def test_groups_are_those_of_union_find(spark, seed, bound):
    rng = random.Random(seed)
    ids = [f"c{i}" for i in range(80)]
    odd = lambda x: rng.choice([x, x.upper(), f" {x}\t", x])
    pairs = [(odd(rng.choice(ids)), odd(rng.choice(ids))) for _ in range(40)] + [("c1", None), ("", "c2"), ("nowhere", "c3"), ("nowhere", "c4"), ("c5", "c5")]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(50, 75)]
    sets = [[odd(rng.choice(ids)) for _ in range(3)] for _ in range(4)] + [["lost", "c6", "c7"], []]
    got = groups.group_ids(
        spark.createDataFrame([(i, i) for i in ids], "id string, a string"),
        spark.createDataFrame(pairs, "a string, b string").repartition(7),
        spark.createDataFrame([(s,) for s in sets], "members array<string>"),
        bound,
    )
    assert {(r.id, r.group_id) for r in got.collect()} == brute_groups(ids, pairs, sets)


def test_a_long_path_and_a_star(spark):
    path = spark.range(400).selectExpr("id as u", "id + 1 as v").repartition(6)
    star = spark.range(1000, 1400).selectExpr("1000 as u", "id as v")
    for bound in (50, 1_000_000):
        got = {r.id: r.root for r in components(path.unionByName(star), bound).collect()}
        assert len({got.get(i, i) for i in range(401)}) == 1 and len({got.get(i, i) for i in range(1000, 1400)}) == 1
        assert got.get(0, 0) != got.get(1000, 1000)
    assert components(path.where("false")).count() == 0


def test_spellings_and_bad_json(spark):
    ids = spark.createDataFrame([("A",), ("a",), ("b",), (None,), (" ",)], "id string")
    pairs = spark.createDataFrame([("a ", "B")], "a string, b string")
    assert {(r.id, r.group_id) for r in groups.group_ids(ids, pairs).collect()} == {("A", "A"), ("a", "A"), ("b", "A")}
    texts = ['["a", "b"', "", None, "{}", '["a",1,null,"b","a"]', "NaN", "[NaN]"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", groups.json_members("t").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [None, None, None, None, ["a", "b"], None, None]


# ---- problem 5


def brute_boundary(text, limit):
    text = text.strip(split.BLANK)
    if len(text) <= limit:
        return None
    ok = lambda ps: all(len(p.strip(split.BLANK)) <= limit for p in ps)
    para = re.split(r"\n[ \t\r\f\n]*\n", text)
    if ok(para):
        return "paragraph"
    if ok([y for p in para for y in re.split(r"(?<=[.!?])[ \t\r\n\f]+|(?<=[。！？])", p)]):
        return "sentence"
    return "word" if ok(re.split(r"[ \t\r\n\f]+", text)) else "none"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n。!", max_size=80), st.integers(3, 30))
def test_boundary(text, limit):
    assert split.boundary_of(text, limit) == brute_boundary(text, limit)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n。", max_size=120), st.integers(3, 30), st.data())
def test_pieces_cover_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    text = text.strip(split.BLANK)
    got = split.split_text(text, limit, overlap)
    assert all(0 <= a < b and b - a <= limit for a, b, _ in got)
    rest, upto = "", 0
    for a, b, _ in got:
        assert b > upto and not text[upto:a].strip(split.BLANK)
        assert not overlap or not upto or a == upto - overlap or text[upto : upto + limit - overlap].strip(split.BLANK) == ""
        rest += text[max(a, upto) : b]
        upto = b
    assert "".join(rest.split()) == "".join(text.split()) and upto == len(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 8), st.data())
def test_range_max(values, stretch, data):
    table = split.RangeMax(values, stretch)
    lo = 0
    for _ in range(5):
        lo = data.draw(st.integers(lo, len(values) - 1))
        hi = data.draw(st.integers(lo + 1, len(values)))
        most = max(values[lo:hi])
        assert table.best(lo, hi) == max(i for i in range(lo, hi) if values[i] == most)


def test_strongest_cut_wins_and_ties_go_right():
    assert [text for a, b, _ in split.split_text("aa bb\n\ncc dd ee", 12) for text in ["aa bb\n\ncc dd ee"[a:b]]] == ["aa bb", "cc dd ee"]
    assert [(a, b) for a, b, _ in split.split_text("aa bb cc", 5)] == [(0, 5), (6, 8)]
    assert split.split_text("", 5) == []
    with pytest.raises(ValueError, match="overlap"):
        split.split_text("abc", 2, 2)


def test_split_tables(spark):
    rows = [(1, "x" * 4000), (1, "x" * 4000), (2, None), (3, " \n\f"), (4, "short"), (5, "word " * 100_000)]
    df = spark.createDataFrame(rows, "parsed_id long, text string")
    assert {(r.parsed_id, r.boundary) for r in split.boundaries(df).collect()} == {(1, "none"), (5, "word")}
    got = split.pieces(df).collect()
    assert {r.parsed_id for r in got} == {1, 4, 5} and max(len(r.text) for r in got) <= 1600
    assert sorted(r["index"] for r in got if r.parsed_id == 1) == [0, 1, 2]
    assert all(r.text == dict(rows)[r.parsed_id].strip(split.BLANK)[r.start : r.start + len(r.text)] for r in got)
    assert split.boundaries(df.where("false")).count() == 0
