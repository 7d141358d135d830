"""Scans, pages, tokens, leaks, truncation: fixtures, round trips and brute force."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tessera.llm import boilerplate, leaks, scans, tokenize, truncation

VOCABULARY = os.path.join(tokenize.VOCABULARIES, "byte_bpe_50k.tiktoken")
has_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


# ---- problem 2

BODY = "the quiet engineer described a narrow result in the northern annex and the committee accepted the report without further comment before the winter"


def scan(pages, header="A quiet report", sep="\f"):
    return sep.join(f"{header}\n" * (i > 0) + p + f"\n{i + 1}\n" for i, p in enumerate(pages))


def test_furniture():
    text = "A quiet report\n\nThe first line of body goes\non to the next line and\n- 1 -\n\fA QUIET REPORT\nends here. The other body.\n\nPage 2 of 3\n\n\n\n\nChapter 2\nmore body text of the page.\nSome Press, 1946"
    lines = text.split("\n")
    got = {i + 1 for i, o in enumerate(scans.furniture_of(lines)) if o}
    assert got == {5, 6, 9, 14, 16}
    assert scans.furniture_of(["", "Title"]) == [False, False] and scans.furniture_of([]) == []


def test_body_keeps_years_and_list_numbers():
    lines = ["Title", "", "It was built in", "1952, and then again in the year", "1960 by the same people."]
    assert not any(scans.furniture_of(lines))


def test_divided_words_and_compounds():
    lines = ["Title", "", "the engi-", "neer kept a low-", "cost plan¬", "ning group 1914-", "18 and"]
    d, words = scans.body_words(lines, [False] * len(lines))
    assert [(a, b) for _, a, b, _ in d] == [("engi", "neer"), ("low", "cost"), ("plan", "ning")]
    assert "neer" not in [w for _, w in words]


@pytest.mark.parametrize(("word", "meant", "place"), [("tbe", "the", 1), ("frorn", "from", 3), ("1ine", "line", 0), ("callecl", "called", 5), ("vvork", "work", 0), ("mstructor", "instructor", 0), ("cat", "dog", None)])
def test_confusions(word, meant, place):
    assert scans.place_of(word, meant) == place
    delta = scans._value(meant) - scans._value(word)
    assert (delta in {scans._value(b) - scans._value(a) for a, b in scans.confusions()}) == (place is not None)


def test_damage_and_repair(spark):
    rows = [(i, f"# Note\n\n{BODY}.", "/notes/a.md", None) for i in range(100, 130)]
    rows += [(1, f"A quiet report\n\n{BODY[:40]}\nthe tbe quiet engi-\nneer described a narr0w result ﬁnally\n1\n\fA quiet report\nin the annex.\n2", "/x/scans/a.pdf", "{}")] * 2
    rows += [(2, None, "/x/scans/b.pdf", None), (3, " ", "/x/scans/c.pdf", None), (4, "another text", "/x/other/d.pdf", None), (5, "A one line scan", None, '{"source": "/in/scans/e.png"}')]
    df = spark.createDataFrame(rows, "parsed_id long, text string, source string, metadata string")
    got = {(r.parsed_id, r.line_no, r.fault) for r in scans.damage(df).collect()}
    assert got == {(1, 4, "glyph"), (1, 4, "hyphen"), (1, 5, "glyph"), (1, 6, "furniture"), (1, 7, "furniture"), (1, 9, "furniture")}
    text = {r.parsed_id: r.text for r in scans.repaired(df).collect()}
    assert set(text) == {1, 5} and "the the quiet engineer described a narrow result finally in the annex." in text[1]
    assert scans.damage(df.where("false")).count() == 0


def test_a_misread_word_that_a_clean_text_has_once(spark):
    rows = [(i, BODY + (" tbe" if i == 100 else ""), "/notes/a.md", None) for i in range(100, 130)]
    rows += [(i, "A quiet report\n\nthe quiet engineer described\ntbe narrow result in the annex.", "/x/scans/a.pdf", None) for i in range(8)]
    df = spark.createDataFrame(rows, "parsed_id long, text string, source string, metadata string")
    got = {(r.parsed_id, r.line_no, r.word, r.meant) for r in scans.damage(df).where("fault = 'glyph'").collect()}
    assert got == {(i, 4, "tbe", "the") for i in range(8)}


# ---- problem 4


def site(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    pages = []
    for i in range(n):
        body = [" ".join(word() for _ in range(12)) + "." for _ in range(2)]
        title, link = f"The {word()} {word()} of {word()}", f"Some {word()} and {word()} {word()}"
        pages.append((i, f"https://www.some-site.test/p{i}", f"Home | About | Contact\n\n{title}\n\n{body[0]}\n\n{body[1]}\n\n{i} comments\n\nRelated pages\n{link}\n\n© 2021 Some Site. All rights reserved."))
    return pages


def test_only_the_body_is_left(spark):
    rows = site(40) + [(900, "https://www.some-site.test/wall", "Home | About | Contact\n\nRelated pages\nSome other page"), (901, "/scans/a.pdf", "Home | About | Contact"), (902, "https://x.y/z", None), (903, None, "Home")]
    df = spark.createDataFrame(rows + rows[:2], "parsed_id long, source string, text string")
    got = {}
    for r in boilerplate.outside(boilerplate.web_pages(df)).where("line_no > 0").collect():
        got.setdefault(r.parsed_id, set()).add(r.line_no)
    assert got[5] == {1, 9, 11, 12, 14} and got[900] == {1, 3, 4} and 901 not in got
    main = {r.parsed_id: r.text for r in boilerplate.outside(boilerplate.web_pages(df)).where("line_no = 0").collect()}
    assert main[900] is None and main[5] == "\n\n".join(rows[5][2].split("\n\n")[1:4]) and len(main) == 41
    assert boilerplate.outside(boilerplate.web_pages(df.where("false"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_ranks(values):
    import numpy as np

    s = np.array([*values, -1])
    order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert [int(x) for x in np.argsort(boilerplate.suffix_ranks(s))] == order


def test_support_counts_pages_once():
    lines = [[(["a", "b"], True), (["a", "b"], True), (["c"], True)], [(["a", "b"], True), (["d"], True)], [(["c"], True)]]
    got = {(k, h): n for k, h, n in boilerplate.shard_support(lines)}
    assert got["short", boilerplate.hash_of(["a", "b"])] == 2 and got["short", boilerplate.hash_of(["c"])] == 2 and ("short", boilerplate.hash_of(["d"])) not in got
    assert boilerplate.shard_support([]) == []


def test_supports_of_many_shards_are_those_of_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(240):
        menu = ["Home"] + ["Rare link"] * (i % 80 == 0) + [f"All the pages of part {'abcdefghij'[i % 10]}"]
        rows.append((i, "some-site.test", "\n".join([*menu, f"The {word()} {word()} of {word()}", " ".join(word() for _ in range(12)) + ".", "A line of some."])))
    pages = spark.createDataFrame(rows, "parsed_id long, host string, text string")
    one, many = ({(r.kind, r.h) for r in boilerplate.site_text(boilerplate.sharded(pages, chars)).collect()} for chars in (1_000_000, 400))
    assert ("line", boilerplate.hash_of(["rare", "link"])) in one
    assert many == one


def test_text_of_several_hosts_counts_on_large_hosts_too(spark):
    line = "Brought to you by the same press"
    rows = [(1000 * k + i, f"h{k}.test", f"Page {i} of it\n{line}\nSome words that end here.") for k in range(3) for i in range(5)]
    rows += [(9000 + i, "large.test", (f"{line}\n" if i == 7 else "") + "Other words that end here.") for i in range(220)]
    known = boilerplate.site_text(boilerplate.sharded(spark.createDataFrame(rows, "parsed_id long, host string, text string"))).where("host = 'large.test'")
    assert boilerplate.hash_of(boilerplate.tokens_of(line)) in {r.h for r in known.collect()}


def test_substrings_inside_lines_are_found_in_any_number_of_shards(spark):
    rng = random.Random(8)
    notice = "this notice stands inside a line and never begins one of them at all"
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    rows = []
    for i in range(400):
        own = [" ".join(word() for _ in range(12)) for _ in range(3)]
        if i % 20 == 0:
            own.append(f"{word()} {notice} {word()}")
        rows.append((i, "pages.test", "\n".join(own)))
    pages = spark.createDataFrame(rows, "parsed_id long, host string, text string")
    found = [{(r.kind, r.h) for r in boilerplate.site_text(boilerplate.sharded(pages, chars)).collect() if r.kind == "span"} for chars in (1_000_000, 400)]
    assert found[0] == found[1] == {("span", h) for h in boilerplate.span_hashes([boilerplate.tokens_of(notice)]).tolist()[: 15 - boilerplate.SPAN]}
    known = np.sort(np.array([h for _, h in found[0]]))
    lines = [boilerplate.tokens_of(x) for x in ("an own line of the page", f"a {notice} b", "short")]
    assert [round(x, 3) for x in boilerplate.spanned(lines, known)] == [0, 0.875, 0]


# ---- problem 6


@has_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_library_and_go_back(text):
    import tiktoken

    ranks = tokenize.read_ranks(VOCABULARY)
    want = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    e = tokenize.Encoder(ranks)
    assert e.encode(text) == want and e.decode(want) == text


@has_vocabulary
def test_long_runs_and_specials():
    import tiktoken

    ranks = tokenize.read_ranks(VOCABULARY)
    lib = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = tokenize.Encoder(ranks)
    rng = random.Random(1)
    for t in ("a" * 5000, "".join(rng.choice("abcd") for _ in range(5000)), "<|endoftext|>", " " * 300 + "x", "é" * 700, "�\u0000"):
        assert e.encode(t) == lib.encode_ordinary(t)


@has_vocabulary
def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenize.encode_column(df, "doc_id", "text", VOCABULARY).collect()}
    assert got[1] and got[2] == [] and got[3] == []
    assert tokenize.encode_column(df.where("false"), "doc_id", "text", VOCABULARY).count() == 0


# ---- problem 7


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton_is_exact(items, doc, least):
    a = leaks.Automaton(list(enumerate(items)), least)
    got = set()
    for at, n, found in a.matches(doc):
        assert any(doc[at - n + 1 : at + 1] == w[i : i + n] for w in items for i in range(len(w)))
        got |= found
    runs = {tuple(doc[i : i + least]) for i in range(len(doc) - least + 1)}
    assert got == {k for k, w in enumerate(items) if any(tuple(w[i : i + least]) in runs for i in range(len(w) - least + 1))}


def test_leaks_and_scrubbing(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Before it: {item.upper()}! and after it stand many other words of this text here now"), (2, item.rsplit(" ", 2)[0]), (3, None), (4, ""), (5, f"{item} x"), (6, item.replace("six", "6"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "short one")], "item_id long, text string")
    for size in (5, 200_000):
        assert {tuple(r) for r in leaks.leaks(docs, items, size=size).collect()} == {(1, 7), (5, 7)}
    got = {r.doc_id: r for r in leaks.scrubbed(docs, items).collect()}
    assert got[1].text == "Before it: ! and after it stand many other words of this text here now" and not got[1].dropped
    assert got[5].dropped and got[5].text is None and set(got) == {1, 5}
    assert leaks.leaks(docs, items.where("false")).count() == 0 and leaks.leaks(docs.where("false"), items).count() == 0


# ---- problem 8


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("A whole sentence.", "whole"), ("She said \"it is so.\"", "whole"), ("A sentence that sto", "ask"), ("It goes on and on, and it never comes to the end of what it has to say in th", "cut"),
        ("It was the…", "dots"), ("It was the [...]", "cut"), ("And then (more)", "cut"), ("It was\n--- connection closed", "cut"), ("The last w�", "cut"), ("It ends here,", "cut"),
        ('{"a": [1, 2', "cut"), ('{"a": [1, 2]}', "whole"), ("```\ncode()\n```", "whole"), ("Text.\n```\ncode()", "cut"), ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"), ("| a | b |\n|---|---|\n| 1 |", "cut"),
        ("Several notes (e.g.", "cut"), ("Best wishes\n\n-- \nsome desk", "whole"), ("这是一个完整的句子。", "whole"), ("A finished one. 🌱", "whole"), ("Some text <a href='x", "cut"), ("He wrote, \"the log is", "cut"),
        ("unclosed (bracket here. Then it ended.", "cut"), ("<b>bold text. Finished.", "cut"), ("He said \"yes. And left.", "cut"), ("One \"open\n\nparagraph. The next ends.", "whole"), ("a \\u12", "cut"), ("x = f(a, [1,\n2, 3)", "whole"),
        ("Sad :( but done.", "whole"), ("A 5\" pipe is here.", "whole"), ("Noted. --- connection closed " + "x" * 400, "cut"), ("It <em>went</em> on.", "whole"), ("He waited...", "dots"),
    ],
)
def test_verdicts(text, verdict):
    assert truncation.judge(text)[0] == verdict


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=60).filter(lambda t: t.strip()))
def test_any_text_has_a_verdict(text):
    assert truncation.judge(text.strip())[0] in ("cut", "whole", "ask", "dots")


def test_an_ellipsis_is_ordinary_where_its_source_uses_it(spark):
    rows = [(i, "tales", "He waited... Nothing came… And then it rained." if i % 9 else "He waited... And so it went...") for i in range(40)]
    rows += [(100 + i, "feed", "The board met on Monday. It will decide on the" + "…" * (i % 2 == 0)) for i in range(40)]
    got = {r.doc_id: r.cut for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not any(v for k, v in got.items() if k < 100) and all(v for k, v in got.items() if k >= 100 and k % 2 == 0)


def test_other_texts_vouch(spark):
    rng = random.Random(3)
    terms = [f"{a} {b}" for a in ("kelp", "lock", "type") for b in ("bed", "table", "lattice")]
    rows = []
    for i in range(120):
        t = rng.choice(terms)
        rows.append((i, "a", f"Notes toward a {t}\n\nThe {t} was seen again, as the committee had said it would be in the winter."))
    rows += [(500, "b", "Notes toward a kelp bed"), (501, "b", "Notes toward a kel"), (502, "b", None), (503, "b", "  "), (504, "b", "The lock table was"), (505, None, "The type lattice.")]
    got = {r.doc_id: r.cut for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(got) == 124 and {k for k, v in got.items() if v} == {501, 504}
    assert truncation.judged(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


# ---- all of them


def test_queries_are_there():
    names = set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= names


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match(r"p\d_", n)))
def test_queries_run(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and rows
