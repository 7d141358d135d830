"""Fixtures for text, weights, chunkers and HTML."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunkers as K
from tessera.functions import text as X
from tessera.functions import weights as W
from tessera.functions.html import html_text, page_text
from tessera.functions.vectors import cosine, jaccard


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, _kind(v)) for k, v in values.items())))
    return df.select(expr.alias("x")).first().x


def _kind(v):
    return {str: "string", int: "int", float: "double", type(None): "string"}.get(type(v)) or ("array<double>" if v and isinstance(v[0], float) else "array<string>")


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("Some text\n42\nMore text\n123\nEnd", "Some text\nMore text\nEnd"),
        ("Content here\nPage 3 of 10\nMore content", "Content here\nMore content"),
        ("Previous text\nCHAPTER 5\nChapter content starts here.", "Previous text\nChapter content starts here."),
        ("First paragraph.\n\nSecond paragraph.", "First paragraph.\n\nSecond paragraph."),
        ("", ""),
    ],
)
def test_pattern_noise(spark, text, kept):
    assert one(spark, X.strip_pattern_noise(F.col("t")), t=text) == kept


def test_repeated_page_lines(spark):
    from tessera.operators.documents import strip_pdf_noise

    doc = "\f".join(f"My Book Title\nContent on page number {'abcdefghij'[n]}\nFooter Corp Inc" for n in range(10))
    rows = [(1, doc), (2, "Short document with no page breaks."), (3, None), (4, "One.\n\n\n\n\nTwo.")]
    got = {r.k: r.text for r in strip_pdf_noise(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert "My Book Title" not in got[1] and "Footer" not in got[1] and got[1].count("Content") == 10
    assert got[2] == rows[1][1] and got[3] is None and got[4] == "One.\n\nTwo."


def test_pdf_clean_joins(spark):
    assert one(spark, X.clean_pdf_text(F.col("t")), t="a line\nbroken, and\nmore\n\n\n\nEx-\nample") == "a line broken, and more\n\nEx-\nample".replace("Ex-\na", "Exa")


@pytest.mark.parametrize(("text", "is_one"), [("^ one\nAnother line", False), ("^ one\nSmith J (1999). Title\nText", True), ("^ one", False), (None, False)])
def test_citation(spark, text, is_one):
    assert one(spark, X.is_citation_chunk(F.col("t")), t=text) is is_one


@pytest.mark.parametrize(("text", "is_one"), [("Term: meaning\nword: x\nOther — thing", False), ("Term: meaning\nno match here\nOther — thing\nnothing", True), ("a\nb\nc\nd", False)])
def test_glossary(spark, text, is_one):
    assert one(spark, X.is_glossary_chunk(F.col("t")), t=text) is is_one


@pytest.mark.parametrize(("line", "is_one"), [("A" * 80, True), ("A" * 81, False), ("A b c d e f g h i j", True), ("A b c d e f g h i j k", False), ("Title.", False), ("lower", False), ("", False)])
def test_header(spark, line, is_one):
    assert one(spark, X.is_header(F.col("t")), t=line) is is_one
    assert K.is_header(line) is is_one


def test_labels_and_tags(spark):
    assert one(spark, X.concept_label(F.col("t")), t="w" * 60) == "w" * 60
    assert one(spark, X.concept_label(F.col("t")), t="x" * 40 + " " + "y" * 40) == "x" * 40
    assert one(spark, X.concept_label(F.col("t")), t="x" * 10 + " " + "y" * 80) == ("x" * 10 + " " + "y" * 80)[:60]
    assert one(spark, X.source_label(F.col("t")), t="/a/b/c.md") == "c.md"
    assert one(spark, X.source_label(F.col("t")), t="HTTPS://x.y/z") == "HTTPS://x.y/z"
    assert one(spark, X.parse_relationship(F.col("t")), t=" Supports\t") == "supports"
    assert one(spark, X.parse_relationship(F.col("t")), t="likes") == "related_to"
    assert one(spark, X.parse_tags(F.col("t")), t="a, b ,,c") == ["a", "b", "c"]
    assert one(spark, X.parse_tags(F.col("t")), t='["a", "A "]') == ["a", "A"]
    assert one(spark, X.parse_tags(F.col("t")), t=None) == []
    assert X.relationship_filter(["nonsense"]) is None and X.relationship_filter([" SUPPORTS ", "x"]) == ["supports"]
    assert one(spark, X.path_label(F.col("t"), F.col("w")), t="n", w=0.8) == "n (w:0.80)"
    assert one(spark, X.clock(F.col("n")), n=3725) == "62:05"


def test_pages_without_blocks_and_capital_classes():
    from tessera.functions.html import html_text, page_text

    assert html_text("<body><div>Only  a div.</div></body>") == "Only a div."
    assert html_text("") == html_text(None) == html_text("<body></body>") == ""
    assert page_text('<body><div class="Cookie-Banner">Accept</div><main><p>Text.</p></main></body>') == "Text."
    assert page_text("<body><main>Bare.</main></body>") == "Bare."


@pytest.mark.parametrize(("text", "ids"), [('["a","","a",7,null]', ["a", "a"]), ("not json", []), ('["a", "b"', []), ("{}", []), (None, []), ("[]", []), (r'["caf\u00e9","x"]', ["café", "x"]), (r'["a\"b"]', ['a"b']), ('["a",1,{"k":"1"}]', ["a"])])
def test_json_ids(spark, text, ids):
    assert one(spark, X.json_ids(F.col("t")), t=text) == ids


def test_text_overlap(spark):
    a = "".join(chr(97 + i % 26) + str(i) for i in range(200))[:300]
    assert one(spark, X.text_overlap(F.col("a"), F.col("b")), a=a, b=a[:240] + "x" * 60) == pytest.approx(0.8)
    assert one(spark, X.text_overlap(F.col("a"), F.col("b")), a="short", b="short") == 0
    assert one(spark, X.text_overlap(F.col("a"), F.col("b")), a="", b=a) == 0


def test_similarities(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == 0
    e = F.array().cast("array<string>")
    assert one(spark, jaccard(e, e), a="x") == 1 and one(spark, jaccard(e, F.array(F.lit("a"))), a="x") == 0


def test_weights(spark):
    assert one(spark, W.hebbian(F.col("w"), F.col("n")), w=0.4, n=5) == pytest.approx(1 - 0.6 * 0.95**5)
    step = 0.4
    for _ in range(5):
        step += 0.05 * (1 - step)
    assert one(spark, W.hebbian(F.col("w"), F.col("n")), w=0.4, n=5) == pytest.approx(step)
    assert one(spark, W.reinforced(F.col("w"), F.col("n"), F.lit(0.5), F.lit(1.0)), w=0.96, n=5) == pytest.approx(0.99)
    now = F.lit("2026-01-10").cast("timestamp")
    stale = one(spark, W.decayed(F.col("w"), F.lit(1), F.lit("2026-01-01").cast("timestamp"), now), w=0.8)
    fresh = one(spark, W.decayed(F.col("w"), F.lit(1), now, now), w=0.8)
    assert stale < fresh < 0.8
    assert one(spark, W.decayed(F.col("w"), F.lit(0), F.lit("2026-01-01").cast("timestamp"), now), w=0.05) == 0.05


def test_sections_and_paragraphs():
    t = "Intro line.\nHead One\nHead Two\nbody two.\nLast Head"
    assert K.sections(t) == [("", "Intro line."), ("Head Two", "body two.")]
    big = "x" * 2000
    assert K.paragraph_chunks(big, 400, 60) == [big]
    small = "tiny"
    body = "A sentence of words. " * 30
    assert K.paragraph_chunks(f"{body}\n\n{small}", 200, 60)[-1].endswith("\n\ntiny")
    assert K.paragraph_chunks(f"{small}\n\n{'y' * 1580}", 395, 60) == [small, "y" * 1580]
    many = ["z" * 1596] * 3
    assert K.paragraph_chunks("\n\n".join(many), 400, 60) == many
    assert K.semantic_chunks("") == [] and K.chunks_of(None) == [] and K.chunks_of(" \n") == []


def test_audio_windows():
    t = "[0:00] a\nnoise\n[1:59] b\n[2:00] c\n[65:10] d"
    assert K.audio_chunks(t) == [("[0:00] a\n[1:59] b", 0, 119), ("[2:00] c", 120, 120), ("[65:10] d", 3910, 3910)]
    assert K.audio_chunks("no marks") == [("no marks", 0, 0)]


def test_token_chunks():
    assert K.token_chunks("One short sentence.") == ["One short sentence."]
    long = " ".join(f"Sentence number {i} has some words in it." for i in range(200))
    got = K.token_chunks(long)
    assert len(got) > 1 and max(K.Words().count(c) for c in got) <= 512
    assert max(K.Words().count(c) for c in K.token_chunks("word " * 3000)) <= 512
    w = K.token_windows("a b c d e f g h i j", 4, 1, K.Words())
    assert w == ["a b c d", "d e f g", "g h i j"]
    assert len(K.token_chunks("\n\n".join(f"Paragraph {i} with text." for i in range(50)))) >= 1


def test_windows_and_prefixes():
    s = [f"{'w' * 36} {i:02d}." for i in range(20)]
    got = K.sentence_windows(" ".join(s), 50, 20)
    assert got[0].startswith(s[0]) and all(g.split(". ")[0] in got[i] for i, g in enumerate(got[1:]))
    assert got[1].startswith(s[3])
    assert K.dedupe_by_prefix(["Same start " * 6 + "x", "other", "same START " * 6 + "longer"]) == ["same START " * 6 + "longer", "other"]
    assert K.segmented_chunks("A text. More.", lambda w: None) == ["A text. More."]
    assert K.segmented_chunks("A text.\n\nMore.", lambda w: {"a": 1}) == ["A text. More."]


def test_html():
    page = "<html><head><title>My  Title</title><meta name='description' content='About it'></head><body><nav><p>menu</p></nav><article><h1>Head</h1><p>Para <b>one</b></p><ul><li><p>in</p></li></ul><div class='top-ad box'><p>buy</p></div><div class='header-bad'><p>kept</p></div></article><footer>x</footer></body></html>"
    assert html_text(page).split("\n\n") == ["Head", "Para one", "in", "in", "buy", "kept"]
    assert page_text(page).split("\n\n") == ["# My Title", "About it", "Head", "Para one", "in", "in", "kept"]
    assert html_text(None) == "" and page_text("") == "" and html_text("<p>a<p>b") == "a\n\nb"
