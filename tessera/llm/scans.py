"""Problem 2: noise in text from scanned pages.

Three kinds of damage are found and repaired: lines at the edges of pages (running
headers, footers, page numbers), words divided at the ends of lines, and
misread characters.

Misread words are found by anagram hashing. The hash of a word is the sum of
the fifth powers of its characters' codes, so a confusion of two groups of
characters changes it by a fixed difference wherever it happens. Rare words, with each
such difference added, are joined in SQL with frequent words on the hash; a pair
is kept when the confusion at one place turns one into the other, and of
several the most frequent word wins. Whether a word is rare is seen from the whole
corpus, and a word that texts which weren't scanned use as well is none.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.filters import filter_of, may_hold
from tessera.plans.durable import durable
from tessera.sources.tables import table

# Groups of characters that look alike in print; read in both directions.
ALIKE = (
    "c e", "a o", "i l", "l 1", "i 1", "o 0", "s 5", "g 9", "b 6", "b 8", "z 2", "t f", "h b", "n u", "u v", "v y", "q g", "i j", "c o", "e o", "a e",
    "m rn", "m in", "m ni", "m nn", "n ri", "n ii", "u ii", "u li", "d cl", "w vv", "w uu", "h li", "h ln", "b lo", "k lc", "nn rm", "k ic", "d ol", "ff fi", "tt ti", "a ci", "p n", "s 8", "t 7", "q 9", "o 6", "f s",
)
# Signs that stand for a group of letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Signs that divide a word at the end of a line.
DIVIDERS = "-‐‑­¬"
#: A misread word is at most one such part as frequent as the right one, which has at least so many occurrences.
RATIO, FREQUENT = 8, 8
_TOKEN = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(rf"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
_DIVIDED = re.compile(rf"(?<![^\W_])([^\W_][^\W_]*)[{DIVIDERS}]$")
_FIRST = re.compile(r"^[\"'“‘(]*([^\W_]+)")
_ROMAN = re.compile(r"^(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$", re.IGNORECASE)
_NUMBER_LINE = re.compile(
    r"^(?:[-–—~•*]\s*\d{1,4}\s*[-–—~•*]|[\[(<{]\s*\d{1,4}\s*[\])>}]|\d{1,4}|\d(?: \d){1,3}|(?:page|p\.|pg\.?|seite|página|folio)\s*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?\.?|\d{1,4}\s*(?:/|of)\s*\d{1,4})$",
    re.IGNORECASE,
)
_IMPRINT = re.compile(r"^(?:\d{1,4}\s*[|·•/]\s*)?\S+(?: \S+){0,4} (?:Press|Publishers?|Publishing|Verlag|Books|Editions?|House),? (?:1[5-9]|20)\d\d(?:\s*[|·•/]\s*\d{1,4})?$")
_CHAPTER = re.compile(r"^(?:chapter|kapitel|chapitre|capítulo|part|section)\s+(?:\d{1,3}|[ivxlc]{1,7})\b[.:]?(?:\s{2,}.*)?$", re.IGNORECASE)
_WITH_NUMBER = re.compile(r"^(?:\d{1,4}\s{2,}(?P<a>\S.*)|(?P<b>\S.*?)\s{2,}\d{1,4})$")
_SURE = re.compile(r"[^\W\d_][|!$@€][^\W\d_]|[ﬀ-ﬆ]")
_MIXED = re.compile(r"(?<![^\W_])(?=[OolISBZsz\d]*\d)(?=\d*[OolISBZsz])[OolISBZsz\d]{2,}(?![^\W_])")


def is_scan() -> Column:
    """Whether a parsed document comes from scanned pages: its path has a folder of scans, or its metadata says so."""
    path = F.coalesce("source", F.get_json_object(F.when(F.col("metadata").rlike(r"^\s*\{"), F.col("metadata")), "$.source"), F.lit(""))
    return path.rlike(r"(?i)(?:^|/)scan(?:s|ned)?/") & ~path.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")


def _key(line: str) -> str:
    """A line without page numbers and case, to compare running lines."""
    m = _WITH_NUMBER.match(line)
    return re.sub(r"\d+", "#", " ".join(((m["a"] or m["b"]) if m else line).lower().split()))


def _heading(line: str) -> bool:
    """Reads like a heading: short, begins with a capital or a number, has no sentence sign inside or at its end."""
    return 0 < len(line) <= 90 and line[-1] not in ".,;:?!\"”'" + DIVIDERS and (line[0].isupper() or line[0].isdigit()) and len(line.split()) <= 14 and not re.search(r"[^\d\W][.,;?!][\s\"”]", line)


def _like(a: str, others: list[str]) -> bool:
    """Whether a running line is one of the others, but for some misread signs."""
    m = SequenceMatcher(None, "", a, autojunk=False)
    for b in others:
        if abs(len(a) - len(b)) <= 4:
            m.set_seq1(b)
            # two cheap upper bounds come before the comparison itself
            if m.real_quick_ratio() >= 0.88 and m.quick_ratio() >= 0.88 and m.ratio() >= 0.88:
                return True
    return False


def furniture_of(lines: list[str]) -> list[bool]:
    """For each line, whether it is a running header, a footer or a page number.

    Page numbers and imprints are known by their form. They, form feeds and runs of
    at least three empty lines end a page. The line on top of a page is a header when
    it has a header's form, is the title or the top of another page but for misread
    signs, or reads like a heading that stands inside a sentence, or
    between two sentences in a text most of whose pages have a header. The first line
    is the title, unless it has a header's form or tops other pages, and a title follows.
    """
    n = len(lines)
    s = [x.strip(" \t\r\f") for x in lines]
    full = [i for i in range(n) if s[i]]
    out = [False] * n
    if not full:
        return out
    first = full[0]
    for i in full[1:]:
        x = s[i]
        if _NUMBER_LINE.match(x) or _IMPRINT.match(x) or (_ROMAN.match(x) and len(x) <= 12):
            out[i] = True
    place = {i: at for at, i in enumerate(full)}
    out = [o and _at_edge(place[i], s, lines, full, out) for i, o in enumerate(out)]
    tops: list[int] = []
    last_body = prev = first
    before = {}
    for i in full[1:]:
        lead = lines[i][: len(lines[i]) - len(lines[i].lstrip())]
        feed = "\f" in lead or any("\f" in x for x in lines[prev + 1 : i]) or lines[prev].rstrip(" \t\r").endswith("\f")
        if not out[prev]:
            last_body = prev
        if not out[i] and (feed or i - prev > 3 or out[prev]):
            tops.append(i)
            before[i] = last_body
        prev = i
    keys = {i: _key(s[i]) for i in full}
    seen = Counter(keys[i] for i in tops)
    widths = sorted(len(s[i]) for i in full)
    wide = widths[len(widths) * 9 // 10]
    if len(full) > 2 and full[1] == first + 1 and not out[full[1]] and _heading(s[full[1]]) and not s[full[2]][0].islower():
        formed = bool(_CHAPTER.match(s[first])) or bool(_WITH_NUMBER.match(s[first])) and _heading(s[first])
        if formed or _heading(s[first]) and seen[keys[first]]:
            out[first] = True
            first = full[1]
            tops = [i for i in tops if i != first]
    title = keys[first]
    every = Counter(keys[i] for i in full if i != first and _heading(s[i]))
    head = set()
    for i in tops:
        k = keys[i]
        if _CHAPTER.match(s[i]) or _WITH_NUMBER.match(s[i]) and _heading(s[i]) or _heading(s[i]) and (k == title or seen[k] > 1 or every[k] > 1):
            head.add(i)
    others = list(dict.fromkeys([title, *(keys[i] for i in head)]))
    body = [i for i in full if not out[i] and i not in head]
    below = {i: at for at, i in enumerate(body)}

    def open_after(i: int) -> bool:
        """Whether a sentence is open at the end of a line of body text that isn't a heading itself."""
        while i != first and (i in head or i not in below):
            i = full[place[i] - 1]
        if i == first or s[i][-1] in ".?!\"”:":
            return False
        at = below[i]
        alone = at > 0 and (s[body[at - 1]][-1] in ".?!\"”:" or body[at - 1] == first or i - body[at - 1] > 1)
        return not (_heading(s[i]) and alone and len(s[i]) <= 0.85 * wide)

    for i in tops:
        x = s[i]
        if i in head or not x[0].isupper() or x[-1] in ".,;:?!" + DIVIDERS:
            continue
        if _like(keys[i], others):
            head.add(i)
            continue
        if not _heading(x) or re.match(r"\d{1,2}\. ", x):
            continue
        at = place[i]
        y = s[full[at + 1]] if at + 1 < len(full) else ""
        stops = open_after(before[i])
        goes_on = y[:1].islower()
        if stops and (goes_on or len(x) <= 0.8 * wide):
            head.add(i)
        elif not stops and not goes_on and y and len(head) * 2 >= len(tops) and full[at + 1] == i + 1 and len(x) <= 0.85 * wide:
            head.add(i)
    for i in head:
        out[i] = True
    # headers of pages that nothing else parts: the title again, or one heading again and again
    for i in full:
        if i == first or out[i] or s[i][-1] in ".,;:?!" + DIVIDERS or not s[i][0].isupper():
            continue
        if _heading(s[i]) and (keys[i] == title or every[keys[i]] > 1):
            out[i] = True
        elif 0 < place[i] < len(full) - 1 and s[full[place[i] + 1]][0].islower() and open_after(full[place[i] - 1]) and _like(keys[i], others):
            out[i] = True
    return out


def _at_edge(at: int, s: list[str], lines: list[str], full: list[int], out: list[bool]) -> bool:
    """Whether a line with a page number's form stands where a page may end: not as the last words of a sentence that the lines around it belong to."""
    i = full[at]
    if at + 1 >= len(full) or len(s[i]) < 12:
        return True
    j = full[at + 1]
    x = s[j]
    return j - i > 1 or "\f" in lines[j] or out[j] or _heading(x) or x[0].islower() or i - full[at - 1] > 1


def body_words(lines: list[str], out: list[bool]) -> tuple[list[tuple[int, str, str, int]], list[tuple[int, str]]]:
    """Divided words (line, left, right, next line) and all other words (line, word) of the lines that aren't furniture."""
    body = [i for i in range(len(lines)) if lines[i].strip(" \t\r\f") and not out[i]]
    divided, words = [], []
    skip = 0
    for at, i in enumerate(body):
        x = lines[i].strip(" \t\r\f")
        start, end = skip, len(x)
        skip = 0
        m = _DIVIDED.search(x)
        if m and at + 1 < len(body) and not m[1].isdigit():
            j = body[at + 1]
            y = lines[j].strip(" \t\r\f")
            f = _FIRST.match(y)
            capitals = f and m[1].isupper() and f[1].isupper() and len(m[1]) > 1
            if f and (f[1][0].islower() or capitals) and f.start(1) == 0 and f[1] not in ("and", "or", "to", "und", "oder", "et", "ou", "y", "o", "e"):
                divided.append((i, m[1], f[1], j))
                end, skip = m.start(1), f.end(1)
        words += [(i, w) for w in _TOKEN.findall(x[start:end])]
    return divided, words


def _furnished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their furniture lines."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [[i for i, o in enumerate(furniture_of(text.split("\n"))) if o] for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=["parsed_id", "text", "furniture"])


def _counts(seen: Counter[str], scanned: bool) -> pa.RecordBatch:
    n, none = pa.array(seen.values(), pa.int64()), pa.array([0] * len(seen), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *((none, n) if scanned else (n, none))], names=["word", "clean", "scan"])


def _compounds(lines: list[str]) -> Iterator[str]:
    for x in lines:
        if "-" in x or "‐" in x or "‑" in x:
            yield from (re.sub("[‐‑]", "-", c) for c in _COMPOUND.findall(x.lower()))


def _count_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and compounds of texts that weren't scanned."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            seen: Counter[str] = Counter()
            for text in batch.column(0).slice(at, 1024).to_pylist():
                seen.update(_TOKEN.findall(text.lower()))
                seen.update(_compounds(text.split("\n")))
            yield _counts(seen, False)


def _count_scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and compounds of scanned texts (text, furniture), without their furniture and divided words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            seen: Counter[str] = Counter()
            for text, furniture in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                out = _flags(lines, furniture)
                seen.update(w.lower() for _, w in body_words(lines, out)[1])
                seen.update(_compounds([x for x, o in zip(lines, out, strict=True) if not o]))
            yield _counts(seen, True)


def _flags(lines: list[str], furniture: list[int]) -> list[bool]:
    out = [False] * len(lines)
    for i in furniture:
        out[i] = True
    return out


def anagram_value(word: Column) -> Column:
    """The anagram hash of a column of words, in SQL."""
    code = F.transform(F.split(word, ""), lambda c: F.ascii(c).cast("long") % 1021)
    return F.aggregate(code, F.lit(0).cast("long"), lambda acc, c: acc + c * c * c * c * c)


def _value(text: str) -> int:
    return sum((ord(c) % 1021) ** 5 for c in text)


def confusions() -> list[tuple[str, str]]:
    """(misread, meant) for all pairs of groups, in both directions."""
    pairs = [tuple(x.split()) for x in ALIKE]
    return sorted(set(pairs) | {(b, a) for a, b in pairs})


def place_of(word: str, meant: str) -> int | None:
    """Where one confusion turns `word` into `meant`; null if none does."""
    a = 0
    while a < min(len(word), len(meant)) and word[a] == meant[a]:
        a += 1
    for i in range(max(0, a - 2), a + 1):
        for x, y in _BY_FIRST.get(word[i : i + 1], ()):
            if word.startswith(x, i) and word[:i] + y + word[i + len(x) :] == meant:
                return i
    return None


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _x, _y in confusions():
    _BY_FIRST.setdefault(_x[0], []).append((_x, _y))


@F.pandas_udf(T.IntegerType())
def _places(word: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([place_of(a, b) for a, b in zip(word, meant, strict=True)], dtype="Int32")


def _rare(vocabulary: DataFrame) -> Column:
    """Whether a word may be misread: it has letters, and texts that weren't scanned have at most a tenth of what their length leads one to expect."""
    total = vocabulary.agg(F.sum("clean"), F.sum("scan")).first()
    expect = (total[0] or 0) / max(1, total[1] or 0)
    return (F.col("scan") > 0) & (F.col("clean") <= 0.1 * expect * F.col("scan")) & F.col("word").rlike(r"\p{L}")


def corrections(vocabulary: DataFrame) -> DataFrame:
    """(word, meant, place): each misread word with its best correction. vocabulary: word, clean, scan.

    A word is misread when it is rare beside the word it may stand for, and texts that
    weren't scanned have at most a tenth of the share of it that their length leads
    one to expect.
    """
    words = vocabulary.where("word not like '%-%'").select("word", "clean", "scan", (F.col("clean") + F.col("scan")).alias("n")).where("length(word) > 1")
    rare = words.where(_rare(vocabulary))
    steps = F.array(*[F.lit(v) for v in sorted({_value(y) - _value(x) for x, y in confusions()})])
    keyed = rare.select("word", F.col("n").alias("rare_n"), anagram_value(F.col("word")).alias("av")).select("word", "rare_n", F.explode(F.transform(steps, lambda d: F.col("av") + d)).alias("k"))
    frequent = words.where(F.col("n") >= FREQUENT).select(F.col("word").alias("meant"), "n", anagram_value(F.col("word")).alias("k"))
    near = keyed.join(frequent, "k").where((F.col("n") >= RATIO * F.col("rare_n")) & (F.abs(F.length("word") - F.length("meant")) <= 2))
    placed = near.withColumn("place", _places("word", "meant")).where("place is not null")
    best = placed.groupBy("word").agg(F.max_by(F.struct("meant", "place"), F.struct("n", "meant")).alias("m"))
    return best.select("word", "m.meant", "m.place")


_MARK = "parsed_id long, line_no int, kind string, word string, left string, right string, next_no int"


class _Wanted(dict):
    """Whether a word may be among those of a filter."""

    def __init__(self, marks) -> None:  # noqa: ANN001
        self.marks = marks

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = bool(may_hold(self.marks, [hashlib.md5(word.encode(), usedforsecurity=False).digest()])[0])
        return got


def _mark(marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    wanted = _Wanted(marks.value)
    names = [x.split()[0] for x in _MARK.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for key, text, furniture in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                lines = text.split("\n")
                out = _flags(lines, furniture)
                rows += [(key, i + 1, "furniture", None, None, None, None) for i, o in enumerate(out) if o]
                divided, words = body_words(lines, out)
                for i, left, right, j in divided:
                    a, b = left.lower(), right.lower()
                    rows.append((key, i + 1, "divided", a + b, a, b, j + 1))
                    if _SURE.search(left) or _MIXED.search(left):
                        rows.append((key, i + 1, "sure", None, None, None, None))
                    if _SURE.search(right) or _MIXED.search(right):
                        rows.append((key, j + 1, "sure", None, None, None, None))
                rows += [(key, i + 1, "word", w, None, None, None) for i, w in {(i, w.lower()) for i, w in words} if wanted[w]]
                body = [i for i, o in enumerate(out) if not o and lines[i].strip()]
                rows += [(key, i + 1, "sure", None, None, None, None) for i in body if _SURE.search(lines[i]) or _MIXED.search(lines[i])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def damage(parsed: DataFrame) -> DataFrame:
    """(parsed_id, line_no, fault, word, meant, left): every damaged line of the scanned texts of `parsed`.

    parsed: parsed_id, text, source, metadata; the vocabulary is counted over all of
    its texts. `fault` is furniture, hyphen (word: the joined word) or glyph (word: the
    misread word and what is meant, null where it is only known that a sign is wrong).
    Null, empty and blank texts have no rows; a repeated row counts once.
    """
    flagged = parsed.where("parsed_id is not null and text is not null and trim(text) <> ''").select("parsed_id", is_scan().alias("scanned"), "text")
    scans = durable(flagged.where("scanned").select("parsed_id", "text").mapInArrow(_furnished, "parsed_id long, text string, furniture array<int>"))
    counted = "word string, clean long, scan long"
    words = flagged.where("not scanned").select("text").mapInArrow(_count_clean, counted).unionByName(scans.select("text", "furniture").mapInArrow(_count_scanned, counted))
    vocabulary = durable(words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")))
    right = durable(corrections(vocabulary))
    # only words that have a correction are marked: a filter of bounded size tells them
    known = flagged.sparkSession.sparkContext.broadcast(filter_of(right.select(F.unhex(F.md5(F.col("word").cast("binary"))))))
    marks = durable(scans.mapInArrow(lambda it: _mark(known, it), _MARK).distinct())
    furniture = marks.where("kind = 'furniture'").select("parsed_id", "line_no", F.lit("furniture").alias("fault"), *_nulls("word", "meant", "left"))
    sure = marks.where("kind = 'sure'").select("parsed_id", "line_no", F.lit("glyph").alias("fault"), *_nulls("word", "meant", "left"))
    wrong = marks.where("kind = 'word'").join(right, "word").select("parsed_id", "line_no", F.lit("glyph").alias("fault"), "word", "meant", *_nulls("left"))
    # evidence for and against each division: the joined word, the compound, both parts
    counts = vocabulary.select("word", (F.col("clean") + F.col("scan")).alias("n"))
    split = durable(marks.where("kind = 'divided'"))
    forms = split.select("word", "left", "right").distinct()
    for name, form in (("joined", F.col("word")), ("compound", F.concat_ws("-", "left", "right")), ("n_left", F.col("left")), ("n_right", F.col("right"))):
        forms = forms.withColumn("k", form).join(counts.select(F.col("word").alias("k"), F.col("n").alias(name)), "k", "left").drop("k").fillna(0, [name])
    is_compound = (F.col("compound") > F.col("joined")) | ((F.col("joined") == 0) & (F.col("n_left") >= FREQUENT) & (F.col("n_right") >= FREQUENT) & (F.length("left") > 2) & (F.length("right") > 2))
    real = durable(split.join(forms.where(~is_compound).select("word", "left", "right"), ["word", "left", "right"]).select("parsed_id", "line_no", "word", "left", "next_no"))
    hyphen = real.select("parsed_id", "line_no", F.lit("hyphen").alias("fault"), "word", *_nulls("meant"), "left")
    across = real.join(right, "word").select("parsed_id", F.when(F.col("place") < F.length("left"), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), F.lit("glyph").alias("fault"), "word", "meant", *_nulls("left"))
    return furniture.unionByName(sure).unionByName(wrong).unionByName(hyphen).unionByName(across)


def _nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def rebuild(text: str, faults: list[dict]) -> str:
    """The text as continuous paragraphs: furniture gone, divided words joined, misread words put right.

    A paragraph ends at a blank line or before an indented line; lines of a paragraph are joined by blanks.
    """
    lines = text.split("\n")
    gone = {f["line_no"] for f in faults if f["fault"] == "furniture"}
    joined = {f["line_no"] for f in faults if f["fault"] == "hyphen"}
    meant = {f["word"]: f["meant"] for f in faults if f["fault"] == "glyph" and f["meant"]}

    def right(m: re.Match) -> str:
        w = m[0]
        if (r := meant.get(w.lower())) is None:
            return w
        return r.upper() if w.isupper() and len(w) > 1 else r.capitalize() if w[0].isupper() else r

    out: list[str] = []
    glue = ""
    fresh = True
    blanks = 0
    for i, raw in enumerate(lines, 1):
        x = raw.strip(" \t\r\f")
        if i in gone:
            continue
        if not x:
            blanks += 1
            continue
        x = re.sub(r"[ \t]{2,}", " ", x)
        for sign, letters in LIGATURES.items():
            x = x.replace(sign, letters)
        # a page break inside a sentence leaves blank lines that part nothing
        indented = raw.strip("\r\f")[:2] in ("  ", "\t") or raw.startswith("\t")
        open_ = bool(out) and out[-1][-1:] not in ".?!:\"”" and x[0].islower()
        if glue or (not fresh and not (blanks and not open_) and not indented):
            # a compound that ends a line with its own hyphen goes on without a blank
            out[-1] += x if glue or re.search(r"[^\W\d_]-$", out[-1]) and x[0].islower() else " " + x
        else:
            out.append(x)
        fresh, blanks, glue = False, 0, ""
        if i in joined:
            out[-1] = out[-1].rstrip(DIVIDERS)
            glue = "\x00"
    return "\n\n".join(_TOKEN.sub(right, p) for p in out)


def repaired(parsed: DataFrame) -> DataFrame:
    """(parsed_id, text, faults): the scanned texts of `parsed` with their damage repaired and the number of damaged lines."""
    faults = damage(parsed)
    per = faults.groupBy("parsed_id").agg(F.collect_list(F.struct("line_no", "fault", "word", "meant")).alias("faults"), F.countDistinct("line_no", "fault").alias("n")).withColumnRenamed("parsed_id", "k")
    texts = parsed.where("parsed_id is not null and text is not null and trim(text) <> ''").where(is_scan()).select("parsed_id", "text").dropDuplicates(["parsed_id"])

    @F.pandas_udf("string")
    def fix(text: pd.Series, faults: pd.Series) -> pd.Series:
        return pd.Series([rebuild(t, [] if f is None else list(f)) for t, f in zip(text, faults, strict=True)])

    joined = texts.join(per, F.col("parsed_id") == F.col("k"), "left")
    return joined.select("parsed_id", fix("text", "faults").alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("faults"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_documents", "parsed_id", "text", "source", "metadata")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parsed_id, line_no, fault) of every damaged line of the scanned texts."""
    return damage(_parsed(spark, sf_dir)).select("parsed_id", "line_no", "fault").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned texts in readable paragraphs."""
    return repaired(_parsed(spark, sf_dir))
