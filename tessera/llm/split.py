"""Problem 5: splitting oversized texts at natural boundaries.

Every place where a text may be cut has a strength. A sparse table answers
"the strongest cut among these, the rightmost of equals" in constant time. It is
built for a stretch of cuts at a time and only as high as one window needs, so a
text of c cuts costs O(c log w) for windows of w cuts, and memory stays small
however long the text is.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import per_row
from tessera.sources.tables import table

#: Characters that count as blank.
BLANK = " \t\r\n\f"
#: Names of the strengths 0 to 3.
BOUNDARIES = ("none", "word", "sentence", "paragraph")
LIMIT, OVERLAP = 1600, 160
_CUT = re.compile(r"[ \t\r\n\f]+|(?<=[。！？])(?![ \t\r\n\f])")

#: Ends, next starts and strengths of the cuts of a text.
Cuts = tuple[array, array, array]


def cuts_of(text: str) -> Cuts:
    """Ends, next starts and strengths of the cuts inside a text that has no blanks at its ends."""
    ends, starts, strengths = array("q"), array("q"), array("b")
    for m in _CUT.finditer(text):
        a, b = m.span()
        if 0 < a and b < len(text):
            ends.append(a)
            starts.append(b)
            strengths.append(3 if text.count("\n", a, b) > 1 else 2 if text[a - 1] in ".!?。！？" else 1)
    return ends, starts, strengths


def cuts_at(cuts: Cuts, level: int) -> Cuts:
    """Those of the cuts that a boundary allows: a word's are all blanks, and a sign that ends a sentence without a blank is none."""
    ends, starts, strengths = cuts
    keep = [i for i, s in enumerate(strengths) if (s >= level if level > 1 else starts[i] > ends[i])]
    return array("q", [ends[i] for i in keep]), array("q", [starts[i] for i in keep]), array("b", [strengths[i] for i in keep])


class RangeMax:
    """Sparse table over strengths: place of the greatest value in [lo, hi), the rightmost of equals.

    Windows come in ascending order; the table holds `stretch` values from the window's start on.
    """

    def __init__(self, values: array | list[int], stretch: int = 1 << 13) -> None:
        self.values, self.stretch = values, stretch
        self.at = self.upto = 0
        self.rows: list[list[int]] = []

    def _build(self, lo: int, hi: int) -> None:
        self.at, self.upto = lo, min(len(self.values), max(hi, lo + self.stretch))
        n = self.n = self.upto - lo
        # strength and place in one number: the greater place wins a tie
        self.rows = [[v * n + i for i, v in enumerate(self.values[lo : self.upto])]]

    def best(self, lo: int, hi: int) -> int:
        if lo < self.at or hi > self.upto:
            self._build(lo, hi)
        k = (hi - lo).bit_length() - 1
        while len(self.rows) <= k:
            w, low = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append([a if a > b else b for a, b in zip(low, low[w:])])  # noqa: B905
        row = self.rows[k]
        return self.at + max(row[lo - self.at], row[hi - self.at - (1 << k)]) % self.n


def split_text(text: str, limit: int = LIMIT, overlap: int = 0, cuts: Cuts | None = None) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece of a text without blanks at its ends.

    No piece is over `limit` characters. Each cut is the strongest that leaves a piece of
    over `overlap` and at most `limit` characters, the rightmost of equals; where there is
    none the text is cut at the limit (strength 0). With an overlap each piece
    but the first begins exactly `overlap` characters before the end of the one before it, so
    every piece goes further than the last and no character is lost; only where the blanks after a cut
    fill all that remains does the next piece begin behind them. Without an overlap it begins after the
    blanks of the cut. The last strength is 3. `cuts` are the cuts to use, by default all of the text's.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and under the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, 3)] if n else []
    ends, starts, strengths = cuts_of(text) if cuts is None else cuts
    table_, pieces, at = RangeMax(strengths), [], 0
    while n - at > limit:
        lo, hi = bisect_right(ends, at + overlap), bisect_right(ends, at + limit)
        if lo < hi:
            i = table_.best(lo, hi)
            end, nxt, strength = ends[i], starts[i], strengths[i]
        else:
            end = nxt = at + limit
            strength = 0
        pieces.append((at, end, strength))
        at = nxt if not overlap or nxt - end >= limit - overlap else end - overlap
    pieces.append((at, n, 3))
    return pieces


def boundary_of(text: str, limit: int = LIMIT) -> str | None:
    """The strongest boundary at which all cuts can be made; null for a text of at most `limit` characters.

    The text is split with the cuts of one boundary after the other; the first that never has to cut at the limit is it.
    """
    text = text.strip(BLANK)
    if len(text) <= limit:
        return None
    cuts = cuts_of(text)
    for level in (3, 2, 1):
        if all(strength for _, _, strength in split_text(text, limit, 0, cuts_at(cuts, level))):
            return BOUNDARIES[level]
    return BOUNDARIES[0]


def boundaries(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(parsed_id, boundary) of `df` (parsed_id, text): one row for each id whose text is over the limit.

    Null, empty and blank texts are never over it. A row delivered more than once counts once.
    """

    def make():  # noqa: ANN202
        return lambda key, text: [(key, b)] if text and (b := boundary_of(text, limit)) else []

    # JVM-side, before any text goes to Python: only long texts can be over the limit
    return per_row(df.select("parsed_id", "text").where(f"length(text) > {limit}"), make, "parsed_id long, boundary string").distinct()


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(parsed_id, index, start, text, boundary) of `df` (parsed_id, text): pieces numbered from 0, with the place of their first character.

    Places are those of the text without blanks at its ends. `boundary` is the kind of the cut at the piece's end, `paragraph` for the
    last. A text within the limit is one piece; null and blank texts have none.
    A row delivered more than once counts once.
    """

    def one(key, text):  # noqa: ANN001, ANN202
        text = (text or "").strip(BLANK)
        return [(key, i, a, text[a:b], BOUNDARIES[s]) for i, (a, b, s) in enumerate(split_text(text, limit, overlap))]

    once = df.select("parsed_id", "text").where("text is not null").dropDuplicates(["parsed_id"])
    return per_row(once, lambda: one, "parsed_id long, index int, start long, text string, boundary string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parsed_id, boundary) of the documents over 1,600 characters."""
    return boundaries(table(spark, sf_dir, "parsed_documents", "parsed_id", "text"))


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk pieces of all parsed documents, 1,600 characters with an overlap of 160."""
    return pieces(table(spark, sf_dir, "parsed_documents", "parsed_id", "text"))


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parsed_id, chars, digest, empty, over) of all parsed documents: what the pieces of `p5_chunks` give when they are put together again.

    `chars` and `digest` (MD5) are those of the pieces' text without what the piece before holds already and without blanks;
    `empty` and `over` count pieces of blanks only and pieces over the limit.
    """
    got = p5_chunks(spark, sf_dir)
    per = got.groupBy("parsed_id").agg(F.array_sort(F.collect_list(F.struct("index", "start", "text"))).alias("p"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.length("text") > LIMIT).alias("over"))
    upto = F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda x: x["start"] + F.length(x["text"])))
    own = F.transform("p", lambda x, i: F.substr(x["text"], F.greatest(F.get(upto, i) - x["start"], F.lit(0)).cast("int") + 1))
    whole = F.translate(F.concat_ws("", own), BLANK, "")
    return per.select("parsed_id", F.length(whole).cast("long").alias("chars"), F.md5(whole.cast("binary")).alias("digest"), "empty", "over")
