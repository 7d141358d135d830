"""Problem 8: texts cut off by a field limit or a broken transfer.

A stack automaton reads each text from its first to its last character: brackets, quotes,
markup elements, fences, escapes and broken byte sequences. What is open at the
end of structured text (JSON, code between fences), or of the last paragraph of other text, and escapes,
tags and fences that never end are cuts. Where nothing is
open and the last sentence has its terminator the text is whole; a mark of a
cut or prose without a terminator is a cut. What remains are
short last lines without a terminator, which may be whole titles, tag lines or
list items: those are compared with the lines that stand inside texts, and so are
known to be whole, by their shape and by their last word. Last come baselines of each source: a source that ends sentences
with an ellipsis inside its texts may end texts so, and one with far more unvouched short endings than its
plain cuts lead one to expect has a style of its own.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.skew import lookup
from tessera.plans.durable import durable
from tessera.sources.tables import table

# Signs and phrases that stand where a text was cut.
MARKS = re.compile(
    r"(?:…|\.{4,}|(?<!\.)\.\.\.(?!\.)|\[(?:\.\.\.|…|more|cut|truncated|continued|snip|read more)\]|\((?:\.\.\.|…|more|cut|truncated|continued|cont(?:inue)?d?\.?|read more)\)"
    r"|<(?:truncated|cut|more|snip)/?>|(?:continue reading|read more|show more|see more)(?:\s*(?:»|→|>>|\.\.\.|…))?|-{2,}\s*(?:connection (?:closed|lost|reset)|transfer (?:aborted|failed|interrupted)|truncated|cut off|end of file|eof|timeout|timed out)\b[^\n]*|�)$",
    re.IGNORECASE,
)
#: Signs that may also end an ordinary sentence; the source's baseline decides.
ELLIPSIS = re.compile(r"[^\W_][\"'”’]?(?:…|(?<!\.)\.\.\.)$")
#: An ellipsis is ordinary in a source where so many sentences inside texts end with one, and texts no more often than so many times as they do.
ORDINARY, TIMES = 5, 3
#: Unvouched short endings of a source are its style when there are over so many times as many as expected, and so many more.
STYLE = (5, 2)
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "approx.", "cf.", "vs.", "z.b.", "p. ex.", "etwa.", "no.", "fig.")
TERMINATORS = ".!?。！？…।؟۔"
CLOSERS = "\"'”’»)]}›」』）】"
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
#: Longest last line, in words, that may be a title, a tag line or an item.
SHORT = 14
#: A shape, a last word, a label, a last word after a label count as known when they are seen so often, and with so large a share of all of their kind.
SHAPES, ENDINGS, LABELS, TAGGED = (3, 2e-3), (2, 2e-4), (10, 1e-3), (2, 5e-4)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LABEL = re.compile(r"^([^\W\d_][\w -]{0,20}):\s")
_ENDS = re.compile(r"[.!?。！？…](?=\s)")
_DOTS = re.compile(r"[^\W_](?:…|(?<!\.)\.\.\.)(?=\s+[^\Wa-z]|\n)")
_CELL = re.compile(r"(?<!\\)\|")


# Elements that need no end; `s` is a marker of other programs more often than an element.
VOID = frozenset("s area base br col embed hr img input link meta source track wbr p li dd dt td th tr option".split())
_STRUCTURE = re.compile(
    r"(?P<escape>\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^ux\n]|(?P<half>u[0-9a-fA-F]{0,3}$|x[0-9a-fA-F]?$|$))?)"
    r"|(?P<fence>^[ \t]*(?:```+|~~~+))|(?P<gap>\n[ \t\r\f]*(?=\n))|(?P<comment><!--(?:.*?-->)?)"
    r"|(?P<tag></?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>)|(?P<unended><[A-Za-z/!][^<>]{0,200}$)|(?P<smile>[:;]-?[()\[\]]|\x1b\[)|(?P<sign>[\"“”«»()\[\]{}`])",
    re.MULTILINE | re.DOTALL,
)


def open_at_end(text: str, structured: bool = False) -> str:
    """Stack automaton over a whole text; what is open at its end, innermost last: brackets and quotes as they are, `<` an element, `~` a fence or comment, `\\` an escape, `t` a tag.

    In structured text (JSON and the like) only escapes and the closing quote count
    inside quotes, and nothing ends but by its closer. In other text a blank line ends what a paragraph left open,
    but not inside fences; a quote after a digit (inches) or closers without an opener mean nothing.
    """
    stack: list[str] = []
    fenced = 0
    for m in _STRUCTURE.finditer(text):
        kind, got = m.lastgroup, m[0]
        if kind == "half":
            kind = "escape"
        quoted = bool(stack) and stack[-1] == '"'
        if kind == "escape":
            if m["half"] is not None and m.end() == len(text) and (structured or got != "\\" or m.start() == 0 or text[m.start() - 1] != "\\"):
                return "".join(stack) + "\\"
        elif structured and quoted:
            if got == '"':
                stack.pop()
        elif kind == "fence":
            if not structured:
                fenced ^= 1
                stack.clear()
        elif fenced and kind != "sign":
            continue
        elif kind == "gap":
            if not structured and not fenced:
                stack.clear()
        elif kind == "comment":
            if not got.endswith("-->"):
                return "".join(stack) + "~"
        elif kind == "unended":
            if m.end() == len(text):
                return "".join(stack) + "t"
        elif kind == "tag":
            name = re.match(r"</?([A-Za-z0-9:-]+)", got)[1].lower()
            if name in VOID or got.endswith("/>"):
                continue
            if not got.startswith("</"):
                stack.append("<" + name)
            elif "<" + name in stack:
                del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
        elif kind == "sign":
            if got == '"':
                if quoted:
                    stack.pop()
                elif '"' in stack and not structured:
                    # a closing quote ends what was opened after it
                    del stack[len(stack) - 1 - stack[::-1].index('"') :]
                elif structured or not (m.start() and text[m.start() - 1].isdigit()):
                    stack.append('"')
            elif got in "([{“«":
                stack.append(got)
            elif got in PAIRS and PAIRS[got] in stack:
                if structured:
                    if stack[-1] == PAIRS[got]:
                        stack.pop()
                else:
                    del stack[len(stack) - 1 - stack[::-1].index(PAIRS[got]) :]
    return ("~" if fenced else "") + "".join(x[0] for x in stack)


def judge(text: str) -> tuple[str, str]:
    """("cut" | "whole" | "ask" | "dots", last line).

    `ask` is for short last lines that only other texts can vouch for, `dots` for a text that ends with an ellipsis.
    """
    t = text.rstrip()
    last = t[t.rfind("\n") + 1 :].strip()
    if MARKS.search(last):
        return ("dots" if ELLIPSIS.search(last) else "cut"), last
    if t[0] in "{[" and t[:400].lstrip("{[ \n\t\r")[:1] in '"{[]}-0123456789tfn':
        try:
            json.loads(t)
        except ValueError:
            if open_at_end(t, True):
                return "cut", last
        else:
            return "whole", last
    tail = open_at_end(t)
    if tail[-1:] in ("\\", "t", "~") or "~" in tail:
        return "cut", last
    if last[:3] in ("```", "~~~"):
        return "whole", last
    if last[:1] == "|":
        lines = t[:-1].rsplit("\n", 2)
        above = lines[-2].strip() if len(lines) > 1 else ""
        same = above[:1] != "|" or len(_CELL.findall(above)) == len(_CELL.findall(last))
        return ("whole" if last[-1] == "|" and len(last) > 1 and same else "cut"), last
    if re.search(r"\n-- *\n[^\n]*$", t):
        return "whole", last
    body = last.rstrip(CLOSERS)
    closers = last[len(body) :]
    end = body[-1:]
    if tail:
        return "cut", last
    if not end:
        return ("whole", last) if closers else ("cut", last)
    if end in TERMINATORS:
        # an abbreviation's point means the sentence goes on
        low = body.lower()
        if any(low.endswith(a) and (len(low) == len(a) or not low[-len(a) - 1].isalnum()) for a in ABBREVIATIONS):
            return "cut", last
        return "whole", last
    if end in ",;:(-–—/&+=" or (end == '"' and len(body) > 1 and body[-2] in ",;"):
        return "cut", last
    if closers:
        return "whole", last
    if not end.isalnum():
        # a sign such as an emoji after a finished sentence
        rest = re.sub(r"[^\w" + re.escape(TERMINATORS + CLOSERS) + r"]+$", "", body)
        return ("whole" if rest[-1:] and rest[-1] in TERMINATORS + CLOSERS else "ask" if len(_WORD.findall(last)) <= SHORT else "cut"), last
    return ("ask" if len(_WORD.findall(last)) <= SHORT else "cut"), last


def _bare(line: str) -> str:
    """A line without list and heading signs, in lower case; empty when it ends in a terminator or isn't short."""
    s = re.sub(r"^(?:[-*+>•]|#{1,6}|\d{1,3}[.)])\s+", "", line.strip())
    return "" if not s or not s[-1].isalnum() or len(s) > 160 or len(_WORD.findall(s)) > SHORT else s.lower()


def shape(line: str, common: frozenset[str]) -> str:
    """A line with every run of words that aren't common as one star; signs stay."""
    out = _WORD.sub(lambda m: m[0] if m[0] in common else "*", line)
    return re.sub(r"\*(?:[ \t]+\*)+", "*", out)


def _ending(line: str) -> str:
    words = _WORD.findall(line)
    return words[-1].lower() if words else ""


_SEEN = "kind string, doc_id long, source string, chars long, verdict string, line string, n long, dots long, ends long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SEEN.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            inside: Counter[str] = Counter()
            rows = []
            for doc, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not text or not (t := text.strip()):
                    continue
                verdict, last = judge(t)
                dots = len(_DOTS.findall(t)) if "…" in t or "..." in t else 0
                rows.append(("doc", doc, source, len(text), verdict, last if verdict == "ask" else None, 1, dots, len(_ENDS.findall(t))))
                lines = t.split("\n")
                inside.update(b for x in lines[:-1] if (b := _bare(x)))
            rows += [("line", None, None, None, None, k, n, None, None) for k, n in inside.items()]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, chars, cut) of every document of `docs` (doc_id, source, text) that isn't null, empty or blank.

    A null source is a source of its own. Repeated rows come out as often as they
    come in. Unvouched short endings of a source are cuts unless they are its style: far more than its plain
    cuts lead one to expect, with no length at which they pile up. A final ellipsis is a cut unless sentences
    inside the texts of its source end so about as often.
    """
    seen = durable(docs.select("doc_id", "source", "text").where("text is not null").mapInArrow(_scan, _SEEN))
    lines = durable(seen.where("kind = 'line'").groupBy("line").agg(F.sum("n").alias("n")))
    words = lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), 1)).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    # words with over 1/250 of all words: at most 250 of them
    common = frozenset(r[0] for r in words.where(F.col("n") * 250 > total).select("w").collect())

    @F.pandas_udf("string")
    def shapes(s: pd.Series) -> pd.Series:
        return s.map(lambda x: shape(x, common))

    @F.pandas_udf("string")
    def endings(s: pd.Series) -> pd.Series:
        return s.map(_ending)

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(_bare)

    def least(rule: tuple[int, float], of: int) -> float:
        return max(rule[0], rule[1] * of)

    all_lines = lines.agg(F.sum("n")).first()[0] or 0
    vouched = lines.withColumn("shape", shapes("line")).groupBy("shape").agg(F.sum("n").alias("vouchers")).where(F.col("vouchers") >= least(SHAPES, all_lines)).withColumnRenamed("shape", "k")
    ended = lines.withColumn("last", endings("line")).groupBy("last").agg(F.sum("n").alias("ends")).where(F.col("ends") >= least(ENDINGS, all_lines)).withColumnRenamed("last", "k")
    docs_seen = seen.where("kind = 'doc'")
    habit = docs_seen.groupBy(F.coalesce("source", F.lit("")).alias("k")).agg(F.sum("dots").alias("dots"), F.sum("ends").alias("ends"), F.count_if(F.col("verdict") == "dots").alias("final"), F.count("*").alias("texts"))
    habit = habit.where((F.col("dots") >= ORDINARY) & (F.col("final") * F.col("ends") <= TIMES * F.col("dots") * F.col("texts"))).select("k", F.lit(True).alias("ordinary"))
    rows = lookup(docs_seen.withColumn("s", F.coalesce("source", F.lit(""))), "s", habit, "k", how="left")
    rows = rows.select("doc_id", "source", "chars", F.when(F.col("verdict") != "dots", F.col("verdict")).when(F.col("ordinary"), "whole").otherwise("cut").alias("verdict"), "line")
    ask = rows.where("verdict = 'ask'").withColumn("bare", bare("line"))
    ask = ask.withColumns({"shape": shapes("bare"), "last": endings("line"), "label": F.nullif(F.regexp_extract("line", r"^([\p{L}][\w -]{0,20}):\s", 1), F.lit(""))})
    ask = durable(ask)
    # tag lines and the like end texts and so aren't seen inside them: a label is known by how many texts end with it
    with_label = ask.where("label is not null")
    labels = with_label.groupBy("label").agg(F.count("*").alias("labelled")).where(F.col("labelled") >= least(LABELS, ask.count())).withColumnRenamed("label", "k")
    tags = lookup(with_label, "label", labels, "k").groupBy("last").agg(F.count("*").alias("tagged")).where(F.col("tagged") >= least(TAGGED, with_label.count())).withColumnRenamed("last", "k")
    asked = lookup(lookup(lookup(lookup(ask, "shape", vouched, "k", how="left"), "last", ended, "k", how="left"), "label", labels, "k", how="left"), "last", tags, "k", how="left")
    whole = F.when(F.col("labelled").isNotNull(), F.col("tagged").isNotNull() | F.col("ends").isNotNull()).otherwise((F.col("bare") != "") & F.col("vouchers").isNotNull() & F.col("ends").isNotNull())
    asked = asked.select("doc_id", "source", "chars", F.lit("ask").alias("verdict"), (~whole).alias("loose"))
    rest = rows.where("verdict <> 'ask'").select("doc_id", "source", "chars", "verdict", F.lit(False).alias("loose"))
    every = durable(rest.unionByName(asked))
    # the baseline of each source: as many short endings as its plain cuts lead one to expect, and whether lengths pile up
    piles = every.where("loose").groupBy("source", "chars").count().groupBy(F.coalesce("source", F.lit("")).alias("p")).agg(F.max("count").alias("pile"))
    per = every.groupBy(F.coalesce("source", F.lit("")).alias("k")).agg(F.count_if("loose").alias("loose_n"), F.count_if(F.col("verdict") == "cut").alias("cut_n"))
    total = per.agg(F.sum("loose_n"), F.sum("cut_n")).first()
    expected = F.col("cut_n") * ((total[0] or 0) / max(1, total[1] or 0))
    lax = per.join(piles, F.col("k") == F.col("p")).where((F.col("loose_n") > STYLE[0] * (expected + STYLE[1])) & (F.col("pile") < 0.1 * F.col("loose_n"))).select("k", F.lit(True).alias("lax"))
    out = lookup(every.withColumn("s", F.coalesce("source", F.lit(""))), "s", lax, "k", how="left")
    return out.select("doc_id", "source", "chars", ((F.col("verdict") == "cut") | (F.col("loose") & F.col("lax").isNull())).alias("cut"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of every document that was cut off."""
    return judged(table(spark, sf_dir, "documents", "doc_id", "source", "text")).where("cut").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, docs, cut_docs, cut_share, usual_length) of each source; usual_length is the commonest length of its cut texts."""
    rows = judged(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    per = rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("cut").alias("cut_docs"))
    usual = rows.where("cut").groupBy("source", "chars").count().groupBy("source").agg(F.max_by("chars", F.struct("count", F.col("chars"))).alias("usual_length")).withColumnRenamed("source", "s")
    return per.join(usual, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "docs", "cut_docs", F.round(F.col("cut_docs") / F.col("docs"), 6).alias("cut_share"), "usual_length")
