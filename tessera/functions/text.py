"""Text expressions: cleaning, labels, predicates, estimates. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import RELATIONSHIPS


def strip_all(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def safe_text(c: Column) -> Column:
    """Null as the empty text, else stripped."""
    return F.coalesce(strip_all(c), F.lit(""))


def approx_tokens(c: Column) -> Column:
    """A token for every four characters begun; 0 for null."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4)


def clean_pdf_text(c: Column) -> Column:
    """Soft line breaks joined, three or more line ends as two, words divided at line ends joined, in this order."""
    # fixed values: patterns and bounds
    c = F.regexp_replace(c, r"([a-z,])\n([a-z])", "$1 $2")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"-\n([a-z])", "$1")
    return strip_all(c)


def is_noise_line(line: Column) -> Column:
    """Page numbers, `page x of y`, short chapter marks, lone form feeds."""
    # fixed values: patterns and bounds
    t = strip_all(line)
    return (
        t.rlike(r"^\d{1,4}\z")
        | t.rlike(r"(?i)^page\s+\d+(\s+of\s+\d+)?\z")
        | (t.rlike(r"(?i)^chapter\s+\d+") & (F.length(t) < 40))
        | (F.regexp_replace(line, r"[^\f]", "") == "\f") & (t == "")
    )


def strip_pattern_noise(c: Column) -> Column:
    """The text without noise lines and without runs of blank lines."""
    kept = F.filter(F.split(c, "\n"), lambda x: ~is_noise_line(x))
    return strip_all(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def is_header(line: Column) -> Column:
    """Reads like a heading: at most 80 characters and 10 parts, begins with A-Z, ends in no sentence sign."""
    # fixed values: patterns and bounds
    t = strip_all(line)
    return (t != "") & (F.length(t) <= 80) & ~t.rlike(r"[.!?,;]\z") & t.rlike("^[A-Z]") & (F.size(F.split(t, " ")) <= 10)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip_all), lambda x: x != "")


def is_citation_chunk(c: Column) -> Column:
    """Over half of at least two lines read like entries of a bibliography. Null is none."""
    # fixed values: patterns and bounds
    lines = _lines(c)
    hits = F.filter(lines, lambda x: x.startswith("^ ") | x.rlike(r"^[A-Z][a-z]+.{0,60}\(\d{4}\)"))
    return F.coalesce((F.size(lines) >= 2) & (F.size(hits) / F.greatest(F.size(lines), F.lit(1)) > 0.5), F.lit(False))


def is_glossary_chunk(c: Column) -> Column:
    """Over 45 % of at least four lines read like entries of a glossary. Null is none."""
    # fixed values: patterns and bounds
    lines = _lines(c)
    hits = F.filter(
        lines,
        lambda x: (x.rlike(r"^[A-Z][a-z]+.*[A-Z][a-z]") & (F.length(x) < 120))
        | (x.rlike(r"^[A-Z][A-Za-z\s\-]{0,40}:\s") & (F.length(x) < 150))
        | (x.rlike(r"^[A-Z][A-Za-z\s]{0,40}\s[—–]\s") & (F.length(x) < 150)),
    )
    return F.coalesce((F.size(lines) >= 4) & (F.size(hits) / F.greatest(F.size(lines), F.lit(1)) > 0.45), F.lit(False))


def source_label(c: Column) -> Column:
    """An address as it is, else what follows the last slash."""
    return F.when(c.rlike("(?i)^https?://"), c).otherwise(F.substring_index(c, "/", -1))


def concept_label(c: Column) -> Column:
    """At most 60 characters, cut back to the last blank if that is at 30 or later."""
    t = normalize_text(c)
    cut = F.substring(t, 1, 60)
    back = F.length(cut) - F.locate(" ", F.reverse(cut))
    short = F.when((F.locate(" ", cut) > 0) & (back >= 30), F.substr(cut, F.lit(1), back)).otherwise(cut)
    return F.when(F.length(t) <= 60, t).otherwise(short)


def parse_relationship(c: Column) -> Column:
    """A known relationship, whatever its case and blanks; related_to for all else."""
    t = F.lower(strip_all(c))
    return F.when(t.isin(*RELATIONSHIPS), t).otherwise("related_to")


def relationship_filter(names: list[str] | None) -> list[str] | None:
    """Known relationships among the names; null (no filter) if none is left."""
    kept = [n.strip().lower() for n in names or [] if isinstance(n, str)]
    kept = [n for n in dict.fromkeys(kept) if n in RELATIONSHIPS]
    return kept or None


def parse_tags(c: Column) -> Column:
    """Tags as an array: from a JSON array, else from a list with commas; stripped, none empty."""
    array = F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>")
    plain = F.split(F.when(~F.trim(c).startswith("["), c), ",")
    return F.coalesce(F.filter(F.transform(F.coalesce(array, plain), strip_all), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def json_ids(c: Column) -> Column:
    """The strings of a valid JSON array that aren't empty, whatever escapes they are written with; an empty array for all else. Members that aren't strings go."""
    members = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    strings = F.transform(F.filter(members, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.filter(strings, lambda x: x != ""), F.array().cast("array<string>"))


def clock(seconds: Column) -> Column:
    """`m:ss`; minutes have no bound."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (F.floor(seconds) % 60).cast("long"))


def clock_seconds(mark: Column) -> Column:
    """Seconds of `m:ss`."""
    return F.split_part(mark, F.lit(":"), F.lit(1)).cast("long") * 60 + F.split_part(mark, F.lit(":"), F.lit(2)).cast("long")


def path_label(id: Column, weight: Column) -> Column:
    return F.format_string("%s (w:%.2f)", id, weight)


def text_overlap(a: Column, b: Column, window: int = 60) -> Column:
    """Share of the shorter text that its whole windows found in the longer one cover; 0 if one is empty."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.floor(F.length(shorter) / window)
    starts = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.contains(longer, F.substr(shorter, i * window + 1, F.lit(window))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.size(hits) * window / F.greatest(F.length(shorter), F.lit(1)))
