"""Problem 4: the main body of web pages.

The pages of a host are cut into shards of bounded size. Of each shard the token
streams of its pages are concatenated and their suffix array is built. Substrings of SPAN tokens, wherever they
begin and whatever line ends they cross, stand next to each other there when they are equal; those that a
fixed share of a host's pages hold are its site text, and each page's tokens that they cover go. If a share of all pages
hold a substring then so large a share of some shard's pages do, so candidates come from single shards and
are counted exactly on all shards afterwards. The same array gives, for every line, how many pages hold it
whole, and for every start of a line, how many hold that start; these supports are added up over the
shards of a host. They find short lines and lines with a changing part.
Then each page is read once more: lines covered by site text go, and what only
stands beside them (links under a heading of the site, for one) goes with them; the
unique runs between are the main body.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.skew import lookup
from tessera.plans.durable import durable
from tessera.sources.tables import table

#: Characters of text in one suffix array; but a shard of a host with several has at least so many pages, whatever their length.
CHARS_PER_SHARD, PAGES_PER_SHARD = 1_000_000, 100
#: Tokens (words, signs, line ends) of the repeated substrings, and the share of a line that they must cover.
SPAN, SPANNED = 8, 0.75
#: A line is site text when at least so many pages, and so large a share of a host's pages, hold it; for starts of lines likewise.
LEAST_PAGES, LINE_SHARE, START_SHARE = 3, 0.02, 0.05
#: Share for lines of at most SHORT_TOKENS tokens: shorter than any title, so links of a menu.
SHORT_SHARE, SHORT_TOKENS = 0.002, 3
#: Pages and share that an item of a list needs, and a line that begins as titles on its host do.
STRONG_PAGES, STRONG_SHARE = 6, 0.1
#: A start belongs to headings when it begins the title on so large a share of the pages that have a label with it.
HEAD_RATIO = 0.15
#: Every host also has the lines and starts that are site text on at least so many hosts.
LEAST_HOSTS = 3
#: Tokens of the starts that are compared, of labels and of sentences; a sentence must be covered by its start to COVERED.
LABEL_STARTS, SENTENCE_STARTS, COVERED = (2, 3, 4), (6, 8, 12, 16, 24, 32, 48), 0.75
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_+")
_WORD = re.compile(r"[^\W_]+")
_SIGNS = frozenset(":>/»›→")
_END = re.compile(r"[.!?。！？…][\"'”’)\]]*$")


def tokens_of(line: str, site: frozenset[str] = frozenset()) -> list[str]:
    """Words and signs of a line in lower case; numbers are one token, as are words of the site's own name."""
    return ["0" if t[0].isdigit() else "\x01" if t in site else t for t in _TOKEN.findall(line.lower())]


def host_of(address: str) -> str:
    """The host of an address, without `www.` and port."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", address)
    return re.sub(r"^www\d*\.", "", m[1].lower()) if m else ""


def site_words(host: str) -> frozenset[str]:
    """Words of the host's name but its last part, for instance of `weekly.name.example`: weekly, name."""
    return frozenset(w for w in re.split(r"[^a-z0-9]+", host.rpartition(".")[0]) if len(w) > 2)


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Place of each suffix of a sequence of numbers in their sorted order (the inverse suffix array), by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < n and rank.max() < n - 1:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def hash_of(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(tokens).encode()) - (1 << 63)


class _Tokens(dict):
    """Odd 64-bit hashes of tokens; forgets all when it is large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token) | 1
        return h


_HASHED = _Tokens()


def span_hashes(lines: Iterable[list[str]]) -> np.ndarray:
    """Hashes of all substrings of SPAN tokens of a page; a line end is a token."""
    flat = [h for tokens in lines for h in (*map(_HASHED.__getitem__, tokens), _HASHED["\n"])]
    return _windows(np.array(flat, dtype=np.uint64))


def _windows(x: np.ndarray) -> np.ndarray:
    n = len(x) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SPAN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shard_support(pages: list[list[tuple[list[str], bool]]], least: int = 2, spans: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, hash, pages) of the lines and starts of lines that at least `least` pages hold, and of the substrings that at least `spans` hold.

    pages: per page its lines, per line its tokens and whether it may be a label.
    The suffixes that begin a line are next to each other in the suffix array when
    they begin alike; a run of them whose common prefixes reach past the line's end
    has the whole line in common. Kinds: `line`, `short` for
    lines of few tokens, and `start` for both sorts of starts.
    """
    number: dict[str, int] = {"\n": 1}
    stream: list[int] = []
    page_of, line_at, length, label, text = [], [], [], [], []
    for p, lines in enumerate(pages):
        for tokens, is_label in lines:
            line_at.append(len(stream))
            length.append(len(tokens))
            page_of.append(p)
            label.append(is_label)
            text.append(tokens)
            stream += [number.setdefault(t, len(number) + 1) for t in tokens]
            stream.append(1)
        stream.append(-p - 1)  # a page's end is like nothing else
    if not line_at:
        return []
    s = np.array(stream, dtype=np.int64)
    rank = suffix_ranks(s)
    out: list[tuple[str, int, int]] = [] if spans is None else _spans(s, rank, number, spans)
    at, page, size, labels = np.array(line_at), np.array(page_of), np.array(length), np.array(label)
    order = np.argsort(rank[at], kind="stable")
    at, page, size, labels = at[order], page[order], size[order], labels[order]
    # common prefixes of neighbours among the starts of lines, as far as the later line goes
    lcp = np.zeros(len(at), dtype=np.int64)
    alive = np.arange(1, len(at))
    k = 0
    while len(alive):
        alive = alive[at[alive - 1] + k < len(s)]
        alive = alive[s[at[alive - 1] + k] == s[at[alive] + k]]
        k += 1
        lcp[alive] = k
        alive = alive[size[alive] >= k]

    def runs(kind: str, cut: int | None, new: np.ndarray, able: np.ndarray) -> None:
        group = np.cumsum(new)
        pairs = np.unique(np.stack([group[able], page[able]], 1), axis=0)
        which, n = np.unique(pairs[:, 0], return_counts=True)
        enough = n >= least
        for g, m in zip(np.searchsorted(group, which[enough]).tolist(), n[enough].tolist(), strict=True):
            tokens = text[order[g]]
            out.append(("short" if kind == "line" and len(tokens) <= SHORT_TOKENS else kind, hash_of(tokens if cut is None else tokens[:cut]), m))

    runs("line", None, np.concatenate([[True], lcp[1:] < size[1:] + 1]), np.ones(len(at), bool))
    for k in LABEL_STARTS:
        runs("start", k, np.concatenate([[True], lcp[1:] < k]), labels & (size > k))
    for k in SENTENCE_STARTS:
        runs("start", k, np.concatenate([[True], lcp[1:] < k]), ~labels & (size > k) & (k >= COVERED * size))
    return out


def _spans(s: np.ndarray, rank: np.ndarray, number: dict[str, int], least: int) -> list[tuple[str, int, int]]:
    """Substrings of SPAN tokens that at least `least` pages hold, from the suffix array of their stream."""
    n = len(s)
    end = s < 0
    page = np.cumsum(end) - end
    hashed = np.array([0, 0, *map(_HASHED.__getitem__, list(number)[1:])], dtype=np.uint64)
    hashed[1] = _HASHED["\n"]
    value = _windows(hashed[np.maximum(s, 0)])
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    # substrings that would cross a page's end are none
    sa = sa[(sa + SPAN <= n)]
    sa = sa[page[sa] == page[sa + SPAN - 1]]
    sa = sa[~end[sa + SPAN - 1]]
    if not len(sa):
        return []
    same = np.ones(len(sa) - 1, bool)
    for k in range(SPAN):
        same &= s[sa[1:] + k] == s[sa[:-1] + k]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    held = np.bincount(np.unique(group * (page[-1] + 1) + page[sa]) // (page[-1] + 1), minlength=len(first))
    enough = np.flatnonzero(held >= least)
    return [("span", h, m) for h, m in zip(value[sa[first[enough]]].tolist(), held[enough].tolist(), strict=True)]


def lines_of(text: str) -> list[str]:
    return [x.strip(" \t\r\f") for x in text.split("\n")]


def _is_prose(line: str) -> bool:
    """A sentence or more: ends as one, or is too long for a label."""
    words = len(_WORD.findall(line))
    return words >= 4 and bool(_END.search(line)) or words > 24


def _is_item(line: str) -> bool:
    return line[:2] in ("> ", "- ", "• ", "– ") or re.match(r"\d{1,3}[.)] ", line) is not None


def _label(line: str) -> bool:
    return not _is_prose(line) and not _is_item(line)


def _title_of(lines: Iterable[tuple[list[str], bool]]) -> list[str] | None:
    """The last label before the first sentence or item."""
    seen = None
    for tokens, label in lines:
        if not label:
            return seen
        seen = tokens
    return None


def _profile(part: pd.DataFrame) -> pd.DataFrame:
    """Supports of one shard of a host: all of them, since what one page of a shard holds may be in every other shard."""
    host = part["host"].iloc[0]
    site = site_words(host)
    shards = int(part["shards"].iloc[0])
    spans = max(LEAST_PAGES if shards == 1 else 2, int(np.ceil(LINE_SHARE * len(part) - 1e-9)))
    rows = shard_support([[(tokens_of(x, site), _label(x)) for x in lines_of(text) if x] for text in part["text"]], 1, spans)
    out = pd.DataFrame(rows, columns=["kind", "h", "pages"]).groupby(["kind", "h"], as_index=False)["pages"].max()
    out.insert(0, "host", host)
    return out


def _heads(part: pd.DataFrame, often_part: pd.DataFrame) -> pd.DataFrame:
    """How many titles of one shard begin alike (`head`), and how many of its pages hold the substrings in question (`span`); lines that are often on the whole host are no titles."""
    heads: dict[int, int] = {}
    asked = often_part["h"].to_numpy()[(often_part["kind"] == "span").to_numpy()]
    held: list[np.ndarray] = []
    host = part["host"].iloc[0] if len(part) else ""
    site, often = site_words(host), frozenset(often_part["h"][often_part["kind"] != "span"].tolist())
    for text in part["text"]:
        lines = [(tokens_of(x, site), _label(x)) for x in lines_of(text) if x]
        if len(asked):
            own = np.unique(span_hashes(x[0] for x in lines))
            held.append(own[np.isin(own, asked)])
        t = _title_of(x for x in lines if not names_site(x[0], site) and hash_of(x[0]) not in often)
        for k in LABEL_STARTS:
            if t and len(t) > k:
                h = hash_of(t[:k])
                heads[h] = heads.get(h, 0) + 1
    out = [("head", h, n) for h, n in heads.items()]
    if held:
        out += [("span", h, n) for h, n in zip(*(x.tolist() for x in np.unique(np.concatenate(held), return_counts=True)), strict=True)]
    out = pd.DataFrame(out, columns=["kind", "h", "pages"])
    out.insert(0, "host", host)
    return out


def spanned(lines: list[list[str]], spans: np.ndarray) -> list[float]:
    """The share of each line's tokens that the site's substrings (sorted hashes) cover."""
    if not len(spans):
        return [0.0] * len(lines)
    size = np.array([len(t) + 1 for t in lines], dtype=np.int64)
    own = span_hashes(lines)
    hit = (spans[np.minimum(np.searchsorted(spans, own), len(spans) - 1)] == own).astype(np.int64)
    edge = np.zeros(int(size.sum()) + 1, dtype=np.int64)
    edge[: len(hit)] += hit
    edge[SPAN : SPAN + len(hit)] -= hit
    upto = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    ends = np.cumsum(size)
    # the line's end itself does not count
    return [(upto[e - 1] - upto[e - n]) / max(1, n - 1) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def names_site(tokens: list[str], site: frozenset[str]) -> bool:
    """Whether the line has the site's name: two words of it, side by side."""
    return len(site) > 1 and any(a == b == "\x01" for a, b in zip(tokens, tokens[1:]))  # noqa: B905


def classify(text: str, site: frozenset[str], known: dict[int, str], spans: np.ndarray) -> list[bool]:
    """For each line of a page, whether it lies outside the main body; blank lines are False.

    spans: the site's substrings, sorted hashes. known: the site text by hash: `line` and `strong` lines, `start` of labels and
    sentences, `head` for starts of headings. A page without a sentence or item of
    its own has no main body.
    """
    lines = lines_of(text)
    n = len(lines)
    out, body = [False] * n, [False] * n
    at = [i for i in range(n) if lines[i]]
    tokens = [tokens_of(lines[i], site) for i in at]
    for i, t, share in zip(at, tokens, spanned(tokens, spans), strict=True):
        x = lines[i]
        label = _label(x)
        starts = [known.get(hash_of(t[:k])) for k in LABEL_STARTS if len(t) > k] if label else []
        # titles and items of lists that several pages share are long enough to be covered, and need stronger evidence
        if share >= SPANNED and "head" not in starts and not _is_item(x):
            out[i] = True
            continue
        kind = known.get(hash_of(t))
        if label:
            out[i] = kind == "strong" or ("head" not in starts and (kind == "line" or "start" in starts)) or _row_of_links(x, known, site) or _link(t, known)
        else:
            out[i] = kind == "strong" or (kind == "line" and not _is_item(x)) or any(known.get(hash_of(t[:k])) == "start" for k in SENTENCE_STARTS if COVERED * len(t) <= k < len(t))
        out[i] = out[i] or names_site(t, site) and len(t) <= 100
        body[i] = not label and not out[i]
    if not any(body):
        for i in at:
            out[i] = True
        return out
    first, last = min(i for i in at if body[i]), max(i for i in at if body[i])
    for i in at:
        # a link of a menu that few pages have, among links that many have
        if i < first and not out[i] and len(tokens_of(lines[i])) <= SHORT_TOKENS and (i > 0 and out[i - 1] or out[i + 1]):
            out[i] = True
    spaced = sum(not x for x in lines[at[0] : at[-1]]) * 4 > len(at)
    for before, i in zip(at, at[1:]):  # noqa: B905
        # links under a heading of the site, with nothing of the article after them
        if i > last and not out[i]:
            out[i] = out[before] and (not spaced or before == i - 1)
    return out


def _link(tokens: list[str], known: dict[int, str]) -> bool:
    """A label, a sign, and what reads like a title: a link to another page or the way to this one."""
    for i, t in enumerate(tokens[1:8], 1):
        if t in _SIGNS:
            rest = tokens[i + 1 :]
            if any(known.get(hash_of(rest[:k])) == "head" for k in LABEL_STARTS if len(rest) > k):
                return True
    return False


def _row_of_links(line: str, known: dict[int, str], site: frozenset[str]) -> bool:
    """A line of parts between signs, most of which are lines of the site in their own right."""
    parts = [p for p in re.split(r"\s*[|·•»>/]\s*|\s{3,}", line) if p]
    return len(parts) > 2 and sum(known.get(hash_of(tokens_of(p, site))) in ("line", "strong") for p in parts) * 2 > len(parts)


def sharded(pages: DataFrame, chars: int = CHARS_PER_SHARD, pages_least: int = PAGES_PER_SHARD) -> DataFrame:
    """Pages with the number of their host's pages (n), its shards, and a shard of bounded size."""
    size = pages.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("total")).withColumnRenamed("host", "k")
    size = size.withColumn("shards", F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / chars), F.floor(F.col("n") / pages_least))))
    return lookup(pages, "host", size, "k").withColumn("shard", F.pmod(F.xxhash64("parsed_id"), F.col("shards"))).drop("total")


def site_text(pages: DataFrame) -> DataFrame:
    """(host, kind, h): the site text of each host of `pages` (the output of `sharded`)."""
    support = durable(pages.groupBy("host", "shard").applyInPandas(_profile, "host string, kind string, h long, pages long"))
    size = durable(pages.groupBy("host").agg(F.count("*").alias("n"), F.first("shards").alias("shards")).withColumnRenamed("host", "k"))
    rows = durable(lookup(durable(support.groupBy("host", "kind", "h").agg(F.sum("pages").alias("pages"))), "host", size, "k"))
    # titles are looked for when the shards are added up: a line may be often on the host and rare in a shard
    often = rows.where(f"kind in ('line', 'short') and pages >= {LEAST_PAGES} and pages >= {LINE_SHARE} * n").select(F.col("host").alias("k"), F.lit("line").alias("kind"), "h").distinct()
    # substrings that are often in one of several shards are counted in all of them
    some = rows.where("kind = 'span' and shards > 1").select(F.col("host").alias("k"), "kind", "h")
    often = often.unionByName(some)
    per_shard = pages.select(F.col("host").alias("k"), F.col("shard").alias("s")).distinct().join(often, "k")
    second = pages.groupBy("host", "shard").cogroup(per_shard.groupBy("k", "s")).applyInPandas(_heads, "host string, kind string, h long, pages long")
    # written first: what looks for hot keys would read the pages again
    second = durable(lookup(durable(second.groupBy("host", "kind", "h").agg(F.sum("pages").alias("pages"))), "host", size, "k"))
    heads = second.where("kind = 'head'").select("host", "h", "pages", "n")
    span = rows.where("kind = 'span' and shards = 1").unionByName(second.where("kind = 'span'").select(*rows.columns))
    span = span.where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LINE_SHARE * F.col("n"))).select("host", "kind", "h")
    starts = rows.where("kind = 'start'").select("host", "h", F.col("pages").alias("seen"))
    # a start of titles that no label but titles have has no row of its own among the starts
    head = heads.join(starts, ["host", "h"], "left").where(F.col("pages") >= HEAD_RATIO * F.coalesce("seen", "pages")).select("host", "h", "n", "pages")
    share = F.when(F.col("kind") == "short", SHORT_SHARE).otherwise(LINE_SHARE)
    line = rows.where("kind in ('line', 'short')").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= share * F.col("n")))
    strong = (F.col("pages") >= STRONG_PAGES) & (F.col("pages") >= STRONG_SHARE * F.col("n"))
    line = line.select("host", F.when(strong, "strong").otherwise("line").alias("kind"), "h")
    start = rows.where("kind = 'start'").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= START_SHARE * F.col("n"))).join(head, ["host", "h"], "left_anti").select("host", "kind", "h")
    own = durable(line.unionByName(start))
    # what several hosts have in common is site text on all others as well
    pool = own.groupBy("kind", "h").agg(F.count("*").alias("hosts")).where(f"hosts >= {LEAST_HOSTS}")
    common_heads = head.groupBy("h").agg(F.count("*").alias("hosts")).where(f"hosts >= {LEAST_HOSTS}").select("h")
    pool = pool.join(common_heads, "h", "left_anti").groupBy("h").agg(F.max("kind").alias("kind"))
    held = rows.where("kind <> 'span'").select("host", "h").distinct()
    also = held.join(pool, "h").select("host", "kind", "h")
    heads = head.select("host", "h").unionByName(held.join(common_heads, "h").select("host", "h")).select("host", F.lit("head").alias("kind"), "h")
    # one kind for each hash of a host; by name, strong goes before start, line and head
    return own.unionByName(also).unionByName(heads).unionByName(span).groupBy("host", "h").agg(F.max("kind").alias("kind")).select("host", "kind", "h")


def outside(pages: DataFrame) -> DataFrame:
    """(parsed_id, line_no, text) of all lines of `pages` (the output of `web_pages`) outside the main body, and `text` of each page's body at line 0.

    A page without a main body has a null text at line 0.
    """
    pages = durable(sharded(pages))
    known = site_text(pages)
    shards = pages.select(F.col("host").alias("k"), F.col("shard").alias("s")).distinct()
    per_shard = shards.join(known.select(F.col("host").alias("k"), F.col("kind").alias("kind"), F.col("h").alias("h")), "k")

    def run(part: pd.DataFrame, site_part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"parsed_id": [], "line_no": [], "text": []})
        site = site_words(part["host"].iloc[0])
        is_span = (site_part["kind"] == "span").to_numpy()
        spans = np.sort(site_part["h"].to_numpy()[is_span])
        kinds = dict(zip(site_part["h"][~is_span].tolist(), site_part["kind"][~is_span].tolist(), strict=True))
        rows = []
        for key, text in zip(part["parsed_id"].tolist(), part["text"].tolist(), strict=True):
            gone = classify(text, site, kinds, spans)
            rows += [(key, i + 1, None) for i, g in enumerate(gone) if g]
            kept = [x for x, g in zip(lines_of(text), gone, strict=True) if not g]
            rows.append((key, 0, re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip() or None))
        return pd.DataFrame(rows, columns=["parsed_id", "line_no", "text"])

    return pages.groupBy("host", "shard").cogroup(per_shard.groupBy("k", "s")).applyInPandas(run, "parsed_id long, line_no int, text string")


def web_pages(parsed: DataFrame) -> DataFrame:
    """(parsed_id, host, text) of the web pages of `parsed` (parsed_id, source, text), each once; pages without text are left out."""
    web = parsed.select("parsed_id", "source", "text").where("source rlike '^(?i)https?://' and text is not null and trim(text) <> ''")
    host = F.regexp_replace(F.lower(F.regexp_extract("source", r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\d*\.", "")
    return web.select("parsed_id", host.alias("host"), "text").dropDuplicates(["parsed_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parsed_id, line_no) of every line of a web page outside its main body."""
    return outside(web_pages(table(spark, sf_dir, "parsed_documents", "parsed_id", "source", "text"))).where("line_no > 0").select("parsed_id", "line_no")


def p4_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parsed_id, text): the main body of every web page; null where there is none."""
    return outside(web_pages(table(spark, sf_dir, "parsed_documents", "parsed_id", "source", "text"))).where("line_no = 0").select("parsed_id", "text")
