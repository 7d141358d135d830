"""Problem 7: evaluation texts that leak into training text.

A generalised suffix automaton of the items' words is built once and broadcast;
documents are streamed through it word by word. At each word the automaton gives
the longest run that ends there and stands in some item, and the suffix of
exactly `least` words of that run names all items that hold it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import per_row
from tessera.sources.tables import table

_WORD = re.compile(r"[^\W_]+")
LEAST_WORDS = 12
#: Words of items in one automaton; more items are searched in blocks of this size, so what is broadcast is bounded (about 60 MB).
WORDS_PER_BLOCK = 200_000


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits in the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST_WORDS) -> None:
        self.least = least
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.number.setdefault(w, len(self.number)), own)
                own[last].add(item)
        # a state's items are its own and those of all states whose suffix link leads to it
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= least:
                own[self.link[s]] |= own[s]
        self.items = [frozenset(x) if n >= least else frozenset() for x, n in zip(own, self.length, strict=True)]

    def _state(self, length: int, to: dict[int, int], link: int, own: list[set[int]]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        own.append(set())
        return len(self.link) - 1

    def _extend(self, p: int, c: int, own: list[set[int]]) -> int:
        if (q := self.next[p].get(c)) is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, own)
        s = self._state(self.length[p] + 1, {}, 0, own)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = s
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, own)
        return s

    def _split(self, p: int, c: int, q: int, own: list[set[int]]) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def matches(self, words: list[str]) -> list[tuple[int, int, frozenset[int]]]:
        """(place of the last word, length, items) wherever a run of at least `least` words of an item ends.

        `items` are those that hold the last `least` words of the run.
        """
        out, state, length = [], 0, 0
        number, nxt, link, longest, least = self.number.get, self.next, self.link, self.length, self.least
        for at, w in enumerate(words):
            c = number(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                length = longest[state]
            if (to := nxt[state].get(c)) is None:
                continue
            state, length = to, length + 1
            if length >= least:
                s = state
                while longest[link[s]] >= least:
                    s = link[s]
                out.append((at, length, self.items[s]))
        return out


def _blocks(items: list[tuple[int, list[str]]], size: int, least: int = LEAST_WORDS) -> list[list[tuple[int, list[str]]]]:
    """Items in blocks of at most `size` words (or `2 * least`); an item over it is cut into pieces that overlap by all but one word of a run of `least`, so that each such run stands in a piece."""
    out: list[list[tuple[int, list[str]]]] = [[]]
    held = 0
    size = max(size, 2 * least)
    for item, words in ((i, w[at : at + size]) for i, w in items for at in range(0, max(1, len(w) - least + 1), size - least + 1)):
        if out[-1] and held + len(words) > size:
            out.append([])
            held = 0
        out[-1].append((item, words))
        held += len(words)
    return out


def _automata(items: DataFrame, least: int, size: int) -> list[Automaton]:
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator()
    kept = sorted((r[0], w) for r in rows if len(w := words_of(r[1])) >= least)
    return [Automaton(b, least) for b in _blocks(kept, size, least) if b]


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, size: int = WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id): the document holds at least `least` successive words of the item.

    docs: doc_id, text. items: item_id, text; held-out sets don't grow with the
    corpus, and the automata go out in blocks of bounded size. Null, empty and
    shorter texts match nothing; repeated rows count once.
    """
    sc = docs.sparkSession.sparkContext
    # blocks are bounded; where there are several, each document meets one after the other in the same task
    shared = [sc.broadcast(a) for a in _automata(items, least, size)]
    if not shared:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")

    def make():  # noqa: ANN202
        def one(doc, text):  # noqa: ANN001, ANN202
            words = words_of(text)
            return [(doc, i) for i in sorted({i for b in shared for _, _, got in b.value.matches(words) for i in got})]

        return one

    return per_row(docs.select("doc_id", "text").where("text is not null"), make, "doc_id long, item_id long").distinct()


def scrubbed(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, coverage: float = 0.5, size: int = WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, text, removed_words, dropped) of every document that leaks.

    Each run of at least `least` words of an item is cut out of the text, from
    its first to its last word. Where the runs make up at least `coverage` of the
    document's words the whole text goes (null, dropped = true).
    """
    sc = docs.sparkSession.sparkContext
    automata = _automata(items, least, size)
    if not automata:
        return docs.sparkSession.createDataFrame([], "doc_id long, text string, removed_words long, dropped boolean")
    # blocks are bounded; where there are several they are read one after the other in the same task
    shared = [sc.broadcast(a) for a in automata]

    def make():  # noqa: ANN202
        def one(doc, text):  # noqa: ANN001, ANN202
            low = text.lower()
            if len(low) != len(text):  # a letter whose lower case is longer: work on a text with the same places
                low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
            spans = [m.span() for m in _WORD.finditer(low)]
            words = [low[a:b] for a, b in spans]
            runs = sorted((at - n + 1, at) for b in shared for at, n, _ in b.value.matches(words))
            merged: list[list[int]] = []
            for a, b in runs:
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            if not merged:
                return []
            gone = sum(b - a + 1 for a, b in merged)
            if gone >= coverage * len(words):
                return [(doc, None, gone, True)]
            out, at = [], 0
            for a, b in merged:
                out.append(text[at : spans[a][0]])
                at = spans[b][1]
            return [(doc, "".join([*out, text[at:]]), gone, False)]

        return one

    return per_row(docs.select("doc_id", "text").where("text is not null"), make, "doc_id long, text string, removed_words long, dropped boolean")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leak of at least 12 words."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p7_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents without the leaked passages."""
    return scrubbed(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")).select("doc_id", F.col("text"), "removed_words", "dropped")
