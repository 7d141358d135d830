"""Text of web pages, with the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements of a page by their role.
PRUNED = frozenset("script style nav footer header".split())
PRUNED_ONLINE = PRUNED | {"aside"}
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = re.compile(r"(^|[\s_-])(ad|ads|banner|cookie)([\s_-]|$)", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)

    def walk(self):  # noqa: ANN201
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.walk()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)


class _Tree(HTMLParser):
    """A tree that forgives missing end tags: a new block of a kind that can't nest closes the open one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li") and any(n.tag == tag for n in self.open[-3:]) and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def prune(node: Node, tags: frozenset[str], boilerplate: bool) -> Node:
    kept: list[Node | str] = []
    for k in node.kids:
        if isinstance(k, Node):
            named = boilerplate and (BOILERPLATE.search(k.attrs.get("class", "")) or BOILERPLATE.search(k.attrs.get("id", "")))
            if k.tag in tags or named:
                continue
            prune(k, tags, boilerplate)
        kept.append(k)
    node.kids = kept
    return node


def collapse(text: str) -> str:
    return " ".join(text.split())


def blocks(node: Node) -> str:
    """The texts of all blocks, in order, parted by blank lines; a block within a block comes out twice."""
    return "\n\n".join(t for n in node.walk() if n.tag in BLOCKS and (t := collapse(n.text())))


def _first(root: Node, want) -> Node | None:  # noqa: ANN001
    return next((n for n in root.walk() if want(n)), None)


def _blocks_or_all(node: Node) -> str:
    return blocks(node) or collapse(node.text())


def html_text(html: str | None) -> str:
    """Text of a stored page: the blocks of its body, or all its text as one where there is no block."""
    if not html:
        return ""
    root = prune(parse(html), PRUNED, False)
    return _blocks_or_all(_first(root, lambda n: n.tag == "body") or root)


def page_text(html: str | None) -> str:
    """Text of a fetched page: its title as a heading, its description, its main content."""
    if not html:
        return ""
    root = prune(parse(html), PRUNED_ONLINE, True)
    title = _first(root, lambda n: n.tag == "title")
    about = _first(root, lambda n: n.tag == "meta" and n.attrs.get("name", "").lower() == "description")
    main = _first(root, lambda n: n.tag in ("main", "article") or n.attrs.get("role") == "main") or _first(root, lambda n: n.tag == "body") or root
    parts = [f"# {collapse(title.text())}" if title and collapse(title.text()) else "", collapse(about.attrs.get("content", "")) if about else "", _blocks_or_all(main)]
    return "\n\n".join(p for p in parts if p)
