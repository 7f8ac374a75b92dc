"""A small HTML reader for Python workers: a tree, and selectors of tags, ids, classes and attributes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)['\"]?([^'\"\]]*)['\"]?)?\]")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def text(self) -> str:
        """All text inside, white space runs as one space."""
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                todo.extend(reversed(x.children))
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def walk(self):
        """The nodes inside, in document order."""
        todo = [x for x in reversed(self.children) if isinstance(x, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(y for y in reversed(x.children) if isinstance(y, Node))

    def find(self, selector: str) -> list[Node]:
        steps = _compiled(selector)
        return [x for x in self.walk() if any(_matches(x, s) for s in steps)]

    def closest(self, selector: str) -> Node | None:
        steps, x = _compiled(selector), self
        while x is not None and not any(_matches(x, s) for s in steps):
            x = x.parent
        return x


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "option") and self.at.tag == tag and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent:
            self.at = x.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_cache: dict[str, list] = {}


def _compiled(selector: str) -> list:
    if selector not in _cache:
        _cache[selector] = [[_SIMPLE.findall(part) for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one)] for one in re.split(r",(?![^\[]*\])", selector)]
    return _cache[selector]


def _is(node: Node, tests: list) -> bool:
    for tag, ident, cls, name, how, value in tests:
        a = node.attributes
        if tag and tag not in ("*", node.tag) or ident and a.get("id") != ident or cls and cls not in a.get("class", "").split():
            return False
        if name:
            got = a.get(name)
            if got is None or (how == "=" and got != value) or (how == "*=" and value not in got) or (how == "^=" and not got.startswith(value)) or (how == "$=" and not got.endswith(value)):
                return False
    return True


def _matches(node: Node, steps: list) -> bool:
    """Whether the last step fits node and the others fit ancestors, in order."""
    if not _is(node, steps[-1]):
        return False
    left, x = len(steps) - 2, node.parent
    while left >= 0 and x is not None:
        if _is(x, steps[left]):
            left -= 1
        x = x.parent
    return left < 0
