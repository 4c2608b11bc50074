"""Tolerant trees of XML and HTML: any input gives a tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
# Elements that end an open paragraph.
END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Named characters; others stay as written.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "bull": "•", "middot": "·", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼",
    "frac34": "¾", "sup2": "²", "sup3": "³", "micro": "µ", "para": "¶", "sect": "§", "dagger": "†", "Dagger": "‡",
    "permil": "‰", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "laquo": "«", "raquo": "»", "larr": "←",
    "rarr": "→", "harr": "↔", "darr": "↓", "uarr": "↑", "ne": "≠", "le": "≤", "ge": "≥", "infin": "∞",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "mu": "μ", "omega": "ω", "shy": "",
    "ensp": " ", "emsp": " ", "thinsp": " ", "zwnj": "‌", "zwj": "‍",
}
#: What an open element (key) makes of a new one: it ends before these.
ENDS = {
    "p": END_P,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "tr": frozenset(("tr",)),
    "option": frozenset(("option", "optgroup")),
    "thead": frozenset(("thead", "tbody", "tfoot")),
    "tbody": frozenset(("thead", "tbody", "tfoot")),
    "tfoot": frozenset(("thead", "tbody", "tfoot")),
    "head": frozenset(("body",)),
}
_ENTITY = re.compile(r"&(?:#[xX]?([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]{1,31}));")
_TAG = re.compile(r"<([A-Za-z_][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*(?:(?P<end>>)|=|(?P<name>[^\s=/>]+)(?:\s*=\s*(?:"(?P<d>[^"]*)(?:"|$)|'(?P<s>[^']*)(?:'|$)|(?P<u>[^\s>]*)))?)""")


def decode_entities(s: str) -> str:
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        if m[2]:
            return ENTITIES.get(m[2], m[0])
        hexadecimal = m[0][2] == "x"
        if m[0][2] == "X" or not hexadecimal and not m[1].isdigit():
            return m[0]
        code = int(m[1], 16 if hexadecimal else 10)
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return _ENTITY.sub(one, s)


@dataclass(eq=False, slots=True)
class Node:
    """An element; its kids are nodes and strings."""

    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.partition(":")[2] or self.name

    def is_(self, query: str) -> bool:
        return (self.name if ":" in query else self.local) == query

    def attr(self, query: str) -> str | None:
        """An attribute by its name; without a prefix in the query, by its local name too."""
        if query in self.attrs:
            return self.attrs[query]
        return next((v for k, v in self.attrs.items() if ":" in k and k.partition(":")[2] == query), None) if ":" not in query else None

    def elements(self, query: str | None = None) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and (query is None or k.is_(query))]

    def child(self, query: str) -> Node | None:
        return next((k for k in self.kids if isinstance(k, Node) and k.is_(query)), None)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; without recursion, as hostile input nests deeply."""
        stack = [iter(self.kids)]
        while stack:
            for k in stack[-1]:
                if isinstance(k, Node):
                    yield k
                    stack.append(iter(k.kids))
                    break
            else:
                stack.pop()

    def path_to(self, node: Node) -> str:
        """Names from this element's kids down to node, joined by slashes; empty where node isn't below."""
        stack: list[tuple[Node, str]] = [(k, k.name) for k in self.elements()]
        while stack:
            here, path = stack.pop()
            if here is node:
                return path
            stack += [(k, f"{path}/{k.name}") for k in here.elements()]
        return ""

    def all(self, query: str) -> list[Node]:
        return [k for k in self.walk() if k.is_(query)]

    def first(self, query: str) -> Node | None:
        return next((k for k in self.walk() if k.is_(query)), None)

    def text(self) -> str:
        out, stack = [], [iter(self.kids)]
        while stack:
            for k in stack[-1]:
                if isinstance(k, Node):
                    stack.append(iter(k.kids))
                    break
                out.append(k)
            else:
                stack.pop()
        return "".join(out)

    def say(self, s: str) -> None:
        if s:
            if self.kids and isinstance(self.kids[-1], str):
                self.kids[-1] += s
            else:
                self.kids.append(s)


def _read_tag(src: str, at: int, html: bool) -> tuple[str, dict[str, str], bool, int] | None:
    m = _TAG.match(src, at)
    if not m:
        return None
    attrs: dict[str, str] = {}
    pos, closed = m.end(), False
    while pos < len(src) and (a := _ATTR.match(src, pos)):
        gap = src[pos : a.start("name")] if a["name"] else src[pos : a.end()]
        closed |= "/" in gap
        pos = a.end()
        if a["end"]:
            break
        if a["name"]:
            name = a["name"].lower() if html else a["name"]
            value = next((a[g] for g in "dsu" if a[g] is not None), None)
            attrs[name] = decode_entities(name if value is None else value)
    else:
        pos = len(src)
    return m[1], attrs, closed, pos


#: Elements nested deeper than this are kept flat.
DEPTH = 300


def parse(src: str, html: bool) -> Node:
    root = Node("#document")
    open_ = [root]
    pos, n = 0, len(src)
    lower = None
    while pos < n:
        at = src.find("<", pos)
        open_[-1].say(decode_entities(src[pos : at if at >= 0 else n]))
        if at < 0:
            break
        after = src[at : at + 9]
        skip = next(((len(a), z) for a, z in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")) if after.startswith(a)), None)
        if skip:
            end = src.find(skip[1], at + skip[0])
            inner = src[at + skip[0] : end if end >= 0 else n]
            pos = end + len(skip[1]) if end >= 0 else n
            if skip[0] == 9:
                open_[-1].say(inner)
            elif after.startswith("</") and end >= 0:
                name = inner.strip().lower() if html else inner.strip()
                depth = next((d for d in range(len(open_) - 1, 0, -1) if name in (open_[d].name, open_[d].local)), None)
                if depth:
                    del open_[depth:]
            continue
        tag = _read_tag(src, at, html)
        if not tag:
            open_[-1].say("<")
            pos = at + 1
            continue
        name, attrs, closed, pos = tag
        node = Node(name.lower() if html else name, attrs)
        if html and len(open_) > 1:
            top = open_[-1].local
            if node.local in ENDS.get(top, ()):
                open_.pop()
                if top in ("td", "th") and node.local == "tr" and open_[-1].local == "tr":
                    open_.pop()
        open_[-1].kids.append(node)
        if closed or html and node.local in VOID:
            continue
        if html and node.local in RAW:
            if lower is None:
                lower = src.lower() if len(src.lower()) == n else re.sub("[A-Z]+", lambda m: m[0].lower(), src)
            end = lower.find("</" + node.local, pos)
            node.say(src[pos : end if end >= 0 else n])
            gt = src.find(">", end) if end >= 0 else -1
            pos = gt + 1 if gt >= 0 else n
            continue
        if len(open_) < DEPTH:
            open_.append(node)
    return root


def parse_html(src: str) -> Node:
    return parse(src, True)


def parse_xml(src: str) -> Node:
    return parse(src.removeprefix("﻿"), False)
