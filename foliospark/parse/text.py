"""Markdown text helpers for the parsers (the column functions in foliospark.functions.markdown give the same results)."""

from __future__ import annotations

import re

SPACE = "\t\n\x0b\f\r    -     　﻿"
WS = f"[{SPACE}]"
_BLANKS = "\t\n\x0b\f\r                  　﻿"
_INLINE = re.compile(r"[\\`*_\[\]<>|]")
_LEADING = re.compile(rf"({WS}*)([-+*>#]|[0-9]+[.)])(?={WS})")
_FIRST_MARK = re.compile(rf"({WS}*)([-+>#]|[0-9]+[.)])(?={WS})")


def strip(s: str) -> str:
    return s.strip(_BLANKS)


def rstrip(s: str) -> str:
    return s.rstrip(_BLANKS)


def margins(s: str) -> tuple[str, str, str]:
    """Leading blanks, core, trailing blanks."""
    left = s.lstrip(_BLANKS)
    core = left.rstrip(_BLANKS)
    return s[: len(s) - len(left)], core, left[len(core) :]


def escape_inline(s: str) -> str:
    return _INLINE.sub(lambda m: "\\" + m[0], s)


def _mark(s: str, pattern: re.Pattern) -> str:
    m = pattern.match(s)
    return f"{m[1]}\\{m[2]}{s[m.end() :]}" if m else s


def escape_block(s: str) -> str:
    return _mark(escape_inline(s), _LEADING)


def escape_first_mark(s: str) -> str:
    """For text that is Markdown already."""
    return _mark(s, _FIRST_MARK)


def collapse(s: str) -> str:
    return re.sub(" {2,}", " ", re.sub("[\t\f\x0b ]+", " ", s))


def href(s: str) -> str:
    s = strip(s)
    if s.startswith("data:") or not re.search("[ ()<>]", s):
        return s
    return "<" + s.replace(">", "%3E") + ">"


def _suffix(title: str | None) -> str:
    return ' "' + title.replace('"', '\\"') + '"' if title else ""


def link(text: str, target: str, title: str | None = None) -> str:
    target = href(target)
    return f"[{strip(text) or target}]({target}{_suffix(title)})"


def image(alt: str, target: str, title: str | None = None) -> str:
    return f"![{re.sub('[][]', '', alt)}]({href(target)}{_suffix(title)})"


def code_block(code: str, language: str = "") -> str:
    fence = "`" * max([3, *(len(x) + 1 for x in re.findall("`{3,}", code))])
    return f"{fence}{language}\n{code.rstrip(chr(10))}\n{fence}"


def quote(s: str) -> str:
    return "\n".join(f"> {x}" if x else ">" for x in s.split("\n"))


def normalize(s: str) -> str:
    s = re.sub("\r\n?", "\n", s)
    s = "\n".join(x if (cut := x.rstrip(" \t")) + "  " == x else cut for x in s.split("\n"))
    return rstrip(re.sub("\n{3,}", "\n\n", s).lstrip("\n")) + "\n"


class Writer:
    """Blocks of a document, joined with a blank line between."""

    def __init__(self) -> None:
        self.blocks: list[str] = []

    def push(self, block: str) -> None:
        if block := rstrip(block):
            if strip(block):
                self.blocks.append(block)

    def heading(self, level: int, text: str) -> None:
        if clean := strip(collapse(text)):
            self.push("#" * min(6, max(1, level)) + " " + clean)

    def quote(self, text: str) -> None:
        if body := strip(text):
            self.push(quote(body))

    def rule(self) -> None:
        self.blocks.append("---")

    def __str__(self) -> str:
        return normalize("\n\n".join(self.blocks))


def render_table(rows: list[list[str]], right: set[int] = frozenset(), escape: bool = True) -> str:
    """An aligned table; the first row is the header. Widths count code points."""
    if not rows:
        return ""
    across = range(max(map(len, rows)))
    grid = [[strip(re.sub("\r?\n", "<br>", escape_inline(r[c]) if escape else r[c])) if c < len(r) else "" for c in across] for r in rows]
    width = [max([3, *(len(r[c]) for r in grid)]) for c in across]
    lines = ["| " + " | ".join(r[c].ljust(width[c]) for c in across) + " |" for r in grid]
    rule = "| " + " | ".join("-" * max(2, width[c] - 1) + ":" if c in right else "-" * width[c] for c in across) + " |"
    return "\n".join([lines[0], rule, *lines[1:]])
