"""Editor commands as functions of (text, selection) to (text, selection)."""

from __future__ import annotations

import re
from typing import NamedTuple

# Marks of inline commands with the words they put in, prefixes of line commands, the table that is put in.
WRAPS = {"bold": ("**", "bold text"), "italic": ("*", "italic text"), "strike": ("~~", "struck text"), "code": ("`", "code")}
PREFIXES = {"h1": "# ", "h2": "## ", "h3": "### ", "bullet": "- ", "number": "1. ", "task": "- [ ] ", "quote": "> "}
BLOCKS = {"table": "| Column | Column |\n| --- | --- |\n| Cell | Cell |", "rule": "---"}
OWN = {
    **{h: re.compile(rf"(\s*){p[:-1]}\s+") for h, p in PREFIXES.items() if h[0] == "h"},
    "bullet": re.compile(r"(\s*)[-*+]\s+(?!\[[ xX]\]\s)"),
    "number": re.compile(r"(\s*)\d+\.\s+"),
    "task": re.compile(r"(\s*)[-*+]\s+\[[ xX]\]\s+"),
    "quote": re.compile(r"(\s*)>\s?"),
}
ANY = re.compile(r"(\s*)(?:#{1,6}\s+|[-*+]\s+\[[ xX]\]\s+|[-*+]\s+|\d+\.\s+|>\s?)")
ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])(\s+\[[ xX]\])?\s+(.*)$")
QUOTED = re.compile(r"(\s*)>\s?(.*)$")
TARGET = re.compile(r"(?i)(https?://|mailto:|/|\./)\S*$")


class Edit(NamedTuple):
    text: str
    start: int
    end: int


def _splice(text: str, a: int, b: int, new: str, select: tuple[int, int]) -> Edit:
    """text with [a, b) replaced; the selection is relative to a."""
    return Edit(text[:a] + new + text[b:], a + select[0], a + select[1])


def _whole_lines(text: str, start: int, end: int) -> tuple[int, int]:
    stop = text.find("\n", end)
    return text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop


def wrap(action: str, text: str, start: int, end: int) -> Edit:
    mark, words = WRAPS[action]
    n, chosen = len(mark), text[start:end]
    if start >= n and text[start - n : start] == mark == text[end : end + n]:
        return _splice(text, start - n, end + n, chosen, (0, len(chosen)))
    if len(chosen) > 2 * n and chosen.startswith(mark) and chosen.endswith(mark):
        return _splice(text, start, end, chosen[n:-n], (0, len(chosen) - 2 * n))
    body = chosen or words
    return _splice(text, start, end, mark + body + mark, (n, n + len(body)))


def mark_lines(action: str, text: str, start: int, end: int) -> Edit:
    """Put a mark on the chosen lines, or take it off where all have it; another mark gives way. Blank lines stay as they are unless there is nothing else."""
    a, b = _whole_lines(text, start, end)
    lines = text[a:b].split("\n")
    filled = [x for x in lines if x.strip()]
    undo = bool(filled) and all(map(OWN[action].match, filled))
    old, out, n = OWN[action] if undo else ANY, [], 0
    for line in lines:
        if filled and not line.strip():
            out.append(line)
            continue
        n += 1
        bare = old.sub(lambda m: m[1], line, count=1) if old.match(line) else line
        body = bare.lstrip()
        indent = bare[: len(bare) - len(body)]
        out.append(indent + ("" if undo else f"{n}. " if action == "number" else PREFIXES[action]) + body)
    new = "\n".join(out)
    return _splice(text, a, b, new, (0, len(new)))


def link(text: str, start: int, end: int) -> Edit:
    """A chosen address becomes the target and the label is to be typed; else the other way round."""
    chosen = text[start:end]
    given = bool(TARGET.match(chosen.strip()))
    label, target = ("link text" if given or not chosen else chosen), (chosen.strip() if given else "https://")
    new = f"[{label}]({target})"
    return _splice(text, start, end, new, (1, 1 + len(label)) if given else (len(new) - 1 - len(target), len(new) - 1))


def insert_block(action: str, text: str, start: int, end: int) -> Edit:
    block = BLOCKS[action]
    lead = "\n\n" if text[:start] and text[start - 1] != "\n" else ""
    tail = "\n\n" if text[end : end + 1] not in ("", "\n") else "\n"
    return _splice(text, start, end, lead + block + tail, (len(lead), len(lead) + len(block)))


def enter(text: str, caret: int) -> Edit | None:
    """What a line break does inside a list or quote; None where it is an ordinary one. An empty item ends its list."""
    a = text.rfind("\n", 0, caret) + 1
    line = text[a:caret]
    if m := ITEM.match(line):
        indent, mark, box, body = m.groups()
        follows = (f"{int(mark[:-1]) + 1}{mark[-1]}" if mark[0].isdigit() else mark) + (" [ ] " if box else " ")
    elif m := QUOTED.match(line):
        indent, body, follows = m[1], m[2], "> "
    else:
        return None
    if not body.strip():
        return _splice(text, a, caret, indent, (len(indent),) * 2)
    new = f"\n{indent}{follows}"
    return _splice(text, caret, caret, new, (len(new),) * 2)


def tab(text: str, start: int, end: int, back: bool = False) -> Edit | None:
    """Move the chosen list items in or out by two spaces; None where there is no list."""
    a, b = _whole_lines(text, start, end)
    lines = text[a:b].split("\n")
    if not any(map(ITEM.match, lines)):
        return None
    new = "\n".join((re.sub("^ {1,2}", "", x) if back else "  " + x) if ITEM.match(x) else x for x in lines)
    return _splice(text, a, b, new, (0, len(new)))


def apply(action: str, text: str, start: int, end: int) -> Edit:
    if action in WRAPS:
        return wrap(action, text, start, end)
    if action in PREFIXES:
        return mark_lines(action, text, start, end)
    if action in BLOCKS:
        return insert_block(action, text, start, end)
    if action == "link":
        return link(text, start, end)
    if action == "enter":
        return enter(text, start) or Edit(text[:start] + "\n" + text[end:], start + 1, start + 1)
    if action in ("indent", "outdent"):
        return tab(text, start, end, action == "outdent") or Edit(text, start, end)
    return Edit(text, start, end)
