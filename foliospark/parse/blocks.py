"""Markdown as input: its blocks as rows, tables as cells."""

from __future__ import annotations

import re

_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})\s*([\w+#-]*)\s*$")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_RULE = re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM = re.compile(r"(\s*)([-*+]|\d{1,9}[.)])\s+(?:\[([ xX])\]\s+)?(.*)$")
_DIVIDER = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def split_row(line: str) -> list[str]:
    """Cells of a table line; an escaped pipe is part of its cell."""
    cells = re.split(r"(?<!\\)\|", line.strip().removeprefix("|"))
    if line.rstrip().endswith("|") and not line.rstrip().endswith("\\|"):
        cells.pop()
    return [c.strip().replace("\\|", "|") for c in cells]


def alignments(divider: str) -> list[str]:
    return [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "") for c in split_row(divider)]


def blocks(markdown: str) -> list[dict]:
    """kind (front, code, heading, rule, quote, table, list, paragraph), level, info and text of each block, in order."""
    lines = re.sub("\r\n?", "\n", markdown).split("\n")
    out: list[dict] = []
    at = 0

    def add(kind: str, text: str, level: int = 0, info: str = "") -> None:
        out.append({"kind": kind, "level": level, "info": info, "text": text})

    if lines[0].strip() == "---" and "---" in lines[1:]:
        end = lines.index("---", 1)
        add("front", "\n".join(lines[1:end]))
        at = end + 1
    while at < len(lines):
        line = lines[at]
        start = at
        at += 1
        if not line.strip():
            continue
        if m := _FENCE.match(line):
            close = re.compile(rf"\s{{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            while at < len(lines) and not close.match(lines[at]):
                at += 1
            add("code", "\n".join(lines[start + 1 : at]), 0, m[2])
            at += 1
        elif m := _HEADING.match(line):
            add("heading", m[2], len(m[1]))
        elif _RULE.match(line):
            add("rule", "")
        elif line.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            add("quote", "\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[start:at]))
        elif "|" in line and at < len(lines) and _DIVIDER.match(lines[at]) and "-" in lines[at]:
            align = alignments(lines[at])
            at += 1
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                at += 1
            add("table", "\n".join([line, *lines[start + 2 : at]]), len(align), ",".join(align))
        elif _ITEM.match(line):
            while at < len(lines) and (_ITEM.match(lines[at]) or lines[at].startswith("  ") and lines[at].strip()):
                at += 1
            add("list", "\n".join(lines[start:at]), 0, "ordered" if _ITEM.match(line)[2][0].isdigit() else "bulleted")
        else:
            while at < len(lines) and lines[at].strip() and not any(p.match(lines[at]) for p in (_FENCE, _HEADING, _RULE, _ITEM)) and not lines[at].lstrip().startswith(">"):
                at += 1
            add("paragraph", "\n".join(x.strip() for x in lines[start:at]))
    return out


def list_items(text: str) -> list[dict]:
    """depth, ordered, task (None, False or True) and text of each item of a list block."""
    out: list[dict] = []
    for line in text.split("\n"):
        if m := _ITEM.match(line):
            out.append({"depth": len(m[1].expandtabs(4)) // 2, "ordered": m[2][0].isdigit(), "task": None if m[3] is None else m[3] in "xX", "text": m[4]})
        elif out:
            out[-1]["text"] += "\n" + line.strip()
    return out


# The schemes that a link or an image may have.
LINK = re.compile(r"(?i)(https?:|mailto:|tel:|#|/|\./|\.\./)")
IMAGE = re.compile(r"(?i)(data:image/|https?:)")
_INLINE_ANY = re.compile("")
_INLINE = re.compile(
    r"(?P<image>!\[(?P<alt>(?:\\.|[^\]\\])*)\]\((?P<src><[^>]*>|[^)\s]*)(?:\s+\"[^\"]*\")?\))|(?P<link>\[(?P<label>(?:\\.|[^\[\]\\]|!?\[[^\]]*\]\([^)]*\))*)\]\((?P<href><[^>]*>|[^)\s]*)(?:\s+\"[^\"]*\")?\))"
    r"|(?P<code>(?P<f>`+)(?P<c>.+?)(?<!`)(?P=f)(?!`))|(?P<bold>\*\*(?P<b>.+?)\*\*)|(?P<strike>~~(?P<s>.+?)~~)|(?P<italic>\*(?P<i>[^*\s](?:.*?[^*\s])?)\*)|(?P<auto><(?P<u>(?:https?://|mailto:)[^>\s]+)>)"
    r"|(?P<sup><sup>(?P<above>[^<]*)</sup>)|(?P<sub><sub>(?P<below>[^<]*)</sub>)|(?P<br><br\s*/?>)",
    re.S,
)


def inline(text: str) -> list[dict]:
    """kind (image, link, code, bold, strike, italic, auto, sup, sub, br, text), text and target of a text's parts; targets of other schemes are dropped."""
    out, at = [], 0
    # Escaped characters stand aside as private-use ones, so that they open and close nothing.
    hidden = re.sub(r"\\([\\`*_\[\]<>|#+\-.!~()])", lambda m: chr(0xE000 + ord(m[1])), text)
    shown = lambda s, lead="": re.sub("[\ue000-\ue07f]", lambda m: lead + chr(ord(m[0]) - 0xE000), s)

    def add(kind: str, s: str, target: str | None = None) -> None:
        if s or target:
            out.append({"kind": kind, "text": s, "target": target})

    for m in _INLINE.finditer(hidden):
        add("text", shown(hidden[at : m.start()]))
        kind = next(k for k in ("image", "link", "code", "bold", "strike", "italic", "auto", "sup", "sub", "br") if m[k])
        said = {"image": "alt", "link": "label", "code": "c", "bold": "b", "strike": "s", "italic": "i", "auto": "u", "sup": "above", "sub": "below", "br": "br"}[kind]
        target = {"image": m["src"], "link": m["href"], "auto": m["u"]}.get(kind)
        target = shown(target.strip("<>")) if target else None
        if target and not (IMAGE if kind == "image" else LINK if kind == "link" else _INLINE_ANY).match(target):
            target = None
        if kind == "br":
            add(kind, "\n")
            at = m.end()
            continue
        add(kind, shown(m[said].strip(), "\\") if kind == "code" else shown(m[said]), target)
        at = m.end()
    add("text", shown(hidden[at:]))
    return out
