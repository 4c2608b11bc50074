"""Text files to Markdown, one at a time (for bodies inside other documents; `operators.plain_text` does columns of texts)."""

from __future__ import annotations

import json
import re

from foliospark.parse.text import Writer, code_block, escape_block, normalize, render_table, strip

BULLET = re.compile(r"(\s*)[-*+•·▪◦‣o]\s+(.+)$")
ORDERED = re.compile(r"(\s*)([0-9]{1,3})[.)]\s+(.+)$")
UNDERLINE = re.compile(r"\s*(={3,}|-{3,}|~{3,}|\*{3,}|_{3,})\s*$")
NAMED = re.compile(r"(?i)(chapter|section|part|appendix)\s+[0-9ivx]+")
# Extensions of source code, and fence languages that differ from the extension.
CODE = frozenset("js mjs cjs ts tsx jsx py rb go rs java kt swift c h cpp hpp cc cs php sh bash zsh ps1 sql r scala dart lua pl vim toml ini cfg conf gradle tf dockerfile makefile m mm".split())
LANGUAGES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "yml": "yaml", "md": "markdown", "kt": "kotlin", "rs": "rust", "cs": "csharp", "cpp": "cpp", "h": "c", "m": "objectivec"}
COLUMNS = 24


def is_heading(line: str, following: str) -> bool:
    if not 3 <= len(line) <= 80 or line[-1] in ".,;":
        return False
    letters = re.sub("[^A-Za-z]", "", line)
    return not strip(following) and len(letters) >= 3 and letters == letters.upper() or bool(NAMED.match(line))


def plain_to_markdown(text: str, bullet: str = "-", keep_breaks: bool = False) -> str:
    lines = re.sub("\r\n?", "\n", text).replace("\t", "    ").split("\n")
    w, prose, items = Writer(), [], []

    def close(keep_items: bool = False) -> None:
        if prose:
            w.push("  \n".join(map(escape_block, prose)) if keep_breaks else escape_block(strip(re.sub(r"\s+", " ", " ".join(prose)))))
            prose.clear()
        if items and not keep_items:
            w.push("\n".join(items))
            items.clear()

    skip = False
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        if skip:
            skip = False
            continue
        bare = strip(line)
        if bare and UNDERLINE.match(following) and len(bare) <= 120:
            close()
            w.heading(1 if strip(following)[0] == "=" else 2, bare)
            skip = True
        elif not bare:
            close()
        elif UNDERLINE.match(line):
            close()
            w.rule()
        elif m := BULLET.match(line) or ORDERED.match(line):
            close(keep_items=True)
            mark = bullet if m.re is BULLET else m[2] + "."
            items.append("  " * min(4, len(m[1]) // 2) + f"{mark} {escape_block(strip(m[m.lastindex]))}")
        else:
            if items:
                close()
            if is_heading(bare, following):
                close()
                w.heading(2 if len(bare) < 40 else 3, bare)
            else:
                prose.append(bare)
    close()
    return str(w) if w.blocks else ""


def _flat(v) -> bool:
    return isinstance(v, dict) and not any(isinstance(x, dict | list) for x in v.values())


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    return str(v)


def records_table(records: list[dict]) -> str | None:
    columns = list(dict.fromkeys(k for r in records for k in r))
    return render_table([columns, *([_cell(r.get(c)) for c in columns] for r in records)]) if 1 <= len(columns) <= COLUMNS else None


def json_to_markdown(text: str, lines: bool, warnings: list[str]) -> str:
    if lines:
        found = []
        for line in text.split("\n"):
            try:
                found.append(json.loads(line)) if strip(line) else None
            except ValueError:
                continue
        table = records_table([r for r in found if _flat(r)])
        if table:
            return table
    try:
        value = json.loads(text)
    except ValueError as e:
        warnings.append(f"The JSON could not be parsed ({e}); kept as a code block.")
        return code_block(strip(text), "json")
    if isinstance(value, list) and value and all(map(_flat, value)) and (table := records_table(value)):
        return table
    return code_block(json.dumps(value, indent=2, ensure_ascii=False), "json")


def subtitles_to_markdown(text: str) -> str:
    w = Writer()
    for cue in re.split("\n{2,}", re.sub(r"^WEBVTT[^\n]*\n", "", re.sub("\r\n?", "\n", text))):
        lines = [x for x in cue.split("\n") if strip(x)]
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            w.push(strip(escape_block(" ".join(lines))))
            continue
        span = " ".join(re.sub(r"\s*-->\s*", " → ", lines[at], count=1).replace(",", ".").split(" ")[:3])
        said = strip(re.sub("<[^>]+>", "", " ".join(lines[at + 1 :])))
        if said:
            w.push(f"**{span}**  \n{escape_block(said)}")
    return str(w)


def text_to_markdown(text: str, extension: str, bullet: str, keep_breaks: bool, warnings: list[str]) -> str:
    if extension in ("md", "markdown", "mdown", "mkd"):
        return normalize(text)
    if extension in ("json", "jsonl", "ndjson"):
        return json_to_markdown(text, extension != "json", warnings)
    if extension in ("srt", "vtt"):
        return subtitles_to_markdown(text)
    if extension in ("yaml", "yml", "xml", "svg") or extension in CODE:
        return code_block(strip(text) if extension not in CODE else text.rstrip(), LANGUAGES.get(extension, extension))
    return plain_to_markdown(text, bullet, keep_breaks)
