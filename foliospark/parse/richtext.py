"""RTF to Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from foliospark.parse.decode import windows_1252
from foliospark.parse.office import Options, Output, merge_emphasis
from foliospark.parse.text import Writer, collapse, render_table, strip

# Destinations whose text is no part of the document.
HIDDEN = frozenset("fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator info pict object themedata colorschememapping datastore xmlnstbl latentstyles header headerl headerr headerf footer footerl footerr footerf ftnsep ftnsepc pgdsctbl fldinst bkmkstart bkmkend shppict nonshppict mmathPr filetbl revtbl".split())
# Control words that stand for a character.
CHARACTERS = {"par": "\n", "line": "\n", "tab": "    ", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "~": " ", "_": "-", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)|[\r\n]|\\'?")


@dataclass
class State:
    bold: bool = False
    italic: bool = False
    strike: bool = False
    sup: bool = False
    sub: bool = False
    size: int = 24
    skip: int = 1
    hidden: bool = False
    marker: bool = False
    field: list | None = None


@dataclass
class Paragraph:
    runs: list = field(default_factory=list)
    size: int = 0
    listed: bool = False
    level: int = 0
    outline: int | None = None


class RichText:
    def __init__(self, data: bytes, options: Options):
        self.src, self.o, self.out = data.decode("latin-1"), options, Output()
        self.paragraphs: list[Paragraph] = []
        self.now = Paragraph()
        self.rows: list[list[str]] = []
        self.row: list[str] = []
        self.in_table = False
        self.info: dict[str, str] = {}

    def say(self, text: str, s: State) -> None:
        if s.marker:
            self.now.listed |= bool(strip(text))
        elif not s.hidden and text:
            href = s.field[0] if s.field else ""
            self.now.runs.append((text, (False, s.strike, s.bold, s.italic, s.sup, s.sub, href)))
            if strip(text):
                self.now.size = max(self.now.size, s.size)

    def flush(self) -> None:
        if self.now.runs and not self.in_table:
            self.paragraphs.append(self.now)
        keep = self.now
        if not self.in_table:
            self.now = Paragraph(level=keep.level, outline=keep.outline)

    def parse(self) -> None:
        s, stack, drop, opened, instruction, star = State(), [], 0, False, "", False
        pending: list[int] = []

        def settle() -> None:
            if pending:
                self.say(windows_1252(bytes(pending)), s)
                pending.clear()

        for m in _TOKEN.finditer(self.src):
            word, number, byte, symbol, brace, text = m.groups()
            if byte is None:
                settle()
            if brace == "{":
                stack.append(s)
                s = replace(s)
                opened = True
                continue
            if brace == "}":
                if stack:
                    s = stack.pop()
                opened = star = False
                drop = 0
                continue
            if symbol == "*":
                star = True
                continue
            if byte is not None:
                if drop:
                    drop -= 1
                else:
                    pending.append(int(byte, 16))
            elif text is not None:
                if drop:
                    cut = min(drop, len(text))
                    text, drop = text[cut:], drop - cut
                if s.field is not None and s.hidden and s.field[1]:
                    instruction = s.field[2] = s.field[2] + text
                    target = re.search(r'HYPERLINK\s+(?:\\\\l\s+)?"([^"]+)"', instruction)
                    if target:
                        s.field[0] = target[1]
                else:
                    self.say(windows_1252(text.encode("latin-1")), s)
            elif symbol is not None:
                if symbol in "\\{}":
                    self.say(symbol, s)
                elif symbol in ("\n", "\r"):
                    self.end_paragraph()
                elif symbol in CHARACTERS:
                    self.say(CHARACTERS[symbol], s)
            elif word:
                drop = self.control(word, None if number is None else int(number), s, opened, star)
            opened = opened and word is None and symbol is None
            if word and word != "u":
                star = False
        settle()
        self.end_paragraph()

    def end_paragraph(self) -> None:
        self.flush()

    def control(self, word: str, n: int | None, s: State, opened: bool, star: bool) -> int:
        """Act on a control word; how many fallback characters follow it."""
        on = n != 0
        if word in ("listtext", "pntext"):
            s.marker = True
        elif word == "field":
            s.field = ["", False, ""]
        elif word == "fldinst":
            s.hidden = True
            if s.field is not None:
                s.field[1] = True
        elif word == "fldrslt":
            s.hidden = False
            if s.field is not None:
                s.field[1] = False
        elif word in HIDDEN or star and opened and word not in ("pn", "shptxt"):
            s.hidden = True
        elif word in ("b", "i", "strike"):
            setattr(s, {"b": "bold", "i": "italic"}.get(word, word), on)
        elif word == "super":
            s.sup = on
        elif word == "sub":
            s.sub = on
        elif word == "nosupersub":
            s.sup = s.sub = False
        elif word == "plain":
            s.bold = s.italic = s.strike = s.sup = s.sub = False
            s.size = 24
        elif word == "fs" and n is not None:
            s.size = n
        elif word == "uc" and n is not None:
            s.skip = n
        elif word == "u" and n is not None:
            code = n % 65536
            if not 0xD800 <= code < 0xE000:
                self.say(chr(code), s)
            return s.skip
        elif word == "pard":
            self.now.listed, self.now.level, self.now.outline = False, 0, None
            self.in_table = False
        elif word == "intbl":
            self.in_table = True
        elif word == "ls":
            self.now.listed = True
        elif word == "ilvl" and n is not None:
            self.now.level = min(4, n)
        elif word == "outlinelevel" and n is not None:
            self.now.outline = n
        elif word == "cell" and not s.hidden:
            self.row.append(strip(collapse(merge_emphasis(self.now.runs).replace("\n", " "))))
            self.now = Paragraph()
        elif word == "row" and not s.hidden:
            self.rows.append(self.row)
            self.row, self.now, self.in_table = [], Paragraph(), False
        elif word in ("par", "sect", "page"):
            if not s.hidden:
                self.end_paragraph()
        elif word == "line" and not s.hidden:
            self.now.runs.append(("  \n", None))
        elif word in CHARACTERS:
            self.say(CHARACTERS[word], s)
        return 0

    def convert(self) -> Output:
        if not self.src.startswith("{\\rtf"):
            raise ValueError("The file is not an RTF document.")
        self.parse()
        w, items = Writer(), []
        sizes = sorted(p.size for p in self.paragraphs if p.size)
        body = sizes[len(sizes) // 2] if sizes else 24
        for p in self.paragraphs:
            text = strip(collapse(merge_emphasis(p.runs)))
            if p.listed and text:
                items.append("  " * p.level + f"{self.o.bullet} {text}")
                continue
            if items:
                w.push("\n".join(items))
                items = []
            if not text:
                continue
            level = 0
            if p.outline is not None and 0 <= p.outline <= 8:
                level = min(6, p.outline + 1)
            elif p.size >= 1.25 * body and len(text) < 120:
                ratio = p.size / body
                level = 1 if ratio >= 1.7 else 2 if ratio >= 1.45 else 3
            if level:
                w.heading(level, text.replace("**", ""))
            else:
                w.push(re.sub(r"^([-+>#]|\d+[.)])(?=\s)", r"\\\1", text))
        if items:
            w.push("\n".join(items))
        if self.rows:
            w.push(render_table(self.rows, escape=False))
        self.out.markdown = str(w)
        return self.out
