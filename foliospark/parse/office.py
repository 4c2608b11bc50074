"""Word processor, slide and spreadsheet packages (OOXML) to Markdown.

Cells of tables are Markdown when they reach the table, so they are set without a second escaping.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from foliospark.parse.archive import Package, relationships
from foliospark.parse.html import wrap
from foliospark.parse.markup import Node
from foliospark.parse.text import Writer, code_block, collapse, escape_inline, image, link, margins, quote, render_table, strip

# Media types of images by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf", "wmf": "image/wmf", "heic": "image/heic", "avif": "image/avif", "ico": "image/x-icon"}


@dataclass
class Options:
    front_matter: bool = True
    image_mode: str = "embed"  # embed, reference or skip
    max_image: int = 512 * 1024
    page_separators: bool = True
    notes: bool = True
    bullet: str = "-"
    pdf_headings: bool = True
    keep_breaks: bool = False


@dataclass
class Output:
    markdown: str = ""
    meta: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    images: int = 0


def place_image(data: bytes | None, name: str, alt: str, options: Options, out: Output) -> str:
    """An image by the options: embedded, referred to, or left out."""
    if options.image_mode == "skip":
        return ""
    file = name.rpartition("/")[2]
    if data is None:
        out.warnings.append(f"Image {file} is missing from the file.")
        return ""
    if options.image_mode == "embed" and len(data) <= options.max_image:
        out.images += 1
        kind = IMAGE_TYPES.get(file.rpartition(".")[2].lower(), "application/octet-stream")
        return image(alt, f"data:{kind};base64,{base64.b64encode(data).decode()}")
    if options.image_mode == "embed":
        out.warnings.append(f"Image {file} is too large to embed and was linked by name.")
    else:
        out.images += 1
    return image(alt, file)


def core_properties(package: Package) -> dict[str, str]:
    root, out = package.xml("docProps/core.xml"), {}
    for name, tag in (("title", "title"), ("author", "creator"), ("subject", "subject"), ("keywords", "keywords"), ("created", "created"), ("modified", "modified")):
        found = root.first(tag) if root else None
        if found and strip(found.text()):
            out[name] = strip(found.text())
    app = package.xml("docProps/app.xml")
    if app and (company := app.first("Company")) and strip(company.text()):
        out["company"] = strip(company.text())
    return out


def emphasise(text: str, fmt: tuple) -> str:
    """fmt: code, strike, bold, italic, superscript, subscript, href."""
    code, strike, bold, italic, sup, sub, target = fmt
    left, core, right = margins(text)
    if not core:
        return text
    core = f"`{core}`" if code else escape_inline(core)
    for on, mark in ((strike, "~~"), (bold, "**"), (italic, "*")):
        core = wrap(core, mark) if on else core
    core = f"<sup>{core}</sup>" if sup else f"<sub>{core}</sub>" if sub else core
    return left + (link(core, target) if target else core) + right


def merge_emphasis(runs: list[tuple[str, tuple]]) -> str:
    """Neighbours of one format are one run. A format of None is finished Markdown."""
    out: list[list] = []
    for text, fmt in runs:
        if out and out[-1][1] == fmt:
            out[-1][0] += text
        else:
            out.append([text, fmt])
    return "".join(t if f is None else emphasise(t, f) for t, f in out)


# ------------------------------------------------------------------------ Word


class Word:
    def __init__(self, package: Package, options: Options):
        self.p, self.o, self.out = package, options, Output(meta=core_properties(package))
        self.rels = relationships(package, "word/document.xml")
        self.styles = {s.attr("styleId") or "": ((s.child("name") or s).attr("val") or "").lower() for s in self._all("word/styles.xml", "style")}
        self.ordered = self._numbering()
        self.notes = {kind: {n.attr("id"): strip(collapse(" ".join(t.text() for t in n.all("t")))) for n in self._all(f"word/{kind}s.xml", kind)} for kind in ("footnote", "endnote", "comment")}
        self.cited: list[tuple[str, str]] = []
        self.counters: dict[tuple[str, int], int] = {}

    def _all(self, part: str, tag: str) -> list[Node]:
        root = self.p.xml(part)
        return root.all(tag) if root else []

    def _numbering(self) -> dict[tuple[str, int], tuple[bool, int]]:
        root, out = self.p.xml("word/numbering.xml"), {}
        if not root:
            return out
        abstract = {a.attr("abstractNumId"): a.elements("lvl") for a in root.all("abstractNum")}
        for num in root.all("num"):
            used = num.child("abstractNumId")
            for lvl in abstract.get(used.attr("val") if used else None, []):
                fmt, start = lvl.child("numFmt"), lvl.child("start")
                kind = fmt.attr("val") if fmt else "bullet"
                first = start.attr("val") if start else "1"
                out[num.attr("numId") or "", int(lvl.attr("ilvl") or 0)] = (kind not in ("bullet", "none"), int(first) if (first or "").isdigit() else 1)
        return out

    def convert(self) -> Output:
        w = Writer()
        root = self.p.xml("word/document.xml")
        body = root.first("body") if root else None
        for b in self.blocks(body) if body else ():
            w.push(b) if b != "---" else w.rule()
        if self.cited:
            w.rule()
            for i, (kind, ident) in enumerate(self.cited, 1):
                w.push(f"[^fn{i}]: {self.notes[kind].get(ident, '')}")
        self.out.markdown = str(w)
        return self.out

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        items: list[str] = []

        def flush() -> None:
            if items:
                out.append("\n".join(items))
                items.clear()

        for k in self._flat(node):
            if k.local == "tbl":
                flush()
                self.counters.clear()
                if t := self.table(k):
                    out.append(t)
                continue
            if k.local != "p":
                continue
            kind, text = self.paragraph(k)
            if kind == "item":
                items.append(text)
                continue
            if kind != "empty":
                flush()
                self.counters.clear()
                out.append(text)
            elif not items:
                self.counters.clear()
            if self.o.page_separators and any(b.attr("type") == "page" for b in k.all("br")) and (out or items):
                flush()
                out.append("---")
        flush()
        return out

    def _flat(self, node: Node):
        for k in node.elements():
            if k.local in ("sdt", "sdtContent", "smartTag", "ins", "customXml"):
                yield from self._flat(k)
            else:
                yield k

    def paragraph(self, p: Node) -> tuple[str, str]:
        props = p.child("pPr")
        get = lambda tag: (x.attr("val") if props and (x := props.child(tag)) else None)
        style = self.styles.get(get("pStyle") or "", (get("pStyle") or "").lower())
        flat = re.sub(r"[\s_-]+", "", style)
        text = strip(merge_emphasis(self.runs(p)))
        if not text:
            return "empty", ""
        numbering = props.child("numPr") if props else None
        if numbering:
            num, level = numbering.child("numId"), numbering.child("ilvl")
            ident = num.attr("val") if num else None
            depth = int((level.attr("val") if level else "0") or 0)
            if ident and ident != "0":
                ordered, start = self.ordered.get((ident, depth), (False, 1))
                for key in [k for k in self.counters if k[1] > depth]:
                    del self.counters[key]
                n = self.counters[ident, depth] = self.counters.get((ident, depth), start - 1) + 1
                mark = f"{n}." if ordered else self.o.bullet
                return "item", "  " * depth + f"{mark} {text}"
        level = 0
        if m := re.match(r"heading([1-9])", flat):
            level = min(6, int(m[1]))
        elif flat in ("title", "subtitle"):
            level = 1 if flat == "title" else 2
        elif (outline := get("outlineLvl")) and outline.isdigit() and int(outline) <= 8:
            level = min(6, int(outline) + 1)
        if level:
            return "heading", "#" * level + " " + re.sub(r"\*\*|\n", " ", text).strip().replace("  ", " ")
        if "quote" in flat:
            return "quote", quote(text)
        if "code" in flat or "preformatted" in flat:
            return "code", code_block("".join(t.text() for t in p.all("t")))
        if flat == "caption":
            return "caption", f"*{text}*"
        return "plain", re.sub(r"^([-+>#]|\d+[.)])(?=\s)", r"\\\1", text)

    def runs(self, node: Node, href: str = "") -> list[tuple[str, tuple]]:
        out: list[tuple[str, tuple]] = []
        field_href, instruction, in_code = "", "", False
        for k in node.elements():
            tag = k.local
            if tag in ("del", "moveFrom", "pPr"):
                continue
            if tag == "hyperlink":
                rel = self.rels.get(k.attr("id") or "")
                anchor = k.attr("anchor")
                out += self.runs(k, rel[0] if rel else f"#{anchor}" if anchor else "")
            elif tag == "r":
                char = k.child("fldChar")
                if char is not None:
                    kind = char.attr("fldCharType")
                    if kind == "begin":
                        instruction, in_code = "", True
                    elif kind == "separate":
                        m = re.search(r'HYPERLINK\s+(?:\\l\s+)?"([^"]*)"', instruction)
                        field_href, in_code = (("#" if "\\l" in instruction else "") + m[1] if m else ""), False
                    else:
                        field_href, in_code = "", False
                    continue
                if in_code:
                    instruction += "".join(i.text() for i in k.all("instrText"))
                    continue
                out += self.run(k, href or field_href)
            elif tag in ("ins", "sdt", "sdtContent", "smartTag", "fldSimple", "moveTo"):
                out += self.runs(k, href)
        return out

    def run(self, r: Node, href: str) -> list[tuple[str, tuple]]:
        props = r.child("rPr")

        def on(tag: str) -> bool:
            x = props.child(tag) if props else None
            return x is not None and (x.attr("val") or "1").lower() not in ("0", "false", "none", "off")

        fonts = props.child("rFonts") if props else None
        style = props.child("rStyle") if props else None
        code = any(m in " ".join(fonts.attrs.values()).lower() for m in ("consolas", "courier", "mono")) if fonts else False
        code = code or bool(style) and "code" in self.styles.get(style.attr("val") or "", "")
        lift = (props.child("vertAlign").attr("val") if props and props.child("vertAlign") else "") or ""
        fmt = (code, on("strike") or on("dstrike"), on("b"), on("i"), lift == "superscript", lift == "subscript", href)
        out: list[tuple[str, tuple]] = []
        for k in r.elements():
            tag = k.local
            if tag == "t":
                out.append((k.text(), fmt))
            elif tag == "tab":
                out.append(("    ", fmt))
            elif tag in ("br", "cr"):
                if k.attr("type") != "page":
                    out.append(("  \n", None))
            elif tag == "noBreakHyphen":
                out.append(("-", fmt))
            elif tag == "sym":
                out.append((chr(int(k.attr("char") or "2022", 16) & 0xFFFF) if re.fullmatch("[0-9a-fA-F]+", k.attr("char") or "") else "•", fmt))
            elif tag in ("footnoteReference", "endnoteReference"):
                self.cited.append((tag[:-9], k.attr("id") or ""))
                out.append((f"[^fn{len(self.cited)}]", None))
            elif tag == "commentReference" and self.o.notes:
                if note := self.notes["comment"].get(k.attr("id")):
                    out.append((f" *({escape_inline(note)})*", None))
            elif tag in ("drawing", "pict", "object"):
                out.append((self.drawing(k), None))
        return out

    def drawing(self, node: Node) -> str:
        blip = node.first("blip") or node.first("imagedata")
        rel = self.rels.get((blip.attr("embed") or blip.attr("link") or blip.attr("id") or "") if blip else "")
        if not rel:
            return ""
        info = node.first("docPr")
        alt = (info.attr("descr") or info.attr("name") or "") if info else ""
        if rel[2]:
            return image(alt, rel[0])
        return place_image(self.p.read(rel[0]), rel[0], alt, self.o, self.out)

    def table(self, tbl: Node) -> str:
        rows, headers = [], 0
        for tr in tbl.elements("tr"):
            row: list[str] = []
            for tc in tr.elements("tc"):
                parts = []
                for k in self._flat(tc):
                    if k.local == "p" and (t := strip(merge_emphasis(self.runs(k)))):
                        parts.append(t.replace("  \n", "<br>"))
                    elif k.local == "tbl":
                        parts.append(strip(collapse(" ".join(t.text() for t in k.all("t")))))
                span = tc.first("gridSpan")
                n = int((span.attr("val") if span else "1") or 1)
                row += ["<br>".join(parts), *[""] * (n - 1)]
            props = tr.child("trPr")
            if props and props.child("tblHeader") is not None and headers == len(rows):
                headers += 1
            rows.append(row)
        if not rows:
            return ""
        if not headers and not (len(rows) > 1 and all(rows[0])):
            rows.insert(0, [""] * max(map(len, rows)))
        return render_table(_piped(rows), escape=False)


def _piped(rows: list[list[str]]) -> list[list[str]]:
    """Cells of Markdown: bare pipes escaped, newlines as breaks."""
    return [[re.sub(r"(?<!\\)\|", r"\\|", c).replace("\n", "<br>") for c in r] for r in rows]


# --------------------------------------------------------------------- slides


class Slides:
    def __init__(self, package: Package, options: Options):
        self.p, self.o, self.out = package, options, Output(meta=core_properties(package))

    def order(self) -> list[str]:
        root, rels = self.p.xml("ppt/presentation.xml"), relationships(self.p, "ppt/presentation.xml")
        listed = [rels[i][0] for s in (root.all("sldId") if root else []) if (i := s.attrs.get("r:id") or next((v for k, v in s.attrs.items() if k.endswith(":id")), "")) in rels]
        found = [x for x in listed if x in self.p]
        return found or [n for n in self.p.under("ppt/slides/slide", ".xml")]

    def convert(self) -> Output:
        w = Writer()
        parts = self.order()
        self.out.meta["slides"] = str(len(parts))
        for i, part in enumerate(parts, 1):
            root = self.p.xml(part)
            if root is None:
                continue
            rels = relationships(self.p, part)
            if i > 1 and self.o.page_separators:
                w.rule()
            shapes = self.shapes(root, rels)
            title = next((t for kind, t in shapes if kind == "title" and t), "")
            w.heading(2, re.sub(r"\s*\n\s*", " ", title) or f"Slide {i}")
            for kind, text in shapes:
                if kind != "title" or text != title:
                    w.push(text)
            if self.o.notes:
                self.add_notes(w, rels)
        self.out.markdown = str(w)
        return self.out

    def shapes(self, root: Node, rels: dict) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for k in root.walk():
            if k.local == "sp" and (body := k.child("txBody")):
                ph = k.first("ph")
                kind = (ph.attr("type") or "body") if ph else ""
                is_title = kind in ("title", "ctrTitle")
                out.append(("title" if is_title else "text", self.body(body, rels, plain=is_title or kind == "subTitle" or not ph)))
            elif k.local == "tbl":
                out.append(("table", self.table(k, rels)))
            elif k.local == "pic":
                blip, info = k.first("blip"), k.first("cNvPr")
                rel = rels.get(blip.attr("embed") or "") if blip else None
                if rel:
                    out.append(("picture", place_image(self.p.read(rel[0]), rel[0], (info.attr("descr") or info.attr("name") or "") if info else "", self.o, self.out)))
        return out

    def body(self, body: Node, rels: dict, plain: bool) -> str:
        blocks: list[list] = []
        counters: dict[int, int] = {}
        for p in body.elements("p"):
            text = strip(self.runs(p, rels))
            if not text:
                continue
            props = p.child("pPr")
            level = int((props.attr("lvl") if props else "0") or 0)
            bulleted = props is not None and any(props.child(t) is not None for t in ("buChar", "buAutoNum", "buBlip"))
            if props is not None and props.child("buNone") is not None and level == 0 or plain and not bulleted and level == 0:
                counters.clear()
                blocks.append(["p", text])
                continue
            if props is not None and props.child("buAutoNum") is not None:
                for k in [k for k in counters if k > level]:
                    del counters[k]
                counters[level] = counters.get(level, 0) + 1
                mark = f"{counters[level]}."
            else:
                mark = self.o.bullet
            line = "  " * level + f"{mark} {text}"
            if blocks and blocks[-1][0] == "l":
                blocks[-1][1] += "\n" + line
            else:
                blocks.append(["l", line])
        return "\n\n".join(b for _, b in blocks)

    def runs(self, p: Node, rels: dict) -> str:
        out: list[tuple[str, tuple | None]] = []
        for k in p.elements():
            if k.local == "br":
                out.append(("  \n", None))
            elif k.local in ("r", "fld"):
                props, t = k.child("rPr"), k.child("t")
                get = lambda a: (props.attr(a) if props else None) or ""  # noqa: B023, E731
                click = props.child("hlinkClick") if props else None
                rel = rels.get(click.attr("id") or "") if click else None
                fmt = (False, get("strike") in ("sngStrike", "dblStrike"), get("b") in ("1", "true"), get("i") in ("1", "true"), False, False, rel[0] if rel and rel[2] else "")
                out.append((t.text() if t else "", fmt))
        return merge_emphasis(out)

    def table(self, tbl: Node, rels: dict) -> str:
        rows = []
        for tr in tbl.elements("tr"):
            row: list[str] = []
            for tc in tr.elements("tc"):
                if tc.attr("hMerge") in ("1", "true"):
                    continue
                row += [" ".join(x for p in tc.all("p") if (x := strip(self.runs(p, rels)))), *[""] * (int(tc.attr("gridSpan") or 1) - 1)]
            rows.append(row)
        props = tbl.child("tblPr")
        if rows and props is not None and props.attr("firstRow") not in ("1", "true"):
            rows.insert(0, [""] * max(map(len, rows)))
        return render_table(_piped(rows), escape=False)

    def add_notes(self, w: Writer, rels: dict) -> None:
        part = next((t for t, kind, _ in rels.values() if kind.endswith("/notesSlide")), None)
        root = self.p.xml(part) if part else None
        if not root:
            return
        said = []
        for sp in root.all("sp"):
            ph = sp.first("ph")
            if ph and ph.attr("type") in ("sldNum", "sldImg"):
                continue
            said += [strip(self.runs(p, {})) for p in sp.all("p")]
        text = "\n\n".join(x for x in said if x)
        if text:
            w.push(quote(f"**Notes:** {text}"))


# ----------------------------------------------------------------- spreadsheet

BUILT_IN_DATES = frozenset((*range(14, 23), 45, 46, 47))


def serial_date(value: str) -> str:
    """A day number of the 1900 system as ISO text; what is no number stays."""
    try:
        moment = datetime(1899, 12, 30) + timedelta(milliseconds=round(float(value) * 86_400_000))
    except (ValueError, OverflowError):
        return value
    whole = abs(float(value) % 1) <= 1e-9
    return moment.strftime("%Y-%m-%d" if whole else "%Y-%m-%d %H:%M:%S")


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


class Sheets:
    def __init__(self, package: Package, options: Options):
        self.p, self.o, self.out = package, options, Output(meta={k: v for k, v in core_properties(package).items() if k in ("title", "author", "modified")})
        strings = package.xml("xl/sharedStrings.xml")
        self.shared = ["".join(t.text() for t in ([s.child("t")] if s.child("t") else [t for r in s.elements("r") for t in r.elements("t")])) for s in (strings.all("si") if strings else [])]
        self.dates = self._date_styles()

    def _date_styles(self) -> set[int]:
        root = self.p.xml("xl/styles.xml")
        if not root:
            return set()
        custom = {f.attr("numFmtId"): re.sub(r'\[[^\]]*\]|"[^"]*"', "", f.attr("formatCode") or "") for f in root.all("numFmt")}
        xfs = root.first("cellXfs")
        out = set()
        for i, xf in enumerate(xfs.elements("xf") if xfs else []):
            ident = xf.attr("numFmtId") or "0"
            if ident.isdigit() and int(ident) in BUILT_IN_DATES or re.search("(?i)[ymdhs]", custom.get(ident, "")):
                out.add(i)
        return out

    def sheets(self) -> list[tuple[str, str, bool]]:
        """Name, part and whether it's hidden."""
        root, rels = self.p.xml("xl/workbook.xml"), relationships(self.p, "xl/workbook.xml")
        out = []
        for n, s in enumerate(root.all("sheet") if root else [], 1):
            ident = next((v for k, v in s.attrs.items() if k.endswith(":id") or k == "id"), "")
            part = rels[ident][0] if ident in rels else f"xl/worksheets/sheet{n}.xml"
            out.append((s.attr("name") or f"Sheet {n}", part, (s.attr("state") or "visible") != "visible"))
        return out

    def cells(self, part: str) -> dict[tuple[int, int], str]:
        root = self.p.xml(part)
        if not root:
            return {}
        rels = relationships(self.p, part)
        links = {}
        for h in root.all("hyperlink"):
            rel = rels.get(h.attr("id") or "")
            links[(h.attr("ref") or "").split(":")[0]] = rel[0] if rel else f"#{h.attr('location')}" if h.attr("location") else ""
        out: dict[tuple[int, int], str] = {}
        row = -1
        for r in root.all("row"):
            row = int(r.attr("r")) - 1 if (r.attr("r") or "").isdigit() else row + 1
            for key in [k for k in out if k[0] == row]:
                del out[key]
            col = -1
            for c in r.elements("c"):
                ref = c.attr("r") or ""
                col = column_number(ref) if ref else col + 1
                text = escape_inline(self.value(c))
                target = links.get(ref)
                out[row, col] = link(text, target) if target and strip(text) else text
        return out

    def value(self, c: Node) -> str:
        kind, v = c.attr("t") or "n", c.child("v")
        if kind == "inlineStr":
            inline = c.child("is")
            return "".join(t.text() for t in inline.all("t")) if inline else ""
        raw = v.text() if v else ""
        if kind == "s":
            return self.shared[int(raw)] if raw.isdigit() and int(raw) < len(self.shared) else ""
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        if kind == "n" and raw and (c.attr("s") or "").isdigit() and int(c.attr("s")) in self.dates:
            return serial_date(raw)
        return raw

    def convert(self) -> Output:
        w, sheets = Writer(), self.sheets()
        self.out.meta["sheets"] = str(len(sheets))
        for name, part, hidden in sheets:
            if len(sheets) > 1:
                w.heading(2, escape_inline(name) + (" (hidden)" if hidden else ""))
            cells = {k: v for k, v in self.cells(part).items() if strip(v)}
            if not cells:
                w.push("_Empty sheet._")
                continue
            first, last, width = min(r for r, _ in cells), max(r for r, _ in cells), max(c for _, c in cells) + 1
            rows = [[cells.get((r, c), "") for c in range(width)] for r in range(first, last + 1)]
            w.push(render_table(_piped(rows), escape=False))
        self.out.markdown = str(w)
        return self.out
