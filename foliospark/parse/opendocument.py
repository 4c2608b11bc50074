"""OpenDocument packages (text, spreadsheet, presentation) to Markdown."""

from __future__ import annotations

from foliospark.parse.archive import Package, resolve
from foliospark.parse.markup import Node
from foliospark.parse.office import Options, Output, _piped, merge_emphasis, place_image
from foliospark.parse.text import Writer, collapse, image, quote, render_table, strip

#: Most copies made of a repeated row or column; style parents followed; spaces of one element.
REPEATS, PARENTS, SPACES = 64, 32, 8
PLAIN = (False, False, False, False, False, False, "")


class OpenDocument:
    def __init__(self, package: Package, options: Options):
        self.p, self.o, self.out = package, options, Output()
        self.content = package.xml("content.xml")
        self.styles: dict[str, dict] = {}
        self.lists: dict[str, dict[int, bool]] = {}
        for part in ("content.xml", "styles.xml"):
            self._load(package.xml(part))
        meta = package.xml("meta.xml")
        for name, tags in (("title", ("title",)), ("author", ("creator", "initial-creator")), ("created", ("creation-date",)), ("modified", ("date",))):
            found = next((strip(x.text()) for t in tags if meta and (x := meta.first(t)) and strip(x.text())), "")
            if found:
                self.out.meta[name] = found

    def _load(self, root: Node | None) -> None:
        for s in root.all("style") if root else ():
            t = s.child("text-properties")
            get = lambda a: ((t.attr(a) if t else None) or "").lower()  # noqa: B023, E731
            self.styles[s.attr("name") or ""] = {
                "parent": s.attr("parent-style-name"),
                "flags": ("mono" in get("font-name") or "courier" in get("font-name"), get("text-line-through-style") not in ("", "none"), get("font-weight") in ("bold", "600", "700", "800", "900"), get("font-style") in ("italic", "oblique")),
            }
        for s in root.all("list-style") if root else ():
            self.lists[s.attr("name") or ""] = {int(k.attr("level") or 1): k.local == "list-level-style-number" for k in s.elements()}

    def flags(self, name: str | None) -> tuple:
        """Code, strike, bold, italic; merged up the chain of parents."""
        out, seen = (False,) * 4, 0
        while name and name in self.styles and seen < PARENTS:
            out = tuple(a or b for a, b in zip(out, self.styles[name]["flags"], strict=True))
            name, seen = self.styles[name]["parent"], seen + 1
        return out

    def convert(self) -> Output:
        w = Writer()
        body = self.content.first("body") if self.content else None
        kind = next((k for t in ("spreadsheet", "presentation", "text") if body and (k := body.child(t)) is not None), None)
        if kind is not None:
            {"spreadsheet": self.sheets, "presentation": self.slides, "text": self.text}[kind.local](kind, w)
        self.out.markdown = str(w)
        return self.out

    def text(self, node: Node, w: Writer) -> None:
        for k in node.elements():
            tag = k.local
            if tag == "h":
                w.heading(int(k.attr("outline-level") or 1), self.inline(k))
            elif tag == "p":
                w.push(strip(self.inline(k)))
            elif tag == "list":
                w.push(self.list_(k, 0, k.attr("style-name")))
            elif tag == "table":
                w.push(self.table(k))
            elif tag in ("section", "index-body", "text-box", "table-of-content"):
                self.text(k, w)
            elif tag == "frame":
                w.push(self.frame(k))
            elif tag == "soft-page-break" and self.o.page_separators and w.blocks:
                w.rule()

    def list_(self, node: Node, depth: int, style: str | None) -> str:
        ordered = self.lists.get(style or "", {}).get(depth + 1, False)
        lines, n = [], 0
        for item in node.elements():
            if item.local not in ("list-item", "list-header"):
                continue
            n += 1
            mark = f"{n}." if ordered else self.o.bullet
            said = [strip(self.inline(k)) for k in item.elements() if k.local in ("p", "h")]
            nested = [x for k in item.elements("list") if (x := self.list_(k, depth + 1, k.attr("style-name") or style))]
            said = [x for x in said if x]
            if said:
                lines.append("  " * depth + f"{mark} " + "<br>".join(said))
            lines += nested
        return "\n".join(lines)

    def rows(self, table: Node) -> tuple[list[list[str]], int]:
        """Rows, and how many of them are header rows."""
        rows: list[list[str]] = []
        heads = 0
        for tr in table.all("table-row"):
            row: list[str] = []
            for c in tr.elements():
                if c.local in ("table-cell", "covered-table-cell"):
                    row += [self.cell(c)] * min(REPEATS, int(c.attr("number-columns-repeated") or 1))
            rows += [row] * min(REPEATS, int(tr.attr("number-rows-repeated") or 1))
        head = table.child("table-header-rows")
        heads = len(head.elements("table-row")) if head else 0
        while rows and not any(map(strip, rows[-1])):
            rows.pop()
        width = max((i + 1 for r in rows for i, c in enumerate(r) if strip(c)), default=0)
        return [r[:width] for r in rows], heads

    def cell(self, c: Node) -> str:
        said = [x for p in c.elements() if p.local in ("p", "h") and (x := strip(self.inline(p)))]
        return "<br>".join(said) or c.attr("date-value") or c.attr("value") or ""

    def table(self, node: Node) -> str:
        rows, heads = self.rows(node)
        if not rows:
            return ""
        if not heads:
            rows = [[""] * max(map(len, rows)), *rows]
        return render_table(_piped(rows), escape=False)

    def sheets(self, node: Node, w: Writer) -> None:
        tables = node.elements("table")
        self.out.meta["sheets"] = str(len(tables))
        for i, t in enumerate(tables, 1):
            if len(tables) > 1:
                w.heading(2, t.attr("name") or f"Sheet {i}")
            rows, _ = self.rows(t)
            w.push(render_table(_piped(rows), escape=False) if rows else "_Empty sheet._")

    def slides(self, node: Node, w: Writer) -> None:
        pages = node.elements("page")
        self.out.meta["slides"] = str(len(pages))
        for i, page in enumerate(pages, 1):
            if i > 1 and self.o.page_separators:
                w.rule()
            frames = [f for f in page.elements() if f.local in ("frame", "custom-shape", "g")]
            title = next((f for f in frames if f.attr("class") == "title"), None)
            w.heading(2, (strip(collapse(title.text())) if title else "") or page.attr("name") or f"Slide {i}")
            for f in frames:
                if f is not title:
                    inner = Writer()
                    box = f.child("text-box")
                    self.text(box or f, inner) if box or f.local != "frame" else inner.push(self.frame(f))
                    for b in inner.blocks:
                        w.push(b)
            notes = page.child("notes")
            said = [x for p in (notes.all("p") if notes else []) if (x := strip(self.inline(p)))]
            if said and self.o.notes:
                w.push(quote("**Notes:** " + "\n\n".join(said)))

    def frame(self, f: Node) -> str:
        pic, box, table = f.child("image"), f.child("text-box"), f.child("table")
        if table:
            return self.table(table)
        if box:
            inner = Writer()
            self.text(box, inner)
            return "\n\n".join(inner.blocks)
        if not pic:
            return ""
        target = pic.attr("href") or ""
        label = f.child("title") or f.child("desc")
        alt = strip(label.text()) if label else f.attr("name") or ""
        if ":" in target:
            return image(alt, target)
        part = resolve("", target)
        return place_image(self.p.read(part), part, alt, self.o, self.out) if target else ""

    def inline(self, node: Node) -> str:
        return merge_emphasis(self.runs(node, PLAIN))

    def runs(self, node: Node, fmt: tuple) -> list[tuple[str, tuple | None]]:
        out: list[tuple[str, tuple | None]] = []
        for k in node.kids:
            if isinstance(k, str):
                out.append((collapse(k.replace("\n", " ")), fmt))
                continue
            tag = k.local
            if tag == "span":
                own = self.flags(k.attr("style-name"))
                out += self.runs(k, (*(a or b for a, b in zip(fmt[:4], own, strict=True)), *fmt[4:]))
            elif tag == "a":
                out += self.runs(k, (*fmt[:6], k.attr("href") or ""))
            elif tag == "s":
                out.append((" " * min(SPACES, int(k.attr("c") or 1)), fmt))
            elif tag == "tab":
                out.append(("    ", fmt))
            elif tag == "line-break":
                out.append(("  \n", None))
            elif tag == "note":
                body = k.child("note-body")
                out.append((f" ^[{strip(collapse(body.text()))}]" if body else "", None))
            elif tag == "frame":
                out.append((self.frame(k), None))
            elif tag not in ("annotation", "tracked-changes"):
                out += self.runs(k, fmt)
        return out
