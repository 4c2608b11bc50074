"""HTML trees to Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from foliospark.parse.markup import Node, parse_html
from foliospark.parse.text import code_block, collapse, escape_first_mark, escape_inline, image, link, margins, normalize, quote, render_table, strip

# Elements left out with all they hold.
SKIPPED = frozenset("script style noscript head meta link title iframe object embed canvas svg template button input select textarea form nav".split())
# Elements that only hold blocks.
CONTAINERS = frozenset("html body div section article main header footer aside figure fieldset details summary address center font span".split())
BLOCKS = frozenset("p ul ol li blockquote pre hr table dl dt dd figcaption h1 h2 h3 h4 h5 h6".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "cite": "*", "var": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
CODE = frozenset(("code", "kbd", "samp", "tt"))
_BOLD = re.compile(r"font-weight\s*:\s*(bold|[6-9]00)")
_ITALIC = re.compile(r"font-style\s*:\s*(italic|oblique)")
_STRIKE = re.compile(r"text-decoration[^;]*line-through")
_LANGUAGE = re.compile(r"^(?:language|lang|highlight)-")


def _style(css: str) -> tuple[bool, bool, bool]:
    """Struck, bold, italic: in the order in which they are wrapped."""
    css = css.lower()
    return bool(_STRIKE.search(css)), bool(_BOLD.search(css)), bool(_ITALIC.search(css))


def class_styles(root: Node) -> dict[str, tuple[bool, bool, bool]]:
    """Emphasis by class, from plain class selectors of style sheets."""
    out: dict[str, tuple[bool, bool, bool]] = {}
    for sheet in root.all("style"):
        for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", sheet.text())):
            if any(style := _style(body)):
                for selector in selectors.split(","):
                    if m := re.fullmatch(r"\.([\w-]+)", selector.strip(), re.ASCII):
                        out[m[1]] = tuple(a or b for a, b in zip(out.get(m[1], (False,) * 3), style, strict=True))
    return out


def wrap(inner: str, mark: str) -> str:
    """Emphasis around the core of a text, blanks left outside; none twice."""
    left, core, right = margins(inner)
    if not core or core.startswith(mark) and core.endswith(mark):
        return inner
    return f"{left}{mark}{core}{mark}{right}"


def inline_code(s: str) -> str:
    s = re.sub("\r?\n", " ", s)
    if not strip(s):
        return ""
    fence = "`" * (max(map(len, re.findall("`+", s)), default=0) + 1)
    pad = " " if s[0] == "`" or s[-1] == "`" else ""
    return f"{fence}{pad}{s}{pad}{fence}"


def _raw(node: Node) -> str:
    return "".join(k if isinstance(k, str) else "\n" if k.local == "br" else _raw(k) for k in node.kids)


@dataclass
class Renderer:
    """Blocks and inline text of elements. resolve maps (url, 'image' or 'link') to a URL, or None to drop it."""

    bullet: str = "-"
    resolve: Callable[[str, str], str | None] = lambda url, kind: url
    heading_offset: int = 0
    styles: dict | None = None
    images: int = 0
    depth: int = 0

    def is_block(self, node: Node) -> bool:
        if node.local in ("span", "font"):
            return any(isinstance(k, Node) and k.local != "span" and self.is_block(k) for k in node.kids)
        return node.local in CONTAINERS or node.local in BLOCKS

    # blocks

    def pieces(self, node: Node, lists_apart: bool = False) -> list[tuple[str, str]]:
        """('block' or 'list', text) of what an element holds; runs of inline content become blocks."""
        out: list[tuple[str, str]] = []
        run: list = []

        def flush() -> None:
            if text := strip("".join(map(self.inline, run))):
                out.append(("block", text))
            run.clear()

        for k in node.kids:
            if isinstance(k, Node) and k.local in SKIPPED:
                continue
            if isinstance(k, str) or not self.is_block(k):
                run.append(k)
                continue
            flush()
            if lists_apart and k.local in ("ul", "ol"):
                out.append(("list", self.list_(k)))
            else:
                out += [("block", b) for b in self.block(k)]
        flush()
        return [x for x in out if strip(x[1])]

    def blocks(self, node: Node) -> list[str]:
        return [text for _, text in self.pieces(node)]

    def block(self, node: Node) -> list[str]:
        tag = node.local
        if tag in ("ul", "ol"):
            return [self.list_(node)]
        if tag == "hr":
            return ["---"]
        if tag == "pre":
            return [self.pre(node)]
        if tag == "table":
            return self.table(node)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(node))
            return [quote(inner)] if strip(inner) else []
        if tag in BLOCKS - {"li", "dl"}:
            text = strip(self.inlines(node))
            if not text:
                return []
            if tag[0] == "h":
                level = min(6, max(1, int(tag[1]) + self.heading_offset))
                return ["#" * level + " " + re.sub("\n+", " ", text)]
            return [{"dt": f"**{text}**", "dd": f": {text}"}.get(tag) or escape_first_mark(text)]
        return self.blocks(node)

    def pre(self, node: Node) -> str:
        node = node.child("code") or node
        named = next((c for c in (node.attr("class") or "").split() if _LANGUAGE.match(c)), "")
        text = _raw(node)
        return code_block(text.removeprefix("\n").rstrip(), _LANGUAGE.sub("", named))

    def list_(self, node: Node) -> str:
        try:
            number = int(float(node.attr("start") or "1"))
        except (ValueError, OverflowError):
            number = 1
        ordered, indent, lines = node.local == "ol", "  " * self.depth, []
        for li in node.elements("li"):
            mark = f"{number}." if ordered else self.bullet
            number += 1
            box = li.first("input")
            task = "" if box is None or (box.attr("type") or "").lower() != "checkbox" else "[x] " if box.attr("checked") is not None else "[ ] "
            self.depth += 1
            parts = self.pieces(li, lists_apart=True)
            self.depth -= 1
            body = strip("\n\n".join(t for kind, t in parts if kind == "block"))
            nested = [t for kind, t in parts if kind == "list"]
            if not (body or nested or task):
                continue
            first, *rest = body.split("\n")
            pad = indent + " " * (len(mark) + 1)
            item = "\n".join([f"{indent}{mark} {task}{first}", *(pad + x if x else "" for x in rest), *nested])
            lines.append(item.rstrip(" \t"))
        return "\n".join(lines)

    def table(self, node: Node) -> list[str]:
        rows, headers = [], 0
        for tr in node.all("tr"):
            cells = [k for k in tr.elements() if k.local in ("td", "th")]
            row: list[str] = []
            for cell in cells:
                try:
                    span = max(1, int(float(cell.attr("colspan") or "1")))
                except (ValueError, OverflowError):
                    span = 1
                row += [strip("<br>".join(self.blocks(cell))), *[""] * (min(span, 1000) - 1)]
            if row:
                headers += len(rows) == headers and all(c.local == "th" for c in cells)
                rows.append(row)
        if not rows:
            return []
        if not headers:
            rows.insert(0, [""] * len(rows[0]))
        caption = node.child("caption")
        title = strip(self.inlines(caption)) if caption else ""
        return [*([f"**{title}**"] if title else []), render_table(rows)]

    # inline text

    def inlines(self, node: Node) -> str:
        return "".join(map(self.inline, node.kids))

    def inline(self, node) -> str:
        if isinstance(node, str):
            return escape_inline(collapse(node.replace("\n", " ")))
        tag = node.local
        if tag in SKIPPED or tag == "wbr":
            return ""
        if tag in MARKS:
            return wrap(self.inlines(node), MARKS[tag])
        if tag in CODE:
            return inline_code(_raw(node))
        if tag == "br":
            return "  \n"
        if tag == "img":
            return self.img(node)
        if tag == "a":
            return self.anchor(node)
        if tag in ("sup", "sub"):
            inner = strip(self.inlines(node))
            return f"<{tag}>{inner}</{tag}>" if inner else ""
        if tag == "q":
            return f'"{self.inlines(node)}"'
        if self.is_block(node):
            return "\n\n".join(self.block(node))
        out = self.inlines(node)
        style = _style(node.attr("style") or "")
        for name in (node.attr("class") or "").split():
            style = tuple(a or b for a, b in zip(style, (self.styles or {}).get(name, style), strict=True))
        for on, mark in zip(style, ("~~", "**", "*"), strict=True):
            out = wrap(out, mark) if on else out
        return out

    def anchor(self, node: Node) -> str:
        inner = self.inlines(node)
        url = node.attr("href") and self.resolve(node.attr("href"), "link")
        if not url:
            return inner
        left, core, right = margins(inner)
        if not core:
            return "" if url.startswith("#") else f"<{url}>"
        return left + link(core, url, node.attr("title")) + right

    def img(self, node: Node) -> str:
        src = node.attr("src") if node.attr("src") is not None else node.attr("data-src") or ""
        src = src and self.resolve(src, "image")
        if not src:
            return ""
        self.images += 1
        return image(strip(node.attr("alt") or ""), src, node.attr("title"))


def render(root: Node, **options) -> tuple[str, int]:
    """Markdown and the number of images."""
    r = Renderer(**options, styles=class_styles(root))
    return normalize("\n\n".join(r.blocks(root.first("body") or root))), r.images


def title_of(root: Node) -> str:
    found = root.first("title")
    if found and (text := strip(collapse(found.text()))):
        return text
    for meta in root.all("meta"):
        if _meta_key(meta) in ("og:title", "title") and (content := strip(meta.attr("content") or "")):
            return content
    h1 = root.first("h1")
    return strip(collapse(h1.text())) if h1 else ""


def _meta_key(meta: Node) -> str:
    return (meta.attr("name") if meta.attr("name") is not None else meta.attr("property") or "").lower()


META = {"author": "author", "article:author": "author", "description": "description", "og:description": "description", "keywords": "keywords", "article:published_time": "date", "date": "date"}


def meta_of(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for meta in root.all("meta"):
        name, content = META.get(_meta_key(meta)), strip(meta.attr("content") or "")
        if name and content:
            out[name] = content
    return out


def to_markdown(html: str, **options) -> dict:
    """markdown, title, meta, images of a page."""
    root = parse_html(html)
    markdown, images = render(root, **options)
    return {"markdown": markdown, "title": title_of(root), "meta": meta_of(root), "images": images}


def editable_to_markdown(html: str) -> str:
    """Markdown of an editor's HTML: the hard spaces that keep runs of spaces alive there become plain ones."""
    return to_markdown(html, bullet="-")["markdown"].replace("\u00a0", " ")
