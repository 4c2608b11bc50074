"""E-book packages: the chapters of the spine, in order, through the HTML engine."""

from __future__ import annotations

from foliospark.parse.archive import Package, resolve
from foliospark.parse.html import render
from foliospark.parse.markup import parse_html
from foliospark.parse.office import Options, Output, place_image
from foliospark.parse.text import Writer, strip


def convert(package: Package, options: Options) -> Output:
    out, w = Output(), Writer()
    container = package.xml("META-INF/container.xml")
    named = container.first("rootfile").attr("full-path") if container and container.first("rootfile") else None
    opf = named if named in package.entries else next((n for n in package.entries if n.lower().endswith(".opf")), None)
    root = package.xml(opf) if opf else None
    if not root:
        raise ValueError("The e-book has no package file.")
    folder = opf.rpartition("/")[0]
    for name, tag in (("title", "title"), ("author", "creator"), ("language", "language"), ("publisher", "publisher"), ("date", "date")):
        found = root.first(tag)
        if found and strip(found.text()):
            out.meta[name] = strip(found.text())
    manifest = {i.attr("id"): i for i in root.all("item")}
    spine = [manifest[r.attr("idref")] for r in root.all("itemref") if r.attr("idref") in manifest] or list(manifest.values())
    chapters = 0
    for item in spine:
        kind = item.attr("media-type") or ""
        if "nav" in (item.attr("properties") or "").split() or kind and "html" not in kind:
            continue
        part = resolve(folder, item.attr("href") or "")
        text = package.text(part)
        if text is None:
            out.warnings.append(f"Chapter {part} is missing from the file.")
            continue
        here = part.rpartition("/")[0]

        def at(url: str, what: str, here: str = here) -> str | None:
            if what == "link":
                return url if url.split(":")[0] in ("http", "https", "mailto") else None
            if url.startswith(("http:", "https:", "data:")):
                return url
            name = resolve(here, url.split("#")[0])
            placed = place_image(package.read(name), name, "", options, out)
            return placed[4:-1].strip("<>") if placed else None

        markdown, _ = render(parse_html(text), bullet=options.bullet, resolve=at)
        if strip(markdown):
            if chapters and options.page_separators:
                w.rule()
            w.push(markdown)
            chapters += 1
    out.meta["chapters"] = str(chapters)
    out.markdown = str(w)
    return out
