"""One file's bytes to its format and Markdown; errors become a message, never an exception."""

from __future__ import annotations

import re

from foliospark.parse import epub, mail, pdf, picture
from foliospark.parse.archive import Package, PackageError
from foliospark.parse.decode import declared_charset, decode, looks_textual
from foliospark.parse.html import meta_of, render, title_of
from foliospark.parse.markup import parse_html
from foliospark.parse.office import Options, Output, Sheets, Slides, Word
from foliospark.parse.opendocument import OpenDocument
from foliospark.parse.plain import text_to_markdown
from foliospark.parse.richtext import RichText
from foliospark.parse.text import normalize, render_table

# Shortcut files that hold only a link, with the download that helps; image extensions; text labels.
SHORTCUTS = {"gdoc": "Word (.docx)", "gsheet": "Excel (.xlsx)", "gslides": "PowerPoint (.pptx)", "gdraw": "PNG or SVG"}
IMAGES = frozenset("png jpg jpeg gif bmp svg webp tif tiff heic avif ico".split())
LABELS = {"md": "Markdown", "markdown": "Markdown", "json": "JSON", "jsonl": "JSON", "ndjson": "JSON", "yaml": "YAML", "yml": "YAML", "xml": "XML", "srt": "Subtitles", "vtt": "Subtitles", "": "Plain text"}
# The extensions that a file picker offers; what a file is doesn't depend on them.
SUPPORTED = (
    "pdf", "docx", "docm", "dotx", "xlsx", "xlsm", "xltx", "pptx", "pptm", "potx",
    "odt", "ods", "odp", "epub", "rtf", "html", "htm", "xhtml", "eml", "mht", "mhtml",
    "csv", "tsv", "txt", "md", "markdown", "json", "jsonl", "ndjson", "yaml", "yml",
    "xml", "srt", "vtt", "log", "png", "jpg", "jpeg", "gif", "webp", "bmp", "svg",
    "js", "ts", "py", "rb", "go", "rs", "java", "kt", "swift", "c", "h", "cpp", "cs",
    "php", "sh", "sql", "dart", "toml", "ini",
)
ROW_CAP = 5000
#: Largest file that is converted.
SIZE_LIMIT = 200 * 1024 * 1024


class Refused(ValueError):
    """A message for the user."""


def extension_of(name: str) -> str:
    return name.split(".")[-1].lower()


def detect(name: str, data: bytes) -> tuple[str, str]:
    """Format and label; the first rule that fits counts."""
    ext = extension_of(name)
    if ext in SHORTCUTS:
        raise Refused(f"Only a pointer to an online document is stored in a .{ext} file; export it as {SHORTCUTS[ext]} first.")
    if data.startswith(b"%PDF"):
        return "pdf", "PDF"
    if data.startswith(b"{\\rtf"):
        return "rtf", "Rich Text (.rtf)"
    if data.startswith(b"PK") and len(data) > 4:
        return detect_package(data, ext)
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise Refused("Binary Office formats from before 2007 are not supported; resave the file in the XML-based form (docx, xlsx, pptx).")
    if data.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM")) or data.startswith(b"RIFF") and data[8:10] == b"WE" or ext in IMAGES - {"svg"}:
        return "image", "Image"
    if ext in ("eml", "mht", "mhtml"):
        return "eml", "Email message"
    if ext in ("csv", "tsv"):
        return "csv", "Tab-separated values" if ext == "tsv" else "Comma-separated values"
    if ext in ("html", "htm", "xhtml"):
        return "html", "HTML"
    if not looks_textual(data):
        raise Refused(f"No known format fits “{name}”, and its bytes are not text.")
    head = decode(data[:1024])[0].lstrip().lower()
    if head.startswith(("<!doctype html", "<html")) or "<body" in head:
        return "html", "HTML"
    if head.startswith(("from:", "received:", "return-path:", "mime-version:")):
        return "eml", "Email message"
    return "text", "SVG source" if ext == "svg" else LABELS.get(ext, f"Plain text (.{ext})")


def detect_package(data: bytes, ext: str) -> tuple[str, str]:
    try:
        package = Package(data)
    except PackageError as e:
        raise Refused(f"The file’s ZIP container is damaged: {e}") from e
    for part, found in (("word/document.xml", ("docx", "Word (.docx)")), ("xl/workbook.xml", ("xlsx", "Excel (.xlsx)")), ("ppt/presentation.xml", ("pptx", "PowerPoint (.pptx)"))):
        if part in package:
            return found
    kind = (package.text("mimetype") or "").strip()
    if kind == "application/epub+zip" or "META-INF/container.xml" in package:
        return "epub", "EPUB"
    if kind.startswith("application/vnd.oasis.opendocument") or "content.xml" in package:
        return "odf", "OpenDocument " + ("spreadsheet" if "spreadsheet" in kind else "presentation" if "presentation" in kind else "text")
    raise Refused(f"The .{ext} archive holds no known kind of document; unpack it and convert its files one by one.")


def _delimited(name: str, data: bytes, out: Output) -> str:
    from foliospark.parse.delimited import alignment, parse_delimited, sniff

    text, encoding = decode(data)
    delimiter = "\t" if extension_of(name) == "tsv" else sniff(text)
    rows = [r for r in parse_delimited(text, delimiter) if any(c.strip() for c in r)]
    n = len(rows)
    if n > ROW_CAP:
        out.warnings.append(f"Only the first {ROW_CAP} of {n} rows were converted.")
        rows = rows[:ROW_CAP]
    width = max(map(len, rows), default=0)
    out.meta = {"encoding": encoding, "rows": str(max(0, n - 1)), "columns": str(width), "delimiter": "tab" if delimiter == "\t" else delimiter}
    return render_table([r + [""] * (width - len(r)) for r in rows], alignment(rows))


def _html(data: bytes, options: Options, out: Output) -> str:
    text, encoding = decode(data, declared_charset(data))
    root = parse_html(text)
    skip = options.image_mode == "skip"
    markdown, out.images = render(root, bullet=options.bullet, resolve=lambda url, kind: None if skip and kind == "image" else url)
    title = title_of(root)
    out.meta = {"encoding": encoding} | ({"title": title} if title else {}) | meta_of(root)
    return markdown


def run(name: str, data: bytes, options: Options) -> dict:
    """format, label, markdown (without front matter), meta, warnings, images, error."""
    blank = {"format": None, "label": None, "markdown": None, "meta": {}, "warnings": [], "images": 0, "error": None}
    if len(data) > SIZE_LIMIT:
        return blank | {"error": f"Files of over {SIZE_LIMIT >> 20} MB are not converted."}
    try:
        kind, label = detect(name, data)
    except Refused as e:
        return blank | {"error": str(e)}
    found = blank | {"format": kind, "label": label}
    try:
        out = Output()
        if kind == "pdf":
            out = pdf.convert(data, options)
        elif kind == "rtf":
            out = RichText(data, options).convert()
        elif kind == "image":
            out = picture.convert(name, data, options)
        elif kind == "eml":
            out = mail.convert(data, options)
        elif kind == "csv":
            out.markdown = _delimited(name, data, out)
        elif kind == "html":
            out.markdown = _html(data, options, out)
        elif kind == "text":
            text, encoding = decode(data)
            out.markdown = text_to_markdown(text, extension_of(name), options.bullet, options.keep_breaks, out.warnings)
            out.meta = {"encoding": encoding}
        else:
            package = Package(data)
            out = epub.convert(package, options) if kind == "epub" else {"docx": Word, "xlsx": Sheets, "pptx": Slides, "odf": OpenDocument}[kind](package, options).convert()
    except RecursionError:
        return found | {"error": "The document nests too deeply."}
    except Exception as e:  # noqa: BLE001  one file's error is a row, not the job's end
        return found | {"error": str(e) or type(e).__name__}
    return found | {"markdown": normalize(out.markdown) if out.markdown.strip() else "", "meta": {k: re.sub(r"\s+", " ", str(v)) for k, v in out.meta.items()}, "warnings": out.warnings, "images": out.images}
