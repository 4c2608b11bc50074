"""Markdown text functions as native columns: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside brackets: white space of the document formats (Java's own class lacks the no-break space).
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, NOT_WS = f"[{SPACE}]", f"[^{SPACE}]"

# Extensions whose fence language has another name.
FENCE_LANGUAGES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "yml": "yaml", "md": "markdown", "kt": "kotlin", "rs": "rust", "cs": "csharp", "cpp": "cpp", "h": "c", "m": "objectivec"}
# Media types of images by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf", "wmf": "image/wmf", "heic": "image/heic", "avif": "image/avif", "ico": "image/x-icon"}
# Names that mark Markdown files.
MARKDOWN_NAME = r"(?i)\.(md|markdown|mdown|mkd|mdx)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def trim(c) -> Column:
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def rtrim(c) -> Column:
    return F.regexp_replace(_col(c), f"{WS}+$", "")


def is_blank(c) -> Column:
    return ~_col(c).rlike(NOT_WS)


# -------------------------------------------------------------------- escaping


def escape_inline(c) -> Column:
    return F.regexp_replace(_col(c), r"([\\`*_\[\]<>|])", r"\\$1")


def escape_leading(c) -> Column:
    """A backslash before a list, quote or heading marker at the start."""
    return F.regexp_replace(_col(c), rf"^({WS}*)([-+*>#]|[0-9]+[.)])({WS})", r"$1\\$2$3")


def escape_block(c) -> Column:
    return escape_leading(escape_inline(c))


def escape_cell(c) -> Column:
    return F.regexp_replace(escape_inline(c), "\r?\n", "<br>")


def unescape(c) -> Column:
    return F.regexp_replace(_col(c), r"\\([\\`*_\[\]<>|#+.!~()-])", "$1")


def collapse_spaces(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"[\t\f\x0B\u00a0]+", " "), " {2,}", " ")


# ------------------------------------------------------------------ small parts


def encode_href(c) -> Column:
    t = trim(c)
    return F.when(t.startswith("data:"), t).when(t.rlike("[ ()<>]"), F.concat(F.lit("<"), F.replace(t, F.lit(">"), F.lit("%3E")), F.lit(">"))).otherwise(t)


def _title(title) -> Column:
    if title is None:
        return F.lit("")
    t = _col(title)
    return F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.concat(F.lit(' "'), F.replace(t, F.lit('"'), F.lit('\\"')), F.lit('"')))


def link(text, href, title=None) -> Column:
    target, label = encode_href(href), trim(text)
    return F.concat(F.lit("["), F.when(label == "", target).otherwise(label), F.lit("]("), target, _title(title), F.lit(")"))


def image(alt, href, title=None) -> Column:
    return F.concat(F.lit("!["), F.regexp_replace(_col(alt), r"[\[\]]", ""), F.lit("]("), encode_href(href), _title(title), F.lit(")"))


def heading(level, text) -> Column:
    """Null for a blank text."""
    clean = trim(collapse_spaces(text))
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(clean != "", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), clean))


def quote(text) -> Column:
    body = trim(text)
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x)))
    return F.when(body != "", F.array_join(lines, "\n"))


def fence_language(extension) -> Column:
    ext = F.lower(F.regexp_replace(_col(extension), r"^\.", ""))
    return F.coalesce(F.element_at(_map(FENCE_LANGUAGES), ext), ext)


def code_block(code, language=None) -> Column:
    code = _col(code)
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`{3,})"), 1), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("") if language is None else _col(language), F.lit("\n"), F.regexp_replace(code, "\n+$", ""), F.lit("\n"), fence)


def yaml_scalar(c) -> Column:
    v = _col(c)
    special = rf"^[{SPACE}>|@`&*!%#{{\[\]}}]|[:#]{WS}|[\"'\\]|^$|^(?i:true|false|null|yes|no|on|off|~)$|^-?[0-9]+(\.[0-9]+)?$|\n"
    quoted = F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(v.rlike(special), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(v)


def front_matter(entries) -> Column:
    """entries: an array of structs (k, v) in the order of output; empty values are left out. Empty text without any."""
    kept = F.filter(_col(entries), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    lines = F.transform(kept, lambda e: F.concat(e["k"], F.lit(": "), yaml_scalar(e["v"])))
    return F.when(F.size(kept) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---"))).otherwise("")


def normalize(c) -> Column:
    """Line ends, trailing spaces other than a hard break of two, runs of blank lines, one newline at the end."""
    x = F.regexp_replace(_col(c), "\r\n?", "\n")
    x = F.regexp_replace(x, r"(?md)(?<![ \t])(?!  $)[ \t]+$", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.concat(rtrim(F.regexp_replace(x, "^\n+", "")), F.lit("\n"))


def join_blocks(blocks) -> Column:
    """A document from an array of blocks: blank ones go, each is right-trimmed, a blank line between."""
    kept = F.filter(F.transform(_col(blocks), rtrim), lambda b: F.coalesce(b, F.lit("")) != "")
    return F.when(F.size(kept) > 0, normalize(F.array_join(kept, "\n\n"))).otherwise("\n")


# ----------------------------------------------------------------------- counts


def count_words(markdown) -> Column:
    """Words of a conversion's statistics: without fenced code and images."""
    x = F.regexp_replace(_col(markdown), r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(x, r"[#>*_`|-]", " ")
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"))


def library_words(markdown) -> Column:
    """Words of the library's list: runs of non-space once fenced code and marks are gone."""
    x = F.regexp_replace(_col(markdown), r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"[#>*_`|-]", " ")
    return F.regexp_count(x, F.lit(f"{NOT_WS}+"))


def reading_minutes(words) -> Column:
    return F.greatest(F.lit(1), F.floor(_col(words) / 200 + F.lit(0.5)).cast("int"))


# ------------------------------------------------------------------------ names


def extension(name) -> Column:
    """What stands behind the last dot, lower-cased; the whole name if there is none."""
    return F.lower(F.element_at(F.split(_col(name), r"\.", -1), -1))


def title_from_name(name) -> Column:
    stem = F.regexp_replace(_col(name), r"\.[^.]+$", "")
    return trim(F.regexp_replace(F.regexp_replace(stem, "[_-]+", " "), f"{WS}+", " "))


def output_name(name) -> Column:
    stem = F.regexp_replace(_col(name), r"\.[^.]+$", "")
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit(".md"))


def library_name(name) -> Column:
    """A name fit for a file: forbidden characters out, 120 characters at most, never blank, with a Markdown extension."""
    clean = F.regexp_replace(trim(name), r'[/\\<>:"|?*\x00-\x1F]', "")
    clean = trim(F.substring(clean, 1, 120))
    clean = F.when(clean == "", "Untitled").otherwise(clean)
    return F.when(clean.rlike(MARKDOWN_NAME), clean).otherwise(F.concat(clean, F.lit(".md")))


def alt_from_name(name) -> Column:
    return title_from_name(name)


def natural_key(name, digits: int = 20) -> Column:
    """Sorting by this key sorts names with runs of digits by their value."""
    parts = F.regexp_extract_all(_col(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), digits, "0")).otherwise(p)), "\x01")


def format_bytes(n) -> Column:
    n = _col(n)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def describe_size(n) -> Column:
    """What a picture adds to a document: whole thousands of bytes, one at least, or millions with one digit.

    format_number rounds the quotient's own binary value, as printf does; format_string's %.1f would round its shortest digits (1.15 to 1.2)."""
    n = _col(n)
    return F.when(n >= 1_000_000, F.concat(F.call_function("format_number", n / 1_000_000, F.lit("0.0")), F.lit(" MB"))).otherwise(F.format_string("%d KB", F.greatest(F.lit(1), F.floor(n / 1000 + 0.5)).cast("long")))


def image_type(name) -> Column:
    return F.coalesce(F.element_at(_map(IMAGE_TYPES), extension(name)), F.lit("application/octet-stream"))


def data_uri(content, mime) -> Column:
    """Needs spark.sql.chunkBase64String.enabled=false, which `session.prepare` sets."""
    return F.concat(F.lit("data:"), _col(mime), F.lit(";base64,"), F.base64(_col(content)))


def normalize_part(path) -> Column:
    """A package part's name with . and .. resolved."""
    steps = F.split(F.regexp_replace(_col(path), "^/", ""), "/", -1)
    start = F.array().cast("array<string>")
    walk = F.aggregate(steps, start, lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(walk, "/")


def excel_serial(value) -> Column:
    """A spreadsheet's day number (1900 system) as ISO date, or date and time to the second."""
    v = _col(value).cast("double")
    t = F.timestamp_millis(F.round((v - F.lit(25569)) * F.lit(86_400_000.0)).cast("long"))
    return F.when(F.abs(v - F.floor(v)) <= 1e-9, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def column_index(reference) -> Column:
    """The column number (from 0) of a cell reference such as AB12."""
    letters = F.split(F.regexp_extract(F.upper(_col(reference)), "^([A-Z]*)", 1), "")
    n = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    return F.greatest(F.lit(0), n - 1)


def is_numeric_cell(c) -> Column:
    t = trim(c)
    return t.rlike(r"^[-+]?[0-9.,]+%?$") & t.rlike("[0-9]")


def split_front_matter(markdown) -> Column:
    """A struct (front with its closing line and a newline, body); front is empty where no block between lines of --- leads."""
    m = _col(markdown)
    lines = F.split(F.regexp_replace(m, "\r\n?", "\n"), "\n", -1)
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "---").cast("int")
    has = m.startswith("---") & (trim(F.element_at(lines, 1)) == "---") & (end > 0)
    front = F.concat(F.array_join(F.slice(lines, F.lit(1), end + 1), "\n"), F.lit("\n"))
    body = F.regexp_replace(F.array_join(F.slice(lines, end + 2, F.size(lines)), "\n"), "^\n+", "")
    return F.struct(F.when(has, front).otherwise("").alias("front"), F.when(has, body).otherwise(m).alias("body"))
