"""PDF files to rows of positioned text (page, x, y, width, size, bold, italic, text), and those to Markdown.

Objects are found by scanning, whatever the cross-reference table says; the last definition of a number counts. A page
that fails gives no text and a warning. Encrypted files are refused.
"""

from __future__ import annotations

import re
import statistics
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

from foliospark.parse.crypt import Security
from foliospark.parse.office import Options, Output
from foliospark.parse.text import Writer, escape_block, escape_inline, strip

PAGES, HOPS, FORM_DEPTH, OPERANDS = 5000, 64, 8, 64


class Name(str):
    __slots__ = ()


class Operator(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


_TOKEN = re.compile(
    rb"(?P<space>[\0\t\n\f\r ]+|%[^\r\n]*)|(?P<open><<)|(?P<close>>>)|(?P<list>\[)|(?P<end>\])|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<str>\()|<(?P<hex>[0-9A-Fa-f\0\t\n\f\r ]*)>"
    rb"|(?P<ref>\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![A-Za-z]))|(?P<num>[-+]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?)|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<odd>.)",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that starts behind the parenthesis at `at - 1`, and where it ends."""
    out, depth = [], 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|([^()\\]+)", re.S).finditer(data, at):
        escaped, paren, plain = m.groups()
        if plain is not None:
            out.append(plain)
        elif paren:
            depth += 1 if paren == b"(" else -1
            if not depth:
                return b"".join(out), m.end()
            out.append(paren)
        elif escaped[:1].isdigit() and escaped[:1] < b"8":
            out.append(bytes([int(escaped, 8) & 255]))
        elif escaped not in (b"\n", b"\r", b"\r\n"):
            out.append(_ESCAPES.get(escaped, escaped))
    return b"".join(out), len(data)


def tokens(data: bytes, at: int = 0):
    """(value, end) of objects and operators; arrays and dictionaries are built."""
    stack: list[tuple[str, list]] = []
    while at < len(data) and (m := _TOKEN.match(data, at)):
        at, kind, text = m.end(), m.lastgroup, m.group(m.lastgroup)
        if kind == "space" or kind == "odd":
            continue
        if kind in ("open", "list"):
            stack.append((kind, []))
            continue
        if kind in ("close", "end"):
            if not stack:
                continue
            opened, items = stack.pop()
            value = items if opened == "list" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), text).decode("latin-1"))
        elif kind == "str":
            value, at = _string(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s|\0", b"", text)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "ref":
            value = Ref(int(text.split()[0]))
        elif kind == "num":
            clean = text.lstrip(b"+-").split(b"-")[0]
            value = (float(clean) if b"." in clean else int(clean)) * (-1 if text.startswith(b"-") else 1)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(text, Operator(text.decode("latin-1")))
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


def text_string(b: bytes) -> str:
    if b.startswith(b"\xfe\xff"):
        return b[2:].decode("utf-16-be", "replace")
    return b[3:].decode("utf-8", "replace") if b.startswith(b"\xef\xbb\xbf") else b.decode("latin-1")


# --------------------------------------------------------------------- filters


def _predict(data: bytes, parms: dict) -> bytes:
    kind, colors, bits, columns = (int(parms.get(k, d)) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    width, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2 and bits == 8:
        out = bytearray(data)
        for row in range(0, len(out) - width + 1, width):
            for i in range(row + step, row + width):
                out[i] = out[i] + out[i - step] & 255
        return bytes(out)
    if kind < 10:
        return data
    out, last = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            a, b, c = row[i - step] if i >= step else 0, last[i], last[i - step] if i >= step else 0
            if how == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[how] if how < 4 else 0
            row[i] = row[i] + near & 255
        out += row
        last = row + bytearray(width - len(row))
    return bytes(out)


def _lzw(data: bytes, early: int) -> bytes:
    out, table, size = [], [bytes([i]) for i in range(256)] + [b"", b""], 9
    bits = held = 0
    last = b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & (1 << size) - 1
        if code == 256:
            del table[258:]
            size, last = 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        size = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += 2 + n if n < 128 else 2
    return bytes(out)


class Pdf:
    def __init__(self, data: bytes):
        self.warnings: list[str] = []
        self.objects: dict[int, object] = {}
        found = [(int(m[1]), int(m[2]), m.end()) for m in re.finditer(rb"(?<!\d)(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj(?![a-z])", data)]
        self.places, self.generations = {n: at for n, _, at in found}, {n: g for n, g, _ in found}
        self.security: Security | None = None
        self.data, self.trailer = data, {}
        for m in re.finditer(rb"trailer[\0\t\n\f\r ]*(?=<<)", data):
            found = next((v for v, _ in tokens(data, m.end())), None)
            if isinstance(found, dict):
                self.trailer = found | self.trailer
        for value in (self.get(Ref(n)) for n in self.places):
            if isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                self.trailer = {k: v for k, v in value.dict.items() if k in ("Root", "Info", "Encrypt", "ID")} | self.trailer
        locked = self.trailer.get("Encrypt")
        if locked is not None:
            entry, ids = self.get(locked), self.get(self.trailer.get("ID"))
            entry = {k: self.get(v) for k, v in entry.items()} if isinstance(entry, dict) else {}
            first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
            self.security = Security(entry, first if isinstance(first, bytes) else b"")
            self.plain = locked.number if isinstance(locked, Ref) else None
            self.objects = {}  # what was read so far wasn't opened
        for n in self.places:
            value = self.get(Ref(n))
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                self._unpack(value)
        self.pages = self._pages()

    def _unpack(self, s: Stream) -> None:
        data, first = self.decode(s), int(self.get(s.dict.get("First")) or 0)
        head = [v for v, _ in tokens(data[:first]) if isinstance(v, int)]
        for number, at in zip(head[::2], head[1::2], strict=False):
            if number not in self.places:
                self.objects[number] = next((v for v, _ in tokens(data, first + at)), None)

    def get(self, v, hops: int = 0):
        """What a reference points to."""
        while isinstance(v, Ref) and hops < HOPS:
            n, hops = v.number, hops + 1
            if n not in self.objects:
                if n not in self.places:
                    return None
                self.objects[n] = None  # a cycle ends here
                value = self._read(self.places[n])
                self.objects[n] = value if self.security is None or n == self.plain else self._opened(value, n)
            v = self.objects[n]
        return None if isinstance(v, Ref) else v

    def _opened(self, value, n: int):
        """An object with its strings and its stream decrypted."""
        if isinstance(value, Stream):
            kind = value.dict.get("Type")
            if kind == "XRef" or (kind == "Metadata" and not self.security.metadata):
                return value
            return Stream(self._opened(value.dict, n), self.security.open(value.raw, n, self.generations[n], True))
        if isinstance(value, dict):
            return {k: self._opened(v, n) for k, v in value.items()}
        if isinstance(value, list):
            return [self._opened(v, n) for v in value]
        return self.security.open(value, n, self.generations[n], False) if isinstance(value, bytes) else value

    def _read(self, at: int):
        value, end = next(tokens(self.data, at), (None, at))
        m = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, end) if isinstance(value, dict) else None
        if not m:
            return value
        n = self.get(value.get("Length"))
        stop = m.end() + n if isinstance(n, int) and n >= 0 else -1
        if stop < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, stop):
            found = re.compile(rb"\r?\n?endstream").search(self.data, m.end())
            stop = found.start() if found else len(self.data)
        return Stream(value, self.data[m.end() : stop])

    def decode(self, s: Stream) -> bytes:
        data = s.raw
        as_list = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        names, parms = as_list(self.get(s.dict.get("Filter"))), as_list(self.get(s.dict.get("DecodeParms")))
        for i, name in enumerate(names):
            name, p = self.get(name), self.get(parms[i]) if i < len(parms) else None
            p = {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}
            try:
                if name in ("FlateDecode", "Fl"):
                    z = zlib.decompressobj()
                    try:
                        data = z.decompress(data)
                    except zlib.error:
                        data = zlib.decompressobj(-15).decompress(data[2:])
                    data = _predict(data, p)
                elif name in ("LZWDecode", "LZW"):
                    data = _predict(_lzw(data, int(p.get("EarlyChange", 1))), p)
                elif name in ("ASCIIHexDecode", "AHx"):
                    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                    data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                elif name in ("ASCII85Decode", "A85"):
                    data = _ascii85(data)
                elif name in ("RunLengthDecode", "RL"):
                    data = _run_lengths(data)
                elif name in ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "DCT", "CCF"):
                    break
            except (zlib.error, ValueError, IndexError):
                self.warnings.append("A damaged stream was skipped.")
                return b""
        return data

    def _pages(self) -> list[dict]:
        root = self.get(self.trailer.get("Root")) or next((o for o in map(self.get, map(Ref, self.places)) if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        out, seen = [], set()

        def walk(ref, above: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen or len(out) >= PAGES:
                return
            seen.add(id(node))
            here = above | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, here)
            else:
                out.append(here | node)

        walk(root.get("Pages"), {})
        if not out:
            out = [o for n in sorted({*self.places, *self.objects}) if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Page"]
        return out

    def content(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(self.decode(s) for s in map(self.get, parts) if isinstance(s, Stream))

    def info(self) -> dict[str, str]:
        found, out = self.get(self.trailer.get("Info")), {}
        for key, name in (("Title", "title"), ("Author", "author"), ("Subject", "subject"), ("Keywords", "keywords"), ("Creator", "creator"), ("Producer", "producer"), ("CreationDate", "created"), ("ModDate", "modified")):
            value = self.get(found.get(key)) if isinstance(found, dict) else None
            if isinstance(value, bytes) and (text := strip(text_string(value))):
                if key.endswith("Date") and (m := re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", text)):
                    y, mo, d, h, mi, s = (x or z for x, z in zip(m.groups(), ("", "01", "01", None, None, None), strict=True))
                    text = f"{y}-{mo}-{d}" + (f" {h}:{mi or '00'}:{s or '00'}" if h else "")
                out[name] = text
        return out


# ----------------------------------------------------------------------- fonts

#: Glyph names that aren't letters; letters, digits and uniXXXX follow from a rule.
GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oslash": "ø", "Oslash": "Ø", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™", "Euro": "€", "section": "§", "paragraph": "¶", "periodcentered": "·", "guillemotleft": "«", "guillemotright": "»", "nbspace": " "}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}


def glyph(name: str) -> str:
    import unicodedata

    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    if (m := re.fullmatch(r"([A-Za-z])(\w+)", name)) and m[2] in _ACCENTS:
        return unicodedata.normalize("NFC", m[1] + _ACCENTS[m[2]])
    return ""


def to_unicode(data: bytes) -> dict[int, str]:
    """Codes of a character map; a range counts up the last unit of its first value."""
    out: dict[int, str] = {}
    number = lambda b: int.from_bytes(b, "big")
    text = lambda b: b.decode("utf-16-be", "ignore") if len(b) > 1 else b.decode("latin-1")
    held: list = []
    for v, _ in tokens(data):
        if not isinstance(v, Operator):
            held.append(v)
            continue
        if v == "endbfchar":
            out |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif v == "endbfrange":
            for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                for i in range(min(number(b) - number(a) + 1, 65536)):
                    if isinstance(to, list):
                        if i < len(to) and isinstance(to[i], bytes):
                            out[number(a) + i] = text(to[i])
                    elif isinstance(to, bytes) and text(to):
                        out[number(a) + i] = text(to)[:-1] + chr(min(ord(text(to)[-1]) + i, 0x10FFFF))
        held = []
    return out


class Font:
    def __init__(self, pdf: Pdf, spec: dict):
        get = pdf.get
        self.wide = get(spec.get("Subtype")) == "Type0"
        kid = get((get(spec.get("DescendantFonts")) or [None])[0]) if self.wide else spec
        kid = kid if isinstance(kid, dict) else {}
        about = get(kid.get("FontDescriptor"))
        about = about if isinstance(about, dict) else {}
        cmap = get(spec.get("ToUnicode"))
        self.map = to_unicode(pdf.decode(cmap)) if isinstance(cmap, Stream) else {}
        name = f"{spec.get('BaseFont', '')} {about.get('FontName', '')}".lower()
        flags, weight, stem = (get(about.get(k)) or 0 for k in ("Flags", "FontWeight", "StemV"))
        self.bold = any(x in name for x in ("bold", "black", "heavy", "semibold")) or weight >= 600 or stem >= 120
        self.italic = "italic" in name or "oblique" in name or bool(int(flags) & 64)
        encoding = get(spec.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.table = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
        at = 0
        for x in (get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(x, int):
                at = x
            elif isinstance(x, Name):
                self.table[at] = glyph(x) or self.table.get(at, "")
                at += 1
        self.widths: dict[int, float] = {}
        self.missing = float(get(kid.get("DW")) or 1000) if self.wide else float(get(about.get("MissingWidth")) or 500)
        if self.wide:
            w = [get(x) for x in get(kid.get("W")) or []]
            i = 0
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    self.widths |= {w[i] + j: float(get(x)) for j, x in enumerate(w[i + 1])}
                    i += 2
                elif i + 2 < len(w):
                    self.widths |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 65536) + 1), float(w[i + 2]))
                    i += 3
                else:
                    break
        else:
            first = get(spec.get("FirstChar")) or 0
            self.widths = {first + i: float(x) for i, w in enumerate(get(spec.get("Widths")) or []) if isinstance(x := get(w), int | float)}

    def read(self, data: bytes) -> tuple[str, float, int, int]:
        """Text, width in thousandths, characters, spaces."""
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.wide else list(data)
        text = "".join(self.map.get(c) or ("" if self.wide else self.table.get(c, "")) for c in codes)
        return text, sum(self.widths.get(c, self.missing) for c in codes), len(codes), 0 if self.wide else data.count(32)


# ----------------------------------------------------------------- page content


@dataclass
class Item:
    x: float
    y: float
    width: float
    size: float
    text: str
    bold: bool
    italic: bool


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass
class Graphics:
    ctm: tuple = (1, 0, 0, 1, 0, 0)
    font: Font | None = None
    size: float = 12
    leading: float = 0
    char: float = 0
    word: float = 0
    scale: float = 1
    rise: float = 0


class Reader:
    def __init__(self, pdf: Pdf):
        self.pdf, self.fonts, self.items = pdf, {}, []

    def font(self, resources: dict, name: str) -> Font | None:
        spec = self.pdf.get((self.pdf.get(resources.get("Font")) or {}).get(name))
        if not isinstance(spec, dict):
            return None
        if id(spec) not in self.fonts:
            self.fonts[id(spec)] = Font(self.pdf, spec)
        return self.fonts[id(spec)]

    def show(self, data: bytes, g: Graphics, tm: tuple) -> tuple:
        if g.font is None:
            return tm
        text, width, n, spaces = g.font.read(data)
        full = _times((g.size * g.scale, 0, 0, g.size, 0, g.rise), _times(tm, g.ctm))
        advance = (width / 1000 * g.size + n * g.char + spaces * g.word) * g.scale
        across = _times(tm, g.ctm)
        if text:
            self.items.append(Item(full[4], full[5], abs(advance) * (across[0] ** 2 + across[1] ** 2) ** 0.5, (full[2] ** 2 + full[3] ** 2) ** 0.5, text, g.font.bold, g.font.italic))
        return _times((1, 0, 0, 1, advance, 0), tm)

    def run(self, data: bytes, resources: dict, g: Graphics, depth: int = 0) -> None:
        from copy import copy

        one = (1, 0, 0, 1, 0, 0)
        stack, args, tm, line = [], [], one, one
        at = 0
        source = tokens(data)
        for v, at in source:
            if not isinstance(v, Operator):
                args = [*args, v][-OPERANDS:]
                continue
            op, a, args = str(v), args, []
            nums = [x for x in a if isinstance(x, int | float)]
            if op == "q":
                stack.append(copy(g))
            elif op == "Q" and stack:
                g = stack.pop()
            elif op == "cm" and len(nums) == 6:
                g.ctm = _times(tuple(nums), g.ctm)
            elif op == "BT":
                tm = line = one
            elif op == "Tf" and len(a) > 1:
                g.font, g.size = self.font(resources, a[0]), float(nums[-1]) if nums else 12
            elif op in ("Td", "TD") and len(nums) > 1:
                if op == "TD":
                    g.leading = -nums[1]
                tm = line = _times((1, 0, 0, 1, nums[0], nums[1]), line)
            elif op == "Tm" and len(nums) == 6:
                tm = line = tuple(nums)
            elif op in ("TL", "Tc", "Tw", "Ts", "Tz") and nums:
                setattr(g, {"TL": "leading", "Tc": "char", "Tw": "word", "Ts": "rise", "Tz": "scale"}[op], nums[0] / 100 if op == "Tz" else nums[0])
            elif op in ("T*", "'", '"'):
                if op == '"' and len(nums) > 1:
                    g.word, g.char = nums[0], nums[1]
                tm = line = _times((1, 0, 0, 1, 0, -g.leading), line)
                if op != "T*" and a and isinstance(a[-1], bytes):
                    tm = self.show(a[-1], g, tm)
            elif op == "Tj" and a and isinstance(a[-1], bytes):
                tm = self.show(a[-1], g, tm)
            elif op == "TJ" and a and isinstance(a[-1], list):
                for x in a[-1]:
                    if isinstance(x, bytes):
                        tm = self.show(x, g, tm)
                    elif isinstance(x, int | float):
                        if x < -180 and self.items and not self.items[-1].text.endswith(" "):
                            self.items[-1].text += " "
                        tm = _times((1, 0, 0, 1, -x / 1000 * g.size * g.scale, 0), tm)
            elif op == "Do" and a and depth < FORM_DEPTH:
                form = self.pdf.get((self.pdf.get(resources.get("XObject")) or {}).get(a[-1]))
                if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                    inner = copy(g)
                    matrix = self.pdf.get(form.dict.get("Matrix"))
                    if isinstance(matrix, list) and len(matrix) == 6:
                        inner.ctm = _times(tuple(matrix), g.ctm)
                    self.run(self.pdf.decode(form), self.pdf.get(form.dict.get("Resources")) or resources, inner, depth + 1)
            elif op == "ID":
                end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(data, at)
                return self.run_rest(data[end.end() :] if end else b"", resources, g, depth)

    def run_rest(self, data: bytes, resources: dict, g: Graphics, depth: int) -> None:
        if data and depth < 10_000:
            self.run(data, resources, g, depth)


def page_items(pdf: Pdf, page: dict) -> list[Item]:
    reader = Reader(pdf)
    reader.run(pdf.content(page), pdf.get(page.get("Resources")) or {}, Graphics())
    return reader.items


# ---------------------------------------------------------------------- layout


@dataclass
class Line:
    y: float
    x: float
    end: float
    size: float
    bold: bool
    italic: bool
    text: str


def lines_of(items: list[Item]) -> list[Line]:
    """Items of about one height as lines, from the top; in a line by x, a gap as a space."""
    out: list[Line] = []
    group: list[Item] = []
    mean = 0.0

    def close() -> None:
        if not group:
            return
        text, end = "", None
        for i in sorted(group, key=lambda i: i.x):
            gap = end is not None and i.x - end > max(1.0, 0.15 * i.size)
            text += (" " if gap and not text.endswith(" ") and not i.text.startswith(" ") else "") + i.text
            end = i.x + i.width
        text = strip(re.sub(r"\s+", " ", text))
        weight = sum(len(i.text) for i in group) or 1
        real = [i for i in group if strip(i.text)]
        if text:
            out.append(Line(mean, min(i.x for i in group), end, sum(i.size * len(i.text) for i in group) / weight, all(i.bold for i in real), all(i.italic for i in real), text))
        group.clear()

    for i in sorted(items, key=lambda i: (-round(i.y / 0.6), i.x)):
        if group and abs(i.y - mean) > max(1.2, 0.45 * min(i.size, group[-1].size)):
            close()
        mean = i.y if not group else mean + (i.y - mean) / (len(group) + 1)
        group.append(i)
    close()
    return out


def strip_running(pages: list[list[Line]]) -> None:
    """Take out edge lines that stand on most pages."""
    if len(pages) < 3:
        return
    mark = lambda x: (int(x.y / 6 + 0.5), re.sub(r"\d+", "#", x.text).lower()[:60])
    edge = lambda page: {*range(min(2, len(page))), *range(max(0, len(page) - 2), len(page))}
    seen = Counter(m for page in pages for m in {mark(page[i]) for i in edge(page)})
    often = {m for m, n in seen.items() if n >= max(3, -(-len(pages) * 6 // 10))}
    for page in pages:
        at = edge(page)
        page[:] = [x for i, x in enumerate(page) if not (i in at and mark(x) in often)]


_BULLET = re.compile(r"([•·▪◦‣∙○●■□*–—-])\s+(\S.*)$")
_ORDERED = re.compile(r"([0-9]{1,3})[.)]\s+(\S.+)$")
_LETTER = re.compile(r"([a-z])[.)]\s+(\S..+)$")


def _item(text: str, bullet: str) -> str | None:
    if m := _BULLET.match(text):
        return f"{bullet} {escape_inline(strip(m[2]))}"
    if m := _ORDERED.match(text):
        return f"{m[1]}. {escape_inline(strip(m[2]))}"
    if m := _LETTER.match(text):
        return f"{bullet} {m[1]}) {escape_inline(strip(m[2]))}"
    return None


def _joined(lines: list[Line]) -> str:
    out = ""
    for x in lines:
        out = x.text if not out else out[:-1] + x.text if out[-1] in "-­" and re.match("[a-zà-ÿ]", x.text) else f"{out} {x.text}"
    return strip(re.sub(r"\s+", " ", out))


def page_markdown(page: list[Line], body: float, levels: list[float], options: Options) -> str:
    gaps = [g for a, b in zip(page, page[1:], strict=False) if (g := a.y - b.y) > 0]
    usual = statistics.median(gaps) if gaps else body * 1.2
    blocks: list[list] = []
    above: Line | None = None
    for x in page:
        item = _item(x.text, options.bullet)
        level = 0
        if options.pdf_headings and not item and len(x.text) <= 160:
            at = next((i for i, s in enumerate(levels) if abs(s - x.size) < 0.6), None)
            if at is not None and x.size > body * 1.08:
                level = min(6, at + 1)
            elif x.bold and x.size >= body * 0.98 and len(x.text) < 90 and x.text[-1] not in ".;,":
                level = min(6, len(levels) + 1)
        far = above is not None and (above.y - x.y > 1.45 * usual or abs(above.size - x.size) > max(0.8, 0.12 * body))
        if item:
            if blocks and blocks[-1][0] == "list" and not far:
                blocks[-1][1].append(item)
            else:
                blocks.append(["list", [item]])
        elif level:
            if blocks and blocks[-1][0] == level and not far:
                blocks[-1][1].append(x)
            else:
                blocks.append([level, [x]])
        elif blocks and blocks[-1][0] == "text" and not far:
            blocks[-1][1].append(x)
        else:
            blocks.append(["text", [x]])
        above = x
    w, last = Writer(), None
    for kind, held in blocks:
        if kind == "list":
            text = "\n".join(held)
            if last == "list":
                w.blocks[-1] += "\n" + text
            else:
                w.push(text)
        elif kind == "text":
            text = escape_block(_joined(held))
            w.push(f"**{text}**" if len(held) == 1 and held[0].bold and len(text) < 120 else text)
        else:
            w.heading(kind, escape_inline(_joined(held)))
        last = kind
    return "\n\n".join(w.blocks)


def convert(data: bytes, options: Options) -> Output:
    pdf, out, w = Pdf(data), Output(), Writer()
    pages: list[list[Line]] = []
    for n, page in enumerate(pdf.pages, 1):
        try:
            pages.append(lines_of(page_items(pdf, page)))
        except (ValueError, TypeError, KeyError, IndexError, ZeroDivisionError, RecursionError, OverflowError, AttributeError):
            pages.append([])
            out.warnings.append(f"Page {n} could not be read.")
    strip_running(pages)
    weights: dict[float, int] = defaultdict(int)
    for x in (x for p in pages for x in p):
        weights[int(x.size * 2 + 0.5) / 2] += len(x.text)
    body = max(weights, key=weights.get) if weights else 12.0
    levels = sorted((s for s in weights if s > body * 1.08), reverse=True)[:6]
    texts = [page_markdown(p, body, levels, options) for p in pages]
    for i, text in enumerate(t for t in texts if t):
        if i and options.page_separators:
            w.rule()
        w.push(text)
    if not w.blocks:
        raise ValueError("The PDF has no text; it may be a scan.")
    empty = [str(i) for i, t in enumerate(texts, 1) if not t]
    if empty:
        out.warnings.append(f"No text on page {', '.join(empty[:20])}.")
    out.warnings += list(dict.fromkeys(pdf.warnings))
    out.meta = pdf.info() | {"pages": str(len(pdf.pages))}
    out.markdown = str(w)
    return out
