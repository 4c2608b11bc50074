"""Bytes to text: byte order marks, declared and guessed encodings."""

from __future__ import annotations

import codecs
import re

#: windows-1252 with the five unassigned bytes as C1 controls, as browsers read it.
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
# Labels that browsers take for windows-1252.
LATIN_LABELS = frozenset("ascii us-ascii ansi_x3.4-1968 cp1252 cp819 ibm819 iso-8859-1 iso8859-1 iso88591 iso_8859-1 l1 latin1 windows-1252 x-cp1252".split())


def windows_1252(data: bytes) -> str:
    return data.decode("latin-1").translate({i: c for i, c in enumerate(_CP1252) if i >= 128})


def decode(data: bytes, hint: str | None = None) -> tuple[str, str]:
    """Text and the encoding it was read as."""
    if not data:
        return "", "utf-8"
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if data.startswith(mark):
            body = data[len(mark) :]
            if name != "utf-8" and len(body) % 2:
                body = body[:-1]
            return body.decode(name.replace("16le", "16-le").replace("16be", "16-be"), "replace"), name
    label = (hint or "").strip().lower()
    if label and label not in ("utf-8", "utf8"):
        if label in LATIN_LABELS:
            return windows_1252(data), label
        try:
            return data.decode(label, "replace"), label
        except (LookupError, ValueError, TypeError):
            pass
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return windows_1252(data), "windows-1252"


def looks_textual(data: bytes) -> bool:
    head = data[:4096]
    if b"\0" in head:
        return False
    odd = sum(b < 9 or 14 <= b < 32 for b in head)
    return odd < len(head) * 0.05 or not head


def declared_charset(data: bytes) -> str | None:
    m = re.search(rb"""(?i)<meta[^>]+charset\s*=\s*["']?([\w-]+)|<\?xml[^>]+encoding\s*=\s*["']([\w-]+)""", data[:2048])
    return (m[1] or m[2]).decode() if m else None


def quoted_printable(data: bytes) -> bytes:
    """Soft line breaks go; an escape of one or two hexadecimal digits gives its byte, any other = stays."""
    data = re.sub(rb"=\r?\n", b"", data)

    def one(m: re.Match) -> bytes:
        digits = re.match(rb"[0-9a-fA-F]{1,2}", m[1])
        return bytes([int(digits[0], 16)]) if digits else b"=" + m[1]

    return re.sub(rb"(?s)=(.{2})", one, data)


def base64_lenient(data: bytes) -> bytes:
    import base64

    clean = re.sub(rb"[^A-Za-z0-9+/]", b"", data)
    if len(clean) % 4 == 1:
        clean = clean[:-1]
    return base64.b64decode(clean + b"=" * (-len(clean) % 4))
