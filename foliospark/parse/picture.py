"""Images: their kind and size from the first bytes, and a Markdown document that holds one."""

from __future__ import annotations

import re
import struct

from foliospark.parse.office import Options, Output, place_image
from foliospark.parse.text import Writer

# Frame markers of JPEG that hold the size.
FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))


def dimensions(data: bytes) -> tuple[int, int] | None:
    if data.startswith(b"\x89PNG") and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data.startswith(b"GIF8") and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    if data.startswith(b"BM") and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            if data[at + 1] in FRAMES:
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height
            at += 2 + (struct.unpack_from(">H", data, at + 2)[0] if data[at + 1] not in (0xFF, 0x01, *range(0xD0, 0xDA)) else 0) if data[at + 1] != 0xFF else 1
        return None
    head = data[:4096]
    if b"<svg" in head:
        width, height = (re.search(rb"<svg[^>]*\s" + n + rb"""\s*=\s*["']([0-9.]+)""", head) for n in (b"width", b"height"))
        if width and height:
            return round(float(width[1])), round(float(height[1]))
    return None


def convert(name: str, data: bytes, options: Options) -> Output:
    out, w = Output(), Writer()
    title = re.sub(r"\.[^.]+$", "", name)
    w.push(place_image(data, name, title, options, out))
    if size := dimensions(data):
        out.meta["dimensions"] = f"{size[0]} × {size[1]}"
    n = len(data)
    out.meta["size"] = f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
    out.markdown = str(w)
    return out
