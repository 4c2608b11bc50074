"""ZIP packages, read tolerantly: by the central directory, without checksums, the last of equal names counting."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

from foliospark.parse.markup import Node, parse_xml

#: Most bytes that one part may unpack to.
PART_LIMIT = 400 * 1024 * 1024


class PackageError(ValueError):
    """A message for the user."""


def inflate(data: bytes, limit: int = PART_LIMIT) -> bytes:
    """Raw deflate or zlib data; a damaged tail gives what came before."""
    for bits in (15, -15) if len(data) > 1 and (data[0] & 15) == 8 and (data[0] << 8 | data[1]) % 31 == 0 else (-15,):
        z = zlib.decompressobj(bits)
        try:
            return z.decompress(data, limit)
        except zlib.error:
            continue
    return b""


class Package:
    """Parts of a ZIP by name; unpacked when asked for."""

    def __init__(self, data: bytes):
        self.data = data
        end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
        if end < 0 or end + 22 > len(data):
            raise PackageError("The file is not a readable ZIP archive.")
        count, _, start = struct.unpack_from("<HII", data, end + 10)
        locator = end - 20
        if (count == 0xFFFF or start == 0xFFFFFFFF) and locator >= 0 and data[locator : locator + 4] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", data, locator + 8)[0]
            if data[at : at + 4] == b"PK\x06\x06":
                count, _, start = struct.unpack_from("<QQQ", data, at + 32)
        self.entries: dict[str, tuple[int, int, int]] = {}
        at = start
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                break
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size = struct.unpack_from("<II", data, at + 20)
            n, extra, note = struct.unpack_from("<HHH", data, at + 28)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            tail = data[at + 46 + n : at + 46 + n + extra]
            while len(tail) >= 4:  # sizes beyond 4 GB
                kind, length = struct.unpack_from("<HH", tail)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", tail, 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF and wide else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF and wide else offset
                tail = tail[4 + length :]
            if not name.endswith("/"):
                self.entries[name] = (method, packed, offset)
            at += 46 + n + extra + note
        if not self.entries:
            raise PackageError("The archive is empty.")

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def read(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        method, packed, at = self.entries[name]
        if self.data[at : at + 4] != b"PK\x03\x04":
            return None
        n, extra = struct.unpack_from("<HH", self.data, at + 26)
        body = self.data[at + 30 + n + extra :][:packed]
        if method not in (0, 8):
            raise PackageError(f"{name} is packed in a way that is not supported ({method}).")
        return body if method == 0 else inflate(body)

    def text(self, name: str) -> str | None:
        data = self.read(name)
        return None if data is None else data.decode("utf-8", "replace").removeprefix("﻿")

    def xml(self, name: str) -> Node | None:
        text = self.text(name)
        return None if text is None else parse_xml(text)

    def under(self, prefix: str, suffix: str = "") -> list[str]:
        return sorted((n for n in self.entries if n.startswith(prefix) and n.endswith(suffix)), key=natural_key)


def natural_key(name: str) -> tuple:
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", name))


def resolve(base: str, target: str) -> str:
    """A part's name from a folder and a relative or absolute target."""
    steps: list[str] = []
    for x in (target if target.startswith("/") else f"{base}/{target}").split("/"):
        if x == "..":
            del steps[-1:]
        elif x not in ("", "."):
            steps.append(x)
    return "/".join(steps)


def relationships(package: Package, part: str) -> dict[str, tuple[str, str, bool]]:
    """Id to (target, type, external) of a part; internal targets are part names."""
    folder, _, file = part.rpartition("/")
    root = package.xml(f"{folder}/_rels/{file}.rels".lstrip("/"))
    out = {}
    for r in root.all("Relationship") if root else ():
        outside = (r.attr("TargetMode") or "").lower() == "external"
        target = r.attr("Target") or ""
        out[r.attr("Id") or ""] = (target if outside else resolve(folder, target), r.attr("Type") or "", outside)
    return out


def write_zip(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()
