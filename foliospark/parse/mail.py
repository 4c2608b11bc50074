"""Messages: headers, MIME parts, encoded words; the best body as Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foliospark.parse.decode import base64_lenient, decode, quoted_printable
from foliospark.parse.html import to_markdown
from foliospark.parse.office import Options, Output
from foliospark.parse.plain import plain_to_markdown
from foliospark.parse.text import Writer, escape_inline, render_table, strip

#: Parts nested deeper than this aren't opened.
DEPTH = 20


@dataclass
class Part:
    headers: dict[str, str]
    body: bytes
    kind: str = "text/plain"
    charset: str | None = None
    filename: str = ""
    attached: bool = False
    parts: list[Part] = field(default_factory=list)

    def text(self) -> str:
        return decode(self.body, self.charset)[0]

    def leaves(self):
        for p in self.parts:
            yield from p.leaves()
        if not self.parts:
            yield self


def encoded_words(s: str) -> str:
    """Encoded words in place; white space between two of them goes."""
    word = r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?="
    s = re.sub(rf"({word})\s+(?==\?)", lambda m: m[1], s)

    def one(m: re.Match) -> str:
        raw = m[3].encode("latin-1", "replace")
        data = base64_lenient(raw) if m[2] in "bB" else quoted_printable(raw.replace(b"_", b" "))
        return decode(data, m[1].split("*")[0])[0]

    return re.sub(word, one, s)


def headers_of(block: str) -> dict[str, str]:
    """The first of each header, by its lower-cased name, unfolded."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", block).split("\n"):
        name, colon, value = line.partition(":")
        if colon and strip(name) and not re.search(r"\s", strip(name)):
            out.setdefault(strip(name).lower(), strip(value))
    return out


def parameter(value: str, name: str) -> str:
    m = re.search(rf"""(?i);\s*{name}\*?\s*=\s*(?:"([^"]*)"|([^;\s]+))""", value)
    return (m[1] if m[1] is not None else m[2]) if m else ""


def parse(data: bytes, depth: int = 0) -> Part:
    m = re.search(rb"\r?\n\r?\n", data)
    head, body = (data[: m.start()], data[m.end() :]) if m else (data, b"")
    headers = headers_of(decode(head)[0])
    content, place = headers.get("content-type", "text/plain"), headers.get("content-disposition", "")
    part = Part(headers, body, strip(content.split(";")[0]).lower() or "text/plain", parameter(content, "charset") or None)
    part.filename = encoded_words(parameter(place, "filename") or parameter(content, "name"))
    part.attached = place.lower().startswith("attachment") or bool(part.filename) and not part.kind.startswith("text/")
    boundary = parameter(content, "boundary")
    if part.kind.startswith("multipart/") and boundary and depth < DEPTH:
        pieces = re.split(rb"(?:^|\r?\n)--" + re.escape(boundary.encode("latin-1", "replace")) + rb"(--)?[ \t]*(?:\r?\n|$)", body)
        part.parts = [parse(p, depth + 1) for p, closing in zip(pieces[2::2], pieces[1::2], strict=False) if closing is None and strip(p.decode("latin-1"))]
        return part
    how = headers.get("content-transfer-encoding", "").lower()
    part.body = base64_lenient(body) if how == "base64" else quoted_printable(body) if how == "quoted-printable" else body
    return part


def _bare(s: str) -> str:
    return re.sub(r"[^\w]+", " ", s.replace("\\", "")).strip().lower()


def convert(data: bytes, options: Options) -> Output:
    message, out, w = parse(data), Output(), Writer()
    leaves = list(message.leaves())
    html = next((p for p in leaves if p.kind == "text/html" and not p.attached), None)
    plain = next((p for p in leaves if p.kind == "text/plain" and not p.attached), None)
    body = ""
    if html:
        body = to_markdown(html.text(), bullet=options.bullet, resolve=lambda u, kind: None if u.startswith("cid:") else u)["markdown"]
    if not strip(body) and plain:
        body = plain_to_markdown(plain.text(), options.bullet, options.keep_breaks)
    subject = encoded_words(message.headers.get("subject", ""))
    first = re.match(r"#{1,3} (.*)", body.lstrip())
    if subject and not (first and _bare(first[1]) == _bare(subject)):
        w.heading(1, escape_inline(subject))
    rows = [[k.title(), encoded_words(v)] for k in ("from", "to", "cc", "date") if (v := message.headers.get(k))]
    if rows:
        w.push(render_table([["Field", "Value"], *rows]))
    w.push(body)
    files = [p for p in leaves if p.attached]
    if files:
        w.heading(2, "Attachments")
        w.push("\n".join(f"{options.bullet} {escape_inline(p.filename or p.kind)}" for p in files))
    for name in ("subject", "from", "date"):
        if message.headers.get(name):
            out.meta["title" if name == "subject" else name] = encoded_words(message.headers[name])
    out.markdown = str(w)
    return out
