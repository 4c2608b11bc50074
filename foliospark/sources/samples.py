"""Small documents of each container format, made of a heading, lines of text and a table: for queries and tests that compare what comes out."""

from __future__ import annotations

import zlib
from html import escape

from foliospark.parse.archive import write_zip


def _zip(parts: dict[str, str]) -> bytes:
    return write_zip([(name, text.encode()) for name, text in parts.items()])


def docx(heading: str, lines: list[str], table: list[list[str]]) -> bytes:
    """A heading of the first level, a numbered list, a table with a header row."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    title = f'<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr>{run(heading)}</w:p>'
    items = "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="7"/></w:numPr></w:pPr>{run(x)}</w:p>' for x in lines)
    cells = "".join(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if not i else ''}{''.join(f'<w:tc><w:p>{run(c)}</w:p></w:tc>' for c in row)}</w:tr>" for i, row in enumerate(table))
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return _zip(
        {
            "word/document.xml": f"<w:document {spaces}><w:body>{title}{items}<w:tbl>{cells}</w:tbl></w:body></w:document>",
            "word/styles.xml": f'<w:styles {spaces}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:numbering {spaces}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num></w:numbering>',
        }
    )


def xlsx(sheet: str, table: list[list[str]]) -> bytes:
    """One sheet; cells of digits alone are numbers, others shared strings."""
    strings: list[str] = []

    def cell(row: int, column: int, value: str) -> str:
        place = f"{chr(65 + column)}{row + 1}"
        if value.isdigit():
            return f'<c r="{place}"><v>{value}</v></c>'
        if value not in strings:
            strings.append(value)
        return f'<c r="{place}" t="s"><v>{strings.index(value)}</v></c>'

    rows = "".join(f'<row r="{i + 1}">{"".join(cell(i, k, v) for k, v in enumerate(row))}</row>' for i, row in enumerate(table))
    return _zip(
        {
            "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="{escape(sheet)}" sheetId="4" r:id="s4"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="s4" Target="worksheets/only.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst>{''.join(f'<si><t>{escape(s)}</t></si>' for s in strings)}</sst>",
            "xl/worksheets/only.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
        }
    )


def pptx(title: str, lines: list[str]) -> bytes:
    """One slide: a title and bullets, every second one a level deeper."""
    shape = lambda kind, body: f'<p:sp><p:nvSpPr><p:nvPr><p:ph {kind}/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    text = lambda t, level: f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{escape(t)}</a:t></a:r></a:p>'
    shapes = shape('type="title"', text(title, 0)) + shape('idx="1"', "".join(text(t, i % 2) for i, t in enumerate(lines)))
    return _zip(
        {
            "ppt/presentation.xml": '<p:presentation xmlns:r="r" xmlns:p="p"><p:sldIdLst><p:sldId id="300" r:id="r9"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r9" Target="slides/first.xml"/></Relationships>',
            "ppt/slides/first.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>',
        }
    )


def odt(heading: str, lines: list[str], table: list[list[str]]) -> bytes:
    """A heading of the second level, a list, a table."""
    items = "".join(f"<text:list-item><text:p>{escape(t)}</text:p></text:list-item>" for t in lines)
    cells = "".join(f"<table:table-row>{''.join(f'<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>' for c in row)}</table:table-row>" for row in table)
    body = f'<text:h text:outline-level="2">{escape(heading)}</text:h><text:list>{items}</text:list><table:table>{cells}</table:table>'
    spaces = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content {spaces}><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def epub(title: str, chapters: list[str]) -> bytes:
    """A chapter for each line, the line as its heading, in the reverse order of the files."""
    names = [f"part{len(chapters) - i}.xhtml" for i in range(len(chapters))]
    manifest = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    parts = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/list.opf"/></rootfiles></container>',
        "book/list.opf": f'<package xmlns:dc="d"><metadata><dc:title>{escape(title)}</dc:title></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>',
    }
    return _zip(parts | {f"book/{n}": f"<html><body><h1>{escape(c)}</h1><p>About <em>{escape(c.lower())}</em></p></body></html>" for n, c in zip(names, chapters, strict=True)})


def rtf(heading: str, lines: list[str]) -> bytes:
    """A large first paragraph, then plain ones; the first word of each is bold."""
    body = "".join(rf"{{\b {t.split(' ', 1)[0]}}} {t.partition(' ')[2]}\par " for t in lines)
    return rf"{{\rtf1\ansi{{\fonttbl{{\f0 Serif;}}}}{{\fs48 {heading}\par}}\pard {body}}}".encode("ascii")


def eml(subject: str, sender: str, lines: list[str]) -> bytes:
    """An HTML mail in base64 with an encoded subject."""
    import base64

    html = "<ul>" + "".join(f"<li>{escape(t)}</li>" for t in lines) + "</ul>"
    word = base64.b64encode(subject.encode()).decode()
    head = [f"From: {sender}", f"Subject: =?utf-8?B?{word}?=", "MIME-Version: 1.0", "Content-Type: text/html; charset=utf-8", "Content-Transfer-Encoding: base64"]
    return "\r\n".join([*head, "", base64.encodebytes(html.encode()).decode().replace("\n", "\r\n")]).encode()


def pdf(heading: str, lines: list[str], encrypt=None) -> bytes:
    """One compressed page: a large bold heading and paragraphs apart from each other. encrypt: gives object number and bytes as they are to be stored, and the dictionary."""
    show = lambda t: t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    text = f"BT /B 22 Tf 60 700 Td ({show(heading)}) Tj ET BT /R 11 Tf 60 660 Td " + " 0 -40 Td ".join(f"({show(t)}) Tj" for t in lines) + " ET"
    stream = zlib.compress(text.encode("cp1252"))
    extra = ""
    if encrypt:
        stream, extra = encrypt(stream)
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</R 5 0 R/B 6 0 R>>>>>>",
        b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(stream), stream),
        b"<</Type/Font/Subtype/Type1/BaseFont/Times-Roman/Encoding/WinAnsiEncoding>>",
        b"<</Type/Font/Subtype/Type1/BaseFont/Times-Bold/Encoding/WinAnsiEncoding>>",
    ]
    body = b"".join(b"%d 0 obj%s endobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.5\n" + body + b"trailer<</Root 1 0 R" + extra.encode("latin-1") + b">>"
