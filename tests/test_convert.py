"""Documents of every format, built in memory, and what becomes of them."""
# ruff: noqa: E501

import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.parse.archive import Package, inflate, natural_key, resolve, write_zip
from foliospark.parse.convert import run
from foliospark.parse.decode import base64_lenient, decode, looks_textual, quoted_printable
from foliospark.parse.html import to_markdown
from foliospark.parse.markup import decode_entities, parse_html, parse_xml
from foliospark.parse.office import Options
from foliospark.parse.pdf import Item, _ascii85, _lzw, _predict, _run_lengths, lines_of, strip_running, to_unicode
from foliospark.parse.picture import dimensions
from foliospark.plans.convert import convert_files
from foliospark.sources.files import read_files
from foliospark.streaming.inbox import convert_inbox

W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:wp="wp"'


def package(parts):
    return write_zip([(k, v.encode()) for k, v in parts.items()])


def element(name, body="", **attributes):
    given = "".join(f' {k.replace("__", ":")}="{v}"' for k, v in attributes.items())
    return f"<{name}{given}>{body}</{name}>"


def para(*runs, **properties):
    return element("w:p", element("w:pPr", "".join(properties.values())) + "".join(runs))


def word_run(t, *marks):
    return element("w:r", element("w:rPr", "".join(f"<w:{m}/>" for m in marks)) + f'<w:t xml:space="preserve">{t}</w:t>')


STEP = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>'
LOG = para(word_run("Harbour log"), style='<w:pStyle w:val="Cover"/>') + para(word_run("Moorings"), style='<w:pStyle w:val="Part"/>')
LOG += para(word_run("The "), word_run("north quay", "i"), word_run(" holds "), word_run("12 boats", "b"), word_run(", see "), '<w:hyperlink r:id="map">' + word_run("the chart") + "</w:hyperlink>", '<w:r><w:footnoteReference w:id="9"/></w:r>')
LOG += para(word_run("Cast off"), number=STEP) + para(word_run("Hoist sail"), number=STEP)
LOG += "<w:tbl>" + "".join(element("w:tr", "".join(element("w:tc", para(c)) for c in row)) for row in ((word_run("Boat"), word_run("Crew")), (word_run("Gull"), word_run("2|3", "b")))) + "</w:tbl>"
DOCX = {
    "word/document.xml": f"<w:document {W}><w:body>{LOG}</w:body></w:document>",
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Cover"><w:name w:val="Title"/></w:style><w:style w:styleId="Part"><w:name w:val="heading 3"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="4"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="9">{para(word_run("Drawn in spring."))}</w:footnote></w:footnotes>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="map" Type="x" Target="https://charts.example/n" TargetMode="External"/></Relationships>',
}
TIDES = '<row r="1"><c r="A1" t="inlineStr"><is><t>Gauge</t></is></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="A4" t="s"><v>0</v></c><c r="B4"><v>3.25</v></c><c r="C4" s="2"><v>45000</v></c></row>'
XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Tides" sheetId="8" r:id="one"/><sheet name="Drafts" sheetId="9" state="hidden" r:id="two"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="two" Target="worksheets/b.xml"/><Relationship Id="one" Target="worksheets/a.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><r><t>Pier </t></r><r><t>west</t></r></si><si><t>Read on</t></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/a.xml": f"<worksheet><sheetData>{TIDES}</sheetData></worksheet>",
    "xl/worksheets/b.xml": "<worksheet/>",
}
KELP = '<text:h text:outline-level="3">Kelp survey</text:h><text:p>Thick <text:span text:style-name="strong">below</text:span> the ledge.</text:p><text:list><text:list-item><text:p>brown</text:p></text:list-item><text:list-item><text:p>red</text:p></text:list-item></text:list><table:table><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>m</text:p></table:table-cell><table:table-cell><text:p>n</text:p></table:table-cell></table:table-row></table:table>'
ODT = {
    "mimetype": "application/vnd.oasis.opendocument.text",
    "content.xml": f'<office:document-content xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:table="tb" xmlns:fo="f"><office:automatic-styles><style:style style:name="strong"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles><office:body><office:text>{KELP}</office:text></office:body></office:document-content>',
}
EPUB = {
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="in/list.opf"/></rootfiles></container>',
    "in/list.opf": '<package xmlns:dc="d"><metadata><dc:title>Two shores</dc:title></metadata><manifest><item id="w" href="west.xhtml" media-type="application/xhtml+xml"/><item id="e" href="east.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="e"/><itemref idref="w"/></spine></package>',
    "in/west.xhtml": "<html><body><h2>The west shore</h2><p>Sand.</p></body></html>",
    "in/east.xhtml": '<html><body><h2>The east shore</h2><p>Rock, see <a href="west.xhtml">there</a>.</p></body></html>',
}
SLIDE = "".join(f'<p:sp><p:nvSpPr><p:nvPr><p:ph {kind}/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>' for kind, body in (('type="title"', "<a:p><a:r><a:t>Lighthouse rota</a:t></a:r></a:p>"), ('idx="4"', '<a:p><a:r><a:t>Trim the lamp</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:rPr i="1"/><a:t>At dusk</a:t></a:r></a:p><a:p><a:r><a:t>Wind the clock</a:t></a:r></a:p>')))
PPTX = {
    "ppt/presentation.xml": '<p:presentation xmlns:r="r" xmlns:p="p"><p:sldIdLst><p:sldId id="280" r:id="s"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="s" Target="slides/rota.xml"/></Relationships>',
    "ppt/slides/rota.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{SLIDE}</p:spTree></p:cSld></p:sld>',
}
SHEET = zlib.compress(b"BT /Fat 20 Tf 50 740 Td (Ferry timetable) Tj ET BT /Thin 10 Tf 50 700 Td (Boats leave the quay at every full hour and) Tj 0 -12 Td (come back before the next one begins.) Tj 0 -28 Td (\\225 Dogs travel free) Tj 0 -12 Td [(Bicycles)-420(pay)] TJ ET")
PDF = b"%PDF-1.6\n11 0 obj<</Type/Catalog/Pages 12 0 R>>endobj\n12 0 obj<</Type/Pages/Kids[13 0 R]/Count 1>>endobj\n13 0 obj<</Type/Page/Parent 12 0 R/Contents 14 0 R/Resources<</Font<</Thin 15 0 R/Fat 16 0 R>>>>>>endobj\n"
PDF += b"14 0 obj<</Length %d/Filter/FlateDecode>>stream\n" % len(SHEET) + SHEET + b"\nendstream endobj\n15 0 obj<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>endobj\n16 0 obj<</Type/Font/Subtype/Type1/BaseFont/Courier-Bold>>endobj\n17 0 obj<</Title(Ferry)/Author(Quay office)/CreationDate(D:20230704081500Z)>>endobj\ntrailer<</Root 11 0 R/Info 17 0 R>>"
RTF = rb"""{\rtf1\ansi{\fonttbl{\f0 Serif;}}{\fs48 Net repairs\par}\pard Use {\i waxed} or {\b tarred} twine.\par{\pntext \bullet\tab}Mend first\par\pard No\'ebl pays \u8364?35. {\field{\*\fldinst HYPERLINK "https://nets.example"}{\fldrslt order}}\par\trowd\intbl K\cell L\cell\row}"""
EML = b"From: =?utf-8?Q?Skipper_Bo?= <bo@sea.example>\r\nSubject: =?utf-8?B?U3Rvcm0gd2FybmluZw==?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=\"cut\"\r\n\r\n--cut\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<h1>Storm warning</h1><p>Stay <i>in</i> port =E2=80=93 all day</p>\r\n--cut\r\nContent-Type: text/plain\r\n\r\nstay in port\r\n--cut--\r\n"


def text(name, data, **options):
    got = run(name, data, Options(**options))
    assert got["error"] is None, got["error"]
    return got["markdown"]


def test_word():
    md = text("a.docx", package(DOCX))
    for part in ("# Harbour log", "### Moorings", "The *north quay* holds **12 boats**, see [the chart](https://charts.example/n)[^fn1]", "4. Cast off\n5. Hoist sail", "| Boat | Crew     |", "| Gull | **2\\|3** |", "[^fn1]: Drawn in spring."):
        assert part in md


def test_spreadsheet():
    md = text("b.xlsx", package(XLSX))
    for part in ("## Tides", "| Gauge     |      | Read on    |", "| Pier west | 3.25 | 2023-03-15 |", "## Drafts (hidden)", "_Empty sheet._"):
        assert part in md


def test_slides():
    assert text("l.pptx", package(PPTX)) == "## Lighthouse rota\n\n- Trim the lamp\n  - *At dusk*\n- Wind the clock\n"


def test_open_document():
    assert text("j.odt", package(ODT)) == "### Kelp survey\n\nThick **below** the ledge.\n\n- brown\n- red\n\n|     |     |     |\n| --- | --- | --- |\n| m   | m   | n   |\n"


def test_e_book():
    md = text("k.epub", package(EPUB))
    assert md.index("The east shore") < md.index("---") < md.index("The west shore")


def test_pdf():
    got = run("c.pdf", PDF, Options())
    assert got["markdown"] == "# Ferry timetable\n\nBoats leave the quay at every full hour and come back before the next one begins.\n\n- Dogs travel free\n\nBicycles pay\n"
    assert got["meta"] == {"title": "Ferry", "author": "Quay office", "created": "2023-07-04 08:15:00", "pages": "1"}


def test_rich_text():
    md = text("d.rtf", RTF)
    for part in ("# Net repairs", "Use *waxed* or **tarred** twine.", "- Mend first", "Noël pays €35. [order](https://nets.example)", "| K   | L   |"):
        assert part in md


def test_mail():
    md = text("e.eml", EML)
    assert md.count("Storm warning") == 1 and "Skipper Bo \\<bo@sea.example\\>" in md and "Stay *in* port – all day" in md


@pytest.mark.parametrize(
    ("name", "data", "part"),
    [
        ("f.csv", b'boat;berth;n\nGull;"quay, north";1\nTern;y;22%\n;;\n', "| Gull | quay, north | 1   |"),
        ("g.txt", b"INTRODUCTION\n\nSome text\nover lines.\n", "## INTRODUCTION\n\nSome text over lines."),
        ("h.json", b'[{"a":1,"b":null},{"b":"x|y","c":2.0}]', "|     | x\\|y | 2   |"),
        ("h.jsonl", b'{"a":1}\nbroken\n{"a":true}\n', "| true |"),
        ("i.srt", b"1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\nworld\n", "**00:00:01.000 → 00:00:02.000**  \nHello world"),
        ("x.py", b"print(1)\n", "```python\nprint(1)\n```"),
        ("q.png", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03", "![q](data:image/png;base64,"),
    ],
)
def test_others(name, data, part):
    assert part in text(name, data)


@pytest.mark.parametrize(("name", "data", "part"), [("m.doc", b"\xd0\xcf\x11\xe0xx", "before 2007"), ("n.gdoc", b"{}", "Word"), ("o.bin", b"\0\1\2", "No known format"), ("p.zip", package({"a": "b"}), "no known kind"), ("q.pdf", b"%PDF-1.4", "no text"), ("r.docx", b"PK\x03\x04 damaged", "is damaged")])
def test_refused(name, data, part):
    assert part in run(name, data, Options())["error"]


@pytest.mark.parametrize(
    ("html", "md"),
    [
        ("<ul><li>one<li>two</ul><p>tail", "- one\n- two\n\ntail\n"),
        ("<ul><li><input type=checkbox checked> do<ul><li>n</ul></ul>", "- [x] do\n  - n\n"),
        ('<style>.c1{font-weight:700}</style><p>At: <span class="c1">Am</span>, S.</p>', "At: **Am**, S.\n"),
        ("<p>a<br>b</p><blockquote><p>q</p><p>r</p></blockquote>", "a  \nb\n\n> q\n>\n> r\n"),
        ('<pre><code class="language-bash">ls\n</code></pre>', "```bash\nls\n```\n"),
        ("<table><tr><td>1<td>2</table>", "|     |     |\n| --- | --- |\n| 1   | 2   |\n"),
        ('<ol start="3"><li>a<li>b</ol><dl><dt>t</dt><dd>d</dd></dl><hr>', "3. a\n4. b\n\n**t**\n\n: d\n\n---\n"),
        ("<p>1. x</p><nav>gone</nav><p><a href='#'></a><a href='u'>  l </a></p>", "1\\. x\n\n[l](u)\n".replace("1\\. x", "\\1. x")),
    ],
)
def test_html(html, md):
    assert to_markdown(html)["markdown"] == md


def test_markup():
    root = parse_xml('<w:p a:space="x">a &amp; b<![CDATA[<c>]]></w:p>')
    assert root.first("p").attr("space") == "x" and root.text() == "a & b<c>" and root.first("w:p") and not root.first("x:p")
    assert decode_entities("&#65;&#x42;&nbsp;&nope;&shy;") == "AB\u00a0&nope;"
    assert len(parse_html("<p>" + "<b>" * 5000 + "x").text()) == 1
    assert parse_html("a < b <script>if (x</p) y</script>z").text().startswith("a < b ")


def test_codecs():
    assert decode(b"\xef\xbb\xbfx") == ("x", "utf-8") and decode(b"\xff\xfea\0b") == ("a", "utf-16le")
    assert decode(b"caf\xe9") == ("café", "windows-1252") and decode(b"\x81")[0] == "\x81" and decode(b"x", "ISO-8859-1")[1] == "iso-8859-1"
    assert quoted_printable(b"a=\r\nb=e9=4G=zz") == b"ab\xe9\x04=zz" and base64_lenient(b"aGk=!\n") == b"hi"
    assert looks_textual(b"abc") and not looks_textual(b"a\0")
    assert inflate(zlib.compress(b"x" * 40000)) == b"x" * 40000
    assert sorted(["a10", "a2"], key=natural_key) == ["a2", "a10"] and resolve("word", "../a/./b") == "a/b"
    p = Package(write_zip([("a.txt", b"1"), ("a.txt", b"2")]))
    assert p.read("a.txt") == b"2" and p.read("none") is None
    assert _ascii85(b"87cURD]j7BEbo80~>") == b"Hello world!" and _run_lengths(b"\x02abc\xfed\x80") == b"abcddd"
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == b"-----A---B"
    assert _predict(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"
    assert to_unicode(b"1 beginbfrange <01> <04> <0041> endbfrange") == {1: "A", 2: "B", 3: "C", 4: "D"}
    assert dimensions(b"GIF89a\x02\0\x03\0") == (2, 3) and dimensions(b'<svg width="10" height="20">') == (10, 20)


def test_running_lines_go():
    item = lambda y, t: Item(50, y, 40, 10, t, False, False)
    pages = [lines_of([item(780, f"Header {n}"), item(700, f"body {c} one"), item(680, f"body {c} two"), item(660, f"x{c}"), item(20, f"{n}")]) for n, c in enumerate("abc")]
    strip_running(pages)
    assert [[x.text for x in p] for p in pages] == [[f"body {c} one", f"body {c} two", f"x{c}"] for c in "abc"]


def test_files_as_rows(spark, tmp_path):
    for name, data in (("a.docx", package(DOCX)), ("b.csv", b"x,y\n1,2\n"), ("c.bin", b"\0\0"), ("d.gdoc", b"{}")):
        (tmp_path / name).write_bytes(data)
    rows = {r.name: r for r in convert_files(read_files(spark, str(tmp_path)), moment="2024-01-15").collect()}
    assert len(rows) == 4 and rows["a.docx"].format == "docx" and rows["c.bin"].error and rows["d.gdoc"].error
    assert rows["a.docx"].document.startswith("---\ntitle: a\nsource_file: a.docx\nsource_format: Word (.docx)\nconverted: 2024-01-15\n---\n\n# Harbour log")
    assert rows["b.csv"].output_name == "b.md"


def test_inbox_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    go = lambda: convert_inbox(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    (inbox / "a.txt").write_text("one\n")
    go()
    (inbox / "b.txt").write_text("two\n")
    go()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("name")).collect()) == ["a.txt", "b.txt"]
