"""The column functions and the parsers' helpers agree, and undo or repeat themselves where they should."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import markdown as md
from foliospark.operators import library, plain_text, tables
from foliospark.parse import plain, text
from foliospark.parse.delimited import parse_delimited, sniff

SAMPLES = ["", "a*b_c [x] <y> `z` |p| \\", "- item", "  + x", "1. one", "12) two", "# no", "a  \nb   \n\n\n\nc\t\n", "  x   y ", "\r\na\r\rb\n", "```\ncode\n```\n![a](b) word's über-all", "data:xx", "u (1)>", "true", "12.5", "a: b", "line\nline", "x" * 130 + ".md", "a/b:c", "INTRO\n\ntext\nmore\n- a\n- b\n1. c\nTitle\n=====\nx\n---\ny", "Chapter 1\nfoo\n\nCAPS HERE", "===\n===\n===\nq"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id int, text string").repartition(1).cache()


@pytest.mark.parametrize("pair", [(md.escape_inline, text.escape_inline), (md.escape_block, text.escape_block), (md.collapse_spaces, text.collapse), (md.encode_href, text.href), (md.normalize, text.normalize), (md.code_block, text.code_block), (md.trim, text.strip)], ids=lambda p: p[0].__name__)
def test_column_and_python_agree(samples, pair):
    native, python = pair
    for row in samples.select("text", native("text").alias("x")).collect():
        assert row.x == python(row.text)


def test_plain_text_natively_and_in_python(spark, samples):
    got = {r.doc_id: r.markdown for r in plain_text.to_markdown(samples).collect()}
    assert got == {i: plain.plain_to_markdown(t) for i, t in enumerate(SAMPLES)}


def test_plain_text_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert {r.markdown for r in plain_text.to_markdown(rows).collect()} == {""}
    assert plain_text.to_markdown(rows.where("1 = 0")).count() == 0


def test_counts_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(md.count_words(F.lit("# Title\n\nTwo words here."))) == 4
    assert one(md.count_words(F.lit("a b\n```\nx y z\n```"))) == 2
    assert one(md.library_name(F.lit("  a/b:c  "))) == "abc.md"
    assert one(md.library_name(F.lit("???"))) == "Untitled.md"
    assert one(md.title_from_name(F.lit("my_file--name.tar.gz"))) == "my file name.tar"
    assert one(md.output_name(F.lit(".txt"))) == "document.md"
    assert one(md.extension(F.lit("Makefile"))) == "makefile"
    assert one(md.excel_serial(F.lit(45306.5))) == "2024-01-15 12:00:00"
    assert one(md.column_index(F.lit("AB12"))) == 27
    assert one(md.normalize_part(F.lit("/word/../a/./b"))) == "a/b"
    assert one(md.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(md.split_front_matter(F.lit("---\na: b\n---\n\nbody"))).asDict() == {"front": "---\na: b\n---\n", "body": "body"}
    assert one(md.front_matter(F.array(F.struct(F.lit("k").alias("k"), F.lit("yes").alias("v"))))) == '---\nk: "yes"\n---'
    assert one(plain_text.subtitles(F.lit("1\n00:01,0 --> 00:02,0\n<i>Hi</i>\n"))) == "**00:01.0 → 00:02.0**  \nHi\n"


def test_natural_order(spark):
    names = ["slide10.xml", "slide2.xml", "slide1.xml", "a"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(md.natural_key("n"))
    assert [r.n for r in rows.collect()] == ["a", "slide1.xml", "slide2.xml", "slide10.xml"]


def test_names_that_differ(spark):
    rows = [(1, "X.md"), (2, "x.md"), (3, "X 2.md"), (4, "X.md"), (5, "y.md")]
    got = {r.id: r.unique_name for r in library.unique_names(spark.createDataFrame(rows, "id int, name string"), "name", "id").collect()}
    assert got == {1: "X.md", 2: "x 3.md", 3: "X 2.md", 4: "X 4.md", 5: "y.md"}


def test_library_changes(spark):
    docs = spark.createDataFrame([("a", "A.md", "x y", 1), ("b", "B.md", "z", 2), ("c", None, "z", 3)], "id string, name string, markdown string, updated long")
    changes = spark.createDataFrame([("a", "rename", "AA.md", None, 5), ("b", "delete", None, None, 6), ("q", "rename", "Q.md", None, 7)], "id string, op string, name string, markdown string, updated long")
    assert [(r.id, r.words) for r in library.listing(docs).collect()] == [("b", 1), ("a", 2)]
    got = {r.id: (r.name, r.markdown) for r in library.apply_changes(docs.where("name is not null"), changes).collect()}
    assert got == {"a": ("AA.md", "x y")}
    taken = spark.createDataFrame([("a", "rename", "b.MD", None, 5), ("n", "save", "B", "w", 9)], "id string, op string, name string, markdown string, updated long")
    got = {r.id: r.name for r in library.apply_changes(docs.where("name is not null"), taken).collect()}
    assert got == {"b": "B.md", "a": "b 2.md", "n": "B 3.md"}
    assert [r.markdown for r in library.read(docs, "a").collect()] == ["x y"] and not library.read(docs, "c").collect()
    new = library.created(spark.createDataFrame([("n", None, 4), ("m", "Tide", 5)], "id string, name string, updated long"))
    assert {(r.name, r.markdown) for r in library.apply_changes(docs.where("1 = 0"), new).collect()} == {("Untitled.md", "# Untitled\n\n"), ("Tide.md", "# Tide\n\n")}


def test_small_functions(spark):
    got = [r.s for r in spark.createDataFrame([(1,), (1499,), (1500,), (2_345_000,)], "n long").select(md.describe_size("n").alias("s")).collect()]
    assert got == ["1 KB", "1 KB", "2 KB", "2.3 MB"]
    from foliospark.parse.blocks import inline
    from foliospark.parse.html import editable_to_markdown
    from foliospark.parse.markup import parse_html

    assert [(p["kind"], p["text"]) for p in inline("x<sup>2</sup> H<sub>2</sub>O<br/>end")] == [("text", "x"), ("sup", "2"), ("text", " H"), ("sub", "2"), ("text", "O"), ("br", "\n"), ("text", "end")]
    assert editable_to_markdown("<p>a\u00a0 b&nbsp;c</p>").strip() == "a b c"
    root = parse_html("<div><ul><li>x</li></ul></div>")
    assert root.path_to(root.first("li")).endswith("div/ul/li") and root.path_to(parse_html("<p>y</p>")) == ""


def test_one_document_is_given_as_it_is(spark):
    from foliospark.sources import sinks

    one = spark.createDataFrame([("a.md", "a.txt", "text"), ("b.md", "b.txt", None)], "output_name string, name string, document string")
    assert [(r.name, bytes(r.content)) for r in sinks.exported(one).collect()] == [("a.md", b"text")]
    assert all(r.name.endswith(".zip") for r in sinks.exported(one.fillna("x")).collect())


def test_tables_natively_and_in_python(spark):
    grid = [["Name", "V|x"], ["a", "1"], ["b\nc", "22%"], ["d"]]
    cells = spark.createDataFrame([(1, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "k int, row int, col int, value string")
    got = tables.render_tables(cells, ["k"], tables.infer_alignment(cells, ["k"])).first().markdown
    assert got == text.render_table(grid, {1})
    assert "| ------ | ---: |" in got and "b<br>c" in got


def test_delimited():
    assert sniff("a;b;c\n1;2;3") == ";"
    assert parse_delimited('a,"b,c",d\n', ",") == [["a", "b,c", "d"]]
    assert parse_delimited('"a ""q"" b"x,\r\n\n1', ",") == [['a "q" bx', ""], [""], ["1"]]


@given(st.text(max_size=60))
def test_escape_and_back(s):
    assert re.sub(r"\\([\\`*_\[\]<>|])", r"\1", text.escape_inline(s)) == s


@given(st.text(alphabet=" \t\nab", max_size=40))
def test_normalize_settles(s):
    assert text.normalize(text.normalize(s)) == text.normalize(s)


@given(st.lists(st.lists(st.text(alphabet='ab",;\n', max_size=6), min_size=1, max_size=4), min_size=1, max_size=5))
def test_delimited_round_trip(rows):
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert parse_delimited(out.getvalue(), ",") == rows


def test_long_numbers_count_as_taken(spark):
    rows = [(0, "page-1500.md"), (1, "page-99999999999999999999.md"), *((i, "page.md") for i in range(2, 1602))]
    got = [r.unique_name for r in library.unique_names(spark.createDataFrame(rows, "id int, name string"), "name", "id", spaced=False).collect()]
    assert len(set(got)) == len(got) and "page-1499.md" in got and "page-1501.md" in got


def test_sizes_round_like_printf(spark):
    """The binary value of a quotient is rounded (1.15 is a little less, 1.35 a little more), exact halves to the even digit."""
    n = [1_000_000, 1_050_000, 1_150_000, 1_250_000, 1_350_000, 1_750_000, 2_949_999, 9_950_000, 12_250_000, 12_345_678_950_000, *range(1_050_000, 20_000_000, 100_000)]
    got = [r.s for r in spark.createDataFrame([(x,) for x in n], "n long").select(md.describe_size("n").alias("s")).collect()]
    assert got == [f"{x / 1_000_000:.1f} MB" for x in n]
