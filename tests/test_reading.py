"""Markdown as input, and the editor's commands in caret notation: | is a caret, [ and ] enclose a selection."""

import pytest

from foliospark.operators.tables import render_tables
from foliospark.parse import blocks, editing
from foliospark.plans import reading


def unmark(s):
    if "|" in s:
        at = s.index("|")
        return s.replace("|", "", 1), at, at
    a, b = s.index("["), s.index("]")
    return s[:a] + s[a + 1 : b] + s[b + 1 :], a, b - 1


def mark(e):
    return f"{e.text[: e.start]}|{e.text[e.start :]}" if e.start == e.end else f"{e.text[: e.start]}[{e.text[e.start : e.end]}]{e.text[e.end :]}"


@pytest.mark.parametrize(
    ("action", "before", "after"),
    [
        ("bold", "[hello] world", "**[hello]** world"), ("bold", "**[hello]** world", "[hello] world"), ("bold", "|", "**[bold text]**"), ("italic", "x [*y*]", "x [y]"),
        ("h2", "hello| world", "[## hello world]"), ("h2", "## hello| world", "[hello world]"), ("h1", "- an| item", "[# an item]"), ("number", "[one\ntwo\nthree]", "[1. one\n2. two\n3. three]"),
        ("bullet", "[one\n\ntwo]", "[- one\n\n- two]"), ("task", "- a|", "[- [ ] a]"), ("h3", "## Title|", "[### Title]"), ("bullet", "  some text|", "[  - some text]"),
        ("bullet", "|", "[- ]"), ("number", "|", "[1. ]"), ("quote", "|", "[> ]"), ("link", "[https://example.org]", "[[link text]](https://example.org)"), ("link", "[the protocol]", "[the protocol]([https://])"),
        ("rule", "text|", "text\n\n[---]\n"), ("enter", "- milk|", "- milk\n- |"), ("enter", "1. first\n2. second|", "1. first\n2. second\n3. |"), ("enter", "- milk\n- |", "- milk\n|"),
        ("enter", "> to be|", "> to be\n> |"), ("enter", "just words|", "just words\n|"), ("indent", "- one\n- two|", "- one\n[  - two]"), ("outdent", "  - two|", "[- two]"), ("indent", "text|", "text|"),
    ],
)
def test_commands(action, before, after):
    assert mark(editing.apply(action, *unmark(before))) == after


def test_task_lines():
    assert editing.apply("bullet", "- [ ] a", 7, 7).text == "- a" and editing.apply("enter", "- [ ] buy", 9, 9).text == "- [ ] buy\n- [ ] "


DOC = "---\na: b\n---\n\n# One\n\ntext\nmore\n\n> q\n> r\n\n| A | B\\|b |\n| :-- | --: |\n| 1 | 2 |\n\n- x\n  - [x] y\n\n---\n\n```py\ncode\n```\n"


def test_blocks():
    got = [(b["kind"], b["level"], b["info"], b["text"]) for b in blocks.blocks(DOC)]
    assert got == [("front", 0, "", "a: b"), ("heading", 1, "", "One"), ("paragraph", 0, "", "text\nmore"), ("quote", 0, "", "q\nr"), ("table", 2, "left,right", "| A | B\\|b |\n| 1 | 2 |"), ("list", 0, "bulleted", "- x\n  - [x] y"), ("rule", 0, "", ""), ("code", 0, "py", "code")]
    assert blocks.list_items("- x\n  - [x] y")[1] == {"depth": 1, "ordered": False, "task": True, "text": "y"}


def test_inline():
    got = [(x["kind"], x["text"], x["target"]) for x in blocks.inline("a \\*b\\* **c** [d](https://e.org) `f` ![g](javascript:x) <https://h.org>")]
    assert got == [("text", "a *b* ", None), ("bold", "c", None), ("text", " ", None), ("link", "d", "https://e.org"), ("text", " ", None), ("code", "f", None), ("text", " ", None), ("image", "g", None), ("text", " ", None), ("auto", "https://h.org", "https://h.org")]


def test_tables_round_trip(spark):
    docs = spark.createDataFrame([(1, "| A   | B\\|b |\n| --- | ---- |\n| 1   | 2    |")], "id int, markdown string")
    cells = reading.table_cells(reading.blocks(docs, "id"), "id")
    assert render_tables(cells, ["id", "n"]).first().markdown == docs.first().markdown


def test_edits_over_columns(spark):
    rows = spark.createDataFrame([("bold", "ab", 0, 1), ("none", "x", 0, 0)], "action string, text string, start int, `end` int")
    assert [(r.new_text, r.new_start, r.new_end) for r in reading.edited(rows).collect()] == [("**a**b", 2, 3), ("x", 0, 0)]
