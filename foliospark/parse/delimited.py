"""Delimited text: the delimiter, the rows, which columns are numbers."""

from __future__ import annotations

import re

DELIMITERS = (",", ";", "\t", "|")


def parse_delimited(text: str, delimiter: str) -> list[list[str]]:
    """Rows of fields. A quote opens a field only where nothing but blanks came before; ragged rows stay ragged."""
    rows, row, field = [], [], []
    i, n = (1 if text.startswith("﻿") else 0), len(text)
    while i < n:
        c = text[i]
        if c == '"' and not "".join(field).strip():
            field = []
            while True:  # to the closing quote
                j = text.find('"', i + 1)
                if j < 0:
                    field.append(text[i + 1 :])
                    i = n
                    break
                field.append(text[i + 1 : j])
                if text[j + 1 : j + 2] == '"':
                    field.append('"')
                    i = j + 1
                    continue
                i = j + 1
                break
            if field and "".join(field).strip() == "":
                field = ["".join(field)]
            while i < n and text[i] not in (delimiter, "\n", "\r"):  # what follows is appended
                field.append(text[i])
                i += 1
            continue
        if c == delimiter:
            row.append("".join(field))
            field = []
        elif c in "\r\n":
            i += text[i : i + 2] == "\r\n"
            row.append("".join(field))
            rows.append(row)
            row, field = [], []
        else:
            field.append(c)
        i += 1
    if field or row:
        row.append("".join(field))
        rows.append(row)
    return rows


def sniff(text: str) -> str:
    lines = [re.sub(r'"(?:[^"]|"")*("|$)', "", x) for x in re.split("\r?\n", text[:8192])[:20]]
    best, top = ",", -1.0
    for d in DELIMITERS:
        counts = [n for x in lines if (n := x.count(d))]
        if counts:
            mean = sum(counts) / len(counts)
            score = mean * len(counts) - 2 * sum((n - mean) ** 2 for n in counts) / len(counts)
            if score > top:
                best, top = d, score
    return best


def alignment(rows: list[list[str]]) -> set[int]:
    """Columns of the header whose filled cells below are all numbers."""
    out = set()
    for c in range(len(rows[0]) if len(rows) > 1 else 0):
        filled = [x for r in rows[1:] if c < len(r) and (x := r[c].strip())]
        if filled and all(re.fullmatch(r"[-+]?[0-9.,]+%?", x) and re.search("[0-9]", x) for x in filled):
            out.add(c)
    return out
