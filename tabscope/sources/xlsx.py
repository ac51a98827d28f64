"""One sheet of an Excel workbook, read with the standard library."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = set()
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.I):
            own.add(int(f.get("numFmtId")))
    styles = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def moment(serial: float, from_1904: bool) -> object:
    """A day number as date and time; below one day as HH:mm:ss text."""
    if 0 <= serial < 1:
        return (datetime(1970, 1, 1) + timedelta(seconds=round(serial * 86400))).strftime("%H:%M:%S")
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    return start + timedelta(microseconds=round(serial * 86_400_000_000 / 1000) * 1000)


def cell_value(cell, shared: list[str], dates: set[int], from_1904: bool) -> object:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return text_of(cell)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind == "e":
        return None
    if kind in ("str", "d"):
        return value.text
    number = float(value.text)
    if int(cell.get("s", 0)) in dates:
        return moment(number, from_1904)
    return int(number) if number == int(number) and "." not in value.text and "E" not in value.text.upper() else number


def read_sheet(payload: bytes, sheet: int | str = 0) -> list[list[object]]:
    """Rows of a sheet, by number or name, padded to the same width."""
    with zipfile.ZipFile(BytesIO(payload)) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(LINK)]) for s in root.iter(f"{MAIN}sheet")]
        found = [t for k, (name, t) in enumerate(sheets) if sheet in (k, name)]
        if not found:
            raise ValueError(f"Worksheet {sheet!r} not found.")
        target = found[0].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        properties = root.find(f"{MAIN}workbookPr")
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        dates = date_styles(book)
        rows: list[list[object]] = []
        for row in ElementTree.fromstring(book.read(path)).iter(f"{MAIN}row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at + 1 - len(rows))]
            for k, cell in enumerate(row.iter(f"{MAIN}c")):
                place = column_number(cell.get("r")) if cell.get("r") else k
                rows[at] += [None] * (place + 1 - len(rows[at]))
                rows[at][place] = cell_value(cell, shared, dates, from_1904)
    width = max((len(r) for r in rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]
