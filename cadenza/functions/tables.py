"""Tables of web pages as rows, from the stream of their tags.

Pages may leave cells and rows open, and put tables into cells.  A cell ends at the next cell of
its own row, a row at the next row of its own table, and both where their table ends; text belongs
to the innermost open cell.  What stands outside all rows is kept too, in page order, as it may
name what the next table is about.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A comment, a declaration, a tag with its attributes (quoted ones may hold ">"), or text.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+|<)""", re.S)
_HREF = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SILENT = ("script", "style", "title")

#: Pages whose events a worker holds at once.
PAGES = 16
ROWS = "n int, kind string, depth int, cells array<struct<text: string, href: string>>"


def _plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


class _Page:
    """Events in page order: text and link outside rows, row, and end (of a table)."""

    def __init__(self):
        self.events: list[tuple[str, int, list]] = []
        self.rows: list[dict] = []  # open rows, the innermost last
        self.depth = 0
        self.link: dict | None = None  # a link outside all rows
        self.loose: list[str] = []

    def read(self, page: str) -> list[tuple[str, int, list]]:
        at = 0
        while at < len(page):
            token = _TOKEN.match(page, at)
            if token is None:  # a lone "<" of a tag that never ends
                self.data(page[at])
                at += 1
                continue
            at = token.end()
            name = (token["name"] or "").lower()
            if token["text"] is not None:
                self.data(token["text"])
            elif name in _SILENT and not token["close"]:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name:
                (self.closed if token["close"] else self.opened)(name, token["rest"] or "")
        self.ended(0)
        self.flush()
        return self.events

    def cell(self) -> dict | None:
        return self.rows[-1]["cell"] if self.rows else None

    def data(self, text: str) -> None:
        cell = self.cell()
        if cell is not None:
            cell["text"].append(text)
        elif not self.rows:
            (self.link["text"] if self.link else self.loose).append(text)

    def flush(self) -> None:
        text = _plain(self.loose)
        self.loose = []
        if text:
            self.events.append(("text", self.depth, [(text, None)]))

    def opened(self, name: str, rest: str) -> None:
        cell = self.cell()
        if name == "table":
            if cell is not None:
                # what a layout cell says before its table is no part of a row
                self.loose, cell["text"] = cell["text"], []
            self.flush()
            self.depth += 1
        elif name == "tr":
            self.flush()
            self.ended(self.depth)
            self.rows.append({"depth": self.depth, "cells": [], "cell": None})
        elif name in ("td", "th") and self.rows:
            self.cell_ended(self.rows[-1])
            self.rows[-1]["cell"] = {"text": [], "href": None}
        elif name == "a" and (href := _HREF.search(rest)):
            link = html.unescape(next(x for x in href.groups() if x is not None))
            if cell is not None:
                cell["href"] = cell["href"] or link
            elif not self.rows:
                self.flush()
                self.link = {"href": link, "text": []}
        elif cell is not None and name in ("br", "p", "div", "li"):
            cell["text"].append(" ")
        elif not self.rows and name in ("br", "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "hr"):
            self.flush()

    def closed(self, name: str, rest: str) -> None:
        if name in ("td", "th") and self.rows:
            self.cell_ended(self.rows[-1])
        elif name == "tr" and self.rows and self.rows[-1]["depth"] == self.depth:
            self.ended(self.depth)
        elif name == "table":
            self.ended(self.depth)
            self.depth = max(0, self.depth - 1)
            self.events.append(("end", self.depth, []))
        elif name == "a" and self.link is not None:
            self.events.append(("link", self.depth, [(_plain(self.link["text"]), self.link["href"])]))
            self.link = None
        elif not self.rows and name in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()

    def cell_ended(self, row: dict) -> None:
        if row["cell"] is not None:
            row["cells"].append((_plain(row["cell"]["text"]), row["cell"]["href"]))
            row["cell"] = None

    def ended(self, depth: int) -> None:
        """All open rows of tables at this depth and deeper end."""
        while self.rows and self.rows[-1]["depth"] >= depth:
            row = self.rows.pop()
            self.cell_ended(row)
            if row["cells"]:
                self.events.append(("row", row["depth"], row["cells"]))


def page_rows(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, n (place in the page), kind (text, link, row, end), depth (of the table) and cells (text, href): one row per event.

    Null and empty pages give no rows.  Pages are read and given on a few at a time: a worker holds the events of ``PAGES`` pages.
    """
    conf = pages.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        if int(conf.get(name).rstrip("b")) > most:
            conf.set(name, str(most))
    key_type = pages.schema[key].dataType.simpleString()
    cell = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(lo, PAGES) for batch in batches for lo in range(0, batch.num_rows, PAGES)):
            found = [(i, n, *event) for i, text in enumerate(batch.column(1).to_pylist()) if text for n, event in enumerate(_Page().read(text))]
            of, number, kind, depth, cells = zip(*found) if found else ([],) * 5
            arrays = [
                batch.column(0).take(pa.array(of, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(kind, pa.string()),
                pa.array(depth, pa.int32()),
                pa.array([[{"text": t, "href": h} for t, h in c] for c in cells], cell),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n", "kind", "depth", "cells"])

    return pages.select(key, page).mapInArrow(run, f"`{key}` {key_type}, {ROWS}")
