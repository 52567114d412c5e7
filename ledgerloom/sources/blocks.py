"""Pages of HTML as blocks of text and tables, in reading order.

One pass over the tags: a block tag ends the paragraph before it, a table becomes one block of cells. Pages are read
where they lie; what is held is one page at a time. The cells of all tables are then read as labelled lines by
`operators.cells`, which is where tables are understood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.cells import lines
from ledgerloom.storage import cut

# Tags that end a paragraph, and tags without visible text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section ul".split())
HIDDEN_TAGS = frozenset(("script", "style", "title", "noscript", "ix:header"))
#: Of these, what hides nothing if it is never closed: the page is read again with it shown.
_REOPENED = frozenset(("title", "noscript", "ix:header"))
# A bullet, a number or a letter that stands alone belongs to the paragraph after it.
MARKER = re.compile(r"[•●▪■◦·–o]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.)]")
_SPACE = re.compile(r"[ \t\r\n\f]+")  # no-break spaces stay
_ROWS = 256
# What sets a text in from the left of its cell, and points for each unit.
_INDENT = re.compile(r"(?:^|[;\s])(?:padding-left|margin-left|text-indent|left)\s*:\s*(-?[\d.]+)(in|pt|px|em|%)?")
_PADDING = re.compile(r"(?:^|[;\s])padding\s*:\s*([^;]+)")
_LENGTH = re.compile(r"^(-?\d*\.?\d+)(in|pt|px|em|%)?$")
_POINTS = {"in": 72.0, "px": 0.75, "em": 10.0, "%": 5.0}


def _count(value: str | None, otherwise: int, least: int = 1, most: int = 65534) -> int:
    """An attribute that counts; anything but digits counts as absent."""
    return min(max(int(value), least), most) if value and value.isascii() and value.isdigit() and len(value) < 9 else otherwise


def _indent(style: str | None) -> float:
    """How far, in points, a style sets a text in."""
    found = [m.groups() for m in _INDENT.finditer(style or "")]
    for m in _PADDING.finditer(style or ""):
        sides = m[1].split()
        left = _LENGTH.match(sides[3 if len(sides) == 4 else 1 if len(sides) > 1 else 0]) if sides else None
        found += [left.groups()] if left else []
    return sum(float(v) * _POINTS.get(unit, 1.0) for v, unit in found if v.strip("-.").replace(".", "", 1).isdigit())


class _Reader(HTMLParser):
    def __init__(self, hidden: frozenset[str] = HIDDEN_TAGS):
        super().__init__(convert_charrefs=True)
        self.hides = hidden
        self.blocks: list[tuple[str, str | None, list | None]] = []
        self.pieces, self.links, self.lists, self.hidden = [], [], [], []
        self.tables, self.rows = 0, []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.append(tag)
            return
        at = dict(attrs)
        if tag in self.hides:
            self.hidden.append(tag)
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self._end()
                self.rows = []
        elif self.tables:
            if self.tables == 1 and tag == "tr":
                self.rows.append([])
            elif self.tables == 1 and tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                # HTML's own limits; a rowspan of 0 holds its columns to the end of the table.
                self.rows[-1].append([[], _count(at.get("colspan"), 1, most=1000), _count(at.get("rowspan"), 1, 0), _indent(at.get("style")), False])
            elif tag == "br" or tag in BLOCK_TAGS or tag in ("td", "th"):
                self._say(" ")
            elif tag == "img":
                self._say("[image]")
            if self.rows and self.rows[-1] and tag not in ("td", "th", "tr", "table") and not self.rows[-1][-1][4]:
                self.rows[-1][-1][3] += _indent(at.get("style"))
        elif tag == "br":
            self.pieces.append("\n")
        elif tag == "hr":
            self._end()
            self.blocks.append(("text", "---", None))
        elif tag == "img":
            self.pieces.append("[image]")
        elif tag == "a" and at.get("href"):
            if self.links:  # a link ends where the next one begins
                self._link()
            self.links.append((len(self.pieces), at["href"]))
        elif tag in BLOCK_TAGS:
            self._end()
            if tag in ("ol", "ul"):
                self.lists.append(_count(at.get("start"), 1, 0, 10**8) if tag == "ol" else None)
            elif tag == "li":
                number = self.lists[-1] if self.lists else None
                if number is None:
                    self.pieces.append("* ")
                else:
                    self.lists[-1] = number + 1
                    self.pieces.append(f"{number}. ")

    def handle_startendtag(self, tag, attrs):
        if tag not in self.hides:  # one that is closed at once hides nothing
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self._table()
        elif self.tables:
            if tag in BLOCK_TAGS:
                self._say(" ")
        elif tag == "a" and self.links:
            self._link()
        elif tag in BLOCK_TAGS:
            self._end()
            if tag in ("ol", "ul") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.tables:
            self._say(data)
        else:
            self.pieces.append(_SPACE.sub(" ", data.replace("*", "\\*")))

    def _say(self, data: str) -> None:
        if self.rows and self.rows[-1]:
            self.rows[-1][-1][0].append(data)
            self.rows[-1][-1][4] |= bool(data.strip())
        elif data.strip():  # text of a table outside its cells
            self.blocks.append(("text", _SPACE.sub(" ", data).strip(" "), None))

    def _link(self) -> None:
        begin, href = self.links.pop()
        said = "".join(self.pieces[begin:])
        label = said.strip(" \n")
        if not label or label.lower() == "table of contents":
            self.pieces[begin:] = [" "] if said else []
        else:
            self.pieces[begin:] = [said[: len(said) - len(said.lstrip())], f"[{label}]({href})", said[len(said.rstrip()) :]]

    def _end(self) -> None:
        while self.links:
            self._link()
        text = re.sub(r" ?\n ?", "\n", re.sub(r" +", " ", "".join(self.pieces))).strip(" \n")
        self.pieces = []
        if text:
            self.blocks.append(("text", text, None))

    def _table(self) -> None:
        cells = grid([[(_SPACE.sub(" ", "".join(said)).strip(" \xa0"), *place) for said, *place, _ in row] for row in self.rows])
        self.rows = []
        if cells:
            self.blocks.append(("table", None, cells))

    def finish(self) -> list[tuple[str, str | None, list | None]]:
        self.close()
        if self.tables:
            self.tables = 0
            self._table()
        self._end()
        out, marker = [], None
        for kind, text, cells in self.blocks:
            if marker is not None and kind == "text":
                text, marker = f"{marker} {text}", None
            elif marker is not None:
                out.append(("text", marker, None))
                marker = None
            if kind == "text" and MARKER.fullmatch(text):
                marker = text
            else:
                out.append((kind, text, cells))
        return out if marker is None else [*out, ("text", marker, None)]


def grid(rows: list[list[tuple[str, int, int, float]]]) -> list[tuple[int, int, int, str, float]]:
    """(row, start, end, text, indent) of the cells (text, columns, rows, indent) that have text, where their columns are; a cell over several rows holds its columns in those below."""
    held: dict[int, float] = {}  # column -> rows below that it is still taken in
    out = []
    for k, row in enumerate(rows):
        at, taken = 0, {}
        for text, columns, down, indent in row:
            while held.get(at, 0):
                at += 1
            if text:
                out.append((k, at, at + columns - 1, text, indent))
            if down != 1:
                taken.update(dict.fromkeys(range(at, at + columns), down - 1 if down else float("inf")))
            at += columns
        held = {c: n - 1 for c, n in held.items() if n > 1} | taken
    return out


def read_blocks(html: str | None) -> list[tuple[str, str | None, list | None]]:
    """(kind, text, cells of a table) for each block of one page; null has none."""
    hidden = HIDDEN_TAGS
    while True:
        reader = _Reader(hidden)
        reader.feed(html or "")
        found = reader.finish()
        open_tags = _REOPENED.intersection(reader.hidden)
        if not open_tags:
            return found
        hidden -= open_tags


_CELLS = "array<struct<row:int,start:int,end:int,text:string,indent:double>>"


def _read(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(page, i, seq, kind, text, cells): page numbers the rows of the input, so that repeated ids are told apart."""
    cell = pa.struct([("row", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("indent", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                part = batch.slice(begin, _ROWS)
                found = [read_blocks(h.as_py()) for h in part.column(2)]
                flat = [(k, seq, *b) for k, page in enumerate(found) for seq, b in enumerate(page)]
                where = pa.array([k for k, *_ in flat], pa.int32())
                cells = [None if b[4] is None else [dict(zip(("row", "start", "end", "text", "indent"), c, strict=True)) for c in b[4]] for b in flat]
                own = [pa.array([b[i] for b in flat], t) for i, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), *own, pa.array(cells, pa.list_(cell))], ["page", "i", "seq", "kind", "text", "cells"])

    plain = pages.select(F.monotonically_increasing_id().alias("page"), F.col(id_column).alias("i"), F.col(html_column).alias("h"))
    kind = plain.schema["i"].dataType.simpleString()
    return plain.mapInArrow(run, f"page long, i {kind}, seq int, kind string, text string, cells {_CELLS}")


def table_cells(read: DataFrame) -> DataFrame:
    """(table, row, start, end, text, indent) of all tables; table is (page, seq)."""
    return read.where("kind = 'table'").select(F.struct("page", "seq").alias("table"), F.inline("cells"))


def blocks(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, seq from 0, kind text or table, text, fallback) for each block of each page.

    A null or empty page has no block, repeated rows are read alike, pages of any length are read whole.
    """
    read = cut(_read(pages, id_column, html_column), "blocks")
    texts = read.where("kind = 'text'").select("i", "seq", "kind", "text", F.lit(None).cast("string").alias("fallback"))
    cells = table_cells(read)
    if not cells.head(1):
        return texts.withColumnRenamed("i", id_column)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    said = lines(cells).groupBy("table").agg(F.array_join(ordered, "\n").alias("text"), F.max("fallback").alias("fallback"))
    said = said.select(F.col("table.page").alias("page"), F.col("table.seq").alias("seq"), "text", "fallback")
    tables = read.where("kind = 'table'").select("page", "i", "seq", "kind").join(said, ["page", "seq"])
    return texts.unionByName(tables.select("i", "seq", "kind", "text", "fallback")).withColumnRenamed("i", id_column)
