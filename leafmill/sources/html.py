"""HTML to ordered blocks, with the standard library's parser, batch by batch."""

from __future__ import annotations

import base64
import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "ordinal int, type string, text string, text_level int, grid array<array<string>>, depth int"
_INLINE = set("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr del".split())
_SKIP = {"script", "style", "head", "template", "noscript", "svg"}
MOST_SPAN, MOST_CELLS, LEAST_PIXELS = 1000, 5_000_000, 32


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def grid(self) -> list[list[str]]:
        """Spans replicated into all covered cells; a cell across the whole width stays in its first column only."""
        taken: dict[tuple[int, int], tuple[str, bool]] = {}
        height, wide = len(self.rows), 0
        for r, row in enumerate(self.rows):
            c = 0
            for text, down, across in row:
                while (r, c) in taken:
                    c += 1
                for i in range(r, min(r + down, height)):
                    for j in range(c, c + across):
                        taken[i, j] = (text, j > c)
                        if len(taken) > MOST_CELLS:
                            raise ValueError("table too large")
                c += across
                wide = max(wide, c)
        out = []
        for r, row in enumerate(self.rows):
            line = [taken.get((r, c), ("", False)) for c in range(wide)]
            alone = len(row) == 1 and row[0][2] >= wide > 1
            out.append([t if not (alone and copied) else "" for t, copied in line])
        return out


class _Walker(HTMLParser):
    def __init__(self, media: dict[str, bytes] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.buffer: list[str] = []
        self.skip = 0
        self.lists: list[str] = []
        self.items: list[list[str]] = []
        self.tables: list[_Table] = []
        self.pre: list[str] | None = None
        self.heading = 0
        self.links: list[tuple[str, int]] = []
        self.math: list[str] | None = None
        self.annotation: list[str] | None = None
        self.images: list[dict] = []
        self.media = media or {}

    # the place text goes to: a cell, preformatted text, a list item or the inline buffer
    def target(self) -> list[str]:
        if self.annotation is not None:
            return self.annotation
        if self.math is not None:
            return self.math
        if self.tables and self.tables[-1].cell is not None:
            return self.tables[-1].cell
        if self.pre is not None:
            return self.pre
        return self.items[-1] if self.items else self.buffer

    def flush(self, kind: str = "text", level: int | None = None) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.add(kind, text, level)

    def add(self, kind: str, text: str | None, level: int | None = None, grid=None, depth: int | None = None) -> None:
        self.blocks.append({"ordinal": len(self.blocks), "type": kind, "text": text, "text_level": level, "grid": grid, "depth": depth})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "math":
            self.math = []
        elif tag == "annotation" and "tex" in (a.get("encoding") or ""):
            self.annotation = []
        elif tag == "br":
            self.target().append("\n" if self.pre is not None else " ")
        elif tag == "img":
            self.image(a)
        elif tag == "a":
            self.links.append((a.get("href") or "", len(self.target())))
        elif tag in ("ul", "ol"):
            if not self.items and not (self.tables and self.tables[-1].cell is not None):
                self.flush()
            self.lists.append(tag)
        elif tag == "li" and self.lists:
            self.items.append([])
        elif tag == "table":
            if not self.tables:
                self.flush()
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            t = self.tables[-1]
            if not t.rows:
                t.rows.append([])
            t.cell, t.span = [], tuple(max(1, min(MOST_SPAN, int(v))) if (v := a.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))
        elif tag == "pre" and not self.tables:
            self.flush()
            self.pre = []
        elif re.fullmatch("h[1-6]", tag) and not self.tables and not self.items:
            self.flush()
            self.heading = int(tag[1])
        elif tag not in _INLINE and not self.tables and not self.items:
            self.flush()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "img", "hr", "wbr", "input", "meta", "link"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "annotation" and self.annotation is not None:
            self.math, self.annotation = ["".join(self.annotation)], None
        elif tag == "math" and self.math is not None:
            latex, self.math = " ".join("".join(self.math).split()), None
            if self.tables or self.items:
                self.target().append(f"\\({latex}\\)")
            else:
                self.flush()
                self.add("equation", latex)
        elif tag == "a" and self.links:
            self.link()
        elif tag == "li" and self.items:
            text = " ".join("".join(self.items.pop()).split())
            if text and not self.tables:
                self.add("list", text, depth=max(0, len(self.lists) - 1))
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("td", "th") and self.tables and self.tables[-1].cell is not None:
            t = self.tables[-1]
            t.rows[-1].append((" ".join("".join(t.cell).split()), *t.span))
            t.cell = None
        elif tag == "table" and self.tables:
            grid = self.tables.pop().grid()
            if not self.tables and grid:
                self.add("table", None, grid=grid)
            elif self.tables:
                self.target().append(" ".join(" ".join(r) for r in grid))
        elif tag == "pre" and self.pre is not None:
            text, self.pre = "".join(self.pre).strip("\n"), None
            if text.strip():
                self.add("code", text)
        elif re.fullmatch("h[1-6]", tag) and self.heading:
            self.flush("title", self.heading)
            self.heading = 0
        elif tag not in _INLINE and not self.tables and not self.items:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.items and self.blocks and not self.target() and not data.strip():
            return
        self.target().append(data)

    def link(self) -> None:
        href, at = self.links.pop()
        place = self.target()
        text = "".join(place[at:]).strip()
        if href and not href.startswith("#") and href != text:
            place.append(f" ({href})")

    def image(self, a: dict) -> None:
        size = [int(v) for k in ("width", "height") if (v := re.sub(r"px$", "", a.get(k) or "")).isdigit()]
        if a.get("role") == "presentation" or a.get("aria-hidden") == "true" or (len(size) == 2 and max(size) < LEAST_PIXELS):
            return
        data = image_bytes(a.get("src") or "", self.media)
        digest = hashlib.sha256(data).hexdigest() if data else None
        if not self.tables and not self.items and not self.links:
            self.flush()
        self.images.append({"src": a.get("src"), "digest": digest})
        self.add("image", a.get("alt") or digest or a.get("src"))

    def finish(self) -> list[dict]:
        if self.pre:
            self.add("code", "".join(self.pre).strip("\n"))
        while self.items:
            self.handle_endtag("li")
        while self.tables:
            self.handle_endtag("table")
        self.flush("title" if self.heading else "text", self.heading or None)
        return self.blocks


def image_bytes(src: str, media: dict[str, bytes]) -> bytes | None:
    """An image's bytes, from a data URI or the document's media."""
    m = re.match(r"data:image/[\w.+-]+;base64,(.*)", src, re.S)
    if m:
        try:
            return base64.b64decode(m.group(1))
        except ValueError:
            return None
    return media.get(src) or media.get(src.rsplit("/", 1)[-1])


def blocks_of(html: str | None, media: dict[str, bytes] | None = None) -> list[dict]:
    """Ordered blocks of one page; comments, scripts and styles say nothing."""
    if not html:
        return []
    w = _Walker(media)
    w.feed(html)
    w.close()
    return w.finish()


def text_of(html: str | None) -> str:
    """All text, joined by blanks."""
    out = []
    for b in blocks_of(html):
        out += [c for r in b["grid"] for c in r] if b["grid"] else [b["text"] or ""]
    return " ".join(x.strip() for x in out if x and x.strip())


def read_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Blocks of every page, in Arrow batches; no shuffle."""

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, h in enumerate(batch.column(1).to_pylist()):
                for b in blocks_of(h):
                    at.append(i)
                    out.append(b)
            kinds = (("ordinal", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("text_level", pa.int32()), ("grid", pa.list_(pa.list_(pa.string()))), ("depth", pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array([b[k] for b in out], t) for k, t in kinds], names=[key, *[k for k, _ in kinds]])

    rows = pages.select(F.col(key), F.col(html))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {BLOCK_SCHEMA}")
