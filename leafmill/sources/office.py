"""Workbooks, slide decks, word documents and XML, with zip and ElementTree only."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

_NS = re.compile(r"\{[^}]*\}")
#: Emu of an image's least side (32 px at 96 dpi).
LEAST_EMU = 32 * 9525


def _tag(e: ET.Element) -> str:
    return _NS.sub("", e.tag)


def _find(e: ET.Element, *path: str) -> list[ET.Element]:
    found = [e]
    for name in path:
        found = [c for f in found for c in f if _tag(c) == name]
    return found


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _tag(c) == name]


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        target = r.get("Target", "")
        base = [] if target.startswith("/") else folder.split("/")
        for step in target.strip("/").split("/"):
            base = base[:-1] if step == ".." else [*base, step]
        out[r.get("Id")] = "/".join(base)
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes) -> list[dict]:
    """Sheets in order: name, grid of shown text, merged ranges, hidden rows; formulas give their stored value."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in _find(ET.fromstring(z.read("xl/sharedStrings.xml")), "si"):
            shared.append("".join(t.text or "" for t in _all(si, "t")))
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        root = ET.fromstring(z.read("xl/styles.xml"))
        custom = {f.get("numFmtId"): f.get("formatCode", "") for f in _all(root, "numFmt")}
        for i, xf in enumerate(_find(root, "cellXfs", "xf")):
            fmt = xf.get("numFmtId", "0")
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(fmt, ""))
            if fmt in {str(n) for n in (*range(14, 23), *range(45, 48))} or re.search(r"[ymdhs]", code, re.I):
                dates.add(i)
    rels = _rels(z, "xl/workbook.xml")
    out = []
    for sheet in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
        rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        root = ET.fromstring(z.read(rels[rid]))
        grid: list[list[str]] = []
        hidden = []
        for row in _all(root, "row"):
            at = int(row.get("r", len(grid) + 1)) - 1
            grid += [[] for _ in range(at + 1 - len(grid))]
            if row.get("hidden") == "1":
                hidden.append(at)
            for c in _find(row, "c"):
                col = _column(c.get("r")) if c.get("r") else len(grid[at])
                grid[at] += [""] * (col + 1 - len(grid[at]))
                grid[at][col] = _cell(c, shared, dates)
        merges = [m.get("ref") for m in _all(root, "mergeCell")]
        out.append({"sheet": sheet.get("name"), "grid": grid, "merges": merges, "hidden_rows": hidden})
    return out


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(c, "t"))
    value = next((v.text or "" for v in _find(c, "v")), "")
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and value and int(c.get("s", "0")) in dates:
        import datetime as dt

        at = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))
        at = (at + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
        return at.date().isoformat() if at.time() == dt.time() else at.isoformat(" ")
    return value


def read_pptx(data: bytes) -> list[dict]:
    """Blocks of a deck: per slide its shapes by place, groups inside out, tables and charts as grids, notes last."""
    z = zipfile.ZipFile(io.BytesIO(data))
    pres = ET.fromstring(z.read("ppt/presentation.xml"))
    rels = _rels(z, "ppt/presentation.xml")
    out = []
    for page, s in enumerate(_all(pres, "sldId")):
        part = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
        root, own = ET.fromstring(z.read(part)), _rels(z, part)
        found: list[tuple[int, int, dict]] = []
        for tree in _all(root, "spTree"):
            _shapes(tree, z, own, found, 0, 0)
            break
        for _, _, b in sorted(found, key=lambda x: (x[0], x[1])):
            out.append({"page_idx": page, **b})
        for target in own.values():
            if "notesSlide" in target and target in z.namelist():
                for sp in _all(ET.fromstring(z.read(target)), "sp"):
                    if any(p.get("type") == "body" for p in _all(sp, "ph")):
                        text = "\n".join(_paragraphs(sp))
                        if text.strip():
                            out.append({"page_idx": page, "type": "text", "text": text, "text_level": None, "grid": None})
    return out


def _paragraphs(sp: ET.Element) -> list[str]:
    return [t for p in _all(sp, "p") if (t := "".join(x.text or "" for x in _all(p, "t"))).strip()]


def _place(e: ET.Element) -> tuple[int, int]:
    for off in _all(e, "off"):
        return int(off.get("y", 0)), int(off.get("x", 0))
    return 0, 0


def _shapes(tree: ET.Element, z: zipfile.ZipFile, rels: dict, out: list, top: int, left: int) -> None:
    for e in tree:
        kind = _tag(e)
        if kind not in ("sp", "grpSp", "graphicFrame", "pic"):
            continue
        y, x = _place(e)
        if kind == "grpSp":
            _shapes(e, z, rels, out, y, x)
        elif kind == "sp":
            title = any(p.get("type") in ("title", "ctrTitle") for p in _all(e, "ph"))
            text = "\n".join(_paragraphs(e))
            if text.strip():
                out.append((y, x, {"type": "title" if title else "text", "text": text, "text_level": 1 if title else None, "grid": None}))
        elif kind == "graphicFrame":
            for tbl in _all(e, "tbl"):
                grid = [[" ".join(_paragraphs(tc)) for tc in _find(tr, "tc")] for tr in _find(tbl, "tr")]
                out.append((y, x, {"type": "table", "text": None, "text_level": None, "grid": grid}))
            for c in _all(e, "chart"):
                rid = next((v for k, v in c.attrib.items() if k.endswith("}id")), None)
                if rels.get(rid) in z.namelist():
                    out.append((y, x, {"type": "table", "text": None, "text_level": None, "grid": _chart(ET.fromstring(z.read(rels[rid])))}))
        else:
            ext = next(iter(_all(e, "ext")), None)
            if ext is None or max(int(ext.get("cx", 0)), int(ext.get("cy", 0))) >= LEAST_EMU:
                name = next((p.get("descr") or p.get("name") for p in _all(e, "cNvPr")), None)
                out.append((y, x, {"type": "image", "text": name, "text_level": None, "grid": None}))


def _chart(root: ET.Element) -> list[list[str]]:
    names, columns, cats = [], [], []
    for ser in _all(root, "ser"):
        names.append(next((v.text or "" for t in _find(ser, "tx") for v in _all(t, "v")), ""))
        cats = cats or [v.text or "" for c in _find(ser, "cat") for v in _all(c, "v")]
        columns.append([v.text or "" for c in _find(ser, "val") for v in _all(c, "v")])
    n = max([len(cats), *map(len, columns)], default=0)
    get = lambda xs, i: xs[i] if i < len(xs) else ""
    return [["", *names], *[[get(cats, i), *[get(c, i) for c in columns]] for i in range(n)]]


def read_docx(data: bytes) -> list[dict]:
    """Blocks of a word document: headings by style, lists, tables, paragraphs."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = _find(ET.fromstring(z.read("word/document.xml")), "body")[0]
    out = []
    for e in body:
        if _tag(e) == "tbl":
            grid = [[" ".join(_paragraphs(tc)) for tc in _find(tr, "tc")] for tr in _find(e, "tr")]
            out.append({"page_idx": 0, "type": "table", "text": None, "text_level": None, "grid": grid})
        elif _tag(e) == "p":
            text = "".join(t.text or "" for t in _all(e, "t"))
            if not text.strip():
                continue
            style = next((next((v for k, v in s.attrib.items() if k.endswith("}val")), "") for s in _all(e, "pStyle")), "")
            head = re.fullmatch(r"(?:Heading|Titre|berschrift|heading )\s?([1-6])|Title", style)
            listed = bool(_all(e, "numPr"))
            out.append({"page_idx": 0, "type": "title" if head else "list" if listed else "text", "text": text, "text_level": int(head.group(1) or 1) if head else None, "grid": None})
    return out


def read_xml(data: bytes | str) -> dict:
    """XML as nested values: attributes with ``@``, text as ``#text``, repeats as lists."""

    def value(e: ET.Element):
        out: dict = {f"@{_NS.sub('', k)}": v for k, v in e.attrib.items()}
        for c in e:
            name, v = _tag(c), value(c)
            if name in out:
                out[name] = [*out[name], v] if isinstance(out[name], list) else [out[name], v]
            else:
                out[name] = v
        text = (e.text or "").strip()
        if not out:
            return text or None
        return out | ({"#text": text} if text else {})

    root = ET.fromstring(data)
    return {_tag(root): value(root)}
