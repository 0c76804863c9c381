"""Office files (docx, pptx, xlsx, odt) as blocks, from their XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from quillspark.sources.blocks import Block, flat

_TYPE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_HEADING = re.compile(r"heading\s*([1-9])", re.I)
_MOST_REPEATED = 64


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(e: ET.Element, *names: str) -> list[ET.Element]:
    """Descendants in order by local names."""
    return [x for x in e.iter() if local(x.tag) in names]


def _kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e if local(x.tag) in names]


def _get(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def _runs(e: ET.Element) -> str:
    return flat("".join(t.text or "" for t in _all(e, "t")))


def docx(raw: bytes) -> list[Block]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    out: list[Block] = []
    for body in _kids(root, "body"):
        for e in body:
            if local(e.tag) == "tbl":
                rows = [[_runs(c) for c in _kids(r, "tc")] for r in _kids(e, "tr")]
                if any(any(r) for r in rows):
                    out.append(Block("table", rows=rows))
            elif local(e.tag) == "p" and (text := _runs(e)):
                level = _docx_level(e)
                kind = "heading" if level else "list" if any(_all(p, "numPr") for p in _kids(e, "pPr")) else "para"
                out.append(Block(kind, text, level or 0))
    return out


def _docx_level(p: ET.Element) -> int | None:
    for properties in _kids(p, "pPr"):
        for o in _kids(properties, "outlineLvl"):
            if (v := _get(o, "val") or "").isdigit():
                return min(int(v) + 1, 6)
        for s in _kids(properties, "pStyle"):
            if m := _HEADING.search(_get(s, "val") or ""):
                return min(int(m[1]), 6)
    return None


def pptx(raw: bytes) -> list[Block]:
    z, out = zipfile.ZipFile(io.BytesIO(raw)), []
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for k, (_, name) in enumerate(slides, 1):
        out.append(Block("marker", f"slide {k}"))
        for shape in _all(ET.fromstring(z.read(name)), "sp", "graphicFrame"):
            if local(shape.tag) == "graphicFrame":
                rows = [[_runs(c) for c in _kids(r, "tc")] for t in _all(shape, "tbl") for r in _kids(t, "tr")]
                if any(any(r) for r in rows):
                    out.append(Block("table", rows=rows))
                continue
            texts = [t for p in _all(shape, "p") if (t := _runs(p))]
            if any(_get(h, "type") in ("title", "ctrTitle") for h in _all(shape, "ph")):
                if texts:
                    out.append(Block("heading", " ".join(texts), 2))
            else:
                out += [Block("list", t) for t in texts]
    return out


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(raw: bytes) -> list[Block]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [flat("".join(t.text or "" for t in _all(si, "t"))) for si in _all(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {_get(r, "Id"): _get(r, "Target") or "" for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out: list[Block] = []
    for sheet in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
        target = targets.get(sheet.attrib.get(_TYPE), "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        if path not in z.namelist():
            continue
        rows = [r for e in _all(ET.fromstring(z.read(path)), "row") if any(r := _xlsx_row(e, shared))]
        if rows:
            out += [Block("heading", _get(sheet, "name") or "", 2), Block("table", rows=rows)]
    return out


def _xlsx_row(row: ET.Element, shared: list[str]) -> list[str]:
    cells: dict[int, str] = {}
    for c in _kids(row, "c"):
        m = re.match("[A-Z]+", _get(c, "r") or "")
        cells[column_index(m[0]) if m else len(cells)] = _xlsx_value(c, shared)
    return [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def _xlsx_value(c: ET.Element, shared: list[str]) -> str:
    kind = _get(c, "t")
    if kind == "inlineStr":
        return _runs(c)
    value = next((flat(v.text) for v in _kids(c, "v")), "")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    return {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value


def odt(raw: bytes) -> list[Block]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
    out: list[Block] = []
    for body in _kids(root, "body"):
        for text in _kids(body, "text"):
            for e in text:
                words, kind = flat("".join(e.itertext())), local(e.tag)
                if kind == "h" and words:
                    out.append(Block("heading", words, min(int(_get(e, "outline-level") or 1), 6)))
                elif kind == "p" and words:
                    out.append(Block("para", words))
                elif kind == "list":
                    out += [Block("list", t) for i in _all(e, "list-item") if (t := flat("".join(i.itertext())))]
                elif kind == "table":
                    rows = [r for x in _all(e, "table-row") if any(r := _odt_row(x))]
                    if rows:
                        out.append(Block("table", rows=rows))
    return out


def _odt_row(row: ET.Element) -> list[str]:
    out: list[str] = []
    for c in _kids(row, "table-cell", "covered-table-cell"):
        times = min(int(_get(c, "number-columns-repeated") or 1), _MOST_REPEATED)
        out += [flat(" ".join(c.itertext()))] * times
    while out and not out[-1]:
        out.pop()
    return out
