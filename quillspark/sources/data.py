"""CSV, JSON, YAML and XML as Markdown, and their values as plain text."""

from __future__ import annotations

import csv
import io
import json
from xml.etree import ElementTree as ET

from quillspark.sources.blocks import flat, normalize, table_markdown
from quillspark.sources.office import local

_SNIFFED = 4096


def csv_rows(text: str) -> tuple[list[list[str]], str]:
    """Rows with content, and the delimiter that was found."""
    try:
        dialect = csv.Sniffer().sniff(text[:_SNIFFED], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    return [r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)], dialect.delimiter


def load(text: str, suffix: str) -> object:
    """The value; ValueError if it is malformed or YAML is not installed."""
    if suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML is not installed") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def scalar(v: object) -> bool:
    return v is None or isinstance(v, str | int | float | bool)


def tabular(v: object) -> bool:
    """More than one object, none empty or nested."""
    return isinstance(v, list) and len(v) > 1 and all(isinstance(x, dict) and x and all(map(scalar, x.values())) for x in v)


def _show(v: object) -> str:
    return "" if v is None else str(v)


def table_rows(items: list[dict]) -> list[list[str]]:
    """Header: all keys in the order they are first seen."""
    header = list(dict.fromkeys(k for x in items for k in x))
    return [list(map(str, header)), *([_show(x.get(k)) for k in header] for x in items)]


def _render(v: object, depth: int) -> list[str]:
    pad = "  " * depth
    if tabular(v):
        return [table_markdown(table_rows(v))]
    if not scalar(v):
        pairs = [(f"{pad}- **{k}:**", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{pad}-", x) for x in v]
        out: list[str] = []
        for head, x in pairs:
            if scalar(x):
                out.append(f"{head} {_show(x)}".rstrip())
            elif tabular(x) and isinstance(v, dict):
                out += [head, "", table_markdown(table_rows(x)), ""]
            else:
                out += [head, *_render(x, depth + 1)]
        return out
    return [pad + _show(v)] if _show(v) else []


def data_markdown(v: object) -> str:
    return normalize("\n".join(_render(v, 0))).strip()


def data_text(v: object) -> str:
    """Values depth-first, a line each, without keys."""

    def walk(x: object) -> list[str]:
        if isinstance(x, dict):
            return [y for z in x.values() for y in walk(z)]
        if isinstance(x, list):
            return [y for z in x for y in walk(z)]
        return [t] if (t := flat(_show(x))) else []

    return normalize("\n".join(walk(v))).strip()


def _table(group: list[ET.Element]) -> list[list[str]] | None:
    """Flat siblings of one tag as attribute columns and text."""
    if len(group) < 2 or any(len(e) for e in group):
        return None
    names = list(dict.fromkeys(local(k) for e in group for k in e.attrib))
    header = [*names, *(["text"] if any(flat(e.text) for e in group) else [])]
    if not header:
        return None
    rows = [header]
    for e in group:
        own = {local(k): v for k, v in e.attrib.items()}
        rows.append([*(own.get(n, "") for n in names), *([flat(e.text)] if header[-1] == "text" and len(header) > len(names) else [])])
    return rows


def _element(e: ET.Element, depth: int) -> list[str]:
    attributes = " ".join(f'{local(k)}="{v}"' for k, v in e.attrib.items())
    label = f"{local(e.tag)} ({attributes})" if attributes else local(e.tag)
    out = [f"{'  ' * depth}- **{label}:** {flat(e.text)}".rstrip()]
    groups: list[list[ET.Element]] = []
    for child in e:
        if groups and groups[-1][0].tag == child.tag:
            groups[-1].append(child)
        else:
            groups.append([child])
    for group in groups:
        rows = _table(group)
        out += ["", table_markdown(rows), ""] if rows else [x for c in group for x in _element(c, depth + 1)]
    return out


def xml_markdown(text: str) -> str:
    return normalize("\n".join(_element(ET.fromstring(text), 0))).strip()


def xml_text(text: str) -> str:
    """Attribute values and text of each element, a line per element."""
    found = (" ".join(x for x in [*e.attrib.values(), flat(e.text)] if x) for e in ET.fromstring(text).iter())
    return normalize("\n".join(x for x in found if x)).strip()
