"""Blocks of a document and their two renderings; decoding of bytes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr")


def normalize(text: str) -> str:
    """No byte order mark, plain spaces, NFC."""
    return unicodedata.normalize("NFC", text.replace("\ufeff", "").replace("\u00a0", " "))


def decode(raw: bytes) -> str:
    """The first encoding that fits; replacement characters if none does."""
    for e in ENCODINGS:
        try:
            return normalize(raw.decode(e))
        except UnicodeDecodeError:
            pass
    return normalize(raw.decode("utf-8", "replace"))


def flat(text: str | None) -> str:
    return " ".join((text or "").split())


def table_markdown(rows: Iterable[Iterable[object]]) -> str:
    """A Markdown table; empty rows go, short ones are padded."""
    clean = [[flat("" if c is None else str(c)).replace("|", "\\|") for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    if not clean:
        return ""
    wide = max(map(len, clean))
    rule = ["---"] * wide
    full = [r + [""] * (wide - len(r)) for r in clean]
    return "\n".join(f"| {' | '.join(r)} |" for r in [full[0], rule, *full[1:]])


@dataclass
class Block:
    kind: str  # heading, para, list, table, marker
    text: str = ""
    level: int = 0
    rows: list[list[str]] = field(default_factory=list)

    def markdown(self) -> str:
        match self.kind:
            case "heading":
                return f"{'#' * self.level} {self.text}"
            case "list":
                return f"- {self.text}"
            case "table":
                return table_markdown(self.rows)
            case "marker":
                return f"<!-- {self.text} -->"
        return self.text

    def plain(self) -> list[str]:
        if self.kind == "table":
            return [" ".join(str(c) for c in r if c) for r in self.rows]
        return [] if self.kind == "marker" else [self.text]


def markdown(blocks: list[Block]) -> str:
    return normalize("\n\n".join(m for b in blocks if (m := b.markdown()) or b.kind != "table")).strip()


def plain(blocks: list[Block]) -> str:
    return normalize("\n".join(x for b in blocks for x in b.plain() if x.strip())).strip()


def count(blocks: list[Block], kind: str) -> int:
    return sum(b.kind == kind for b in blocks)
