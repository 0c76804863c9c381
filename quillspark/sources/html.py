"""HTML as blocks: headings, list items, tables and paragraphs; head, script and style skipped."""

from __future__ import annotations

from html.parser import HTMLParser

from quillspark.sources.blocks import Block, flat

_SKIP = {"script", "style", "head", "noscript", "template"}
_BREAKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote", "pre", "form", "ul", "ol", "figure", "figcaption"}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}


class HtmlBlocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._text: list[str] = []
        self._as: tuple[str, int] = ("para", 0)
        self._hidden = 0
        self._rows: list[list[str]] | None = None
        self._cell: list[str] | None = None

    def _close_text(self) -> None:
        text = flat("".join(self._text))
        self._text = []
        if text:
            self.blocks.append(Block(self._as[0], text, self._as[1]))
        self._as = ("para", 0)

    def _close_cell(self) -> None:
        if self._cell is not None and self._rows is not None:
            if not self._rows:
                self._rows.append([])
            self._rows[-1].append(flat("".join(self._cell)))
        self._cell = None

    def _close_table(self) -> None:
        self._close_cell()
        rows = [r for r in self._rows or [] if any(r)]
        self._rows = None
        if rows:
            self.blocks.append(Block("table", rows=rows))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self._hidden += 1
        elif tag == "table" and self._rows is None:
            self._close_text()
            self._rows = []
        elif self._rows is not None:
            if tag == "tr":
                self._close_cell()
                self._rows.append([])
            elif tag in ("td", "th"):
                self._close_cell()
                self._cell = []
            elif tag == "br" and self._cell is not None:
                self._cell.append(" ")
        elif tag in _HEADINGS or tag == "li":
            self._close_text()
            self._as = ("heading", _HEADINGS[tag]) if tag in _HEADINGS else ("list", 0)
        elif tag in _BREAKS:
            self._close_text()
        elif tag == "br":
            self._text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self._hidden = max(0, self._hidden - 1)
        elif self._rows is not None:
            if tag == "table":
                self._close_table()
            elif tag in ("td", "th"):
                self._close_cell()
        elif tag in _HEADINGS or tag == "li" or tag in _BREAKS:
            self._close_text()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        if self._rows is None:
            self._text.append(data)
        elif self._cell is not None:
            self._cell.append(data)

    def close(self) -> None:
        super().close()
        if self._rows is not None:
            self._close_table()
        self._close_text()


def blocks(text: str) -> list[Block]:
    p = HtmlBlocks()
    p.feed(text)
    p.close()
    return p.blocks
