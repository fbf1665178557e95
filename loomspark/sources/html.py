"""A small converter from page markup to markdown, for use inside tasks."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

_BLOCKS = {"p", "div", "section", "article", "blockquote"}
_SKIP = {"script", "style", "head"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.outer: list[tuple[str, list[str], list[list]]] = []
        self.lists: list[list] = []
        self.skip = 0
        self.pre = False
        self.href: list[str | None] = []
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.cells: list[tuple[int, int, bool] | None] = []
        self.macros: list[dict[str, str]] = []

    def _block(self) -> None:
        if self.out and not self.out[-1].endswith("\n\n"):
            self.out.append("\n\n")

    def _open(self, kind: str) -> None:
        """What follows is a text of its own, until it is closed."""
        self.outer.append((kind, self.out, self.lists))
        self.out, self.lists = [], []

    def _close(self, kind: str) -> str | None:
        """The text since the last opening of the kind, with whatever was left open within it."""
        if all(k != kind for k, _, _ in self.outer):
            return None
        text = ""
        while True:
            text = "".join(self.out) + text
            k, self.out, self.lists = self.outer.pop()
            if k == kind:
                return text

    def _end_cell(self) -> None:
        if self.cells and self.cells[-1] is not None:
            text = " ".join((self._close("cell") or "").split())
            self.tables[-1][-1].append((text, *self.cells[-1]))
            self.cells[-1] = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in _BLOCKS and not self.lists:
            self._block()
        elif tag in ("ul", "ol"):
            if not self.lists:
                self._block()
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            kind = self.lists[-1]
            kind[1] += 1
            mark = f"{kind[1]}." if kind[0] == "ol" else "-"
            self.out.append(f"\n{'  ' * (len(self.lists) - 1)}{mark} ")
        elif tag == "pre":
            self._block()
            self.out.append("```\n")
            self.pre = True
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.href.append(a.get("href"))
            self.out.append("[")
        elif tag == "table":
            self.tables.append([])
            self.cells.append(None)
        elif tag == "tr" and self.tables:
            self._end_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cells[-1] = (_span(a.get("colspan")), _span(a.get("rowspan")), tag == "th")
            self._open("cell")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "code" and self.out and self.out[-1] == "```\n":
            self.out[-1] = f"```{a.get('data-language') or (a.get('class') or '').replace('language-', '')}\n"
        elif tag == "ac:structured-macro":
            self.macros.append({"": (a.get("ac:name") or "").strip().lower()})
            self._open("macro")
        elif tag == "ac:parameter" and self.macros:
            self.macros[-1]["parameter"] = a.get("ac:name") or ""
            self._open("parameter")
        elif tag == "ac:plain-text-body":
            self.pre = True

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or (tag in _BLOCKS and not self.lists):
            self._block()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self._block()
        elif tag == "pre":
            self.out.append("\n```")
            self.pre = False
            self._block()
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.out.append(f"]({href})" if href else "]")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.tables:
            self._end_cell()
            self.cells.pop()
            rows = [r for r in self.tables.pop() if r]
            if self.tables and self.cells[-1] is not None:
                # a table within a cell is a part of the cell's text
                self.out.append(" " + " ".join(c[0] for r in rows for c in r) + " ")
            elif rows:
                self._block()
                self.out.append(_table(rows))
                self._block()
        elif tag == "ac:parameter" and self.macros:
            self.macros[-1][self.macros[-1].pop("parameter", "")] = (self._close("parameter") or "").strip()
        elif tag == "ac:plain-text-body":
            self.pre = False
        elif tag == "ac:structured-macro" and self.macros:
            macro, text = self.macros.pop(), self._close("macro") or ""
            self._block()
            self.out.append(_macro(macro, text))
            self._block()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.tables and self.cells[-1] is None and not data.strip():
            return
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def finish(self) -> str:
        """The whole text; tables and macros that were left open are closed."""
        while self.tables:
            self.handle_endtag("table")
        while self.macros:
            self.handle_endtag("ac:structured-macro")
        return "".join(self.out)


def _span(value: str | None) -> int:
    """The cells that a cell covers; what isn't a number is 1, at most 1,000."""
    return min(1000, max(1, int(value))) if value and re.fullmatch(r"[0-9]{1,9}", value.strip()) else 1


def _table(rows: list[list[tuple[str, int, int, bool]]]) -> str:
    """Cells repeated in all the places that they cover; columns are numbered where the first row has no header cell."""
    at: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, wide, high, _ in row:
            while (y, x) in at:
                x += 1
            for dy in range(min(high, len(rows) - y)):
                for dx in range(wide):
                    at.setdefault((y + dy, x + dx), text)
            x += wide
    width = 1 + max(x for _, x in at)
    grid = [[at.get((y, x), "") for x in range(width)] for y in range(len(rows))]
    if not any(header for *_, header in rows[0]):
        grid.insert(0, [f"Column {x + 1}" for x in range(width)])
    line = lambda r: "| " + " | ".join(r) + " |\n"
    return line(grid[0]) + line(["---"] * width) + "".join(map(line, grid[1:]))


def _macro(macro: dict[str, str], text: str) -> str:
    name = macro[""]
    if name == "code":
        return f"```{macro.get('language', '')}\n{text.rstrip()}\n```"
    if name in ("info", "note"):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        return "\n> ".join([f"> **{name.upper()}:** {lines[0]}", *lines[1:]]) if lines else f"> **{name.upper()}:**"
    if name == "expand":
        return f"#### {macro.get('title') or 'Expand'}\n\n{text.strip()}"
    return f"[macro:{name}]"


def to_markdown(page: str | None) -> str:
    """Headings, paragraphs, nested lists, tables, links, code and macros of a page; scripts and styles are left out. Null gives the empty text.

    Macros: code with its language, info and note as quotes, expand as a
    heading; of others only the name stays.
    """
    w = _Writer()
    w.feed(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1]), page or "", flags=re.DOTALL))
    w.close()
    text = w.finish()
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ ](?=\S)", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()
