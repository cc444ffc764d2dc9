"""Markdown with tables: headings, paragraphs, list items, code and tables, placed by their source lines.

Quotes and lists are containers: what they hold is emitted, list paragraphs as list items.  Rules and HTML blocks are not emitted."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillstrata.sources.decode import Box, Decoded, Element, Grid, ParseError, element_id, register

LINE, WIDTH, MARGIN = 14.0, 612.0, 72.0
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?=\S)|( +)(?=\S)|[ \t]*$)")
_DELIMITERS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r"^ {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")


@dataclass
class Piece:
    type: str
    start: int
    stop: int
    text: str | None = None
    level: int | None = None
    table: Grid | None = None
    language: str | None = None


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


def _starts_block(line: str) -> bool:
    """Whether the line would end a paragraph above it."""
    item = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line) or (item and line[item.end() :].strip() and item[2] in ("-", "+", "*", "1.", "1)")))


def pieces(lines: list[str], at: int = 0, in_list: bool = False) -> list[Piece]:
    """Blocks of the lines, the first of which is line `at` of the source."""
    out: list[Piece] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith(("    ", "\t")):
            j = last = i
            while j < len(lines) and (not lines[j].strip() or lines[j].startswith(("    ", "\t"))):
                last = j if lines[j].strip() else last
                j += 1
            code = "".join(re.sub(r"^(?: {1,4}|\t)", "", x) + "\n" for x in lines[i : last + 1])
            out.append(Piece("code", at + i, at + last + 1, code))
            i = j
        elif m := _FENCE.match(line):
            j = i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            code = "".join(re.sub(rf"^ {{0,{len(m[1])}}}", "", x) + "\n" for x in lines[i + 1 : j])
            out.append(Piece("code", at + i, at + min(j + 1, len(lines)), code, language=m[3].strip() or None))
            i = j + 1
        elif m := _ATX.match(line):
            out.append(Piece("heading", at + i, at + i + 1, (m[2] or "").strip(), len(m[1])))
            i += 1
        elif _RULE.match(line):
            i += 1
        elif _QUOTE.match(line):
            j = i
            inner: list[str] = []
            while j < len(lines) and lines[j].strip() and (_QUOTE.match(lines[j]) or not _starts_block(lines[j])):
                inner.append(_QUOTE.sub("", lines[j], count=1))
                j += 1
            out += pieces(inner, at + i, in_list)
            i = j
        elif _ITEM.match(line):
            i = _item(lines, i, at, out)
        elif _HTML.match(line):
            while i < len(lines) and lines[i].strip():
                i += 1
        elif i + 1 < len(lines) and "|" in line and _DELIMITERS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            headers, rows, j = _cells(line), [], i + 2
            while j < len(lines) and lines[j].strip() and not _starts_block(lines[j]):
                rows.append(_cells(lines[j])[: len(headers)])
                j += 1
            rows = [r + [""] * (len(headers) - len(r)) for r in rows]
            out.append(Piece("table", at + i, at + j, table=Grid(headers, rows, len(rows), len(headers)).check()))
            i = j
        else:
            j = i + 1
            heading = 0
            while j < len(lines) and lines[j].strip():
                if m := _SETEXT.match(lines[j]):
                    heading = 1 if m[1][0] == "=" else 2
                    break
                if _starts_block(lines[j]):
                    break
                j += 1
            text = "\n".join(x.strip() for x in lines[i:j])
            out.append(Piece("heading", at + i, at + j + 1, text, heading) if heading else Piece("list_item" if in_list else "paragraph", at + i, at + j, text))
            i = j + bool(heading)
    return out


def _item(lines: list[str], i: int, at: int, out: list[Piece]) -> int:
    """One list item: its first line behind the marker, and what is indented as far, or continues its paragraph."""
    m = _ITEM.match(lines[i])
    indent = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] else 1)
    inner = [lines[i][min(indent, len(lines[i])) :]]
    j = i + 1
    while j < len(lines):
        line = lines[j]
        if not line.strip():
            inner.append("")
        elif len(line) - len(line.lstrip(" ")) >= indent:
            inner.append(line[indent:])
        elif inner[-1].strip() and not _starts_block(line) and not _ITEM.match(line):
            inner.append(line.lstrip())
        else:
            break
        j += 1
    while len(inner) > 1 and not inner[-1].strip():
        inner.pop()
    out += pieces(inner, at + i, True)
    return i + len(inner)


@register(".md", ".markdown")
def decode_markdown(name: str, content: bytes) -> Decoded:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as error:
        raise ParseError(f"not UTF-8: {error}") from None
    out = Decoded(name.rsplit("/", 1)[-1], "text/markdown", meta={"page_count": "1", "parser": "markdown", "line_count": str(text.count("\n") + 1)})
    for n, p in enumerate(pieces(re.split(r"\r\n|\r|\n", text))):
        box = Box(MARGIN, MARGIN + p.start * LINE, WIDTH - MARGIN, MARGIN + max(p.stop, p.start + 1) * LINE)
        attrs = {"synthetic_bbox": "true"} | ({"language": p.language} if p.language else {})
        out.elements.append(Element(element_id(1, n), n, 1, p.type, box, p.level, None, p.text, p.table, None, attrs))
    out.title = next((e.text for e in out.elements if e.type == "heading" and e.level == 1 and e.text), None)
    out.pages = [(1, WIDTH, round(max((e.bbox.y1 for e in out.elements), default=MARGIN) + MARGIN, 2))]
    return out
