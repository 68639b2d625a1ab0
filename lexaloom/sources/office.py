"""Text of Office and OpenDocument files as Markdown: headings, lists, tables, slides and sheets."""

from __future__ import annotations

import html as entities
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

KINDS = ("docx", "pptx", "xlsx", "odt", "odp", "ods")


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _get(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _name(x) == name)


def table_lines(rows: list[list[str]]) -> list[str]:
    """A Markdown table of rows, the first as its header; empty ends of rows and empty rows are left out."""
    rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    width = max((max(k for k, c in enumerate(r, 1) if c) for r in rows), default=0)
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return lines[:1] + ["|" + "---|" * width] + lines[1:] if lines else []


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for run in _all(p, "r"):
        words = "".join("\t" if _name(t) == "tab" else t.text or "" for t in run.iter() if _name(t) in ("t", "tab"))
        bold = next((b for b in run.iter() if _name(b) == "b"), None)
        strong = bold is not None and _get(bold, "val") not in ("0", "false") and words.strip()
        out.append(f"**{words.strip()}**" + " " * (len(words) - len(words.rstrip())) if strong else words)
    text = "".join(out).strip()
    style = next((_get(s, "val") or "" for s in _all(p, "pStyle")), "")
    level = re.fullmatch(r"[Hh]eading\s*([1-6])", style) or (re.fullmatch("([Tt])itle", style))
    if text and level:
        return "#" * (int(level[1]) if level[1].isdigit() else 1) + " " + text.replace("**", "")
    return f"- {text}" if text and next(_all(p, "numPr"), None) is not None else text


def _document(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    for body in _all(ElementTree.fromstring(z.read("word/document.xml")), "body"):
        for e in body:
            if _name(e) == "tbl":
                out += table_lines([[" ".join(filter(None, map(_paragraph, _all(c, "p")))) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"])
            else:
                out += [t for p in ([e] if _name(e) == "p" else _all(e, "p")) if (t := _paragraph(p))]
    return out


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((m for m in z.namelist() if re.fullmatch(pattern, m)), key=lambda m: int(re.findall(r"\d+", m)[-1]))


def _slides(z: zipfile.ZipFile) -> list[str]:
    out = []
    for n, member in enumerate(_numbered(z, r"ppt/slides/slide\d+\.xml"), 1):
        words = ["".join(t.text or "" for t in _all(p, "t")).strip() for p in _all(ElementTree.fromstring(z.read(member)), "p")]
        out += [f"## Slide {n}", *filter(None, words)]
    return out


def _column(ref: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", ref or "")
    at = 0
    for c in letters[0] if letters else "":
        at = at * 26 + ord(c) - 64
    return at - 1 if letters else after


def _sheets(z: zipfile.ZipFile) -> list[str]:
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
    titles = [_get(s, "name") for s in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")] if "xl/workbook.xml" in names else []
    out: list[str] = []
    for n, member in enumerate(_numbered(z, r"xl/worksheets/sheet\d+\.xml")):
        rows = []
        for row in _all(ElementTree.fromstring(z.read(member)), "row"):
            cells: list[str] = []
            for c in (c for c in row if _name(c) == "c"):
                value, kind = "".join(v.text or "" for v in _all(c, "v")), _get(c, "t")
                if kind == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                at = _column(_get(c, "r"), len(cells))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            rows.append(cells)
        lines = table_lines(rows)
        out += [f"## {titles[n] if n < len(titles) else f'Sheet {n + 1}'}", *lines] if lines else []
    return out


def _open_rows(table: ElementTree.Element) -> list[list[str]]:
    rows = []
    for r in _all(table, "table-row"):
        cells: list[str] = []
        held = 0  # empty cells so far; a sheet ends in thousands of them
        for c in (c for c in r if _name(c) in ("table-cell", "covered-table-cell")):
            text, times = " ".join(filter(None, ("".join(p.itertext()).strip() for p in _all(c, "p")))), int(_get(c, "number-columns-repeated") or 1)
            if text:
                cells += [""] * held + [text] * times
                held = 0
            else:
                held += times
        rows.append(cells)
    return rows


def _open(z: zipfile.ZipFile, kind: str) -> list[str]:
    out: list[str] = []

    def walk(e: ElementTree.Element, listed: bool) -> None:
        for x in e:
            name = _name(x)
            if name == "table":
                lines = table_lines(_open_rows(x))
                out.extend([f"## {_get(x, 'name')}", *lines] if kind == "ods" and lines else lines)
            elif name in ("h", "p"):
                text = "".join(x.itertext()).strip()
                head = "#" * min(6, int(_get(x, "outline-level") or 1)) + " " if name == "h" else "- " if listed else ""
                out.extend([head + text] if text else [])
            elif name == "page":
                out.append(f"## Slide {sum(line.startswith('## Slide ') for line in out) + 1}")
                walk(x, False)
            else:
                walk(x, listed or name == "list-item")

    for body in _all(ElementTree.fromstring(z.read("content.xml")), "body"):
        walk(body, False)
    return out


def _raw(z: zipfile.ZipFile, kind: str) -> list[str]:
    """Words between text tags, for XML that does not parse."""
    wanted = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/sharedStrings\.xml"}.get(kind, r"content\.xml")
    out = []
    for m in sorted((m for m in z.namelist() if re.fullmatch(wanted, m)), key=lambda m: [int(x) for x in re.findall(r"\d+", m)]):
        for part in re.split(r"</(?:w:p|a:p|si|text:p|text:h)>", z.read(m).decode("utf-8", "replace")):
            words = "".join(re.findall(r"<(?:w:t|a:t|t|text:p|text:h|text:span)(?:\s[^>]*)?>([^<]*)", part))
            out += [entities.unescape(words)] if words else []
    return out


def office_text(name: str, data: bytes) -> str:
    """Markdown of a file of one of KINDS: a line for each paragraph, list item, table row or slide text; sheets and slides have headings.

    A file whose XML does not parse gives its bare words, one that is no archive nothing.
    """
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            try:
                read = {"docx": _document, "pptx": _slides, "xlsx": _sheets}.get(kind)
                return "\n".join(read(z) if read else _open(z, kind))
            except (ElementTree.ParseError, KeyError):
                return "\n".join(_raw(z, kind))
    except zipfile.BadZipFile:
        return ""
