"""Front matter as typed data: blocks that are not quite at the top are found, link lists repaired, and a writer that is the reader's inverse.

A block opens with a line of three hyphens, at the start of a page or within its
first lines, as where a page was wrapped in a code fence. Its fields are read as
the part of YAML that pages use (scalars, quoted texts, lists and maps in lines or
in brackets, block texts) into texts and lists of texts, given as a VARIANT. What
is no YAML even after its link lists are quoted leaves the fields null, while the
block still counts as one.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last line on which a block may open.
LAST_OPENING = 6

_STRICT = re.compile(r"\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\Z)", re.S)
_ANYWHERE = re.compile(r"\n---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(r"\A\s*```(?:yaml|yml)?\s*\r?\n\Z", re.I)
_LINKS = re.compile(r"^(\s*[A-Za-z_][\w-]*\s*:\s*)(\[\[[^\]]+\]\](?:\s*,\s*\[\[[^\]]+\]\])+)\s*$")
_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s\[\]{},#&*!|>'"%@`?-][^#]*?|-[^\s:][^#]*?))[ \t]*:(?:[ \t]+(.*)|)\Z""")
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+\Z"), re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\Z")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "e": "\x1b", "N": "\x85", "_": "\xa0"}
#: Texts that need quotes: what is read as another kind or begins, ends or goes on as something else.
_PLAIN = re.compile(r"[^\s\[\]{},#&*!|>'\"%@`:?~-](?:[^\x00-\x1f\x7f]*[^\s\x00-\x1f\x7f:])?\Z")


class Malformed(ValueError):
    pass


def locate(content: str) -> tuple[str, str, str] | None:
    """The block's inner text, the whole block and the body behind it; None if there is no block."""
    m = _STRICT.match(content)
    if m:
        return m[1], m[0], content[m.end() :]
    m = _ANYWHERE.search(content)
    if not m or content.count("\n", 0, m.start() + 1) + 1 > LAST_OPENING:
        return None
    before, body = content[: m.start() + 1], content[m.end() :]
    if _FENCE.match(before):
        body = re.sub(r"\A\s*```\s*(?:\r?\n|\Z)", "", body)
    return m[1], m[0][1:], body


def repaired(payload: str) -> str:
    """payload whose lines ``key: [[a]], [[b]]`` are lists of quoted links."""
    def line(text: str) -> str:
        m = _LINKS.match(text)
        return text if not m else m[1] + "[" + ", ".join(f'"{x.strip()}"' for x in m[2].split(",") if x.strip()) + "]"

    return "\n".join(map(line, payload.split("\n")))


def _scalar(text: str):
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    return int(text) if _INT.match(text) else float(text) if _FLOAT.match(text) else text


def _quoted(text: str, at: int) -> tuple[str, int]:
    """A quoted text that begins at ``at``, and the place behind it."""
    mark, out, at = text[at], [], at + 1
    while at < len(text):
        c = text[at]
        if mark == "'" and text.startswith("''", at):
            out.append("'")
            at += 2
        elif c == mark:
            return "".join(out), at + 1
        elif mark == '"' and c == "\\" and at + 1 < len(text):
            n = {"x": 2, "u": 4, "U": 8}.get(text[at + 1], 0)
            try:
                out.append(chr(int(text[at + 2 : at + 2 + n], 16)) if n else _ESCAPES.get(text[at + 1], text[at + 1]))
            except ValueError:
                raise Malformed(text) from None
            at += 2 + n
        else:
            out.append(c)
            at += 1
    raise Malformed(text)


def _flow(text: str, at: int, inside: bool):
    """A value in one line that begins at ``at``, and the place behind it; inside: of brackets."""
    while at < len(text) and text[at] in " \t\n":
        at += 1
    if at < len(text) and text[at] in "\"'":
        return _quoted(text, at)
    if at < len(text) and text[at] in "[{":
        close, items = "]" if text[at] == "[" else "}", []
        at += 1
        while True:
            while at < len(text) and text[at] in " \t\n":
                at += 1
            if at >= len(text):
                raise Malformed(text)
            if text[at] == close:
                return (items if close == "]" else dict(items)), at + 1
            value, at = _flow(text, at, True)
            if close == "}":
                rest = re.compile(r"\s*:").match(text, at)
                key, value = value, None
                if rest:
                    value, at = _flow(text, rest.end(), True)
                value = ("" if key is None else str(key), value)
            items.append(value)
            while at < len(text) and text[at] in " \t\n":
                at += 1
            if at < len(text) and text[at] == ",":
                at += 1
            elif at >= len(text) or text[at] != close:
                raise Malformed(text)
    end = re.compile(r"(?:(?![,\[\]{}]|:(?:\s|\Z)|\s#).)*" if inside else r"(?:(?!\s#|:(?:\s|\Z)).)*", re.S).match(text, at).end()
    word = text[at:end].strip()
    if word[:1] in tuple("&*!|>%@`]},") and word or not inside and re.match(r":(?:\s|\Z)", text[end:]):
        raise Malformed(text)
    return _scalar(word), end


def _value(text: str):
    value, at = _flow(text, 0, False)
    if text[at:].strip() and not text[at:].lstrip().startswith("#") or text[at:].lstrip().startswith("#") and text[at : at + 1] not in " \t":
        raise Malformed(text)
    return value


def _open(text: str) -> bool:
    """Whether brackets or quotes are still open at the end of a value."""
    if text[:1] not in tuple("[{\"'") or not text:
        return False
    try:
        _flow(text, 0, False)
    except Malformed:
        return True
    return False


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _blank(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


class _Reader:
    def __init__(self, payload: str):
        self.lines = [x.rstrip("\r") for x in payload.split("\n")]
        self.at = 0

    def skip(self) -> None:
        while self.at < len(self.lines) and _blank(self.lines[self.at]):
            self.at += 1

    def block(self, indent: int):
        self.skip()
        if self.at >= len(self.lines):
            return None
        return self.items(indent) if re.match(r" *-(?:\s|\Z)", self.lines[self.at]) else self.fields(indent)

    def items(self, indent: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at >= len(self.lines) or _indent(self.lines[self.at]) < indent or not re.match(r" *-(?:\s|\Z)", self.lines[self.at]):
                return out
            line = self.lines[self.at]
            if _indent(line) != indent:
                raise Malformed(line)
            rest = line[indent + 1 :].strip()
            if rest and _KEY.match(rest) and rest[0] not in "[{\"'":
                self.lines[self.at] = " " * (indent + 2) + rest
                out.append(self.fields(indent + 2))
            else:
                out.append(self.value(rest, indent))

    def fields(self, indent: int) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.lines) or _indent(self.lines[self.at]) < indent:
                return out
            line = self.lines[self.at]
            m = _KEY.match(line.strip()) if _indent(line) == indent and "\t" not in line[:indent] else None
            if not m:
                raise Malformed(line)
            key = _quoted(f'"{m[1]}"', 0)[0] if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3]
            if key in out:
                raise Malformed(line)
            out[key] = self.value((m[4] or "").strip(), indent)

    def value(self, rest: str, indent: int):
        """What follows a key or a hyphen: on its line, and on deeper lines."""
        self.at += 1
        if re.match(r"[|>][-+]?[0-9]?[-+]?\s*\Z", rest):
            return self.text(rest, indent)
        if not rest or rest.startswith("#"):
            self.skip()
            if self.at < len(self.lines):
                deep = _indent(self.lines[self.at])
                if deep > indent or deep == indent and re.match(r" *-(?:\s|\Z)", self.lines[self.at]):
                    return self.block(deep)
            return None
        while self.at < len(self.lines) and (_open(rest) or self.lines[self.at].strip() and _indent(self.lines[self.at]) > indent and rest[0] not in "[{\"'"):
            rest += ("" if _open(rest) and rest[0] in "[{" else "") + " " + self.lines[self.at].strip()
            self.at += 1
        return _value(rest)

    def text(self, mark: str, indent: int) -> str:
        held = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or _indent(self.lines[self.at]) > indent):
            held.append(self.lines[self.at])
            self.at += 1
        deep = min((_indent(x) for x in held if x.strip()), default=0)
        held = [x[deep:] for x in held]
        body = "\n".join(held).rstrip("\n")
        if mark[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n| )", " ", body)
        return body if "-" in mark or not body else body + "\n"


def _shown(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, list | dict) else str(value)


def read_fields(payload: str) -> dict[str, str | list[str]] | None:
    """The fields of a block's inner text; None if it is no map of fields."""
    for text in (payload, repaired(payload)):
        reader = _Reader(text)
        try:
            made = reader.block(0)
            reader.skip()
            if reader.at < len(reader.lines):
                raise Malformed(text)
        except (Malformed, RecursionError):
            continue
        if not isinstance(made, dict):
            return None
        return {k: [_shown(x) for x in v] if isinstance(v, list) else _shown(v) for k, v in made.items()}
    return None


def _written(text: str) -> str:
    plain = _PLAIN.match(text) and isinstance(_scalar(text), str) and not re.search(r":\s|\s#|[\x85\u2028\u2029]", text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def write_page(fields: dict[str, str | list[str]], body: str) -> str:
    """A page of fields, in their order, and a body that ends in one line end."""
    lines = []
    for name, value in fields.items():
        key = name if re.fullmatch(r"\w(?:[\w -]*\w)?", name) else json.dumps(name, ensure_ascii=False)
        if isinstance(value, str):
            lines.append(f"{key}: {_written(value)}")
        elif value:
            lines += [f"{key}:", *(f"  - {_written(x)}" for x in value)]
        else:
            lines.append(f"{key}: []")
    return "---\n" + "".join(f"{x}\n" for x in lines) + f"---\n\n{re.sub(chr(92) + 's+' + chr(92) + 'Z', '', body)}\n"


def _parts(content: pd.Series) -> pd.DataFrame:
    rows = []
    for text in content:
        found = locate(text) if text else None
        fields = read_fields(found[0]) if found else None
        rows.append((found[1], found[2], None if fields is None else json.dumps(fields, ensure_ascii=False)) if found else ("", text, None))
    return pd.DataFrame(rows, columns=["block", "body", "fields"])


def _pages(fields: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([write_page({k: v if isinstance(v, list) else _shown(v) for k, v in json.loads(f).items()}, b or "") if f else b for f, b in zip(fields, body, strict=True)], dtype=object)


def front_matter(content: Column) -> Column:
    """block (with its marks; empty if there is none), body and fields (a VARIANT of texts and lists of texts, or null) of a page."""
    made = F.pandas_udf(_parts, "struct<block:string,body:string,fields:string>")(content)
    return F.struct(made["block"].alias("block"), made["body"].alias("body"), F.try_parse_json(made["fields"]).alias("fields"))


def page_text(fields: Column, body: Column) -> Column:
    """A page written from fields (a VARIANT object of texts and lists of texts) and a body; without fields the body as it is."""
    return F.pandas_udf(_pages, "string")(F.to_json(fields), body)
