"""A compact, token-saving text form of documents.

Objects are ``key: value`` lines, nested by two blanks. An array of objects is a table,
``key[N]{a,b}:`` and one line of values for each; an array of plain values is ``key[N]: 1,2``.
Strings stand bare unless that would lose them. What the form can't hold plainly (nested values in
a table, strings like ``12`` or with signs of the form) is quoted as JSON, so that all that JSON can
say comes back as it was.
"""

from __future__ import annotations

import json
import re
from typing import Any

INDENT = 2
_BARE_KEY = re.compile(r"[^\s:,\[\]{}\"][^:,\[\]{}\"\n\r]*$")


def _bare(text: str) -> bool:
    """Whether a string may stand without quotes and come back as itself."""
    if not text or text != text.strip() or text in ("null", "true", "false", "[]", "{}"):
        return False
    if any(c in text for c in ',"\n\r\x0b\x0c\x1c\x1d\x1e\x85  ') or text[0] in "[{":
        return False
    return not _looks_like_number(text)


def _looks_like_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def _value(value: Any) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return value if _bare(value) else json.dumps(value)
    return str(value)


def _cell(value: Any) -> str:
    """A value inside a line; nested ones, and strings that begin like that, are JSON text behind a mark."""
    if isinstance(value, (dict, list, tuple)) or isinstance(value, str) and value.startswith("@"):
        return "@" + json.dumps(json.dumps(value))
    return _value(value)


def _key(key: str) -> str:
    return key if _BARE_KEY.match(key) and key == key.strip() else json.dumps(key)


def dumps(data: dict[str, Any], level: int = 0) -> str:
    """The text of an object."""
    if not isinstance(data, dict):
        raise TypeError("the top of a document is an object")
    pad = " " * (INDENT * level)
    lines: list[str] = []
    for key, value in data.items():
        name = _key(str(key))
        if isinstance(value, dict):
            lines.append(f"{pad}{name}:" if value else f"{pad}{name}: {_cell(value)}")
            if value:
                lines.append(dumps(value, level + 1))
        elif isinstance(value, (list, tuple)):
            lines.append(_array(name, list(value), pad))
        else:
            lines.append(f"{pad}{name}: {_cell(value)}")
    return "\n".join(lines)


def _array(name: str, items: list, pad: str) -> str:
    if not items:
        return f"{pad}{name}[0]:"
    inner = pad + " " * INDENT
    if all(isinstance(x, dict) for x in items):
        fields = list(dict.fromkeys(k for x in items for k in x))
        complete = all(len(x) == len(fields) for x in items)
        if fields:
            head = f"{pad}{name}[{len(items)}]{{{','.join(_key(str(f)) for f in fields)}}}:"
            return "\n".join([head, *(inner + ",".join(_cell(x.get(f)) if f in x or complete else "null" for f in fields) for x in items)])
    if any(isinstance(x, (dict, list, tuple)) for x in items):
        return "\n".join([f"{pad}{name}[{len(items)}]:", *(inner + _cell(x) for x in items)])
    return f"{pad}{name}[{len(items)}]: {','.join(_cell(x) for x in items)}"


class ToonError(ValueError):
    pass


def _scan_json(text: str, at: int) -> tuple[str, int]:
    try:
        value, end = json.JSONDecoder().raw_decode(text, at)
    except ValueError as e:
        raise ToonError(f"bad quoting in {text!r}") from e
    return value, end


def _cells(text: str) -> list[Any]:
    """The values of a line; a quote or mark opens a quoted cell, commas part cells."""
    out, at = [], 0
    while True:
        mark = text[at : at + 2] == '@"'
        if mark or text[at : at + 1] == '"':
            raw, end = _scan_json(text, at + mark)
            out.append(json.loads(raw) if mark else raw)
            if end < len(text) and text[end] != ",":
                raise ToonError(f"a comma is missing in {text!r}")
        else:
            end = text.find(",", at)
            end = len(text) if end < 0 else end
            out.append(_plain(text[at:end].strip()))
        if end >= len(text):
            return out
        at = end + 1


def _plain(text: str) -> Any:
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    try:
        return int(text)
    except ValueError:
        pass
    if _looks_like_number(text):
        return float(text)
    return text


def _name(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] == '"':
        return _scan_json(text, at)
    m = re.compile(r"[^:,\[\]{}\"]*").match(text, at)
    return m[0].strip(), m.end()


def loads(text: str) -> dict[str, Any]:
    """The object of a text; ``ToonError`` if it is none."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip(" \t\r")) for x in text.split("\n") if x.strip(" \t\r")]
    out, end = _object(lines, 0, 0)
    if end < len(lines):
        raise ToonError(f"unexpected indentation: {lines[end][1]!r}")
    return out


def _object(lines: list[tuple[int, str]], at: int, level: int) -> tuple[dict[str, Any], int]:
    out: dict[str, Any] = {}
    while at < len(lines) and lines[at][0] == level:
        line = lines[at][1]
        name, i = _name(line, 0)
        m = re.compile(r"\[(\d+)\]").match(line, i)
        if m:
            n, i = int(m[1]), m.end()
            fields = None
            if line[i : i + 1] == "{":
                fields, i = [], i + 1
                while True:
                    f, i = _name(line, i)
                    fields.append(f)
                    if line[i : i + 1] == "}":
                        i += 1
                        break
                    if line[i : i + 1] != ",":
                        raise ToonError(f"bad fields: {line!r}")
                    i += 1
            if line[i : i + 1] != ":":
                raise ToonError(f"a colon is missing: {line!r}")
            rest = line[i + 1 :].strip()
            at += 1
            if rest:
                out[name] = _cells(rest)
            else:
                rows = []
                while at < len(lines) and lines[at][0] > level and len(rows) < n:
                    cells = _cells(lines[at][1])
                    rows.append(dict(zip(fields, cells, strict=True)) if fields and len(cells) == len(fields) else cells[0] if fields is None and len(cells) == 1 else _bad(lines[at][1]))
                    at += 1
                out[name] = rows
            if len(out[name]) != n:
                raise ToonError(f"{name} has {len(out[name])} items, not {n}")
            continue
        if line[i : i + 1] != ":":
            raise ToonError(f"a colon is missing: {line!r}")
        rest = line[i + 1 :].strip()
        at += 1
        if not rest:
            if at < len(lines) and lines[at][0] > level:
                out[name], at = _object(lines, at, lines[at][0])
            else:
                out[name] = {}
        else:
            cells = _cells(rest) if rest[0] == '"' or rest.startswith('@"') else [_plain(rest)]
            if len(cells) != 1:
                raise ToonError(f"several values: {line!r}")
            out[name] = cells[0]
    return out, at


def _bad(line: str):
    raise ToonError(f"a row doesn't fit its fields: {line!r}")


def stats(documents: Any, text: str) -> dict[str, Any]:
    """Sizes in characters of the JSON and of this form, and the reduction in percent to one decimal."""
    size = len(json.dumps(documents))
    reduction = (size - len(text)) / size * 100 if size else 0.0
    return {"json_size": size, "toon_size": len(text), "reduction_percent": round(reduction, 1)}


def export(collection: str, documents: list[dict[str, Any]], exported_at: str | None = None) -> str:
    """The shape in which collections travel: name, documents, count and, if given, the time."""
    shape: dict[str, Any] = {"collection": collection, "documents": documents, "count": len(documents)}
    return dumps(shape | ({"exported_at": exported_at} if exported_at else {}))


def documents_of(data: Any) -> list[dict[str, Any]]:
    """Documents of an import: the list under ``documents``, a list, or one object."""
    if isinstance(data, str):
        data = loads(data)
    if isinstance(data, dict) and isinstance(data.get("documents"), list):
        return data["documents"]
    return list(data) if isinstance(data, list) else [data]

