"""Paths into documents, and patterns of them, as text and as steps.

``.`` is the root; a field is ``.name`` or ``."quoted name"``, an index ``[3]`` (``.[3]`` at the root); patterns also have
``.*`` and ``[*]``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    """A field (key), an index, or with neither a wildcard of the kind given."""

    kind: str  # field, index, any_field, any_index
    key: str | None = None
    index: int | None = None


def quote(name: str) -> str:
    if _NAME.fullmatch(name):
        return name
    return '"' + "".join(c if c >= " " and c != "\x7f" and c not in '"\\' else {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{{{ord(c):x}}}") for c in name) + '"'


def render(steps: list[Step]) -> str:
    out = ""
    for s in steps:
        if s.kind in ("field", "any_field"):
            out += "." + ("*" if s.kind == "any_field" else quote(s.key))
        else:
            out += ("." if not out else "") + ("[*]" if s.kind == "any_index" else f"[{s.index}]")
    return out or "."


_TOKEN = re.compile(r'\.(?:(?P<star>\*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|"(?P<quoted>(?:[^"\\]|\\.)*)")|\.?\[(?:(?P<any>\*)|(?P<index>[0-9]+))\]')
_ESCAPE = re.compile(r'\\(?:u\{([0-9a-fA-F]+)\}|(["\\/nrt0]))')
_PLAIN = {'"': '"', "\\": "\\", "/": "/", "n": "\n", "r": "\r", "t": "\t", "0": "\0"}


def parse(text: str, wildcards: bool = True) -> list[Step]:
    """Steps of a path or pattern; PathError tells what is wrong and where."""
    if not text:
        raise PathError("a path isn't empty; the root is '.'")
    if text == ".":
        return []
    steps: list[Step] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (m[0].startswith(".[") and steps) or (m[0].startswith("[") and not steps):
            raise PathError(f"unexpected {text[at:at + 8]!r} at {at} of {text!r}")
        if (m["star"] or m["any"]) and not wildcards:
            raise PathError(f"wildcard at {at} of the path {text!r}")
        if m["star"]:
            steps.append(Step("any_field"))
        elif m["any"]:
            steps.append(Step("any_index"))
        elif m["index"] is not None:
            steps.append(Step("index", index=int(m["index"])))
        else:
            key = m["name"]
            if key is None:
                if re.sub(_ESCAPE, "", m["quoted"]).count("\\"):
                    raise PathError(f"unknown escape in {m['quoted']!r}")
                key = _ESCAPE.sub(lambda e: chr(int(e[1], 16)) if e[1] else _PLAIN[e[2]], m["quoted"])
            steps.append(Step("field", key=key))
        at = m.end()
    return steps


def matches(pattern: list[Step], path: list[Step]) -> bool:
    """Whether a pattern covers a path."""
    any_of = {"any_field": "field", "any_index": "index"}
    return len(pattern) == len(path) and all(p == q or any_of.get(p.kind) == q.kind for p, q in zip(pattern, path, strict=True))


def to_path(pattern: list[Step]) -> list[Step]:
    """A pattern without wildcards as a path."""
    return parse(render(pattern), wildcards=False)


def variant_path(text: str) -> str:
    """The path as ``variant_get`` takes it."""
    return "$" + "".join(f"[{s.index}]" if s.kind == "index" else f"[{json.dumps(s.key, ensure_ascii=False)}]" if "'" in s.key else f"['{s.key}']" for s in parse(text, wildcards=False))


def child(parent: Column, key: Column, index: Column) -> Column:
    """The path of a member of the value at ``parent``: a field if ``key`` isn't null."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    name = F.when(key.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), key).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    stem = F.when(parent == ".", "").otherwise(parent)
    return F.when(key.isNotNull(), F.concat(stem, F.lit("."), name)).otherwise(F.concat(parent, F.lit("["), index.cast("string"), F.lit("]")))
