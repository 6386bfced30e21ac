"""Shapes as rows and as JSON, and back.

``nodes`` gives a row for each node, for queries and for tables kept over time; ``from_nodes`` and ``Stored.from_json``
rebuild the shape. Parts that are one Spark type through and through can be kept as that type alone (``compressed``); such
a part is expanded again when it is read, its counts zero, as the type doesn't tell them.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.paths import quote
from .shape import Shape, is_plain, to_spark

NODE = "id int, parent int, position int, path string, kind string, of string, name string, nullable boolean, count long, first long, last long"
_OF = {T.NullType: "null", T.BooleanType: "bool", T.LongType: "i64", T.DecimalType: "u64", T.DoubleType: "f64", T.StringType: "string"}


def _below(shape: Shape, path: str) -> list[str]:
    """The paths of a shape's parts."""
    stem = "" if path == "." else path
    if shape.kind == "record":
        return [f"{stem}.{quote(n)}" for n in shape.names]
    if shape.kind == "variant":
        return [f"{path}|{a.of or a.kind}" for a in shape.items]
    steps = {"map": lambda i: f"{stem}.*", "array": lambda i: f"{path}[*]", "tuple": lambda i: f"{path}[{i}]"}
    return [steps[shape.kind](i) for i in range(len(shape.items))] if shape.items else []


def node_rows(shape: Shape) -> list[tuple]:
    """Rows of NODE, the root first; an arm of a variant is at the variant's path with its kind behind a bar."""
    rows: list[tuple] = []

    def add(s: Shape, parent: int | None, position: int | None, path: str, name: str | None, nullable: bool | None) -> None:
        own = len(rows)
        rows.append((own, parent, position, path, s.kind, s.of, name, nullable, s.count, s.first, s.last))
        for i, (x, below) in enumerate(zip(s.items, _below(s, path), strict=True)):
            add(x, own, i, below, *((s.names[i], s.nullable[i]) if s.kind == "record" else (None, None)))

    add(shape, None, None, ".", None, None)
    return rows


def nodes(spark: SparkSession, shape: Shape) -> DataFrame:
    return spark.createDataFrame(node_rows(shape), NODE)


def from_nodes(rows: DataFrame) -> Shape:
    """The shape of a table of nodes."""
    found = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["id"])
    below = defaultdict(list)
    for r in found:
        below[r["parent"]].append(r)

    def shape(r: dict) -> Shape:
        parts = sorted(below[r["id"]], key=lambda x: x["position"])
        record = r["kind"] == "record"
        return Shape(r["kind"], r["of"], [shape(x) for x in parts], [x["name"] for x in parts] if record else [], [x["nullable"] for x in parts] if record else [], r["count"], r["first"], r["last"])

    return shape(below[None][0])


def from_type(kind: T.DataType) -> Shape:
    """The shape that a Spark type tells, without counts."""
    if isinstance(kind, T.StructType):
        return Shape("record", items=[from_type(f.dataType) for f in kind], names=kind.names, nullable=[f.nullable for f in kind])
    if isinstance(kind, T.MapType):
        return Shape("map", items=[from_type(kind.valueType)])
    if isinstance(kind, T.ArrayType):
        return Shape("array", items=[from_type(kind.elementType)])
    if type(kind) not in _OF:
        raise ValueError(f"no shape has the type {kind.simpleString()}")
    return Shape("type", of=_OF[type(kind)])


@dataclass
class Stored:
    """A report as it is kept: the shape and what it was made of."""

    docs: int
    shape: Shape
    source: str = ""
    bailed: bool = False

    def as_json(self, compressed: bool = False) -> str:
        """``compressed``: containers that are one Spark type are kept as that type."""

        def told(s: Shape) -> dict:
            own = {"kind": s.kind, "count": s.count, "first": s.first, "last": s.last}
            if compressed and s.kind != "type" and is_plain(s):
                return own | {"type": to_spark(s).jsonValue()}
            return own | {"of": s.of, "names": s.names, "nullable": s.nullable, "items": [told(x) for x in s.items]}

        return json.dumps({"version": 1, "docs": self.docs, "source": self.source, "bailed": self.bailed, "shape": told(self.shape)}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Stored:
        """Reads what ``as_json`` here and ``Outcome.as_json`` write."""
        read = json.loads(text)
        if read.get("version") != 1:
            raise ValueError(f"a report of version {read.get('version')}")

        def shape(d: dict) -> Shape:
            stats = {"count": d["count"], "first": d["first"], "last": d["last"]}
            if "type" in d:
                kind = d["type"]
                typed = from_type(T._parse_datatype_json_value(kind))
                return Shape(typed.kind, typed.of, typed.items, typed.names, typed.nullable, **stats)
            return Shape(d["kind"], d["of"], [shape(x) for x in d["items"]], d["names"], d["nullable"], **stats)

        return cls(read["docs"], shape(read["shape"]), read["source"], read["bailed"])
