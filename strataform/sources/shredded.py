"""Shredded tables: documents stored as typed columns for promoted (path, kind) and a residual variant for the rest.

A value goes to its column if it is of the promoted kind and comes back as the same JSON text; everything else, other
kinds and odd spellings of numbers included, stays in the residual at its place. So a document is read back exactly, and
a query of promoted paths reads their columns and, where these are null, the residual.

Each row also has a sidecar, one number whose bits say what there is in the document (``SIDECAR_BITS`` of them: for each
chosen path whether it is there, and whether it is of a kind). Predicates compile to tests on it in ``plans.predicates``.
Rows are kept in the order of their numbers, so the files' own statistics serve ranges of documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parse, render, variant_path
from ..operators.walk import kind
from .storage import forget, materialize

TYPES = {"bool": "boolean", "i64": "long", "u64": "decimal(20,0)", "f64": "double", "string": "string"}
#: The variant types that a column takes values of.
_SCHEMAS = {"bool": "^BOOLEAN$", "i64": "^BIGINT$", "u64": "^DECIMAL", "f64": "^(DECIMAL|DOUBLE)", "string": "^STRING$"}
#: Bits of a sidecar; the sign's is left alone.
SIDECAR_BITS = 63


@dataclass(frozen=True)
class Layout:
    """Promoted (path, kind), each path of fields and none within another, and the facts that sidecar bits stand for:
    (path, kind), or (path, "") for whether it is there at all."""

    columns: tuple[tuple[str, str], ...] = ()
    facts: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple((render(parse(p)), k) for p, k in self.columns))
        object.__setattr__(self, "facts", tuple((render(parse(p)), k) for p, k in self.facts))
        steps = [parse(p) for p, _ in self.columns]
        if any(not s or any(x.kind != "field" for x in s) for s in steps) or any(k not in TYPES for _, k in self.columns):
            raise ValueError("columns are for scalars at paths of fields")
        if any(a != b and a == b[: len(a)] for a in steps for b in steps) or len(set(map(render, steps))) < len(steps):
            raise ValueError("a column within another, or two for a path")
        if len(self.facts) > SIDECAR_BITS:
            raise ValueError(f"more than {SIDECAR_BITS} facts")

    def column(self, path: str) -> str | None:
        """The name of a path's column."""
        return next((f"c{i}" for i, (p, _) in enumerate(self.columns) if p == path), None)

    def bit(self, path: str, kind: str = "") -> int | None:
        return self.facts.index((path, kind)) if (path, kind) in self.facts else None

    def as_json(self) -> str:
        return json.dumps({"columns": self.columns, "facts": self.facts}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Layout:
        read = json.loads(text)
        return cls(tuple(map(tuple, read["columns"])), tuple(map(tuple, read["facts"])))


def layout_of(plan: DataFrame, facts: Iterable[tuple[str, str]] | None = None, most: int = 200) -> Layout:
    """The layout of a promotion plan (path, kind, n): the ``most`` most frequent, of two kinds at a path the more frequent
    one. Without ``facts`` the sidecar tells of each column's path whether it is there and of the column's kind."""
    rows = plan.orderBy(F.desc("n"), "path", "kind").limit(most).collect()
    chosen: dict[str, str] = {}
    for r in rows:
        chosen.setdefault(r["path"], r["kind"])
    columns = tuple(sorted(chosen.items()))
    return Layout(columns, tuple(facts) if facts is not None else tuple(f for p, k in columns for f in ((p, ""), (p, k)))[:SIDECAR_BITS])


def _tree(layout: Layout) -> dict:
    """Columns by the keys that lead to them."""
    tree: dict = {}
    for i, (path, _) in enumerate(layout.columns):
        at, steps = tree, parse(path)
        for s in steps[:-1]:
            at = at.setdefault(s.key, {})
        at[steps[-1].key] = f"c{i}"
    return tree


def _variant(x: Column) -> Column:
    return x.cast("variant")


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _fits(v: Column, of: str) -> Column:
    """A variant as a column's type if it is of that kind and comes back the same, else null."""
    typed = F.try_variant_get(v, "$", TYPES[of])
    schema = F.schema_of_variant(v)
    return F.when(schema.rlike(_SCHEMAS[of]) & (F.to_json(_variant(typed)) == F.to_json(v)), typed)


def _rest(v: Column, tree: dict, where: str = "") -> Column:
    """``v`` without what its columns hold."""

    def kept(m: Column) -> Column:
        value = m["value"]
        for key, sub in tree.items():
            if isinstance(sub, dict):
                value = F.when(m["key"] == key, _rest(m["value"], sub)).otherwise(value)
        return F.struct(m["key"].alias("key"), value.alias("value"))

    leaves = [(key, c) for key, c in tree.items() if isinstance(c, str)]
    members = F.map_entries(_as_map(v))
    if leaves:
        members = F.filter(members, lambda m: ~F.coalesce(*(F.when((m["key"] == key) & F.col(c).isNotNull(), F.lit(True)) for key, c in leaves), F.lit(False)))
    return F.when(_as_map(v).isNull(), v).otherwise(F.to_variant_object(F.map_from_entries(F.transform(members, kept))))


def _whole(v: Column, tree: dict) -> Column:
    """The document of a residual: columns go back to their places."""

    def whole(m: Column) -> Column:
        value = m["value"]
        for key, sub in tree.items():
            if isinstance(sub, dict):
                value = F.when(m["key"] == key, _whole(m["value"], sub)).otherwise(value)
        return F.struct(m["key"].alias("key"), value.alias("value"))

    leaves = [F.when(F.col(c).isNotNull(), F.struct(F.lit(key).alias("key"), _variant(F.col(c)).alias("value"))) for key, c in tree.items() if isinstance(c, str)]
    members = F.transform(F.map_entries(_as_map(v)), whole)
    members = F.concat(members, F.array_compact(F.array(*leaves))) if leaves else members
    return F.when(_as_map(v).isNull(), v).otherwise(F.to_variant_object(F.map_from_entries(members)))


def sidecar(v: Column, layout: Layout) -> Column:
    """The bits of a document."""
    bits = F.lit(0).cast("long")
    for i, (path, of) in enumerate(layout.facts):
        at = F.try_variant_get(v, variant_path(path), "variant") if path != "." else v
        holds = at.isNotNull() & (F.lit(True) if not of else kind(at) == of)
        bits = bits.bitwiseOR(F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def shred(docs: DataFrame, layout: Layout) -> DataFrame:
    """(ord, c0, c1, ..., sidecar, residual) of documents (ord, v)."""
    typed = {f"c{i}": _fits(F.try_variant_get("v", variant_path(p), "variant"), k) for i, (p, k) in enumerate(layout.columns)}
    rows = docs.select("ord", "v").withColumns(typed) if typed else docs.select("ord", "v")
    return rows.select("ord", *typed, sidecar(F.col("v"), layout).alias("sidecar"), (_rest(F.col("v"), _tree(layout)) if typed else F.col("v")).alias("residual"))


def whole(rows: DataFrame, layout: Layout) -> DataFrame:
    """The documents (ord, v) of shredded rows."""
    return rows.select("ord", (_whole(F.col("residual"), _tree(layout)) if layout.columns else F.col("residual")).alias("v"))


def value(path: str, layout: Layout) -> Column:
    """The variant at a path of shredded rows, null where there is none: its column, or what the residual has there.

    A path that leads to or through columns only in part needs the whole document.
    """
    path = render(parse(path))
    name, steps = layout.column(path), parse(path)
    if name:
        return F.coalesce(_variant(F.col(name)), F.try_variant_get("residual", variant_path(path), "variant"))
    within = any(parse(p)[: len(steps)] == steps for p, _ in layout.columns)
    v = _whole(F.col("residual"), _tree(layout)) if within else F.col("residual")
    return F.try_variant_get(v, variant_path(path), "variant") if steps else v


def write(docs: DataFrame, layout: Layout, path: str, files: int | None = None) -> None:
    """Store documents under ``path``: their rows, in the order of their numbers, and the layout."""
    shredded = materialize(shred(docs, layout))  # ranges come from a look at all rows before they are dealt
    rows = shredded.repartitionByRange(files, "ord") if files else shredded.repartitionByRange("ord")
    rows.sortWithinPartitions("ord").write.mode("overwrite").parquet(f"{path}/rows")
    forget(shredded)
    docs.sparkSession.createDataFrame([(layout.as_json(),)], "layout string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Layout]:
    """The shredded rows of a stored table, and their layout."""
    return spark.read.parquet(f"{path}/rows"), Layout.from_json(spark.read.parquet(f"{path}/layout").first()["layout"])
