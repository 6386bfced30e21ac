"""The values at a set of path patterns, in one pass that only opens what a pattern leads into.

Patterns are laid into one trie. A row is a value with the trie node it has reached; each step replaces it by its members
that have an edge there: named fields and indices are fetched, members of wildcards exploded, everything else is skipped
unread. Values that are to be kept travel on as they are. There is one step for each level of the longest pattern, all in
one stage, and no table is read twice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import Step, child, parse, render, variant_path
from .walk import short_methods

_ROW = "struct<to:int,key:string,at:int,v:variant>"


def _trie(patterns: Iterable[str]) -> tuple[dict[str, int], dict[int, list[tuple[Step, int]]]]:
    """The node of each pattern, and the edges of each node; the root is node 0."""
    nodes, edges = {".": 0}, defaultdict(list)
    for steps in map(parse, patterns):
        for k in range(1, len(steps) + 1):
            name = render(steps[:k])
            if name not in nodes:
                nodes[name] = len(nodes)
                edges[nodes[render(steps[: k - 1])]].append((steps[k - 1], nodes[name]))
    return nodes, edges


def _next(edges: dict[int, list[tuple[Step, int]]], kept: set[int]) -> Column:
    """What a row (node, v) turns into: nodes, the keys or indices that lead there, and values (null where a named member
    isn't there). A kept value's node is -1 - node.

    Nothing here is a function of higher order, which Spark would interpret together with all around it.
    """
    node, v = F.col("node"), F.col("v")
    null = lambda kind: F.lit(None).cast(kind)
    one = lambda to, v, key=None, at=None: F.array(F.struct(to.cast("int").alias("to"), F.lit(key).cast("string").alias("key"), F.lit(at).cast("int").alias("at"), v.alias("v"))).cast(f"array<{_ROW}>")
    none = F.array().cast(f"array<{_ROW}>")

    def members(to: int, any_index: bool) -> Column:
        found = F.try_variant_get(v, "$", "array<variant>" if any_index else "map<string,variant>")
        n = F.size(found)
        key = F.array_repeat(null("string"), n) if any_index else F.map_keys(found)
        at = F.sequence(F.lit(0), n - 1) if any_index else F.array_repeat(null("int"), n)
        rows = F.arrays_zip(F.array_repeat(F.lit(to), n), key, at, found if any_index else F.map_values(found)).cast(f"array<{_ROW}>")
        return F.when(n > 0, rows).otherwise(none)

    out = F.when(node < 0, one(node, v))
    for at in sorted(set(edges) | kept):
        parts = [one(F.lit(-1 - at), v)] if at in kept else []
        for step, to in edges.get(at, ()):
            if step.kind in ("field", "index"):
                parts.append(one(F.lit(to), F.try_variant_get(v, variant_path(render([step])), "variant"), step.key, step.index))
            else:
                parts.append(members(to, step.kind == "any_index"))
        out = out.when(node == at, F.concat(*parts) if len(parts) > 1 else parts[0])
    return out.otherwise(none)


def locate(docs: DataFrame, patterns: Iterable[str], keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(*keep, pattern, path, v) of documents (*keep, v): every value whose path a pattern covers, once for each pattern.

    A JSON null is a value; a field that isn't there is none. Nothing is kept between rows, so streams can be read so too.
    """
    patterns = sorted({render(parse(p)) for p in patterns})
    nodes, edges = _trie(patterns)
    kept = {nodes[p] for p in patterns}
    short_methods(docs.sparkSession)
    known = [(n, name) for name, n in nodes.items() if not any(s.kind.startswith("any") for s in parse(name))]  # paths that need no look at the value
    rows = docs.select(*keep, F.lit(0).alias("node"), F.lit(".").alias("path"), "v")
    for _ in range(max((len(parse(p)) for p in patterns), default=0)):
        # an inner explode would have what it explodes worked out twice, as Spark asks for its size before
        rows = rows.select(*keep, "path", _next(edges, kept).alias("r")).select(*keep, "path", F.explode_outer("r").alias("r")).where("r.v is not null or r.to < 0")
        path = F.when(F.col("r.to") < 0, F.col("path"))
        for n, name in known:
            path = path.when(F.col("r.to") == n, name)
        rows = rows.select(*keep, F.col("r.to").alias("node"), path.otherwise(child(F.col("path"), F.col("r.key"), F.col("r.at"))).alias("path"), "r.v")
    ends = rows.withColumn("node", F.when(F.col("node") < 0, -1 - F.col("node")).otherwise(F.col("node"))).where(F.col("node").isin(*kept))
    pattern = F.lit(None).cast("string")
    for p in patterns:
        pattern = F.when(F.col("node") == nodes[p], p).otherwise(pattern)
    return ends.select(*keep, pattern.alias("pattern"), "path", "v")
