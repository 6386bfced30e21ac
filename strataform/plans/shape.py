"""Decisions and shapes: what the statistics at each path say about the structure there.

The statistics are few once paths are routed (``route``), so shapes are built on the driver.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import child, quote
from ..operators.signatures import parse as parse_signature
from ..operators.walk import SCALARS
from ..sources.storage import forget, materialize, together

#: Caps and thresholds (fixed values).
RECORD_CAP, POSITION_CAP, ARMS_CAP = 64, 32, 16
MAP_MIN_KEYS, MAP_KEY_RATIO = 16, 4
TUPLE_MAX, TUPLE_SHARE = 16, 0.9


@dataclass(frozen=True)
class Policy:
    """Caps of the analysis and when it ends.

    pool: "routed", keys kept before a record overflowed stay fields, or "all", every key of an overflowed object counts
    as a key of one map.
    """

    record_cap: int = RECORD_CAP
    position_cap: int = POSITION_CAP
    arms_cap: int = ARMS_CAP
    max_docs: int | None = None
    max_eviction_rate: float | None = None
    warm_up: int = 100
    pool: str = "routed"


def route(values: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(path, to, parent_to, step, is_index): where the statistics of each raw path belong.

    Level by level: of a path's keys the first ``record_cap`` by (first document, key) keep their field, others go to
    ``.*``; elements keep their position unless an array there is longer than ``position_cap``, then all go to ``[*]``.
    Each level is written before the next begins, so that no plan is longer than one level's.
    """
    paths = materialize(values.groupBy("path", "parent", "step", "is_index").agg(F.min("first").alias("first")))
    longest = materialize(values.where("kind = 'array'").groupBy("path").agg(F.max("max_size").alias("max_size")))
    level = materialize(paths.where("parent is null").select("path", F.col("path").alias("to"), F.lit(None).cast("string").alias("parent_to"), "step", "is_index"))
    done = [level]
    while True:
        up = level.select(F.col("path").alias("parent"), F.col("to").alias("parent_to"))
        below = paths.join(up, "parent").join(longest.withColumnRenamed("path", "parent"), "parent", "left")
        keys = below.where("not is_index").groupBy("parent_to", "step").agg(F.min("first").alias("first"))
        # of each salted part the first ones go on, so that no task sorts all keys of one path
        order = ("first", "step")
        part = keys.withColumn("salt", F.pmod(F.xxhash64("step"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("parent_to", "salt").orderBy(*order))).where(F.col("r") <= policy.record_cap + 1)
        kept = part.withColumn("r", F.row_number().over(Window.partitionBy("parent_to").orderBy(*order)))
        if policy.pool == "all":
            kept = kept.withColumn("many", F.max("r").over(Window.partitionBy("parent_to"))).where(F.col("many") <= policy.record_cap)
        kept = kept.where(F.col("r") <= policy.record_cap).select("parent_to", "step", F.lit(True).alias("kept"))
        size = F.max("max_size").over(Window.partitionBy("parent_to"))
        arrays = below.where("is_index").withColumn("max_size", size)
        pick = lambda d, ok: d.select("path", F.when(ok, child(F.col("parent_to"), F.when(~F.col("is_index"), F.col("step")), F.col("step"))).otherwise(F.concat(F.when(F.col("is_index") | (F.col("parent_to") != "."), F.col("parent_to")).otherwise(""), F.when(F.col("is_index"), "[*]").otherwise(".*"))).alias("to"), "parent_to", F.when(ok, F.col("step")).alias("step"), "is_index")
        level = materialize(pick(below.where("not is_index").join(kept, ["parent_to", "step"], "left"), F.col("kept").isNotNull()).union(pick(arrays, F.col("max_size") <= policy.position_cap)))
        if level.isEmpty():
            forget(paths, longest, level)
            return together(done)
        done.append(level)


def routed(values: DataFrame, buckets: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """The statistics at routed paths, merged."""
    from ..operators.stats import merge

    where = route(values, policy)
    v = values.drop("parent", "step", "is_index").join(where, "path").drop("path").withColumnRenamed("to", "path").withColumnRenamed("parent_to", "parent")
    b = buckets.join(where.select("path", "to"), "path").drop("path").withColumnRenamed("to", "path")
    return merge((v, b))


@dataclass
class Node:
    """Everything known of one routed path."""

    path: str
    parent: str | None = None
    step: str | None = None  # None for the root and wildcards
    is_index: bool = False
    kinds: dict[str, dict] = field(default_factory=dict)
    buckets: dict[str, dict[str, int]] = field(default_factory=lambda: defaultdict(dict))
    children: list[Node] = field(default_factory=list)

    @property
    def obs(self) -> int:
        return sum(r["n"] for r in self.kinds.values())

    @property
    def first(self) -> int:
        return min((r["first"] for r in self.kinds.values()), default=0)

    @property
    def last(self) -> int:
        return max((r["last"] for r in self.kinds.values()), default=0)

    @property
    def scalars(self) -> dict[str, int]:
        return {k: self.kinds[k]["n"] for k in SCALARS if k in self.kinds}

    def fields(self) -> list[Node]:
        return sorted((c for c in self.children if c.step is not None and not c.is_index), key=lambda c: (c.first, c.step))

    def positions(self) -> list[Node]:
        return sorted((c for c in self.children if c.step is not None and c.is_index), key=lambda c: int(c.step))

    def wildcard(self, index: bool) -> Node | None:
        return next((c for c in self.children if c.step is None and c.is_index == index), None)

    def number(self) -> dict | None:
        """Numbers of all numeric kinds together."""
        rows = [self.kinds[k] for k in ("i64", "u64", "f64") if k in self.kinds and self.kinds[k]["n_num"]]
        if not rows:
            return None
        total = {c: sum(r[c] for r in rows) for c in ("n_num", "sum", "n_neg", "n_zero", "n_pos", "n_whole")}
        return total | {"min": min(r["min"] for r in rows), "max": max(r["max"] for r in rows)}


_HEADS = ("skeleton", "key_skeleton", "signature")
#: Rows of statistics up to which routing happens on the driver; more are routed by joins.
DRIVER_ROWS = 20_000
_LEAST, _MOST = ("first", "min", "min_len", "min_size"), ("last", "max", "max_len", "max_size")


def _tree(values: list[dict], buckets: list[tuple[str, str, str, int]]) -> Node | None:
    """The tree of statistics at routed paths, equal ones merged."""
    nodes: dict[str, Node] = {}
    for r in values:
        node = nodes.setdefault(r["path"], Node(r["path"], r["parent"], r["step"], r["is_index"]))
        old = node.kinds.setdefault(r["kind"], r)
        if old is not r:
            for c, x in r.items():
                if c in _LEAST or c in _MOST:
                    old[c] = x if old[c] is None else old[c] if x is None else (min if c in _LEAST else max)(old[c], x)
                elif c.startswith(("n", "sum")):
                    old[c] = old[c] if x is None else x + (old[c] or 0)
    for path, measure, bucket, n in buckets:
        if path in nodes:
            counts = nodes[path].buckets[measure]
            counts[bucket] = counts.get(bucket, 0) + n
    for n in nodes.values():
        if n.parent in nodes:
            nodes[n.parent].children.append(n)
    return nodes.get(".")


def _heads(node: Node) -> None:
    for m in _HEADS:
        if (found := node.buckets.get(m)) and f"all_{m}" not in node.buckets:
            node.buckets[f"all_{m}"] = {"n": sum(found.values())}
            node.buckets[m] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:ARMS_CAP])
    for c in node.children:
        _heads(c)


def collect(values: DataFrame, buckets: DataFrame) -> Node | None:
    """The tree of routed statistics; None without documents. Long bucket lists (skeletons, keys) come as their heads."""
    top = buckets.withColumn("r", F.row_number().over(Window.partitionBy("path", "measure").orderBy(F.desc("n"), "bucket"))).where(F.col("measure").isin(*_HEADS) & (F.col("r") <= ARMS_CAP)).drop("r")
    rest = buckets.where(~F.col("measure").isin(*_HEADS))
    totals = buckets.where(F.col("measure").isin(*_HEADS)).groupBy("path", F.concat(F.lit("all_"), F.col("measure")).alias("measure"), F.lit("n").alias("bucket")).agg(F.sum("n").alias("n"))
    return _tree([r.asDict() for r in values.collect()], [tuple(r) for r in rest.unionByName(top).unionByName(totals).select("path", "measure", "bucket", "n").collect()])


def route_rows(values: list[dict], policy: Policy = Policy()) -> dict[str, tuple[str, str | None, str | None, bool]]:
    """``route`` for few rows: raw path to (to, parent_to, step, is_index)."""
    info, longest, below = {}, {}, defaultdict(list)
    for r in values:
        if r["path"] not in info:
            below[r["parent"]].append(r["path"])
        first = min(r["first"], info.get(r["path"], (0, False, r["first"]))[2])
        info[r["path"]] = r["step"], r["is_index"], first
        if r["kind"] == "array":
            longest[r["path"]] = max(longest.get(r["path"], 0), r["max_size"])
    out = {p: (p, None, None, False) for p in below[None]}
    level = {p: [p] for p in below[None]}  # raw paths by routed path
    while level:
        following: dict[str, list[str]] = defaultdict(list)
        for to, raws in level.items():
            members = [m for p in raws for m in below[p]]
            keys: dict[str, int] = {}
            for m in members:
                step, is_index, first = info[m]
                if not is_index:
                    keys[step] = min(first, keys.get(step, first))
            kept = set(sorted(keys, key=lambda k: (keys[k], k))[: policy.record_cap])
            if policy.pool == "all" and len(keys) > policy.record_cap:
                kept = set()
            flat = max((longest.get(p, 0) for p in raws), default=0) > policy.position_cap
            for m in members:
                step, is_index, _ = info[m]
                keep = not flat if is_index else step in kept
                name = f"[{step if keep else '*'}]" if is_index else "." + (quote(step) if keep else "*")
                at = ("" if to == "." and not is_index else to) + name
                out[m] = at, to, step if keep else None, is_index
                following[at].append(m)
        level = following
    return out


def collect_rows(values: list[dict], buckets: list[tuple[str, str, str, int]], policy: Policy = Policy()) -> Node | None:
    """``route`` and ``collect`` for few rows."""
    to = route_rows(values, policy)
    root = _tree([r | dict(zip(("path", "parent", "step", "is_index"), to[r["path"]], strict=True)) for r in values], [(to[p][0], m, b, n) for p, m, b, n in buckets])
    if root:
        _heads(root)
    return root


# ---- decisions


def is_map(node: Node) -> tuple[bool, str]:
    """Whether the objects at a node are maps, and why."""
    obj = node.kinds["object"]
    keys = len(node.fields())
    mean = obj["sum_size"] / max(obj["n"], 1)
    if node.wildcard(False) is not None:
        return True, f"more than {keys} keys" if keys else "too many keys"
    if keys >= MAP_MIN_KEYS and keys > MAP_KEY_RATIO * max(mean, 1.0):
        return True, f"{keys} keys at a mean of {mean:.1f}"
    return False, f"{keys} keys at a mean of {mean:.1f}"


def tuple_length(node: Node) -> tuple[int | None, str]:
    """The length of the tuple that the arrays at a node are, or None, and why."""
    lengths = {int(k): n for k, n in node.buckets["length"].items()}
    if not node.positions():
        return None, "no positions"
    mode = max(lengths, key=lambda k: (lengths[k], k))
    share = lengths[mode] / sum(lengths.values())
    if 1 <= mode <= TUPLE_MAX and share >= TUPLE_SHARE:
        return mode, f"{share:.1%} have length {mode}"
    return None, f"length {mode} has {share:.1%}"


# ---- shapes


@dataclass
class Shape:
    """kind: type, variant, tuple, absent, array, record, map.

    type has ``of`` (a leaf kind, or a whole struct/map/array of leaves as a Spark type); variant has arms; tuple and
    array have items; record has fields (name, shape, nullable); map has items[0], its value.
    """

    kind: str
    of: str | None = None
    items: list[Shape] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    nullable: list[bool] = field(default_factory=list)
    count: int = 0
    first: int = 0
    last: int = 0

    def has_null(self) -> bool:
        return self.kind == "type" and self.of == "null" or self.kind == "variant" and any(a.has_null() for a in self.items)

    def text(self) -> str:
        """A compact form on one line."""
        if self.kind == "type":
            return self.of
        inner = [a.text() for a in self.items]
        if self.kind == "record":
            return "{" + ", ".join(f"{n}{'?' if q else ''}: {t}" for n, q, t in zip(self.names, self.nullable, inner, strict=True)) + "}"
        return {"absent": "absent", "variant": " | ".join(inner), "tuple": f"({', '.join(inner)})", "array": f"[{''.join(inner)}]", "map": f"map<{''.join(inner)}>"}[self.kind]

    def as_dict(self) -> dict:
        return {"kind": self.kind, "of": self.of, "count": self.count, "first": self.first, "last": self.last, "names": self.names, "nullable": self.nullable, "items": [i.as_dict() for i in self.items]}


def _one_or_variant(arms: list[Shape], **stats) -> Shape:
    if not arms:
        return Shape("absent", **stats)
    return arms[0] if len(arms) == 1 else Shape("variant", items=arms, **stats)


def build(node: Node | None) -> Shape:
    """The shape at a node: its leaves in the order of kinds, then its objects, then its arrays."""
    if node is None:
        return Shape("absent")
    stats = {"count": node.obs, "first": node.first, "last": node.last}
    arms = [Shape("type", of=k, **stats | {"count": n}) for k, n in node.scalars.items()]
    if "object" in node.kinds:
        arms.append(_object(node, stats))
    if "array" in node.kinds:
        arms.append(_array(node, stats))
    return _one_or_variant(arms, **stats)


def _object(node: Node, stats: dict) -> Shape:
    if is_map(node)[0]:
        value = build(node.wildcard(False))
        if value.kind == "absent" and node.fields():
            most = max(node.fields(), key=lambda c: c.obs)  # the first of equals
            value = build(most)
        return Shape("map", items=[value], **stats)
    items = [build(c) for c in node.fields()]
    nullable = [c.obs < node.kinds["object"]["n"] or s.has_null() for c, s in zip(node.fields(), items, strict=True)]
    return Shape("record", items=items, names=[c.step for c in node.fields()], nullable=nullable, **stats)


def _array(node: Node, stats: dict) -> Shape:
    length, _ = tuple_length(node)
    if length:
        return Shape("tuple", items=[build(c) for c in node.positions()[:length]], **stats)
    arms = sorted(node.buckets["signature"].items(), key=lambda x: (-x[1], x[0]))
    shapes = [s for text, _ in arms for s in map(_from_signature, parse_signature(text))]
    distinct = list({s.text(): s for s in shapes}.values())
    order = {k: i for i, k in enumerate((*SCALARS, "record", "array"))}
    distinct.sort(key=lambda s: order.get(s.of or s.kind, 9))
    return Shape("array", items=[_one_or_variant(distinct)], **stats)


def _from_signature(arm: tuple) -> Shape:
    """No map, tuple or optional field is told from a signature."""
    kind, inner = arm
    if kind == "scalar":
        return Shape("type", of=inner)
    if kind == "array":
        return Shape("array", items=[_one_or_variant([_from_signature(a) for a in inner])])
    return Shape("record", items=[_one_or_variant([_from_signature(a) for a in v]) for _, v in inner], names=[k for k, _ in inner], nullable=[False] * len(inner))


_LEAVES = {"null": T.NullType(), "bool": T.BooleanType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "string": T.StringType()}


def is_plain(shape: Shape) -> bool:
    """Whether a shape is one value type through and through: no variant, tuple or absence in it."""
    return shape.kind in ("type", "record", "map", "array") and all(map(is_plain, shape.items))


def to_spark(shape: Shape, variants: bool = True) -> T.DataType:
    """The Spark type of a shape. Variants become VARIANT, or without ``variants`` their most frequent arm that isn't null."""
    if shape.kind == "type":
        return _LEAVES[shape.of]
    if shape.kind == "absent":
        return T.NullType()
    if shape.kind == "variant":
        arms = [a for a in shape.items if not (a.kind == "type" and a.of == "null")]
        if len(arms) == 1:
            return to_spark(arms[0], variants)
        return T.VariantType() if variants else to_spark(max(arms, key=lambda a: a.count), variants)
    if shape.kind == "record":
        return T.StructType([T.StructField(n, to_spark(s, variants), q) for n, s, q in zip(shape.names, shape.items, shape.nullable, strict=True)])
    if shape.kind == "map":
        return T.MapType(T.StringType(), to_spark(shape.items[0], variants), shape.items[0].has_null())
    if shape.kind == "array":
        return T.ArrayType(to_spark(shape.items[0], variants), shape.items[0].has_null())
    if not variants:
        return T.ArrayType(to_spark(shape.items[0], variants), True)
    return T.StructType([T.StructField(f"_{i}", to_spark(s, variants), s.has_null()) for i, s in enumerate(shape.items)])
