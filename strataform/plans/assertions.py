"""Declared expectations of a structure, and where documents break them.

An assertion says what is expected at a path pattern. Some speak of single values, so every value that breaks them is a
violation of its document: ``type`` (one of some kinds), ``arm`` (one of some signatures), ``list`` (an array), ``bag`` (an
array whose elements, nulls aside, have one kind). Others speak of all documents up to one, and break once, at the document
that takes them over a line: ``record`` (at most ``cap`` distinct keys), ``map`` (values, nulls aside, of one kind),
``tuple`` (arrays of one length), ``order`` (at each position of the arrays, nulls aside, one kind). A value of these that
isn't an object or an array at all is a violation of its document too.

``tolerance`` documents may break an assertion before it is reported: single violations are rows from the next such
document on; of a line it is the next document that goes further over it.

Only what the patterns lead into is read. What lines count (distinct keys, kinds, lengths) is reduced to each item's first
document before it is ordered, and ranks in that order are found by counts of blocks of documents, so that no
assertion's rows are sorted in one task, however many documents break it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parse, render
from ..operators.locate import locate
from ..operators.signatures import element_signature
from ..operators.walk import KINDS, kind
from ..sources.storage import materialize
from .shape import RECORD_CAP

SINGLE, LINES = ("type", "arm", "list", "bag"), ("record", "map", "tuple", "order")
#: Documents of one block of the count that ranks rest on.
_BLOCK_BITS = 16


@dataclass(frozen=True)
class Assertion:
    """``expect``: the kinds of ``type``, the signatures of ``arm``; ``cap``: the keys of ``record``."""

    id: str
    pattern: str
    target: str
    expect: tuple[str, ...] = ()
    tolerance: int = 0
    cap: int = RECORD_CAP

    def __post_init__(self):
        if self.target not in SINGLE + LINES:
            raise ValueError(f"{self.id}: no target {self.target!r}")
        if self.target == "type" and not set(self.expect) & set(KINDS) == set(self.expect) != set():
            raise ValueError(f"{self.id}: type expects some of {KINDS}")
        if self.target == "arm" and not self.expect:
            raise ValueError(f"{self.id}: arm expects a signature")
        if self.tolerance < 0 or self.cap < 0:
            raise ValueError(f"{self.id}: tolerance and cap aren't negative")
        object.__setattr__(self, "pattern", render(parse(self.pattern)))

    @property
    def limit(self) -> int:
        """Items that a line allows; of ``order`` only second kinds count."""
        return {"record": self.cap, "order": 0}.get(self.target, 1)


def _checked(docs: DataFrame, assertions: list[Assertion], keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(*keep, pattern, path, v, kind, signature): the values under the assertions' patterns."""
    rows = locate(docs, [a.pattern for a in assertions], keep).withColumn("kind", kind(F.col("v")))
    arms = [a.pattern for a in assertions if a.target == "arm"]
    of_arms = element_signature(F.when(F.col("pattern").isin(*arms), F.col("v"))) if arms else F.lit(None).cast("string")
    return rows.withColumn("signature", of_arms)


_ELEMENTS, _MEMBERS = "array<variant>", "map<string,variant>"


def _inner(values: Column) -> Column:
    """The kinds of some values, nulls aside."""
    return F.array_distinct(F.filter(F.transform(values, kind), lambda k: k != "null"))


def _holds(a: Assertion) -> Column:
    """Whether a row of ``_checked`` under the assertion's pattern keeps it, as far as the value alone tells."""
    if a.target == "type":
        return F.col("kind").isin(*a.expect)
    if a.target == "arm":
        return F.coalesce(F.col("signature").isin(*a.expect), F.lit(False))
    if a.target in ("record", "map"):
        return F.col("kind") == "object"
    found = F.col("kind") == "array"
    return found & (F.size(_inner(F.try_variant_get("v", "$", _ELEMENTS))) <= 1) if a.target == "bag" else found


def _broken(assertions: list[Assertion]) -> Column:
    """The ids of the assertions that a row of ``_checked`` breaks."""
    none = F.array().cast("array<string>")
    return F.concat(none, *(F.when((F.col("pattern") == a.pattern) & ~_holds(a), F.array(F.lit(a.id))).otherwise(none) for a in assertions))


def _of(assertions: list[Assertion], kind: str, what) -> Column:
    """``what`` of the assertion that a row is about."""
    out = F.lit(None).cast(kind)
    for a in assertions:
        out = F.when(F.col("assertion") == a.id, F.lit(what(a)).cast(kind)).otherwise(out)
    return out


def exceptions(docs: DataFrame, assertions: Iterable[Assertion], keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(*keep, refs, pattern, path, observed, shape): values that break assertions, with the ids of all these, sorted.

    Every row comes from one document alone, without tolerance or lines, so ``docs`` may be a stream.
    """
    assertions = sorted(assertions, key=lambda a: a.id)
    rows = _checked(docs, assertions, keep).withColumn("refs", _broken(assertions)).where(F.size("refs") > 0)
    return rows.select(*keep, "refs", "pattern", "path", F.to_json("v").alias("observed"), element_signature(F.col("v")).alias("shape"))


def _nth(rows: DataFrame, n: str) -> DataFrame:
    """(assertion, nth): the document of each assertion's row number ``n`` (a column, from 1) of (assertion, ord, n)."""
    block = F.shiftright("ord", _BLOCK_BITS)
    counts = rows.groupBy("assertion", block.alias("block")).agg(F.count("*").alias("here"), F.max(n).alias("n"))
    upto = F.sum("here").over(Window.partitionBy("assertion").orderBy("block"))
    at = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("here") < F.col("n")))
    at = F.broadcast(at.select("assertion", "block", (F.col("n") - F.col("upto") + F.col("here")).alias("rank")))  # one row an assertion
    within = rows.select("assertion", "ord", block.alias("block")).join(at, ["assertion", "block"])
    place = F.row_number().over(Window.partitionBy("assertion").orderBy("ord"))  # rows of one block
    return within.withColumn("place", place).where(F.col("place") == F.col("rank")).select("assertion", F.col("ord").alias("nth"))


def _single(docs: DataFrame, assertions: list[Assertion]) -> DataFrame:
    """Values that break their assertion, from the first document that isn't tolerated."""
    rows = _checked(docs, assertions).select("ord", "pattern", "path", "v", _broken(assertions).alias("ids"))
    rows = rows.select("ord", "pattern", "path", "v", F.explode_outer("ids").alias("assertion")).where("assertion is not null")
    broken = rows.select("assertion", _of(assertions, "string", lambda a: a.target).alias("target"), _of(assertions, "int", lambda a: a.tolerance).alias("tolerance"), "ord", "pattern", "path", "v")
    if any(a.tolerance for a in assertions):
        broken = materialize(broken)
        docs = broken.where("tolerance > 0").select("assertion", "ord", (F.col("tolerance") + 1).cast("long").alias("n")).distinct()
        start = F.broadcast(_nth(docs, "n"))
        broken = broken.join(start, "assertion", "left").where((F.col("tolerance") == 0) | (F.col("ord") >= F.col("nth")))
    return broken.select("assertion", "target", F.lit("document").alias("mode"), "ord", "pattern", "path", F.to_json("v").alias("observed"), element_signature(F.col("v")).alias("shape"), F.lit(None).cast("long").alias("tipped_at"))


def _items(docs: DataFrame, assertions: list[Assertion]) -> DataFrame:
    """(assertion, ord, item): what values add to their assertions' lines. Only these patterns are read, and members are
    looked at one by one."""
    none = F.array().cast("array<string>")
    about = F.concat(none, *(F.when(F.col("pattern") == a.pattern, F.array(F.lit(a.id))).otherwise(none) for a in assertions))
    rows = locate(docs, [a.pattern for a in assertions]).select("ord", "v", about.alias("ids")).select("ord", "v", F.explode_outer("ids").alias("assertion")).where("assertion is not null")
    of = lambda *targets: F.col("assertion").isin(*(a.id for a in assertions if a.target in targets))
    keyed = F.when(of("record", "map"), F.try_variant_get("v", "$", _MEMBERS))
    listed = F.when(of("tuple", "order"), F.try_variant_get("v", "$", _ELEMENTS))
    rows = rows.select("ord", "assertion", keyed.alias("_map"), listed.alias("_array"))
    # a tuple's item is its length; of a record's the keys are enough
    null = lambda kind, n: F.array_repeat(F.lit(None).cast(kind), n)
    row = "array<struct<key:string,value:variant>>"
    n = F.size("_map")
    members = F.when(of("record"), F.arrays_zip(F.map_keys("_map"), null("variant", n)).cast(row)).when(of("map"), F.arrays_zip(null("string", n), F.map_values("_map")).cast(row))
    members = members.when(of("tuple"), F.array(F.struct(F.size("_array").cast("string"), F.lit(None).cast("variant"))).cast(row)).otherwise(F.arrays_zip(null("string", F.size("_array")), F.col("_array")).cast(row))
    rows = rows.where("_map is not null or _array is not null").select("ord", "assertion", members.alias("ms")).select("ord", "assertion", F.posexplode_outer("ms").alias("pos", "m")).where("m is not null").select("ord", "assertion", "pos", "m.*")
    found = rows.withColumn("kind", F.when(of("map", "order"), kind(F.col("value"))))
    item = F.when(of("map"), F.col("kind")).when(of("order"), F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("kind"))).otherwise(F.col("key"))
    return found.where("kind is null or kind <> 'null'").select("assertion", "ord", item.alias("item"))


def _lines(docs: DataFrame, assertions: list[Assertion]) -> DataFrame:
    """The document that takes each broken line over, and how many items there were with it."""
    firsts = materialize(_items(docs, assertions).groupBy("assertion", "item").agg(F.min("ord").alias("ord")))
    firsts = firsts.select("*", _of(assertions, "string", lambda a: a.target).alias("target"), _of(assertions, "string", lambda a: a.pattern).alias("pattern"), _of(assertions, "int", lambda a: a.tolerance).alias("tolerance"), _of(assertions, "long", lambda a: a.limit).alias("allowed"))
    place = Window.partitionBy("assertion", F.substring_index("item", ":", 1)).orderBy("ord", "item")  # the kinds at one position
    second = firsts.where("target = 'order'").withColumn("k", F.row_number().over(place)).where("k > 1").drop("k")
    items = firsts.where("target <> 'order'").unionByName(second)
    over = _nth(items.withColumn("n", F.col("allowed") + 1), "n").withColumnRenamed("nth", "start")
    beyond = items.join(F.broadcast(over), "assertion").where("ord >= start").select("assertion", "ord", (F.col("tolerance") + 1).cast("long").alias("n")).distinct()
    tips = items.join(F.broadcast(_nth(beyond, "n")), "assertion").where(F.col("ord") <= F.col("nth"))
    found = tips.groupBy("assertion", "target", "pattern", "nth").agg(F.count("*").alias("tipped_at"))
    text = F.lit(None).cast("string")
    return found.select("assertion", "target", F.lit("aggregate").alias("mode"), F.col("nth").alias("ord"), "pattern", F.col("pattern").alias("path"), text.alias("observed"), text.alias("shape"), "tipped_at")


def violations(docs: DataFrame, assertions: Iterable[Assertion]) -> DataFrame:
    """Where documents (ord, v) break the assertions: assertion, target, mode (document, aggregate), ord, pattern, path,
    observed (the value as JSON) and shape (its signature) of single values, tipped_at of lines (items counted by then)."""
    assertions = list(assertions)
    if len({a.id for a in assertions}) < len(assertions):
        raise ValueError("assertions with the same id")
    found, lines = _single(docs, assertions), [a for a in assertions if a.target in LINES]
    return found.unionByName(_lines(docs, lines)) if lines else found
