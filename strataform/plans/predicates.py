"""Predicates on documents, and the tests on a shredded row's sidecar that follow from them.

A test is necessary, not sufficient: a row that fails it cannot match, one that passes still has to be looked at. And and Or
put tests together; an Or with a part that has none has none; Not turns a test around only where it is exact, that is where
it says all that the predicate says, and has none otherwise. ``unpushed`` names the parts that gave no test, and why.

A predicate is true or false for every document: what isn't there has no kind and compares with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parse, render
from ..operators.walk import kind
from ..sources.shredded import Layout, value

_NUMBERS = ("i64", "u64", "f64")
_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True)
class Test:
    """A condition on the sidecar that holds for every match, none if ``holds`` is None; ``exact``: and for nothing else."""

    holds: Column | None = None
    exact: bool = False
    __test__ = False  # not a test case


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def _bit(layout: Layout, path: str, of: str = "") -> Column | None:
    at = layout.bit(path, of)
    return None if at is None else F.col("sidecar").bitwiseAND(F.lit(1 << at)) != 0


def _all(tests: list[Column]) -> Column | None:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def _reached(layout: Layout, path: str) -> Column | None:
    """That the path and what leads to it are there, as far as bits say; whatever lies below a value makes it a container."""
    steps, tests = parse(path), []
    for k in range(len(steps) + 1):
        at = render(steps[:k])
        tests += [b for b in (_bit(layout, at), _bit(layout, at, "object" if k < len(steps) and steps[k].kind == "field" else "array") if k < len(steps) else None) if b is not None]
    return _all(tests)


@dataclass(frozen=True)
class Exists(Predicate):
    path: str

    def exact(self, layout: Layout) -> Column:
        return value(self.path, layout).isNotNull()

    def test(self, layout: Layout) -> Test:
        own = _bit(layout, self.path)
        return Test(own, True) if own is not None else Test(_reached(layout, self.path))


@dataclass(frozen=True)
class IsKind(Predicate):
    path: str
    kind: str

    def exact(self, layout: Layout) -> Column:
        return F.coalesce(kind(value(self.path, layout)) == self.kind, F.lit(False))

    def test(self, layout: Layout) -> Test:
        own = _bit(layout, self.path, self.kind)
        return Test(own, True) if own is not None else Test(_reached(layout, self.path))


@dataclass(frozen=True)
class Compare(Predicate):
    """The value at a path against a number, a text or a truth value, of the same sort."""

    path: str
    op: str
    literal: float | int | str | bool

    def _kinds(self) -> tuple[str, ...]:
        return ("bool",) if isinstance(self.literal, bool) else ("string",) if isinstance(self.literal, str) else _NUMBERS

    def exact(self, layout: Layout) -> Column:
        v = value(self.path, layout)
        typed = F.try_variant_get(v, "$", {"bool": "boolean", "string": "string"}.get(self._kinds()[0], "double"))
        return F.coalesce(kind(v).isin(*self._kinds()) & _COMPARE[self.op](typed, F.lit(self.literal)), F.lit(False))

    def test(self, layout: Layout) -> Test:
        bits = [_bit(layout, self.path, k) for k in self._kinds()]
        reached = _reached(layout, self.path)
        if any(b is None for b in bits):
            return Test(reached)
        own = bits[0]
        for b in bits[1:]:
            own = own | b
        return Test(own if reached is None else own & reached)


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def exact(self, layout: Layout) -> Column:
        return _all([p.exact(layout) for p in self.parts])

    def test(self, layout: Layout) -> Test:
        tests = [p.test(layout) for p in self.parts]
        return Test(_all([t.holds for t in tests if t.holds is not None]), all(t.exact for t in tests))


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def exact(self, layout: Layout) -> Column:
        out = self.parts[0].exact(layout)
        for p in self.parts[1:]:
            out = out | p.exact(layout)
        return out

    def test(self, layout: Layout) -> Test:
        tests = [p.test(layout) for p in self.parts]
        if any(t.holds is None for t in tests):
            return Test()
        out = tests[0].holds
        for t in tests[1:]:
            out = out | t.holds
        return Test(out, all(t.exact for t in tests))


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def exact(self, layout: Layout) -> Column:
        return ~self.part.exact(layout)

    def test(self, layout: Layout) -> Test:
        inner = self.part.test(layout)
        return Test(~inner.holds, True) if inner.exact and inner.holds is not None else Test()


def matching(rows: DataFrame, wanted: Predicate, layout: Layout) -> DataFrame:
    """The shredded rows that match: the test on the sidecar first, then the predicate on what passes."""
    test = wanted.test(layout).holds
    return (rows if test is None else rows.where(test)).where(wanted.exact(layout))


def unpushed(wanted: Predicate, layout: Layout) -> list[tuple[Predicate, str]]:
    """The parts that gave no test, and why."""
    if isinstance(wanted, And | Or):
        found = [x for p in wanted.parts for x in unpushed(p, layout)]
        blocked = isinstance(wanted, Or) and wanted.test(layout).holds is None
        return found + [(wanted, "a part of it has no test")] * blocked
    if isinstance(wanted, Not):
        inner = wanted.part.test(layout)
        return [] if inner.exact else [(wanted, "what it negates has no exact test")]
    return [] if wanted.test(layout).holds is not None else [(wanted, f"no bit says anything of {wanted.path}")]


def skipping(rows: DataFrame, wanted: dict[str, Predicate], layout: Layout) -> DataFrame:
    """One row a predicate, all in one pass: rows, rows its test lets through, matches, matches that it misses (none), and
    of how many files some row is let through."""
    file = F.input_file_name()
    each = [F.struct(F.lit(name).alias("predicate"), (F.lit(True) if (t := p.test(layout).holds) is None else t).alias("let"), p.exact(layout).alias("hit")) for name, p in wanted.items()]
    found = rows.select(file.alias("file"), F.explode(F.array(*each)).alias("x")).select("file", "x.*")
    by_file = found.groupBy("predicate", "file").agg(F.count("*").alias("rows"), F.count_if("let").alias("let"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & ~F.col("let")).alias("missed"))
    return by_file.groupBy("predicate").agg(F.sum("rows").alias("rows"), F.sum("let").alias("let"), F.sum("hits").alias("hits"), F.sum("missed").alias("missed"), F.count("*").alias("files"), F.count_if(F.col("let") > 0).alias("files_let"))
