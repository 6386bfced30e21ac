import json
import random
from collections import defaultdict

import pytest

from strataform.functions.paths import Step, matches, parse, render
from strataform.operators.locate import locate
from strataform.operators.signatures import signature
from strataform.plans.assertions import Assertion, violations
from strataform.sources.documents import from_json


def as_docs(spark, values):
    return from_json(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string"), "t", "i")


def walked(value, steps=()):
    yield list(steps), value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walked(v, (*steps, Step("field", key=k)))
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, (*steps, Step("index", index=i)))


def kind(v):
    return "null" if v is None else "bool" if isinstance(v, bool) else "i64" if isinstance(v, int) else "f64" if isinstance(v, float) else {str: "string", list: "array", dict: "object"}[type(v)]


def any_value(r, depth):
    k = r.randrange(9 if depth else 5)
    if k < 5:
        return (None, True, r.randrange(3), r.random(), "t" * r.randrange(3))[k]
    if k < 7:
        return [any_value(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b", "k 1", "it's", 'q"', "*"]): any_value(r, depth - 1) for _ in range(r.randrange(4))}


def sequential(values, assertions):
    """The violations, document by document."""
    out, seen, bad, counts = [], defaultdict(set), defaultdict(int), defaultdict(int)
    for i, doc in enumerate(values):
        for a in assertions:
            broken = []
            for steps, v in walked(doc):
                if not matches(parse(a.pattern), steps):
                    continue
                k, inner = kind(v), {kind(x) for x in v} - {"null"} if isinstance(v, list) else set()
                ok = {"type": k in a.expect, "arm": a.target == "arm" and signature(v) in a.expect, "list": k == "array", "bag": k == "array" and len(inner) <= 1}.get(a.target, k == ("object" if a.target in ("record", "map") else "array"))
                if not ok:
                    broken.append(render(steps))
                    continue
                items = {"record": lambda v: list(v), "map": lambda v: [kind(x) for x in v.values() if x is not None], "tuple": lambda v: [len(v)], "order": lambda v: [(j, kind(x)) for j, x in enumerate(v) if x is not None]}.get(a.target, lambda v: [])(v)
                seen[a.id].update(items)
            if broken:
                bad[a.id] += 1
                if bad[a.id] > a.tolerance:
                    out += [(a.id, "document", i, p, None) for p in broken]
            count = len(seen[a.id]) - (len({x[0] for x in seen[a.id]}) if a.target == "order" else 0)
            if count > max(counts[a.id], a.limit):
                bad[a.id, "line"] += 1
                if bad[a.id, "line"] == a.tolerance + 1:
                    out.append((a.id, "aggregate", i, a.pattern, count))
            counts[a.id] = count
    return sorted(out, key=str)


def test_locate_finds_what_patterns_cover(spark):
    r = random.Random(7)
    values = [any_value(r, 4) for _ in range(150)]
    patterns = [".", ".a", ".*", ".*.*", ".a[*]", ".[*]", ".[1]", '."k 1".b', '."it\'s"', ".b[0].*", ".*[*].a", '."q\\""']
    got = sorted((x["ord"], x["pattern"], x["path"], x["j"]) for x in locate(as_docs(spark, values), patterns).selectExpr("ord", "pattern", "path", "to_json(v) j").collect())
    want = sorted((i, p, render(s), v) for i, doc in enumerate(values) for s, v in [(s, json.dumps(v)) for s, v in walked(doc)] for p in patterns if matches(parse(p), s))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [json.loads(x[3]) if x[3] else None for x in got] == [json.loads(x[3]) for x in want]
    assert locate(as_docs(spark, values), []).count() == 0


@pytest.mark.parametrize("tolerance", [0, 2])
def test_violations_are_those_of_a_sequential_reading(spark, tolerance):
    r = random.Random(11 + tolerance)
    values = [{"v": any_value(r, 1), "o": {f"k{r.randrange(40)}": r.choice([1, 2, None, "s"][: 2 + i // 60]) for _ in range(r.randrange(4))} if i % 17 else [], "l": [r.choice([1, None, "x"][: 1 + i // 30]) for _ in range(2 + (i > 90) * r.randrange(3))]} for i in range(150)]
    a = [
        Assertion("type", ".v", "type", ("i64", "f64"), tolerance),
        Assertion("arm", ".v", "arm", ("i64", "[i64]", "[]", "{}", "string"), tolerance),
        Assertion("list", ".v", "list", tolerance=tolerance),
        Assertion("bag", ".l", "bag", tolerance=tolerance),
        Assertion("record", ".o", "record", tolerance=tolerance, cap=12),
        Assertion("map", ".o", "map", tolerance=tolerance),
        Assertion("tuple", ".l", "tuple", tolerance=tolerance),
        Assertion("order", ".l", "order", tolerance=tolerance),
        Assertion("never", ".v", "record", tolerance=1000),
        Assertion("nowhere", ".no.where[*]", "list"),
    ]
    found = violations(as_docs(spark, values).repartition(5), a)
    got = sorted(((x["assertion"], x["mode"], x["ord"], x["path"], x["tipped_at"]) for x in found.collect()), key=str)
    assert got == sequential(values, a)
    shown = found.where("assertion = 'list'").collect()
    assert all(kind(json.loads(x["observed"]) if x["observed"] else None) != "array" and x["shape"] for x in shown)
    assert violations(as_docs(spark, values).where("ord < 0"), a).count() == 0


def test_assertions_are_checked(spark):
    for bad in (("x", ".", "shape"), ("x", ".", "type"), ("x", ".", "type", ("int",)), ("x", ".", "arm"), ("x", ".", "list", (), -1)):
        with pytest.raises(ValueError):
            Assertion(*bad)
    with pytest.raises(ValueError):
        violations(as_docs(spark, [1]), [Assertion("x", ".", "list"), Assertion("x", ".", "bag")])


def test_located_values_are_worked_out_once_and_not_interpreted(spark):
    plan = locate(as_docs(spark, [{"a": [1]}]), [".a", ".*[*]", ".a[0]"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_columns_that_are_kept_may_have_any_of_these_names(spark):
    docs = as_docs(spark, [{"a": [1]}]).selectExpr("ord", "ord as at", "'k' as key", "7L as to", "v")
    assert locate(docs, [".a[*]"], ("ord", "at", "key", "to")).drop("v").collect() == [(0, 0, "k", 7, ".a[*]", ".a[0]")]
