import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataform.functions.paths import parse, render
from strataform.plans import tiling
from strataform.plans.predicates import And, Compare, Exists, IsKind, Not, Or, matching, skipping, unpushed
from strataform.sources import shredded
from strataform.sources.shredded import Layout, layout_of

from test_assertions import any_value, as_docs, kind, walked

VALUES = [any_value(random.Random(i), 3) for i in range(160)] + [{"a": {"b": random.Random(i).choice([i, "t", 1.5, None, True, 2**63, 1e300, 7.0, {}, []]), "k 1": i % 3}, "b": i % 2} for i in range(140)]


def pattern(steps):
    return "".join("[*]" if s.kind == "index" and k else ".[*]" if s.kind == "index" else render([s]) for k, s in enumerate(steps)) or "."


def kind_of(v):
    return "u64" if isinstance(v, int) and not isinstance(v, bool) and v >= 2**63 else kind(v)


@pytest.fixture(scope="module")
def docs(spark):
    return as_docs(spark, VALUES).withColumn("ord", F.col("ord") * 37).repartition(3)  # over six tiles


@pytest.fixture(scope="module")
def header(docs):
    return tiling.headers(docs).cache()


def test_headers_say_what_tiles_hold(header):
    have, nulls, kinds = defaultdict(set), defaultdict(set), defaultdict(int)
    for i, doc in enumerate(VALUES):
        for steps, v in walked(doc):
            at = (i * 37 // tiling.TILE, pattern(steps))
            have[at].add(i * 37)
            kinds[(*at, kind_of(v))] += 1
            if v is None:
                nulls[at].add(i * 37)
    rows = header.collect()
    assert {(r["tile"], r["path"]): (r["n"], r["n_null"]) for r in rows} == {k: (len(x), len(nulls[k])) for k, x in have.items()}
    assert {(r["tile"], r["path"], k): n for r in rows for k, n in r["kinds"].items()} == dict(kinds)
    assert {r["docs"] for r in rows} == {len(have[t, "."]) for t in range(6)}
    for bitmap, want in (("present", have), ("nulls", nulls)):
        got = defaultdict(set)
        for r in tiling.documents_of(header, bitmap).collect():
            got[r["tile"], r["path"]].add(r["ord"])
        assert got == {k: x for k, x in want.items() if x}


def test_bloom_filters_miss_nothing(spark, header):
    blooms = tiling.blooms(header)
    assert header.join(blooms, "tile").where(~tiling.may_hold(F.col("path"))).count() == 0
    others = header.select("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat("path", F.lit("?"), i.cast("string")))).alias("path"))
    r = others.join(blooms, "tile").agg(F.count("*").alias("n"), F.count_if(tiling.may_hold(F.col("path"))).alias("let")).first()
    assert r["let"] < 0.05 * r["n"]


def test_promotion_counts_documents(header):
    n = defaultdict(int)
    for doc in VALUES:
        for steps, v in walked(doc):
            if all(s.kind == "field" for s in steps):
                n[render(steps), kind_of(v)] += 1
    for share in (0.1, 0.3):
        got = {(r["path"], r["kind"]): r["n"] for r in tiling.promotion(header, share).collect()}
        assert got == {k: c for k, c in n.items() if c > share * len(VALUES) and k[1] not in ("null", "object", "array")}
    assert layout_of(tiling.promotion(header, 0.1)).columns


LAYOUTS = [Layout(), Layout(((".a.b", "f64"), ('.a."k 1"', "i64"), (".b", "i64"))), Layout(((".a", "string"), ('."it\'s"', "f64"), ('."q\\""', "bool"), (".b", "string"))), Layout(((".a.b", "u64"), (".b.a.b", "i64"), ('."*".a', "i64")))]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_shredded_documents_come_back(spark, docs, layout, tmp_path):
    shredded.write(docs, layout, str(tmp_path), files=3)
    rows, read = shredded.read(spark, str(tmp_path))
    assert read == layout and rows.columns == ["ord", *(f"c{i}" for i in range(len(layout.columns))), "sidecar", "residual"]
    text = lambda df: {r["ord"]: r["t"] for r in df.select("ord", F.to_json("v").alias("t")).collect()}
    assert text(shredded.whole(rows, read)) == text(docs)
    if layout is LAYOUTS[1]:
        got = rows.agg(F.count("c0"), F.count("c1"), F.count("c2"), F.count_if(F.to_json("residual").contains("k 1"))).first()
        fits = [v["a"]["b"] for v in VALUES[160:]]
        assert got[0] >= sum(v in (1.5, 1e300) for v in fits) and got[1] >= 140 and got[2] >= 140 and got[3] < 20


def test_layouts_are_checked():
    for bad in (((".a", "i64"), (".a.b", "i64")), ((".a", "i64"), (".a", "string")), ((".a[0]", "i64"),), ((".", "i64"),), ((".a", "object"),)):
        with pytest.raises(ValueError):
            Layout(bad)
    assert Layout.from_json(LAYOUTS[2].as_json()) == LAYOUTS[2]


PATHS = [".", ".a", ".b", ".a.b", '.a."k 1"', ".a[0]", ".[1]", ".b.a"]


def any_predicate(r, depth):
    k = r.randrange(6 if depth else 3)
    path = r.choice(PATHS)
    if k == 0:
        return Exists(path)
    if k == 1:
        return IsKind(path, r.choice(["null", "i64", "f64", "string", "object", "array"]))
    if k == 2:
        return Compare(path, r.choice(["=", "<", ">="]), r.choice([0, 1, 1.5, 70, "t", True]))
    if k == 3:
        return Not(any_predicate(r, depth - 1))
    return (And, Or)[k - 4](tuple(any_predicate(r, depth - 1) for _ in range(r.randrange(1, 4))))


MISSING = object()


def at(doc, path):
    for s in parse(path):
        if s.kind == "field":
            doc = doc.get(s.key, MISSING) if isinstance(doc, dict) else MISSING
        else:
            doc = doc[s.index] if isinstance(doc, list) and s.index < len(doc) else MISSING
    return doc


def holds(p, doc):
    if isinstance(p, And):
        return all(holds(x, doc) for x in p.parts)
    if isinstance(p, Or):
        return any(holds(x, doc) for x in p.parts)
    if isinstance(p, Not):
        return not holds(p.part, doc)
    v = at(doc, p.path)
    if v is MISSING or isinstance(p, Exists):
        return v is not MISSING
    if isinstance(p, IsKind):
        return kind_of(v) == p.kind
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    same = type(v) is type(p.literal) or number(v) and number(p.literal)
    return same and {"=": v == p.literal, "<": v < p.literal, ">=": v >= p.literal}[p.op] if same else False


def test_no_match_fails_its_test(spark, docs):
    r = random.Random(2)
    wanted = {f"p{i}": any_predicate(r, 3) for i in range(40)}
    facts = ((".", "object"), (".a", ""), (".a", "object"), (".b", ""), (".b", "i64"), (".a.b", "string"), (".a[0]", ""), (".b", "f64"), (".b", "u64"), ('.a."k 1"', ""))
    layout = Layout(LAYOUTS[1].columns, facts)
    rows = shredded.shred(docs, layout).cache()
    got = {x["predicate"]: x for x in skipping(rows, wanted, layout).collect()}
    for name, p in wanted.items():
        hits = sum(holds(p, doc) for doc in VALUES)
        assert (got[name]["rows"], got[name]["hits"], got[name]["missed"]) == (len(VALUES), hits, 0), p
        test = p.test(layout)
        if test.exact:
            assert got[name]["let"] == hits
        if test.holds is None:
            assert got[name]["let"] == len(VALUES) and unpushed(p, layout)
    assert sum(g["let"] < g["rows"] for g in got.values()) > 10  # tests do skip rows
    p = wanted["p3"] & Exists(".a") | ~IsKind(".b", "i64")
    assert matching(rows, p, layout).count() == sum(holds(p, doc) for doc in VALUES)
    assert unpushed(~Compare(".b", "<", 1), layout)[0][1].startswith("what it negates")


def test_headers_walk_documents_once(spark, docs):
    found = tiling.promotion(tiling.headers(docs.select("ord", F.parse_json(F.to_json("v")).alias("v"))))
    assert "parsejson" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")


def test_documents_are_shredded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return f'{{"n": {n}}}'

    docs = spark.range(40).select(F.col("id").alias("ord"), F.parse_json(text("id")).alias("v"))
    shredded.write(docs, Layout((), ()), str(tmp_path / "t"))
    assert seen.value == 40 and spark.read.parquet(str(tmp_path / "t/rows")).count() == 40
