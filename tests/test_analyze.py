import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.generate.documents import chaos
from strataform.operators import stats
from strataform.plans.analyze import Analyzer, analyze, outcome_of, shape_of, statistics
from strataform.plans.shape import Policy
from strataform.sources.documents import from_columns, from_json


def docs(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string")
    return from_json(rows, "t", "i")


def shape(spark, values, **policy):
    return analyze(docs(spark, values), Policy(**policy)).shape.text()


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([1, 2], "i64"),
        ([1, None], "null | i64"),
        ([{"b": 1, "a": "x"}, {"a": "y"}], "{a: string, b?: i64}"),
        ([{"a": None}, {"a": 1}], "{a?: null | i64}"),
        ([[1, "a"], [2, "b"]], "(i64, string)"),
        ([[1], [1, 2], [1, 2, 3]], "[i64]"),
        ([[], {}], "{} | [absent]"),
        ([2**63, 2**64 - 1], "u64"),
        ([1.5, 1.0, -3e300], "f64"),
        ([[{"x": 1}], [{"x": 1}, {"y": "s"}], []], "[{x: i64} | {y: string}]"),
        ([{f"k{i:03}": 1 for i in range(80)}], "map<i64>"),
        ([{f"u{i}-{j}": {"on": True} for j in range(3)} for i in range(10)], "map<{on: bool}>"),
        ([list(range(40))] * 3, "[i64]"),
    ],
)
def test_shapes(spark, values, want):
    assert shape(spark, values) == want


def test_empty(spark):
    out = analyze(docs(spark, [1]).where("false"))
    assert out.docs == 0 and out.shape.kind == "absent" and "No documents" in out.report()


def test_overflow_keeps_first_keys(spark):
    values = [{f"k{i:03}": i for i in range(3)}, {"z": "late"}]
    root = analyze(docs(spark, values), Policy(record_cap=2)).root
    assert [c.step for c in root.fields()] == ["k000", "k001"]
    assert root.wildcard(False).scalars == {"i64": 1, "string": 1}
    assert analyze(docs(spark, values), Policy(record_cap=2, pool="all")).root.fields() == []


def test_both_ways_of_routing(spark):
    values = [{"l": [{"x": 1}, [None]], "w": {f"k{i}": [i] for i in range(j, j + 3)}, "a": list(range(j))} for j in range(4)]
    for policy in (Policy(record_cap=4, position_cap=2), Policy(record_cap=4, pool="all")):
        parts = [x.persist() for x in statistics(docs(spark, values))]
        assert outcome_of(*parts, policy, driver_rows=0).report() == outcome_of(*parts, policy).report()


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_of_routing_random(spark, seed):
    r = random.Random(seed)
    parts = statistics(docs(spark, [chaos(r, 3, 4) for _ in range(25)]))
    policy = Policy(record_cap=r.randint(1, 6), position_cap=r.randint(0, 4), pool=r.choice(["routed", "all"]))
    assert outcome_of(*parts, policy, driver_rows=0).report() == outcome_of(*parts, policy).report()


def test_nested_maps(spark):
    values = [{f"a{i}{j}": {f"b{i}{j}{k}": {"on": True, "n": k} for k in range(8)} for j in range(10)} for i in range(20)]
    assert shape(spark, values) == "map<map<{n: i64, on: bool}>>"


def test_deep(spark):
    v = 1
    for i in range(60):
        v = {"next": v} if i % 2 else [v]
    assert analyze(docs(spark, [v] * 2)).root.kinds["object"]["n"] == 2


def test_partitions_do_not_matter(spark):
    d = docs(spark, [{"a": [i % 3, "x"], "b": {"c": i / 7}} if i % 2 else {"a": None} for i in range(50)])
    assert len({analyze(d.repartition(n)).report() for n in (1, 3, 7)}) == 1


def test_split_and_merge(spark, tmp_path):
    values = [{"a": i, "t": f"ORD-{i}", "l": [i] * (i % 4)} for i in range(30)]
    whole = analyze(docs(spark, values)).report()
    a = Analyzer(spark)
    assert a.feed(docs(spark, values[:10])) == 10
    assert a.feed_json_lines("\n".join(map(json.dumps, values[10:])) + "\nnot json\n\n") == 20
    assert a.report() == whole
    a.save(str(tmp_path / "all"))
    assert Analyzer.load(spark, str(tmp_path / "all")).report() == whole
    for k, part in enumerate((values[:7], values[7:])):
        x = Analyzer(spark)
        x.feed(docs(spark, part))
        x.save(str(tmp_path / str(k)))
    both = Analyzer.load(spark, str(tmp_path / "0"), str(tmp_path / "1"))
    assert both.report() == whole and both.doc_count == 30
    both.close()
    with pytest.raises(RuntimeError):
        both.report()


def test_report_says(spark):
    out = analyze(docs(spark, [{"ts": 1705319400000 + i, "id": f"{i:08x}-0000-4000-8000-{i:012x}", "m": "a@b.c"} for i in range(20)]))
    assert "epoch millis" in out.summary() and "100% uuid" in out.summary() and "100% email" in out.summary()
    assert json.loads(out.as_json())["shape"]["names"] == ["id", "m", "ts"]


def test_spark_type(spark):
    out = analyze(docs(spark, [{"a": 1, "b": [1.5], "c": None}, {"a": 2, "b": [], "d": {"x": "s"}}]))
    t = out.spark_type()
    assert t["a"].dataType == T.LongType() and not t["a"].nullable
    assert isinstance(t["b"].dataType, T.ArrayType) and t["d"].nullable
    assert analyze(docs(spark, [1, "a", "b"])).spark_type() == T.VariantType()
    assert analyze(docs(spark, [1, "a", "b"])).spark_type(variants=False) == T.StringType()


def test_limits(spark):
    d = docs(spark, [{"a": i} for i in range(10)])
    out = analyze(d, Policy(max_docs=4))
    assert out.docs == 4 and out.bailed
    assert analyze(d, Policy(max_docs=10)).bailed and not analyze(d, Policy(max_docs=11)).bailed
    messy = docs(spark, [[{f"k{i}_{j}": 1} for j in range(40)] for i in range(20)])
    assert analyze(messy, Policy(max_eviction_rate=0.5, warm_up=10)).docs == 10


def test_quantiles(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"))
    got = {r["q"]: r["value"] for r in stats.quantiles(df, "x", [0.5, 0.99]).collect()}
    assert abs(got[0.5] - 500) / 500 < 0.04 and abs(got[0.99] - 990) / 990 < 0.04
    buckets = {r["bucket"]: r["n"] for r in df.groupBy(stats.sketch_bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n")).collect()}
    assert stats.quantile(buckets, 0.5) == pytest.approx(got[0.5])


def test_columns_as_documents(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [3.0, 4.0])], "i int, s string, e array<double>")
    assert analyze(from_columns(df)).shape.text() == "{e: (f64, f64), i: i64, s?: string}"


def test_statistics_tables(spark):
    values, buckets = statistics(docs(spark, [{"a": "x-1"}, {"a": "y"}]))
    assert {(r["path"], r["kind"], r["n"]) for r in values.collect()} == {(".", "object", 2), (".a", "string", 2)}
    assert ("skeleton", "A-9") in {(r["measure"], r["bucket"]) for r in buckets.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_the_shape_alone_is_that_of_the_analysis(spark, seed):
    r = random.Random(seed)
    found = docs(spark, [chaos(r, 3, 4) for _ in range(25)] + [{"l": [{"x": i}, [2**63]], f"k{i}": [i] * i} for i in range(5)])
    policy = Policy(record_cap=r.randint(1, 6), position_cap=r.randint(0, 4))
    want = analyze(found, policy).shape.as_dict()
    assert shape_of(found, policy).as_dict() == want == shape_of(found, policy, driver_rows=0).as_dict()
    assert shape_of(found.where("false")).kind == "absent"


def test_the_shape_alone_takes_one_pass_and_no_texts(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, "2024-01-01" if i % 2 else "x y") for i in range(40)], "i long, t string")
    made = from_columns(rows.select("i", F.array(F.struct("t", F.col("i").alias("k"))).alias("l")), "i")
    found = made.withColumn("ord", F.udf(look, "long")("ord"))
    found.strataform_levels = made.strataform_levels
    monkeypatch.setattr(stats, "detect_format", None)
    assert shape_of(found).text() == "{l: ({k: i64, t: string})}"
    assert seen.value == 40
