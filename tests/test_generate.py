import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataform.generate.documents import Generator, SchemaError, chaos, check, spine
from strataform.operators.walk import walk
from strataform.plans.analyze import analyze
from strataform.plans.shape import Policy
from strataform.sources.documents import from_json


def record(required, **fields):
    return {"type": "object", "required": list(required), "properties": fields}


def test_nested_records_come_back_at_every_depth(spark):
    schema = {"type": "boolean"}
    for k in range(5):
        schema = record([f"level{k}"], **{f"level{k}": schema})
    want = "bool"
    for k in range(5):
        want = f"{{level{k}: {want}}}"
    assert analyze(Generator(schema, 1).documents(spark, 20, 2)).shape.text() == want


def test_optional_fields_are_seen_as_often_as_they_are_made(spark):
    g = Generator(record([], left={"type": "integer"}, right={"type": "integer"}), 9)
    made = Counter(k for d in g.take(300) for k in d)
    values = walk(g.documents(spark, 300, 3))
    seen = {r["step"]: r["n"] for r in values.where("parent = '.'").groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert set(seen) == {"left", "right"} and 0 < made["left"] < 300 and all(0 < n < 300 for n in seen.values())
    assert analyze(g.documents(spark, 300, 3)).shape.text() == "{left?: i64, right?: i64}"


def test_clashing_kinds_become_alternatives(spark):
    clash = record(["v"], v={"oneOf": [{"type": "integer"}, {"type": "boolean"}, {"type": "null"}]})
    assert analyze(Generator(clash, 4).documents(spark, 90, 2)).shape.text() == "{v?: null | bool | i64}"


def test_caps_hold_on_generated_documents(spark):
    wide = record([f"c{i:02}" for i in range(30)], **{f"c{i:02}": {"type": "integer"} for i in range(30)})
    docs = Generator(wide, 2).documents(spark, 25, 2)
    assert analyze(docs, Policy(record_cap=30)).shape.text().count("i64") == 30
    assert analyze(docs, Policy(record_cap=29)).shape.text() == "map<i64>"


def test_one_seed_one_stream():
    g = Generator(record(["n"], n={"type": "number"}), 3)
    assert g.take(5) == g.take(5) != Generator(g.schema, 4).take(5)
    with pytest.raises(SchemaError):
        check(record([], a={"type": "decimal"}))


@pytest.mark.parametrize("seed", (3, 8))
def test_any_document_can_be_analyzed(spark, seed):
    made = [chaos(random.Random(seed * 100 + i), 4, 5) for i in range(60)] + [spine(9)]
    docs = from_json(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(made)], "i long, t string"), "t", "i")
    out = analyze(docs)
    roots = Counter("array" if isinstance(v, list) else "object" if isinstance(v, dict) else "scalar" for v in made)
    assert out.docs == 61 and out.report() and out.spark_type() is not None
    assert walk(docs).where("path = '.' and kind = 'object'").count() == roots["object"]
