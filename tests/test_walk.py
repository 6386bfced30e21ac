"""The walk opens all levels without keeping them, and its statistics are those of the values."""

from pyspark.sql import functions as F

from strataform.operators.walk import _depth, opened, walk
from strataform.plans.analyze import analyze
from strataform.plans.tiling import TILE, headers
from strataform.sources.documents import from_columns, levels_of


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, t string").select("ord", F.parse_json("t").alias("v"))


def test_no_level_is_stored(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = walk(_docs(spark, ['{"a":{"b":[1,{"c":null}]}}', "[]", "7"]))
    found = {(r["ord"], r["path"], r["kind"], r["size"]) for r in rows.collect()}
    assert found == {(0, ".", "object", 1), (0, ".a", "object", 1), (0, ".a.b", "array", 2), (0, ".a.b[0]", "i64", None), (0, ".a.b[1]", "object", 1), (0, ".a.b[1].c", "null", None), (1, ".", "array", 0), (2, ".", "i64", None)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_levels_below_one_stage_are_opened(spark):
    rows = opened(_docs(spark, ["[" * 15 + "1" + "]" * 15]))
    assert sorted((r["path"].count("["), r["pattern"].count("[*]"), r["kind"]) for r in rows.collect()) == [(i, i, "array") for i in range(15)] + [(15, 15, "i64")]


def test_levels_are_counted_in_one_job(spark):
    # whatever makes the documents runs once for the count, not once a level
    tracker = spark.sparkContext.statusTracker()
    for texts, most, depth in ((['{"a":{"b":[1,{"c":null}]}}', "[]", "7"], 7, 5), (["null"], 7, 1), (["[[[[1]]]]"], 3, 3), ([], 7, 0)):
        docs = _docs(spark, texts) if texts else _docs(spark, ["1"]).where("ord < 0")
        group = f"depth-{texts}-{most}"
        spark.sparkContext.setJobGroup(group, group)
        assert _depth(docs.select("v"), most) == depth
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        # the rows that are counted may be exchanged first, as a job of its own
        assert len(tracker.getJobIdsForGroup(group)) <= 2


def test_levels_that_columns_tell_are_not_looked_for(spark):
    deep = "array<" * 8 + "int" + ">" * 8
    df = spark.sql(f"select 1L as ord, array(named_struct('a', map('k', array(1, null)), 'b', 2)) as x, cast(null as {deep}) as none, from_json('{'[' * 8}7{']' * 8}', '{deep}') as deep, 's' as s")
    for columns, levels in ((("s",), 2), (("x", "s"), 6), (("x", "none", "deep"), 10)):
        docs = from_columns(df.select("ord", *columns), "ord")
        spark.sparkContext.setJobGroup(f"levels-{levels}", "levels")
        found = opened(docs)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"levels-{levels}")
        rows = lambda d: sorted((r["path"], r["kind"], r["size"] or 0) for r in d.collect())
        assert rows(found) == rows(opened(docs.select("ord", "v"))) and docs.strataform_levels == levels
    # what a variant holds its type doesn't say
    assert levels_of(df.select(F.parse_json(F.lit("[[1]]")).alias("v")).schema) is None


def test_bitmaps_lie_as_bits_of_a_tile(spark):
    docs = spark.range(TILE + 70).select(F.col("id").alias("ord"), F.parse_json(F.when(F.col("id") % 67 == 3, '{"a":null}').otherwise('{"b":[1,"x"]}')).alias("v"))
    rows = {(r["tile"], r["path"]): r for r in headers(docs).collect()}
    here = [i for i in range(TILE) if i % 67 == 3]
    r = rows[0, ".a"]
    assert r["n"] == r["n_null"] == len(here) and r["kinds"] == {"null": len(here)} and len(r["present"]) == TILE // 8
    assert [i for i in range(TILE) if r["present"][i // 8] >> i % 8 & 1] == here and r["present"] == r["nulls"]
    assert rows[0, ".b[*]"]["kinds"] == {"i64": TILE - len(here), "string": TILE - len(here)} and rows[0, ".b[*]"]["n"] == TILE - len(here)


def test_a_map_of_many_keys_is_analyzed(spark):
    docs = spark.range(2).select(F.col("id").alias("ord"), F.parse_json(F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('":{"n":1}'))), ","), F.lit("}"))).alias("v"))
    root = analyze(docs).root
    assert root.kinds["object"]["sum_size"] == 600 and root.wildcard(False) is not None
