import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataform.functions.times import TimeInterpreter
from strataform.plans.analyze import analyze
from strataform.sources.documents import JsonLines, table
from strataform.streaming.tiles import read_tiles, write_tiles


@pytest.fixture
def files(tmp_path):
    for name, days in (("b/two.jsonl", (3, 4)), ("a.jsonl", (1, 2)), ("c.txt", (9,))):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("".join(json.dumps({"day": d, "at": f"2024-01-0{d}T00:00:00Z", "in": {"x": d}} if d != 2 else {"day": d, "at": f"2024-01-0{d}T00:00:00Z"}) + "\n\n" for d in days))
    return tmp_path


def days(spark, source):
    return [r[0] for r in source.read(spark).orderBy("ord").select(F.try_variant_get("v", "$.day", "long")).collect()]


def test_json_lines(spark, files):
    source = JsonLines(str(files), glob="*.jsonl")
    assert days(spark, source) == [1, 2, 3, 4]
    assert days(spark, JsonLines(str(files), glob="*.jsonl", keep=lambda p: p.contains("/b/"))) == [3, 4]
    timed = source.of_time(".at", TimeInterpreter()).within(datetime(2024, 1, 2), datetime(2024, 1, 4))
    assert days(spark, timed) == [2, 3] and "2024-01-02" in timed.describe()
    below = source.under(".in").read(spark).orderBy("ord").select("ord", F.to_json("v")).collect()
    assert [tuple(r) for r in below] == [(0, '{"x":1}'), (1, '{"x":3}'), (2, '{"x":4}')]
    os.utime(files / "a.jsonl", (0, 0))
    assert days(spark, source.within(datetime(2000, 1, 1))) == [3, 4]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "a": 2}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        JsonLines(str(tmp_path)).read(spark).collect()
    assert analyze(JsonLines(str(tmp_path), bad="skip").read(spark)).shape.text() == "{a: i64}"


def test_tables(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").write.parquet(str(tmp_path / "t"))
    assert analyze(table(spark, str(tmp_path / "t"))).shape.text() == "{a: i64, b?: string}"


def test_stream_of_tiles(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.txt").write_text("".join(json.dumps({"n": i * 10 + j, "s": "x"}) + "\n" for j in range(5)))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    q = write_tiles(stream, "value", str(tmp_path / "tiles"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    out = read_tiles(spark, str(tmp_path / "tiles"))
    assert out.docs == 10 and out.shape.text() == "{n: i64, s: string}" and out.root.last == 9
    assert read_tiles(spark, str(tmp_path / "tiles"), last=0).docs == 5
