from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataform.functions import formats, paths
from strataform.functions.times import TimeInterpreter, has_zone, ulid, uuid_v7


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", f(F.col("s"))).orderBy("i").collect()]


def test_formats(spark):
    want = {
        "123e4567-e89b-12d3-a456-426614174000": "uuid", "2024-01-15T10:30:00.5-0530": "iso-timestamp", "2024-01-15 10:30:00": "iso-timestamp", "2024-01-15T10:30": "other", "2024-01-15T10:30:00.": "other",
        "2024-99-99": "iso-date", "255.001.0.9": "ipv4", "256.1.1.1": "other", "1.2.3": "other", "12:34:56": "ipv6", "::1": "ipv6", "a:b": "other", "x@y": "email", "@y": "other", "x@ y": "other", "http://a@b": "email",
        "https://x.org/": "url", "007": "digits", "abc": "alpha", "a1": "alnum", "é": "other", "": "other",
    }
    assert dict(zip(want, column(spark, list(want), formats.detect_format), strict=True)) == want
    assert column(spark, [None], formats.detect_format) == [None]


def test_skeletons(spark):
    want = {"ORD-2024-001234": "A-9-9", "hello world": "A A", "Hi!": "A!", "foo@bar.com": "A@A.A", "": "", "...": "...", "a-b-c-d-e-f-g-h-i-j": "A-A-A-A-A-A-A-A-…", "é1  x": "A9 A"}
    assert dict(zip(want, column(spark, list(want), formats.skeleton), strict=True)) == want


def test_length_buckets(spark):
    assert column(spark, ["", "a", "ab", "abc", "abcd", "x" * 1025], lambda s: formats.length_bucket(F.octet_length(s))) == [0, 0, 1, 1, 2, 10]


def test_times(spark):
    t = datetime(2024, 1, 15, 10, 30)
    assert column(spark, ["1705314600", "-1", "x"], lambda s: TimeInterpreter("s")(s.try_cast("long"))) == [t, None, None]
    assert column(spark, ["2024-01-15T10:30:00Z", "2024-01-15T12:30:00+02:00", "2024-01-15T10:30:00", "Mon, 15 Jan 2024 10:30:00 GMT", "1705314600", "junk", None], TimeInterpreter()) == [t, t, None, t, t, None, None]
    assert column(spark, ["2024-01-15T10:30:00", "2024/01/15 10:30:00", "2024-01-15"], TimeInterpreter(zone="utc")) == [t, t, datetime(2024, 1, 15)]
    assert column(spark, ["2024-01-15 12:30:00"], TimeInterpreter(zone="offset", offset_seconds=7200)) == [t]
    assert column(spark, ["018d0ca8-3540-7abc-8123-0123456789ab", "018D0CA835407ABC81230123456789AB", "018d0ca8-3540-4abc-8123-0123456789ab"], lambda s: F.unix_millis(uuid_v7(s))) == [0x018D0CA83540, 0x018D0CA83540, None]
    assert column(spark, ["01ARZ3NDEKTSV4RRFFQ69G5FAV", "81ARZ3NDEKTSV4RRFFQ69G5FAV", "01ARZ3NDEKTSV4RRFFQ69G5FAU"], lambda s: F.unix_millis(ulid(s))) == [1469922850259, None, None]
    assert column(spark, ["2024-01-15T10:30:00-0700", "2024-01-15 10:30:00", "Jan 15 2024 10:30:00", "UTC"], has_zone) == [True, False, False, False]


@pytest.mark.parametrize("text", [".", ".a.b", ".a[0].b", '."odd name"."x\\"y"', ".[3][4]", '."é"'])
def test_paths_round_trip(text):
    assert paths.render(paths.parse(text, wildcards=False)) == text


@pytest.mark.parametrize("text", [".*", ".a[*].b", ".[*]", ".users.*.on"])
def test_patterns(text):
    assert paths.render(paths.parse(text)) == text
    with pytest.raises(paths.PathError):
        paths.parse(text, wildcards=False)
    with pytest.raises(paths.PathError):
        paths.to_path(paths.parse(text))


@pytest.mark.parametrize("text", ["", "..a", "a", ".a[", '."a', ".a[x]", '."\\q"', "[0]"])
def test_bad_paths(text):
    with pytest.raises(paths.PathError):
        paths.parse(text)


def test_path_matching_and_escapes():
    assert paths.matches(paths.parse(".a.*[*]"), paths.parse(".a.b[3]"))
    assert not paths.matches(paths.parse(".a[*]"), paths.parse(".a.b"))
    assert paths.parse('."a\\nb\\t\\u{1f600}"')[0].key == "a\nb\t\U0001f600"


def test_signatures_of_types(spark):
    from pyspark.sql import functions as F

    from strataform.operators.signatures import element_signature, signature

    docs = ['{"a": 1, "b c": {"x`y": null, "d: e": "t"}}', '{"a": 1.5, "z": {}}', '{"k, l": true, "<": 18446744073709551615}', '{"a": [1, null]}', '[{"a": 1}, {"b": 2}]', "{}", "[]", '{"e": 1e300, "o": {"p": {"q": 1}}}', "7"]
    rows = spark.createDataFrame([(d,) for d in docs], "t string").select("t", F.parse_json("t").alias("v"))
    for r in rows.select("t", "v", element_signature(F.col("v")).alias("s")).collect():
        assert r["s"] == signature(r["v"].toPython()), r["t"]
