from datetime import datetime, timezone

from strataform.operators.moments import by_form, evidence, moment_table, quantiles

VALUES = "path string, num double, str string"


def micros(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


def test_evidence_of_moments(spark):
    cases = [
        ("2024-01-15T10:30:00Z", ("text", "s", "zoned", micros(2024, 1, 15, 10, 30))),
        ("2024-01-15 10:30:00.25", ("text", "ms", "naive", micros(2024, 1, 15, 10, 30) + 250_000)),
        ("2024-01-15T10:30:00.123456-05:30", ("text", "us", "zoned", micros(2024, 1, 15, 16, 0) + 123_456)),
        ("2024-01-15T10:30:00.123456789+0100", ("text", "ns", "zoned", micros(2024, 1, 15, 9, 30) + 123_456)),
        ("1705314600", ("digits", "s", None, 1705314600_000_000)),
        ("1705314600123", ("digits", "ms", None, 1705314600_123_000)),
        (1705314600.5, ("number", "s", None, 1705314600_500_000)),
        (1705314600123.0, ("number", "ms", None, 1705314600_123_000)),
        (1705314600123456.0, ("number", "us", None, 1705314600_123_456)),
        (1705314600123456768.0, ("number", "ns", None, 1705314600_123_456)),
        ("2024-13-45T10:30:00Z", None), ("2024-01-15", None), ("12", None), ("", None), ("x", None), (5.0, None), (-1705314600.0, None), (None, None),
    ]
    rows = [(f"p{i:02}", v if isinstance(v, float) else None, v if isinstance(v, str) else None) for i, (v, _) in enumerate(cases)]
    got = {r["path"]: tuple(r)[1:] for r in evidence(spark.createDataFrame(rows, VALUES)).collect()}
    assert got == {f"p{i:02}": want for i, (_, want) in enumerate(cases) if want}


def test_tables_merge_and_tell_quantiles(spark):
    rows = [("a", 1.7e9 + i * 600, None) for i in range(300)] + [("b", None, "2024-01-15T10:30:00Z")] * 3
    tables = [moment_table(evidence(spark.createDataFrame(part, VALUES))) for part in (rows, rows[:120], rows[120:])]
    both = tables[1].unionByName(tables[2])
    for one in (by_form, lambda t: quantiles(t, [0.5, 0.99])):
        assert sorted(map(str, one(both).collect())) == sorted(map(str, one(tables[0]).collect()))
    assert {tuple(r)[:5] for r in by_form(both).collect()} == {("a", "number", "s", None, 300), ("b", "text", "s", "zoned", 3)}
    q = {(r["path"], r["q"]): r["at"].replace(tzinfo=timezone.utc).timestamp() for r in quantiles(both, [0.5, 0.99]).collect()}
    assert abs(q["a", 0.5] - (1.7e9 + 149 * 600)) <= 1800 and abs(q["a", 0.99] - (1.7e9 + 296 * 600)) <= 1800 and ("b", 0.5) in q
    assert quantiles(tables[0].where("false"), [0.5]).count() == 0
