import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strataform.streaming.sessions import close_open, session_events, session_stream, state_store

FOUND = "ord long, at timestamp, config string, refs array<string>, pattern string, path string, observed string, shape string"
COLUMNS = ("session", "event", "pattern", "ord", "path", "observed", "shape", "reason", "occurrences", "first", "last")


def exceptions(n=220):
    r, at, out = random.Random(4), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=r.choice([1, 5, 30, 30, 400]))
        for path in sorted(r.sample(["x", "y", "z"], r.randrange(3))):
            refs = r.choice([["a"], ["a", "b"]]) if path == "x" else ["c"]
            out.append((i, at, f"v{i // 90}", refs, ".*", f".{path}", r.choice(["1", "2", None]), r.choice(["i64", "i64", "string"])))
    return out


def recursion(rows, idle, until):
    """The events, one exception after another."""
    out, open_ = [], {}
    for ord_, at, config, refs, pattern, path, observed, shape in rows:
        key = ("|".join(refs), pattern)
        s = open_.get(key)
        if s and (config != s["config"] or (at - s["at"]).total_seconds() > idle):
            out.append((s["id"], "close", pattern, None, None, None, None, "evicted" if (at - s["at"]).total_seconds() > idle else "config_changed", s["n"], s["first"], s["last"]))
            s = None
        if s is None:
            s = open_[key] = {"id": f"{key[0]}|{pattern}|{ord_}", "config": config, "opened": observed, "shapes": {shape}, "n": 0, "first": ord_}
            kind, told, new = "open", observed, shape
        else:
            kind, new = ("fit", None) if shape in s["shapes"] else ("grow", shape)
            told = None if observed == s["opened"] else observed
        s["shapes"].add(shape)
        s.update(at=at, last=ord_, n=s["n"] + 1)
        out.append((s["id"], kind, pattern, ord_, path, told, new, None, None, None, None))
    for (_, pattern), s in open_.items():
        gone = (until - s["at"]).total_seconds() > idle
        out.append((s["id"], "close", pattern, None, None, None, None, "evicted" if gone else "stream_end", s["n"], s["first"], s["last"]))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_sessions_of_a_table_are_those_of_a_recursion(spark):
    rows = exceptions()
    df = spark.createDataFrame(rows, FOUND).repartition(5)
    want = recursion(rows, 60, rows[-1][1])
    assert told(session_events(df, 60, F.lit(rows[-1][1]))) == want
    assert {e[1] for e in want} == {"open", "fit", "grow", "close"} and {e[7] for e in want} == {None, "evicted", "config_changed", "stream_end"}
    shifted = df.withColumn("ord", F.col("ord") * 1000)  # over several blocks
    got = [(e[1], e[7], e[8]) for e in told(session_events(shifted, 60, F.lit(rows[-1][1])))]
    assert sorted(got, key=str) == sorted(((e[1], e[7], e[8]) for e in want), key=str)
    assert session_events(df.where("false"), 60).count() == 0


def test_a_stream_gives_the_same_events_across_a_restart(spark, tmp_path):
    rows = exceptions(160)
    want = recursion(rows, 60, rows[-1][1])
    cuts = [0, 70, 71, 190, len(rows)]
    with state_store(spark):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            spark.createDataFrame(rows[a:b], FOUND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k in (1, 3):  # the query stops and starts again from its checkpoint
                found = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                query = session_stream(found, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
                query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).unionByName(close_open(spark, str(tmp_path / "check")))
    assert told(got) == want


def test_rows_go_to_the_state_in_pieces():
    """A cluster's rows of a batch are one row, however many they are."""
    import pyarrow as pa

    from strataform.streaming import sessions

    rows = [{**dict(zip(("ord", "at", "config", "refs", "pattern", "path", "observed", "shape"), (i, datetime(2024, 1, 1) + timedelta(seconds=i), "v", ["a"] if i % 3 else ["a", "b"], ".x", ".x", None, "i64"), strict=True)), "ms": i * 1000, "cluster": str(i % 3 == 0)} for i in range(3000)]
    packs = pa.Table.from_batches(list(sessions._pack(pa.Table.from_pylist(rows).to_batches())))
    assert sorted(packs["refs"].to_pylist()) == [["a"], ["a", "b"]] and max(packs["at"].to_pylist()) == rows[-1]["at"]
    assert sorted(x for d in packs["data"].to_pylist() for x in sessions._unpacked(d)["ord"].to_pylist()) == list(range(3000))
