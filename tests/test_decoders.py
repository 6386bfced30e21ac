import json
import random
import struct
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from strataform.plans.analyze import analyze
from strataform.plans.shape import Shape
from strataform.plans.stored import Stored, from_nodes, node_rows, nodes
from strataform.sources.decoders import JsonLines, LengthPrefixed, records
from strataform.sources.documents import from_json, numbered

TEXTS = [json.dumps({"i": i, "t": "é" * (i % 7), "l": [None, {"x": i}] * (i % 3)}, ensure_ascii=False) for i in range(200)]


def lines(texts):
    return b"".join(t.encode() + (b"\n\n" if i % 9 == 4 else b"\r\n" if i % 9 == 5 else b"\n") for i, t in enumerate(texts))[:-1]


def prefixed(texts):
    return b"".join(struct.pack(">I", len(t.encode())) + t.encode() for t in texts)


@pytest.mark.parametrize(("decoder", "pack"), [(JsonLines(chunk=50), lines), (LengthPrefixed(), prefixed)])
def test_every_record_once_wherever_splits_fall(decoder, pack):
    raw, r = pack(TEXTS), random.Random(1)
    for _ in range(60):
        cuts = [0, *sorted(r.sample(range(1, len(raw)), r.randrange(12))), len(raw)]
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in decoder.decode(BytesIO(raw), a, b, len(raw))]
        assert [t.rstrip("\r") for _, t in got] == TEXTS
        assert all(raw[at:].startswith(t.encode()) or raw[at + 4 :].startswith(t.encode()) for at, t in got)
    assert [x for k in range(len(raw)) for x in decoder.decode(BytesIO(raw), k, k + 1, len(raw))] == list(decoder.decode(BytesIO(raw), 0, len(raw), len(raw)))
    assert list(decoder.decode(BytesIO(b""), 0, 0, 0)) == []


@pytest.mark.parametrize(("decoder", "pack"), [(JsonLines(), lines), (LengthPrefixed(), prefixed)])
def test_two_formats_through_one_source(spark, tmp_path, decoder, pack):
    (tmp_path / "b").mkdir()
    for name, part in (("a", TEXTS[:90]), ("b/c", TEXTS[90:]), ("empty", []), ("_SUCCESS", ["x"])):
        (tmp_path / name).write_bytes(pack(part))
    found = records(spark, str(tmp_path), decoder, split=701)
    assert found.rdd.getNumPartitions() > 4
    rows = found.orderBy("file", "offset")
    assert [r["record"].strip() for r in rows.collect()] == TEXTS
    docs = from_json(numbered(rows.select("record")), "record", "ord")
    assert analyze(docs).docs == 200


def test_broken_lengths_fail():
    with pytest.raises(ValueError):
        list(LengthPrefixed().decode(BytesIO(b"\0\0\0\x09ab"), 0, 6, 6))


def test_reports_are_read_back(spark):
    values = [{"a": i, "b": {"c": [1.5, "x"], "k 1": None if i % 2 else "t"}, "m": {f"k{i}-{j}": {"on": True} for j in range(30)}, "n": [[i]] * (i % 3), "p": [{"x": 1}, {"y": "s"}][i % 2]} for i in range(12)]
    out = analyze(from_json(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string"), "t", "i"), source="made")
    shape = out.shape
    kept = Stored(out.docs, shape, "made")
    assert from_nodes(nodes(spark, shape)) == shape and len({r[3] for r in node_rows(shape)}) == len(node_rows(shape))
    assert Stored.from_json(kept.as_json()) == kept
    assert Stored.from_json(out.as_json()) == kept
    short = kept.as_json(compressed=True)
    back = Stored.from_json(short)
    assert len(short) < len(kept.as_json()) and back.shape.text() == shape.text() and back.shape.count == 12
    part = back.shape.items[back.shape.names.index("m")]
    assert part.kind == "map" and part.count == 12 and part.items[0].count == 0 and part.items[0].items[0].of == "bool"
    assert from_nodes(nodes(spark, Shape("absent"))) == Shape("absent")
    with pytest.raises(ValueError):
        Stored.from_json('{"version": 2}')
    assert nodes(spark, shape).where(F.col("kind") == "map").count() == 1
