import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataform.plans.relation import leaf_counts, leaves, merged, relation, sketched, tile_statistics
from strataform.plans.tiling import TILE
from test_assertions import any_value, as_docs, walked
from test_tiling import pattern


def test_counters_and_sketches(spark):
    r = random.Random(3)
    values = [{"id": i, "few": r.randrange(9), "l": [r.randrange(500) for _ in range(3)], "any": any_value(r, 2), "t": "é" * (i % 5)} for i in range(400)]
    docs = as_docs(spark, values).withColumn("ord", F.col("ord") * (TILE // 100)).repartition(4)
    want, seen = Counter(), defaultdict(set)
    for doc in values:
        for steps, v in walked(doc):
            if not isinstance(v, (dict, list)) or not v:
                want[pattern(steps)] += 1
                seen[pattern(steps)].add(json.dumps(v))
    tiles = tile_statistics(docs).cache()
    assert tiles.select("tile").distinct().count() == 4
    got = {x["path"]: x for x in relation(tiles).collect()}
    assert {p: x["n"] for p, x in got.items()} == dict(want)
    assert all(abs(got[p]["distinct"] - len(s)) <= max(1, 0.06 * len(s)) for p, s in seen.items())
    assert leaves(docs).count() == sum(want.values())
    few = relation(tiles, counters=6, sketches=2).collect()
    assert len(few) == 6 and sum(x["distinct"] is not None for x in few) == 2
    assert sorted((x["n"] for x in few), reverse=True) == [n for _, n in want.most_common(6)]
    # any order and grouping of merges: the same counts, estimates within the error
    halves = [merged(tiles.where(F.col("tile") % 2 == k)) for k in (1, 0)]
    for way in (halves[0].unionByName(halves[1]), halves[1].unionByName(halves[0]), tiles.orderBy(F.desc("tile"), "path")):
        rows = merged(way).select("path", "n", F.hll_sketch_estimate("sketch").alias("distinct")).collect()
        assert {x["path"]: x["n"] for x in rows} == dict(want)
        assert all(abs(x["distinct"] - len(seen[x["path"]])) <= max(1, 0.06 * len(seen[x["path"]])) for x in rows)
    assert relation(tiles.where("false")).count() == 0 and tile_statistics(docs.where("false")).count() == 0


def test_sketches_take_each_leaf_of_a_tile_once(spark):
    values = [{"c": i % 3, "l": [i % 2, "x", None], "e": {}} for i in range(300)]
    docs = as_docs(spark, values).withColumn("ord", F.col("ord") * (TILE // 100))
    counts = leaf_counts(docs)
    want = defaultdict(lambda: [0, -1])
    for i, doc in enumerate(values):
        for steps, v in walked(doc):
            if not isinstance(v, (dict, list)) or not v:
                w = want[i * (TILE // 100) // TILE, pattern(steps), json.dumps(v)]
                w[0], w[1] = w[0] + 1, max(w[1], i * (TILE // 100))
    assert {(r["tile"], r["path"], r["text"]): [r["n"], r["last"]] for r in counts.collect()} == dict(want)
    rows = {(r["tile"], r["path"]): (r["n"], r["last"], r["d"]) for r in sketched(counts).withColumn("d", F.hll_sketch_estimate("sketch")).collect()}
    for tile, path in {(t, p) for t, p, _ in want}:
        of = [w for (t, p, _), w in want.items() if (t, p) == (tile, path)]
        assert rows[tile, path] == (sum(n for n, _ in of), max(last for _, last in of), len(of))
