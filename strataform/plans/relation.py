"""What an optimizer wants to know of a whole collection: how often each path has a value, and how many different ones.

Every tile has a counter and a HyperLogLog sketch for each path of leaves; they merge by sums and unions, so tiles of new
documents are simply added. Counters are the same in any order and grouping of merges; estimates may differ by it, within
the sketches' error. A collection shows ``COUNTERS`` paths with counters and, of
these, ``SKETCHES`` with estimates of distinct values: the most frequent, of equals the more recently seen, then by path.
What is replaced so is only not shown: the tables of tiles keep it, and it comes back when it gets frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.walk import opened
from .tiling import tile_of

COUNTERS, SKETCHES = 256, 64
#: Registers of a sketch are 2 ** LG_K: a standard error of 1.6 %.
LG_K = 12


def leaves(docs: DataFrame) -> DataFrame:
    """(ord, path, text): every leaf of documents (ord, v) with its JSON; indices as ``[*]``. Empty containers are leaves."""
    leaf = F.coalesce(F.col("size"), F.lit(0)) == 0
    rows = opened(docs, kept=F.when(leaf, F.col("v"))).where(leaf)
    return rows.select("ord", F.col("pattern").alias("path"), F.coalesce(F.to_json("v"), F.lit("null")).alias("text"))


def leaf_counts(docs: DataFrame) -> DataFrame:
    """(tile, path, text, n, last): how often each tile has each different leaf, and the last document with it."""
    rows = leaves(docs).withColumn("tile", tile_of(F.col("ord")))
    return rows.groupBy("tile", "path", "text").agg(F.count("*").alias("n"), F.max("ord").alias("last"))


def sketched(counts: DataFrame) -> DataFrame:
    """``tile_statistics`` from leaf counts: a sketch takes a text once, however often a tile has it."""
    return counts.groupBy("tile", "path").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.hll_sketch_agg("text", LG_K).alias("sketch"))


def tile_statistics(docs: DataFrame) -> DataFrame:
    """(tile, path, n, last, sketch): of each tile's leaves, the values, the last document with one, and a sketch of them."""
    return sketched(leaf_counts(docs))


def merged(tiles: DataFrame) -> DataFrame:
    """(path, n, last, sketch) of all tiles (or of what was merged before)."""
    return tiles.groupBy("path").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.hll_union_agg("sketch").alias("sketch"))


def relation(tiles: DataFrame, counters: int = COUNTERS, sketches: int = SKETCHES) -> DataFrame:
    """(path, n, last, distinct): the paths shown, ``distinct`` estimated for those that have a sketch, else null."""
    order = [F.desc("n"), F.desc("last"), F.asc("path")]
    shown = merged(tiles).orderBy(*order).limit(counters)
    estimated = shown.orderBy(*order).limit(sketches).select("path", F.hll_sketch_estimate("sketch").alias("distinct"))
    return shown.select("path", "n", "last").join(estimated, "path", "left")
