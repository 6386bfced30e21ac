"""Analysis of a stream: every micro-batch leaves the statistics of its documents, a tile, in one table.

Tiles are written under their batch's number, so a batch that runs again replaces its own; reports merge all tiles or a
range of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..plans.analyze import Outcome, outcome_of, statistics
from ..plans.shape import Policy
from ..sources.documents import from_json


def write_tiles(stream: DataFrame, column: str, path: str, checkpoint: str, bad: str = "skip", **trigger) -> StreamingQuery:
    """Start the analysis of a streaming text column. ``trigger``: as of DataStreamWriter.trigger."""

    def tile(batch: DataFrame, number: int) -> None:
        values, buckets = statistics(from_json(batch, column, bad=bad))
        values.write.mode("overwrite").parquet(f"{path}/values/tile={number}")
        buckets.write.mode("overwrite").parquet(f"{path}/buckets/tile={number}")

    writer = stream.writeStream.foreachBatch(tile).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_tiles(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, policy: Policy = Policy()) -> Outcome:
    """What the tiles of a range say together. Documents are numbered through the tiles in their order."""
    both = [spark.read.parquet(f"{path}/{t}") for t in ("values", "buckets")]
    if first is not None:
        both = [t.where(F.col("tile") >= first) for t in both]
    if last is not None:
        both = [t.where(F.col("tile") <= last) for t in both]
    values, buckets = both
    sizes = sorted((r["tile"], r["n"]) for r in values.where("path = '.'").groupBy("tile").agg(F.sum("n").alias("n")).collect())
    at, offsets = 0, []
    for tile, n in sizes:
        offsets.append((tile, at))
        at += n
    first_of = spark.createDataFrame(offsets, "tile int, before long")
    values = values.join(F.broadcast(first_of), "tile").withColumns({c: F.col(c) + F.col("before") for c in ("first", "last")}).drop("tile", "before")
    return outcome_of(*stats.merge((values, buckets.drop("tile"))), policy)
