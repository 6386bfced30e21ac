"""Analysis of a set of documents, in one go, step by step, or from kept statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stats
from ..operators.walk import MAX_DEPTH, opened
from ..sources.documents import from_json
from . import report as reports
from .shape import DRIVER_ROWS, Node, Policy, Shape, build, collect, collect_rows, routed, to_spark


def statistics(docs: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(values, buckets) of documents (ord, v), by raw path, each from one pass over the values."""
    kept = stats.element_value(F.col("kind"), F.col("is_index"), F.col("v"))
    values = opened(docs, max_depth, kept)
    table, found = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in (stats.value_table(values), stats.groups(values)))  # by path: few rows
    return table, stats.bucket_table(found, table).unionByName(stats.signature_table(found, values))


def shape_of(docs: DataFrame, policy: Policy = Policy(), driver_rows: int = DRIVER_ROWS) -> Shape:
    """The shape that ``analyze`` finds, from those statistics alone that it is built of, in one pass over the values."""
    some, _ = bounded(docs, policy)
    kept = stats.element_value(F.col("kind"), F.col("is_index"), F.col("v"))
    return outcome_of(*stats.shape_tables(opened(some, kept=kept)), policy, driver_rows=driver_rows).shape


@dataclass
class Outcome:
    """What an analysis found."""

    docs: int
    root: Node | None
    policy: Policy = field(default_factory=Policy)
    source: str = ""
    bailed: bool = False

    @property
    def shape(self) -> Shape:
        return build(self.root)

    def spark_type(self, variants: bool = True) -> T.DataType:
        return to_spark(self.shape, variants)

    def summary(self) -> str:
        return reports.summary(self.root, self.docs)

    def report(self) -> str:
        return reports.report(self.root, self.docs)

    def as_json(self) -> str:
        """The shape tree with its counts, for storage."""
        return json.dumps({"version": 1, "docs": self.docs, "source": self.source, "bailed": self.bailed, "shape": self.shape.as_dict()}, ensure_ascii=False)


def outcome_of(values: DataFrame, buckets: DataFrame, policy: Policy = Policy(), source: str = "", bailed: bool = False, driver_rows: int = DRIVER_ROWS) -> Outcome:
    """Decisions over statistics by raw path."""
    few, some = values.limit(driver_rows + 1).collect(), buckets.select("path", "measure", "bucket", "n").limit(driver_rows + 1).collect()
    if max(len(few), len(some)) <= driver_rows:
        root = collect_rows([r.asDict() for r in few], [tuple(r) for r in some], policy)
    else:
        root = collect(*routed(values.persist(), buckets.persist(), policy))
    docs = root.obs if root else 0
    return Outcome(docs, root, policy, source, bailed)


def bounded(docs: DataFrame, policy: Policy) -> tuple[DataFrame, bool]:
    """The first ``max_docs`` documents, and whether that many were reached."""
    if policy.max_docs is None:
        return docs, False
    some = docs.where(F.col("ord") < policy.max_docs)
    return some, docs.where(F.col("ord") == policy.max_docs - 1).limit(1).count() > 0


def chaos_rate(root: Node | None) -> float:
    """Evictions for each element and text that could cause one: how little the kept signatures and skeletons cover."""
    if root is None:
        return 0.0

    def seen(n: Node) -> int:
        return sum(n.buckets[f"all_{m}"].get("n", 0) for m in ("signature", "skeleton")) + sum(map(seen, n.children))

    return reports.evictions(root) / max(seen(root), 1)


def analyze(docs: DataFrame, policy: Policy = Policy(), source: str = "") -> Outcome:
    """Analyze documents (ord, v). With max_eviction_rate, a first look at ``warm_up`` documents may end it there."""
    if policy.max_eviction_rate is not None:
        look = outcome_of(*statistics(docs.where(F.col("ord") < policy.warm_up)), policy, source)
        if look.docs >= policy.warm_up and chaos_rate(look.root) > policy.max_eviction_rate:
            look.bailed = True
            return look
    some, reached = bounded(docs, policy)
    return outcome_of(*statistics(some), policy, source, reached)


class Analyzer:
    """Step-by-step analysis with state: feed, report at any time, keep, go on.

    The state is the statistics by raw path, two tables that merge by sums; nothing of a document is kept.
    """

    def __init__(self, spark: SparkSession, policy: Policy = Policy()):
        self.spark, self.policy, self.doc_count, self.parts, self.closed = spark, policy, 0, [], False

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the analyzer is closed")

    def feed(self, docs: DataFrame) -> int:
        """Add documents (ord, v); their numbers go on from those fed before. Returns how many."""
        self._open()
        n = docs.count()
        values, buckets = statistics(docs.withColumn("ord", F.col("ord") + F.lit(self.doc_count)))
        self.parts.append((values.persist(), buckets.persist()))
        if len(self.parts) > 8:
            self.parts = [tuple(x.persist() for x in stats.merge(*self.parts))]
        self.doc_count += n
        return n

    def feed_json_lines(self, text: str) -> int:
        """Add the documents of a text, one a line; lines that aren't JSON are skipped."""
        rows = self.spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "i long, line string")
        return self.feed(from_json(rows.orderBy("i"), "line", bad="skip"))

    def feed_json(self, text: str) -> int:
        return self.feed_json_lines(text.replace("\n", " "))

    def outcome(self) -> Outcome:
        self._open()
        if not self.parts:
            return Outcome(0, None, self.policy)
        return outcome_of(*stats.merge(*self.parts), self.policy)

    def report(self) -> str:
        return self.outcome().report()

    def summary(self) -> str:
        return self.outcome().summary()

    def save(self, path: str) -> None:
        """Keep the state as two tables under ``path``."""
        self._open()
        if not self.parts:
            self.feed(self.spark.createDataFrame([], "ord long, line string").select("ord", F.parse_json("line").alias("v")))
        values, buckets = stats.merge(*self.parts)
        values.withColumn("docs", F.lit(self.doc_count)).write.mode("overwrite").parquet(f"{path}/values")
        buckets.write.mode("overwrite").parquet(f"{path}/buckets")

    @classmethod
    def load(cls, spark: SparkSession, *paths: str, policy: Policy = Policy()) -> Analyzer:
        """Go on from kept states; several are merged."""
        out = cls(spark, policy)
        for path in paths:
            values, buckets = spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/buckets")
            n = values.select("docs").first()
            values = values.drop("docs").withColumns({c: F.col(c) + F.lit(out.doc_count) for c in ("first", "last")})
            out.parts.append((values, buckets))
            out.doc_count += n["docs"] if n else 0
        return out

    def close(self) -> None:
        self.closed = True
        for values, buckets in self.parts:
            values.unpersist()
            buckets.unpersist()
