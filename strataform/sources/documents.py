"""Sources of documents: DataFrames (ord, v) of numbered variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, MapType, NullType, StructType, VariantType

from ..functions.paths import variant_path
from ..functions.times import TimeInterpreter, within

#: Duplicate keys are allowed in JSON; the last one wins.
_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def numbered(df: DataFrame, name: str = "ord") -> DataFrame:
    """``df`` with a gapless number from 0 in the order of its rows.

    Two passes over rows that are kept, so that their partitions stay what they are: counts by partition, then an offset
    to each row.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    at, offsets = 0, []
    for p, n in counts:
        offsets.append((p, at))
        at += n
    first = df.sparkSession.createDataFrame(offsets, "_p long, _first long")
    return rows.join(F.broadcast(first), part == F.col("_p")).withColumn(name, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_p", "_first")


def from_json(df: DataFrame, column: str, order: str | None = None, bad: str = "fail") -> DataFrame:
    """Documents from a text column. ``order``: a column of gapless numbers, else rows are numbered as they come.

    bad: "fail" on text that isn't JSON, or "skip" it. Blank text is no document.
    """
    df.sparkSession.conf.set(_DUPLICATES, "true")
    rows = df.where(F.trim(F.col(column)) != "").withColumn("v", (F.parse_json if bad == "fail" else F.try_parse_json)(F.col(column)))
    rows = rows.where("v is not null") if bad == "skip" else rows
    return rows.select(F.col(order).alias("ord"), "v") if order else numbered(rows.select("v")).select("ord", "v")


def levels_of(kind: DataType) -> int | None:
    """How many levels a value of this type has at most as JSON; None where the type doesn't say."""
    if isinstance(kind, (StructType, ArrayType, MapType)):
        inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType if isinstance(kind, ArrayType) else kind.valueType]
        below = [levels_of(k) for k in inner]
        return None if None in below else 1 + max(below, default=0)
    return 1 if isinstance(kind, (AtomicType, NullType)) and not isinstance(kind, VariantType) else None


def from_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of any table as documents: one record each, absent where null. Their columns tell how many levels they have."""
    columns = [c for c in df.columns if c != order]
    docs = from_json(df.select(*([order] if order else []), F.to_json(F.struct(*columns)).alias("_doc")), "_doc", order)
    docs.strataform_levels = levels_of(df.select(*columns).schema)
    return docs


@dataclass(frozen=True)
class JsonLines:
    """JSON, one document a line, of the files under a directory in the order of their paths.

    glob: which file names count; keep: a predicate on the column of the file's path; start and end: a window on the
    file's time, or on the documents' own if ``time`` (path, interpreter) says where it is; at: the path of the part of
    each document that is taken, documents without it don't count.
    """

    path: str
    glob: str | None = None
    keep: Callable[[Column], Column] | None = None
    start: object = None
    end: object = None
    time: tuple[str, TimeInterpreter] | None = None
    at: str | None = None
    bad: str = "fail"
    options: dict = field(default_factory=dict)

    def within(self, start=None, end=None) -> JsonLines:
        return replace(self, start=start, end=end)

    def of_time(self, path: str, interpreter: TimeInterpreter) -> JsonLines:
        return replace(self, time=(path, interpreter))

    def under(self, path: str) -> JsonLines:
        return replace(self, at=path)

    def describe(self) -> str:
        said = [f"JSON lines under {self.path}"]
        said += [f"named {self.glob}"] * bool(self.glob)
        said += [f"from {self.start or 'the start'} to before {self.end or 'the end'}"] * (self.start is not None or self.end is not None)
        said += [f"by {self.time[0]} as {self.time[1].describe()}"] * bool(self.time)
        said += [f"at {self.at}"] * bool(self.at)
        return ", ".join(said)

    def read(self, spark: SparkSession) -> DataFrame:
        spark.conf.set(_DUPLICATES, "true")
        reader = spark.read.option("recursiveFileLookup", "true").options(**self.options)
        reader = reader.option("pathGlobFilter", self.glob) if self.glob else reader
        lines = reader.text(self.path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("changed"))
        if self.keep:
            lines = lines.where(self.keep(F.col("file")))
        if not self.time and (self.start is not None or self.end is not None):
            lines = lines.where(within(F.col("changed"), self.start, self.end))
        lines = lines.withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
        docs = lines.withColumn("v", (F.parse_json if self.bad == "fail" else F.try_parse_json)(F.col("value"))).where("v is not null")
        if self.time and (self.start is not None or self.end is not None):
            value = F.try_variant_get("v", variant_path(self.time[0]), "string")
            docs = docs.where(within(self.time[1](value), self.start, self.end))
        if self.at:
            docs = docs.withColumn("v", F.try_variant_get("v", variant_path(self.at), "variant")).where("v is not null")
        return numbered(docs.orderBy("file", "block", "line").select("v")).select("ord", "v")


def at(docs: DataFrame, path: str) -> DataFrame:
    """The part of each document at ``path``, renumbered; documents without it don't count."""
    found = docs.withColumn("v", F.try_variant_get("v", variant_path(path), "variant")).where("v is not null")
    return numbered(found.orderBy("ord").select("v")).select("ord", "v")


def table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Rows of a stored table (parquet, orc, csv, json, avro or jdbc where the session has them) as documents."""
    return from_columns(spark.read.format(format).options(**options).load(path))
