"""Evidence of moments at each path, whatever they came as: timestamp texts, epoch numbers, epoch numbers as texts.

A value counts if its text has the form of an ISO timestamp, or if it is a number, or a text of digits, within the window
of one epoch unit. Counts by (source, resolution, zone) tell which services disagree and how many texts need a zone; hours
of moments are counted, so quantiles are within half an hour and merge by sums. Texts without a zone count as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import detect_format
from ..functions.times import has_zone

#: Seconds since 1970 that are taken for moments; other units are multiples (fixed values).
EPOCH_FROM, EPOCH_TO = 9e8, 3e9
UNITS = (("s", 1), ("ms", 1_000), ("us", 1_000_000), ("ns", 1_000_000_000))
_HOUR = 3_600_000_000
_TEXT = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?\s*(Z|z|[+-][0-9]{2}:?[0-9]{2})?\z"


def _unit(n: Column) -> Column:
    """The epoch unit whose window holds a number."""
    out = F.lit(None).cast("string")
    for unit, times in UNITS:
        out = F.when((n >= EPOCH_FROM * times) & (n <= EPOCH_TO * times), unit).otherwise(out)
    return out


def _epoch_micros(n: Column, unit: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, times in UNITS:
        out = F.when(unit == name, (n * (1_000_000 / times)).cast("long")).otherwise(out)
    return out


def _text_micros(s: Column) -> Column:
    """An ISO timestamp in micros, by its parts; null if there is no such date or time."""
    part = lambda i: F.regexp_extract(s, _TEXT, i)
    seconds = F.unix_micros(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z")))
    zone = F.regexp_replace(part(4), ":", "")
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    east = F.when(F.length(zone) == 5, sign * (F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 4, 2).cast("long"))).otherwise(0)
    return F.when(s.rlike(_TEXT), seconds + F.rpad(part(3), 6, "0").cast("long") - east * 60_000_000)


def evidence(values: DataFrame) -> DataFrame:
    """(path, source, resolution, zone, micros): the values of a walk that look like moments.

    source: text, number, digits; zone: of texts, zoned or naive.
    """
    s, n = F.trim("str"), F.col("num")
    number = F.coalesce(n, F.when(s.rlike(r"\A[0-9]{9,19}\z"), s.cast("double")))
    read = F.struct(s.alias("s"), number.alias("number"), n.isNotNull().alias("own"), (detect_format(s) == "iso-timestamp").alias("is_text"))
    # exploded, so that what was read isn't worked out again wherever it is used
    rows = values.where(n.isNotNull() | s.isNotNull()).select("path", F.explode(F.array(read)).alias("r")).select("path", "r.*")
    rows = rows.where(F.col("is_text") | F.col("number").isNotNull()).withColumn("unit", _unit(F.col("number")))
    fraction = F.length(F.regexp_extract("s", _TEXT, 3))
    text = F.struct(
        F.lit("text").alias("source"),
        F.when(fraction == 0, "s").when(fraction <= 3, "ms").when(fraction <= 6, "us").otherwise("ns").alias("resolution"),
        F.when(has_zone(F.col("s")), "zoned").otherwise("naive").alias("zone"),
        _text_micros(F.col("s")).alias("micros"),
    )
    other = F.struct(F.when(F.col("own"), "number").otherwise("digits").alias("source"), F.col("unit").alias("resolution"), F.lit(None).cast("string").alias("zone"), _epoch_micros(F.col("number"), F.col("unit")).alias("micros"))
    rows = rows.select("path", F.explode(F.array(F.when(F.col("is_text"), text).otherwise(other))).alias("r")).select("path", "r.*")
    return rows.where("resolution is not null and micros is not null")


def moment_table(found: DataFrame) -> DataFrame:
    """(path, source, resolution, zone, hour, n, first, last) of evidence: what merges, by sums, least and most."""
    hour = F.floor(F.col("micros") / _HOUR).alias("hour")
    return found.groupBy("path", "source", "resolution", "zone", hour).agg(F.count("*").alias("n"), F.min("micros").alias("first"), F.max("micros").alias("last"))


def by_form(table: DataFrame) -> DataFrame:
    """(path, source, resolution, zone, n, first, last), micros since 1970."""
    return table.groupBy("path", "source", "resolution", "zone").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def quantiles(table: DataFrame, qs: list[float]) -> DataFrame:
    """(path, q, at): the middle of the hour that holds the moment of rank max(1, ceil(q n)) at each path."""
    hours = table.groupBy("path", "hour").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("path")  # one row an hour
    run = hours.withColumns({"upto": F.sum("n").over(over.orderBy("hour")), "total": F.sum("n").over(over)}).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    reached = run.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))))
    return reached.groupBy("path", "q").agg(F.timestamp_micros((F.min("hour") * _HOUR + _HOUR // 2).cast("long")).alias("at"))
