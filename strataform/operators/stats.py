"""Statistics of the values at each path: sums that add up over any split of the documents.

``tables`` gives two DataFrames: ``values``, one row for each (path, kind), and ``buckets``, counts of each
(path, measure, bucket): formats, skeletons and length classes of texts and keys, the sketches of numbers, key counts and
lengths, lengths themselves, and signatures of elements. Two results of different documents merge by ``merge``.
"""

from __future__ import annotations

from math import ceil, exp, log

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import detect_format, length_bucket, skeleton
from .signatures import signature_counts, signature_of_types, type_tells

#: Relative error of the sketches.
ACCURACY = 0.02
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)

VALUE_COLUMNS = ("path", "parent", "step", "is_index", "kind")
_SUMS = ("n", "n_num", "sum", "n_neg", "n_zero", "n_pos", "n_whole", "n_str", "sum_len", "sum_size")


def sketch_bucket(x: Column) -> Column:
    """The bucket of a number: its sign and ceil(ln|x| / ln gamma), as text that names both; not for NaN."""
    i = F.ceil(F.log(F.abs(x)) / log(GAMMA)).cast("string")
    return F.when(x == 0, "0").when(x > 0, F.concat(F.lit("+"), i)).otherwise(F.concat(F.lit("-"), i))


def bucket_value(bucket: str) -> float:
    """The middle of a bucket."""
    if bucket == "0":
        return 0.0
    return (1 if bucket[0] == "+" else -1) * exp((int(bucket[1:]) - 0.5) * log(GAMMA))


def quantile(buckets: dict[str, int], q: float) -> float | None:
    """The value of rank max(1, ceil(q * n)) of a sketch."""
    total = sum(buckets.values())
    if not total:
        return None
    rank, seen = max(1, ceil(q * total)), 0
    for b in sorted(buckets, key=bucket_value):
        seen += buckets[b]
        if seen >= rank:
            return bucket_value(b)
    return None


def quantiles(df: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """(q, value): sketch quantiles of a column, worked out over its buckets."""
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(sketch_bucket(x).alias("bucket")).agg(F.count("*").alias("n"))
    i = F.substring("bucket", 2, 12).cast("int")
    value = F.when(F.col("bucket") == "0", 0.0).when(F.col("bucket").startswith("+"), F.exp((i - 0.5) * log(GAMMA))).otherwise(-F.exp((i - 0.5) * log(GAMMA)))
    # a sketch has some thousand buckets at most, whatever the rows
    run = counts.withColumn("value", value).withColumn("upto", F.sum("n").over(Window.orderBy("value"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = run.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    return wanted.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total")))).groupBy("q").agg(F.min("value").alias("value"))


def value_table(values: DataFrame) -> DataFrame:
    """One row for each path and kind."""
    num, size = F.col("num"), F.col("size")
    length = F.octet_length("str")
    return values.groupBy(*VALUE_COLUMNS).agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"),
        F.count("num").alias("n_num"), F.min("num").alias("min"), F.max("num").alias("max"), F.sum("num").alias("sum"),
        F.count_if(num < 0).alias("n_neg"), F.count_if(num == 0).alias("n_zero"), F.count_if(num > 0).alias("n_pos"), F.count_if(num == F.floor(num)).alias("n_whole"),
        F.count("str").alias("n_str"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.sum(length).alias("sum_len"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.sum("size").alias("sum_size"),
    )


#: Columns of what is counted of a value, next to its path and kind: of a text its format, length class and skeleton, of a
#: number its sketch bucket, of a container its size and, of an element, its signature's type.
_COUNTED = ("form", "text_len", "skeleton", "number", "container_size", "type")
#: In place of the type of an element whose signature its value has to tell.
_UNTOLD = "?"


def element_value(kind: Column, is_index: Column, v: Column) -> Column:
    """What ``groups`` needs of a value: an element that is a container."""
    return F.when(is_index & kind.isin("object", "array"), v)


def groups(values: DataFrame) -> DataFrame:
    """How often each path has what is counted, of values (with v as ``element_value`` gives it)."""
    line = F.lit("\n")
    schema = F.when(F.col("kind") == "object", F.schema_of_variant("v"))
    of_type = F.when(F.col("v").isNull(), "").when(F.coalesce(type_tells(schema), F.lit(False)), schema).otherwise(_UNTOLD)
    rows = values.withColumn("type", F.when(F.col("kind").isin("object", "array"), of_type)).withColumn("form", detect_format(F.col("str")))
    text = F.concat("form", line, length_bucket(F.octet_length("str")).cast("string"), line, F.when(F.col("form") == "other", skeleton(F.col("str"))).otherwise(""))
    counted = F.when(F.col("kind") == "string", text).when(F.col("num").isNotNull() & ~F.isnan("num"), sketch_bucket(F.col("num")))
    counted = counted.when(F.col("type").isNotNull(), F.concat(F.col("size").cast("string"), line, "type"))
    # few and narrow keys: the method that counts must be short enough for Java to compile
    found = rows.withColumn("counted", counted).groupBy("path", "parent", "is_index", "kind", "counted").agg(F.count("*").alias("n"))
    part = lambda i: F.split_part("counted", line, F.lit(i))
    is_text, holds = F.col("kind") == "string", F.col("kind").isin("object", "array")
    parts = {
        "form": F.when(is_text, part(1)), "text_len": F.when(is_text, part(2)),
        "skeleton": F.when(is_text & (part(1) == "other"), F.regexp_replace("counted", r"\A[^\n]*\n[^\n]*\n", "")),
        "number": F.when(~is_text & ~holds, F.col("counted")), "container_size": F.when(holds, part(1).cast("int")),
        "type": F.when(holds, F.nullif(F.regexp_replace("counted", r"\A[^\n]*\n", ""), F.lit(""))),
    }
    return found.select("*", *(parts[c].alias(c) for c in _COUNTED)).drop("counted")


def shape_tables(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, buckets) with what shapes are built of and nothing else, from values (with v as ``element_value`` gives it):
    ``n``, ``first``, ``last``, sizes, and as buckets lengths of arrays and signatures of elements. The values are looked at
    once (and those elements again whose type doesn't tell their signature), texts and numbers not at all; the few groups
    they come to are persisted."""
    holds = F.col("kind").isin("object", "array")
    schema = F.when(F.col("kind") == "object", F.schema_of_variant("v"))
    of_type = F.when(F.col("v").isNull(), "").when(F.coalesce(type_tells(schema), F.lit(False)), schema).otherwise(_UNTOLD)
    # short keys: what a value counts as is one text, as ``groups`` has it
    rows = values.withColumn("counted", F.when(holds, F.concat(F.col("size").cast("string"), F.lit("\n"), of_type)))
    found = rows.groupBy(*VALUE_COLUMNS, "counted").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    size, text = F.substring_index("counted", "\n", 1).cast("int"), F.nullif(F.regexp_replace("counted", r"\A[^\n]*\n", ""), F.lit(""))
    found = found.select(*VALUE_COLUMNS, size.alias("size"), F.when(holds, text).alias("type"), "n", "first", "last").persist(StorageLevel.MEMORY_AND_DISK)
    table = found.groupBy(*VALUE_COLUMNS).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.sum(F.col("size") * F.col("n")).alias("sum_size"),
    )
    lengths = found.where("kind = 'array'").groupBy("path", F.lit("length").alias("measure"), F.col("size").cast("string").alias("bucket")).agg(F.sum("n").alias("n"))
    return table, lengths.union(signature_table(found, values))


def bucket_table(found: DataFrame, table: DataFrame) -> DataFrame:
    """Counts of (path, measure, bucket) of groups and, for keys, the value table; not of signatures."""
    pair = lambda measure, bucket: F.struct(F.lit(measure).alias("measure"), bucket.cast("string").alias("bucket"))
    size = F.col("container_size")
    text = F.array(pair("format", F.col("form")), pair("text_len", F.col("text_len")), pair("skeleton", F.col("skeleton")))
    own = F.when(F.col("kind") == "string", text).when(F.col("number").isNotNull(), F.array(pair("number", F.col("number"))))
    own = own.when(F.col("kind") == "object", F.array(pair("key_count", sketch_bucket(size.cast("double")))))
    own = own.when(F.col("kind") == "array", F.array(pair("length", size), pair("length_sketch", sketch_bucket(size.cast("double")))))
    owned = found.where("kind not in ('null', 'bool')").select("path", F.explode(own).alias("x"), "n").select("path", "x.*", "n")
    # keys are texts of the object that holds them
    keys = table.where("not is_index and parent is not null").groupBy(F.col("parent").alias("path"), F.col("step").alias("key")).agg(F.sum("n").alias("n"))
    keys = keys.withColumn("form", detect_format(F.col("key")))
    of_key = F.array(pair("key_format", F.col("form")), pair("key_len", F.octet_length("key")), pair("key_skeleton", F.when(F.col("form") == "other", skeleton(F.col("key")))))
    keys = keys.select("path", F.explode(of_key).alias("x"), "n").select("path", "x.*", "n")
    return owned.union(keys).where("bucket is not null").groupBy("path", "measure", "bucket").agg(F.sum("n").alias("n"))


def signature_table(found: DataFrame, values: DataFrame) -> DataFrame:
    """Counts of the signatures of the elements of each array, from groups and, for those that their type doesn't tell,
    from the values they come from."""
    leaves = found.where("is_index and type is null").select(F.col("parent").alias("path"), F.col("kind").alias("bucket"), "n")
    told = found.where(F.col("is_index") & (F.col("type") != _UNTOLD)).groupBy(F.col("parent").alias("path"), "type").agg(F.sum("n").alias("n"))
    out = leaves.union(signature_of_types(told))
    if not found.where(F.col("type") == _UNTOLD).isEmpty():
        schema = F.when(F.col("kind") == "object", F.schema_of_variant("v"))
        untold = values.where(F.col("is_index") & F.col("v").isNotNull()).where(~F.coalesce(type_tells(schema), F.lit(False)))
        out = out.union(signature_counts(untold.select(F.col("parent").alias("path"), F.col("v").alias("member"))))
    return out.groupBy("path", F.lit("signature").alias("measure"), "bucket").agg(F.sum("n").alias("n"))


def merge(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Statistics of all documents from those of disjoint sets of them."""
    values, buckets = parts[0]
    for v, b in parts[1:]:
        values, buckets = values.unionByName(v), buckets.unionByName(b)
    least, most = ("first", "min", "min_len", "min_size"), ("last", "max", "max_len", "max_size")
    here = lambda columns: [c for c in columns if c in values.columns]
    merged = values.groupBy(*VALUE_COLUMNS).agg(*(F.sum(c).alias(c) for c in here(_SUMS)), *(F.min(c).alias(c) for c in here(least)), *(F.max(c).alias(c) for c in here(most)))
    return merged, buckets.groupBy("path", "measure", "bucket").agg(F.sum("n").alias("n"))
