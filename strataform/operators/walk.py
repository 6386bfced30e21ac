"""Every value of a set of documents with its path, level by level.

Documents are rows (ord, v): a number and a VARIANT. ``walk`` opens all levels in one stage, after one pass that looks how many
there are, and stores none of them. ``levels`` gives the levels one by one, each kept with ``persist``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import child

#: Leaf kinds in their order, then the two containers (fixed values).
SCALARS = ("null", "bool", "i64", "u64", "f64", "string")
KINDS = (*SCALARS, "object", "array")
#: Deepest level that is looked at.
MAX_DEPTH = 500


def short_methods(spark: SparkSession) -> None:
    """Stages whose code would be longer than Java compiles (8,000 bytes) run operator by operator, in methods that it does
    compile; in one method they would be interpreted."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def kind_of(schema: Column, number: Column) -> Column:
    """The kind of a scalar or an empty container from its variant type and, for decimals, its value.

    A decimal is f64, but one without fraction from 2**63 to below 2**64 is u64.
    """
    whole = (number >= F.lit(str(2**63)).cast("decimal(38,0)")) & (number < F.lit(str(2**64)).cast("decimal(38,0)"))
    return (
        F.when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "BIGINT", "i64")
        .when(schema.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & F.coalesce(whole, F.lit(False)), "u64")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "f64")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("string")
    )


def kind(v: Column) -> Column:
    """The kind of a variant, null where there is none."""
    schema = F.schema_of_variant(v)
    return F.when(F.is_variant_null(v), "null").when(v.isNotNull(), kind_of(schema, F.when(schema.startswith("DECIMAL"), F.try_variant_get(v, "$", "decimal(38,0)"))))


def explode_level(level: DataFrame) -> DataFrame:
    """A level (ord, path, parent, step, is_index, v) with its members: pos, key, member; one row with null pos for a leaf."""
    return level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).withColumnRenamed("value", "member")


def values_of(exploded: DataFrame) -> DataFrame:
    """One row for each value of an exploded level: ord, path, parent, step, is_index, kind, num, str, size.

    num: the number as a double; str: the text; size: keys of an object, elements of an array.
    """
    first = exploded.where("pos is null or pos = 0")
    schema = F.when(F.col("pos").isNull(), F.schema_of_variant("v"))
    kind = F.when(F.col("key").isNotNull(), "object").when(F.col("pos").isNotNull(), "array").otherwise(kind_of(schema, F.when(schema.startswith("DECIMAL"), F.try_variant_get("v", "$", "decimal(38,0)"))))
    rows = first.withColumn("kind", F.when(F.col("v").isNull() | F.is_variant_null("v"), "null").otherwise(kind))
    size = F.when(F.col("kind") == "object", F.when(F.col("pos").isNull(), 0).otherwise(F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))))
    size = size.when(F.col("kind") == "array", F.when(F.col("pos").isNull(), 0).otherwise(F.size(F.try_variant_get("v", "$", "array<variant>"))))
    return rows.select(
        "ord", "path", "parent", "step", "is_index", "kind",
        F.when(F.col("kind").isin("i64", "u64", "f64"), F.try_variant_get("v", "$", "double")).alias("num"),
        F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).alias("str"),
        size.alias("size"),
    )


def members_of(exploded: DataFrame) -> DataFrame:
    """The next level."""
    rows = exploded.where("pos is not null")
    index = F.col("key").isNull()
    return rows.select(
        "ord",
        child(F.col("path"), F.col("key"), F.col("pos")).alias("path"),
        F.col("path").alias("parent"),
        F.coalesce("key", F.col("pos").cast("string")).alias("step"),
        index.alias("is_index"),
        F.col("member").alias("v"),
    )


def levels(docs: DataFrame, max_depth: int = MAX_DEPTH) -> list[DataFrame]:
    """The exploded levels of documents, root first, each persisted; the caller unpersists them."""
    level = docs.select("ord", F.lit(".").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("step"), F.lit(False).alias("is_index"), "v")
    out = []
    while len(out) <= max_depth:
        exploded = explode_level(level).persist(StorageLevel.MEMORY_AND_DISK)
        if exploded.isEmpty():
            exploded.unpersist()
            break
        out.append(exploded)
        level = members_of(exploded)
    return out


#: Levels that are opened in one stage before the values below them are kept.
_STAGE = 6
_MEMBERS = "array<struct<key:string,value:variant>>"


def _start(docs: DataFrame) -> DataFrame:
    text = lambda: F.lit(None).cast("string")
    return docs.select(
        "ord", F.lit(".").alias("path"), F.lit(".").alias("pattern"), text().alias("parent"), text().alias("step"), F.lit(False).alias("is_index"),
        text().alias("kind"), F.lit(None).cast("double").alias("num"), text().alias("str"), F.lit(None).cast("int").alias("size"), "v",
    )


def _open(rows: DataFrame, kept: Column) -> DataFrame:
    """Rows with what is known of each value not seen before (``kind`` is null), followed by its members, not seen yet.

    Members take nothing of the value along but its path, so a row is never larger than its own value. Of a value that was
    seen only ``kept`` stays in v.
    """
    fresh = F.col("kind").isNull()
    rows = rows.withColumn("_map", F.when(fresh, F.try_variant_get("v", "$", "map<string,variant>"))).withColumn("_array", F.when(fresh, F.try_variant_get("v", "$", "array<variant>")))
    leaf = fresh & F.col("_map").isNull() & F.col("_array").isNull()
    rows = rows.withColumn("_type", F.when(leaf & F.col("v").isNotNull() & ~F.is_variant_null("v"), F.schema_of_variant("v")))
    number = F.when(F.col("_type").startswith("DECIMAL"), F.try_variant_get("v", "$", "decimal(38,0)"))
    kind = F.when(~fresh, F.col("kind")).when(F.col("_map").isNotNull(), "object").when(F.col("_array").isNotNull(), "array").when(F.col("_type").isNull(), "null").otherwise(kind_of(F.col("_type"), number))
    rows = rows.withColumn("_kind", kind)
    rows = rows.select(
        "ord", "path", "pattern", "parent", "step", "is_index", F.col("_kind").alias("kind"),
        F.when(leaf & F.col("_kind").isin("i64", "u64", "f64"), F.try_variant_get("v", "$", "double")).otherwise(F.col("num")).alias("num"),
        F.when(leaf & (F.col("_kind") == "string"), F.try_variant_get("v", "$", "string")).otherwise(F.col("str")).alias("str"),
        F.when(F.col("_map").isNotNull(), F.size("_map")).when(F.col("_array").isNotNull(), F.size("_array")).otherwise(F.col("size")).alias("size"),
        "v", "_map", "_array",
    )
    one = lambda key, v: F.struct(key.alias("key"), v.alias("value"))
    none = F.lit(None).cast("string")
    # nothing here that Spark interprets: members share the names of their whole document, which a row would copy
    elements = F.arrays_zip(F.array_repeat(none, F.size("_array")), F.col("_array")).cast(_MEMBERS)
    members = F.when(F.col("_map").isNotNull(), F.map_entries("_map").cast(_MEMBERS)).otherwise(elements)
    own = F.array(one(none, kept)).cast(_MEMBERS)
    both = F.when(F.coalesce(F.col("size"), F.lit(0)) == 0, own).otherwise(F.coalesce(F.concat(own, members), own))
    # never empty; an inner explode would have all of it worked out twice, as Spark asks for its size before
    rows = rows.select("ord", "path", "pattern", "parent", "step", "is_index", "kind", "num", "str", "size", F.posexplode_outer(both).alias("_at", "_m"))
    member, key, at = F.col("_at") > 0, F.col("_m.key"), F.col("_at") - 1
    index = key.isNull()
    up = lambda c, new: F.when(member, new).otherwise(F.col(c)).alias(c)
    gone = lambda c: F.when(~member, F.col(c)).alias(c)
    stem = F.when(index, F.concat("pattern", F.lit("[*]"))).otherwise(child(F.col("pattern"), key, at))
    return rows.select(
        "ord", up("path", child(F.col("path"), key, at)), up("pattern", stem), up("parent", F.col("path")), up("step", F.coalesce(key, at.cast("string"))), up("is_index", index),
        gone("kind"), gone("num"), gone("str"), gone("size"), F.col("_m.value").alias("v"),
    )


def _depth(values: DataFrame, most: int) -> int:
    """Levels of values (v), counted up to ``most``: one pass, as whatever makes the documents would run again for another."""
    rows = values.select("v", F.lit(1).alias("depth"))
    for _ in range(most - 1):
        found = F.coalesce(F.map_values(F.try_variant_get("v", "$", "map<string,variant>")), F.try_variant_get("v", "$", "array<variant>"))
        rows = rows.select("depth", F.posexplode_outer(found).alias("at", "v")).select("v", F.when(F.col("at").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    return rows.agg(F.max("depth")).first()[0] or 0


def opened(docs: DataFrame, max_depth: int = MAX_DEPTH, kept: Column | None = None) -> DataFrame:
    """All values of documents (ord, v): ord, path, pattern (indices as ``[*]``), parent, step, is_index, kind, num, str, size, v.

    ``kept``: what of a value stays in v, over these columns and v; none of it if not given. Levels are opened one after
    the other in one stage, and nothing of them is stored; only below every ``_STAGE`` levels the values still to be opened
    are persisted. Documents of ``from_columns`` say how many levels they have and are not looked through for it.
    """
    known = getattr(docs, "strataform_levels", None)
    short_methods(docs.sparkSession)
    kept = F.lit(None).cast("variant") if kept is None else kept
    rows, left, out = _start(docs), max_depth + 1, None
    while True:
        n = _depth(rows.select("v"), min(_STAGE, left) + 1) if known is None else min(known, min(_STAGE, left) + 1)
        for _ in range(max(1, min(n, _STAGE, left))):
            rows = _open(rows, kept)
        seen = rows.where("kind is not null")
        out = seen if out is None else out.union(seen)
        left -= _STAGE
        if n <= _STAGE or left <= 0:
            return out
        known = known and known - _STAGE
        rows = rows.where("kind is null").persist(StorageLevel.MEMORY_AND_DISK)


def walk(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All values of all documents, as ``values_of`` gives them."""
    return opened(docs, max_depth).select("ord", "path", "parent", "step", "is_index", "kind", "num", "str", "size")
