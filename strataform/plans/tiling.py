"""Tiles: what paths the documents of each run of 2,048 hold, and which of them deserve typed columns.

Documents are numbered, so a tile is a range of numbers and needs no place of its own. A tile's header has a row for each
path pattern (indices as ``[*]``): documents that have it, documents that have it as null, counts of its kinds, and two
bitmaps of the tile's documents, where it is present and where it is null. A Bloom filter over its paths says which tiles
cannot have one. Headers are aggregates of (tile, path), so they build up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.walk import KINDS, SCALARS, opened
from ..sources.storage import materialize

TILE_BITS = 11
TILE = 1 << TILE_BITS
#: Share of documents from which a (path, kind) is worth a column.
EXTRACT = 0.6
#: Bloom filters: bits for each path, hash functions, and bits at most (those of a bitmap of Spark).
_BITS, _HASHES, _MOST_BITS = 10, 7, 1 << 15

_INDEX = r'\G((?:[^"\[]|"(?:[^"\\]|\\.)*+"|\[\*\])*+)\[[0-9]+\]'


def pattern_of(path: Column) -> Column:
    """A path with every index as ``[*]``; what is in quotes stays."""
    return F.regexp_replace(path, _INDEX, "$1[*]")


def tile_of(ord_: Column) -> Column:
    return F.shiftright(ord_, TILE_BITS)


#: Documents of one word of a bitmap, and its bits as they lie in a whole bitmap: byte after byte, each from its lowest bit.
_WORD_BITS = 6
_BIT = "shiftleft(1L, cast(56 - 8 * ((ord & 63) div 8) + (ord & 7) as int))"


def _bitmap(bits: str) -> Column:
    """The bitmap of a tile's documents from its words."""
    words = F.map_from_entries(F.collect_list(F.struct("word", F.lpad(F.hex(bits), 16, "0"))))
    whole = F.transform(F.sequence(F.lit(0), F.lit((TILE >> _WORD_BITS) - 1)), lambda i: F.coalesce(F.try_element_at(words, i), F.lit("0" * 16)))
    return F.unhex(F.array_join(whole, ""))


def headers(docs: DataFrame) -> DataFrame:
    """(tile, docs, path, n, n_null, kinds, present, nulls) of documents (ord, v) with numbers from 0.

    n, n_null: documents that have the path at all, and as null; kinds: values of each kind. Documents are walked once,
    here; what is asked of headers later reads the stored words.
    """
    # bitmaps are built up in words, as most paths are in few documents of a tile
    word = F.shiftright(F.col("ord").bitwiseAND(F.lit(TILE - 1)), _WORD_BITS).cast("int")
    values = opened(docs).select(tile_of(F.col("ord")).alias("tile"), word.alias("word"), F.col("pattern").alias("path"), "kind", F.expr(_BIT).alias("bit"))
    kept = materialize(values.groupBy("tile", "path", "word", "kind").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("values")))
    null = F.when(F.col("kind") == "null", F.col("bits")).otherwise(0)
    words = kept.groupBy("tile", "path", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or(null).alias("null_bits"), *(F.sum(F.when(F.col("kind") == k, F.col("values")).otherwise(0)).alias(f"k_{k}") for k in KINDS))
    found = words.groupBy("tile", "path").agg(
        F.sum(F.bit_count("bits")).alias("n"), F.sum(F.bit_count("null_bits")).alias("n_null"), _bitmap("bits").alias("present"), _bitmap("null_bits").alias("nulls"),
        *(F.sum(f"k_{k}").alias(f"k_{k}") for k in KINDS),
    )
    kinds = F.array_compact(F.array(*(F.when(F.col(f"k_{k}") > 0, F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("values"))) for k in sorted(KINDS))))
    trimmed = found.withColumn("kinds", F.map_from_entries(kinds))
    roots = words.where("path = '.'").groupBy("tile").agg(F.sum(F.bit_count("bits")).alias("docs"))  # every document has a root
    return trimmed.join(roots, "tile").select("tile", "docs", "path", "n", "n_null", "kinds", "present", "nulls")


def documents_of(header: DataFrame, bitmap: str = "present") -> DataFrame:
    """(tile, path, ord): the documents in a bitmap of headers."""
    octets = F.sequence(F.lit(0), F.lit(TILE // 8 - 1))
    here = lambda i: F.conv(F.hex(F.substring(F.col(bitmap), i + 1, F.lit(1))), 16, 10).cast("int")
    at = F.flatten(F.transform(octets, lambda i: F.transform(F.filter(F.array(*map(F.lit, range(8))), lambda b: F.getbit(here(i), b) == 1), lambda b: i * 8 + b)))
    return header.select("tile", "path", F.explode(at).alias("at")).select("tile", "path", (F.col("tile") * TILE + F.col("at")).alias("ord"))


def _places(path: Column, bits: Column) -> Column:
    """The places of a path in a Bloom filter of ``bits`` bits."""
    a, b = F.pmod(F.xxhash64(path), bits), F.pmod(F.xxhash64(path, F.lit(1)), bits)
    return F.transform(F.array(*map(F.lit, range(_HASHES))), lambda i: F.pmod(a + i * (b.bitwiseOR(F.lit(1))), bits))


def blooms(header: DataFrame) -> DataFrame:
    """(tile, n_paths, bits, bloom): a filter over each tile's paths, its size a power of two that follows their number.

    Beyond about 3,000 paths a tile it stays at its most, then it lets more through; it never misses a path.
    """
    sizes = header.groupBy("tile").agg(F.count("*").alias("n_paths"))
    power = F.ceil(F.log2(F.greatest(F.col("n_paths") * _BITS, F.lit(64)))).cast("int")
    sizes = sizes.withColumn("bits", F.least(F.pow(F.lit(2), power), F.lit(_MOST_BITS)).cast("long"))
    rows = header.select("tile", "path").join(sizes, "tile")
    placed = rows.select("tile", "n_paths", "bits", F.explode(_places(F.col("path"), F.col("bits"))).alias("at"))
    made = placed.groupBy("tile", "n_paths", "bits").agg(F.bitmap_construct_agg("at").alias("bloom"))
    return made.withColumn("bloom", F.substring("bloom", F.lit(1), (F.col("bits") / 8).cast("int")))


def may_hold(path: Column) -> Column:
    """Whether a row of ``blooms`` may have a path: false is certain."""
    octet = lambda at: F.conv(F.hex(F.substring(F.col("bloom"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(_places(path, F.col("bits")), lambda at: F.getbit(octet(at), (at % 8).cast("int")) == 1)


def candidates(header: DataFrame, share: float = EXTRACT) -> DataFrame:
    """(tile, path, kind, n, docs): of each tile the scalar (path, kind) in more than ``share`` of its documents; only
    paths of fields, which a document has once."""
    kinds = header.select("tile", "docs", "path", F.explode("kinds").alias("kind", "n")).where(F.col("kind").isin(*SCALARS[1:]))
    return kinds.where((F.col("n") > share * F.col("docs")) & ~F.regexp_replace("path", r'"(?:[^"\\]|\\.)*+"', "").contains("[")).select("tile", "path", "kind", "n", "docs")


def promotion(header: DataFrame, share: float = EXTRACT) -> DataFrame:
    """(path, kind, n, docs, tiles): the scalar (path, kind) in more than ``share`` of all documents, and in how many tiles
    they are candidates."""
    total = header.where("path = '.'").agg(F.sum("docs").alias("docs"))
    kinds = header.select("tile", "path", F.explode("kinds").alias("kind", "n")).where(F.col("kind").isin(*SCALARS[1:]))
    kinds = kinds.where(~F.regexp_replace("path", r'"(?:[^"\\]|\\.)*+"', "").contains("[")).groupBy("path", "kind").agg(F.sum("n").alias("n"))
    here = candidates(header, share).groupBy("path", "kind").agg(F.count("*").alias("tiles"))
    found = kinds.join(F.broadcast(total), F.lit(True)).where(F.col("n") > share * F.col("docs"))  # total: one row
    return found.join(here, ["path", "kind"], "left").select("path", "kind", "n", "docs", F.coalesce("tiles", F.lit(0)).alias("tiles"))
