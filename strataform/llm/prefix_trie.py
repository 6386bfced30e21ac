"""Conversation prefix trie: nodes by digest, sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns (role, text) of some conversation, the root the empty one. Its key is a
chained digest, its edge goes to the digest before it in the chain. What lies below a node is added up in doubling rounds:
in round k each node hands what it has gathered to its ancestor 2**k steps up and then points twice as far, so a trie of
depth n takes about log2(n) rounds, each a few joins over one row a node, written before the next begins.

Turns travel as digests (role and text are read once); chains run over sorted rows, so a long conversation is never held
whole. A node that very many point at is joined by a broadcast of at most HUBS such nodes.

Defined cases: null role or text is empty; turns go by turn number (null first), then role, then the text's digest, so
ties have one order; repeated rows are repeated turns; a null conv_id is a conversation of its own that has no number, so
``conv_id`` is the least of the others and ``ends_sha256`` leaves it out; other columns are ignored; an empty table gives no
rows. Digests have 128 bits; different sequences are taken to differ in them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, tidy

#: A node that more than one in HUBS of all point at is a hub; up to FEW nodes none is.
HUBS, FEW = 1000, 50_000
#: conv_ids that differ only in so many low bits are listed together before lists are hashed.
_RANGE_BITS = 12
ROOT = b"\0" * 16


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, turn_digest, turn_bytes): the turns of each conversation from 1, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("by"), digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("turn_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "by")
    return rows.select("conv_id", F.row_number().over(order).alias("at"), "turn_digest", "turn_bytes")


def _chain(batches):
    """Rows (conv_id, at, turn_digest, turn_bytes) in order; at 0 begins a conversation. One row for each of its nodes."""
    held, names = None, ("node", "parent", "depth", "bytes", "conv_id", "last")
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        out = []
        for conv, at, digest, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "turn_digest", "turn_bytes")), strict=True):
            if held:
                out.append((*held, at == 0))
            if at == 0:
                held = ROOT, None, 0, 0, conv
            else:
                node, depth = held[0], held[2] + 1
                held = hashlib.blake2b(node + digest, digest_size=16).digest(), node, depth, size, conv
        if out:
            yield batch(out)
    if held:
        yield batch([(*held, True)])


def _hash_lists(batches):
    """Rows (node, piece) in order: the digest of each node's pieces, comma-joined."""
    node, state, fields = None, None, pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        nodes, said = [], []
        for now, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if now == node:
                state.update(b"," + piece.encode())
                continue
            if state:
                nodes.append(node)
                said.append(state.hexdigest())
            node, state = now, hashlib.sha256(piece.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(said)], schema=fields)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=fields)


def memberships(turns: DataFrame) -> DataFrame:
    """(node, parent, depth, bytes, conv_id, last): the nodes of each conversation, the root first.

    turns: (conv_id, at, turn_digest, turn_bytes), and for each conversation a row with ``at`` 0.
    """
    dealt = turns.select("conv_id", "at", "turn_digest", "turn_bytes").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(tidy(_chain), "node binary, parent binary, depth int, bytes long, conv_id long, last boolean")


def _follow(rows: DataFrame, target: DataFrame, count: int) -> DataFrame:
    """``rows`` (to, ...) joined to ``target`` (to, ...), whose ``to`` are distinct; hubs by a broadcast of bounded size."""
    if count <= FEW:
        return rows.join(target, "to")
    hot = F.broadcast(rows.groupBy("to").count().where(F.col("count") > count // HUBS).select("to"))
    of_hubs = rows.join(F.broadcast(target.join(hot, "to")), "to")
    return of_hubs.unionByName(rows.join(hot, "to", "left_anti").join(target, "to"))


def _gathered(nodes: DataFrame, count: int, depth: int) -> DataFrame:
    """(node, n_leaves, saved): sums over subtrees of ``nodes`` (node, parent, n_leaves, saved), ``depth`` levels at most."""
    now = nodes.select("node", F.col("parent").alias("to"), "n_leaves", "saved")
    for k in range(depth.bit_length()):
        steps = now.where("to is not null")
        up = steps.groupBy(F.col("to").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jumped = _follow(steps.select("node", "to"), now.select(F.col("node").alias("to"), F.col("to").alias("next")), count).select("node", "next")
        after = now.join(up, "node", "left").join(jumped, "node", "left").select(
            "node",
            F.col("next").alias("to"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        after = materialize(after)
        if k:
            forget(now)
        now = after
    return now.select("node", "n_leaves", "saved")


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the decimal conv_ids that end there, ascending, comma-joined."""
    some = members.where("last and conv_id is not null").select("node", "conv_id", F.shiftright("conv_id", _RANGE_BITS).alias("range"))
    pieces = some.groupBy("node", "range").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    return pieces.repartition("node").sortWithinPartitions("node", "range").select("node", "piece").mapInArrow(tidy(_hash_lists), "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (as ``memberships`` takes them): node, parent, conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes of turns that members share, each but once) and ends_sha256."""
    members = materialize(memberships(turns))
    nodes = members.groupBy("node", "parent", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first()
    sums = _gathered(nodes, size["n"], size["depth"])
    of_parent = _follow(nodes.where("parent is not null").select("node", F.col("parent").alias("to")), nodes.select(F.col("node").alias("to"), F.col("conv_id").alias("parent_conv_id")), size["n"]).select("node", "parent_conv_id")
    found = nodes.drop("n_leaves", "saved").join(sums, "node").join(of_parent, "node", "left").join(_ends(members), "node", "left")
    return found.select("node", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``trie`` of conversations as they are: turns (conv_id, turn, role, text)."""
    rows = materialize(numbered(turns))
    return trie(rows.unionByName(_begins(rows)))


def _begins(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id").distinct().select("conv_id", F.lit(0).alias("at"), F.lit(b"").alias("turn_digest"), F.lit(0).cast("long").alias("turn_bytes"))


def spliced(turns: DataFrame, family: int, most: int) -> DataFrame:
    """Turns for ``trie``, as if conversations of a family had branched off from its first: each conversation c begins with
    the first h turns of conversation c - c % ``family`` (all if it has fewer, none if there is none) and goes on with its
    own after its first h; h is crc32 of c's decimal text mod ``most`` + 1. A null conv_id stays as it is."""
    rows = materialize(numbered(turns))
    h = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(most + 1))
    own = rows.where(F.col("at") > h).withColumn("at", F.col("at") + most)
    begins = _begins(rows)
    ids = begins.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    first = rows.where(F.col("at") <= most).withColumnRenamed("conv_id", "base")
    taken = ids.join(first, "base").where(F.col("at") <= F.col("h")).select(*rows.columns)
    return own.unionByName(taken).unionByName(begins)
