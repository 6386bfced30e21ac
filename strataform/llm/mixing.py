"""Mixing sources to target weights, by blocks of words.

The words of a source, its documents in a fixed order, are cut into blocks of ``block`` words. Each output shard draws
how many of its slots come from each source by a multinomial over what the sources have left of their targets; the last
shard takes what is left, so that all together meet the targets. Slot k of a source takes block ``perm(k mod blocks)`` of that source, a pseudorandom permutation for each
pass over it. Blocks and slots are joined by index from the blocks' side: the inverse permutation gives the slots that
take a block, so no slot table is shuffled.

Targets: sources by code point, null last, weigh ``weights`` in turn and share the words of all; no target exceeds
``cap`` times its source, the excess goes to the others by weight until none is above.

Defined cases: null or wordless text has size 0 and takes nothing; null ids and repeated rows are documents like others;
other columns are kept, but in ``sized`` and ``mix`` those with the prefix ``mix_``, which are its own, are replaced; an
empty table gives no rows. What the driver holds
is a few numbers for each source and for each of at most MAX_SHARDS shards. The same rows give the same mix.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACES, as_bytes, lean, materialize, tidy

#: Words in a block, slots in a shard at least, shards at most, documents of a source that one task numbers, about.
BLOCK, SHARD_SLOTS, MAX_SHARDS, PART_DOCS = 32, 1024, 4096, 4096
#: Sources up to which what is known of each is broadcast.
BROADCAST_SOURCES = 100_000
WEIGHTS, CAP, SEED = (1, 2, 3), 3, 20240229


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` and mix_size, its number of words, and mix_tie, which orders rows of one id and size."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(map(zlib.crc32, texts), pa.int64())], names=[*batch.schema.names, "mix_size", "mix_tie"])

    lean(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if not c.lower().startswith("mix_")))
    return docs.mapInArrow(tidy(run), _ddl(docs) + ", mix_size long, mix_tie long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none over cap * size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


class Permutation:
    """A keyed permutation of range(n): four Feistel rounds over the next even power of two, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.key * 0xBF58476D1CE4E5B9 + r * 0x94D049BB133111EB) % (1 << 64))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, rounds) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.mask
        for r in rounds:
            a, b = (b, a ^ self._round(b, r)) if r >= 0 else (b ^ self._round(a, ~r), a)
        return (a << np.uint64(self.half)) | b

    def _walk(self, x: np.ndarray, rounds) -> np.ndarray:
        x = self._once(x.astype(np.uint64), rounds)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], rounds)
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, (0, 1, 2, 3))

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, (~3, ~2, ~1, ~0))


def draw(goal: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard, ``goal`` in all."""
    left = np.array(goal, dtype=np.int64)
    slots = int(left.sum())
    n = max(1, -(-slots // shard_slots))
    out, rng = np.zeros((n, len(goal)), dtype=np.int64), np.random.default_rng(seed)
    for i in range(n - 1):
        size = shard_slots
        while size:  # what a source doesn't have any more is drawn again from the others
            take = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[i] += take
            left -= take
            size -= int(take.sum())
    out[-1] += left
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED, stats: DataFrame | None = None, then=None, schema: str | StructType | None = None) -> DataFrame:
    """``docs`` (as ``sized`` gives them; the text itself isn't needed) and mix_source_size, mix_target, mix_taken, mix_pieces.

    mix_pieces: array of (shard, slot, start, length), the words of the document that the mix takes and where they go;
    a slot of a shard is filled by the pieces of one block. ``stats``: the same rows without their texts, where they are
    at hand already. ``then``: what is done with the batches in the same Python worker, and the ``schema`` that it gives.
    """
    counts = docs if stats is None else stats
    sums = counts.groupBy("source").agg(F.sum("mix_size").alias("size"), F.count("*").alias("docs")).collect()  # a row for each source
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], cap)
    blocks = [-(-s // block) for s in sizes]
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["source"], i, sizes[i], goal[i], 1 + r["docs"] // PART_DOCS) for i, r in enumerate(sums)], "mix_key string, mix_source int, mix_source_size long, mix_target double, mix_parts long")
    known = F.broadcast(known) if len(sums) <= BROADCAST_SOURCES else known
    # the documents of a source are numbered in parts, so that none of them is one task
    parted = lambda d: d.join(known, F.col("source").eqNullSafe(F.col("mix_key"))).withColumn("mix_part", F.pmod(F.xxhash64("doc_id", "mix_size", "source"), F.col("mix_parts"))).drop("mix_key", "mix_parts")
    parts = parted(counts.select("doc_id", "source", "mix_size")).groupBy("mix_source", "mix_part").agg(F.sum("mix_size").alias("part_size"))
    total = sum(goal)
    # in blocks of the source's own mean size, as its last one may be short
    slots_of = [g * b / s if s else 0.0 for g, b, s in zip(goal, blocks, sizes, strict=True)]
    wanted = [min(round(x), cap * b) for x, b in zip(slots_of, blocks, strict=True)]
    shard_slots = max(SHARD_SLOTS, -(-sum(wanted) // MAX_SHARDS))
    drawn = draw(wanted, shard_slots, seed) if total else np.zeros((1, len(sums)), dtype=np.int64)
    plan = [{"blocks": blocks[i], "first": np.concatenate(([0], np.cumsum(drawn[:, i]))).tolist()} for i in range(len(sums))]
    before = np.concatenate((np.zeros((len(drawn), 1), np.int64), np.cumsum(drawn, axis=1)), axis=1).tolist()  # slots of a shard go by source

    parts = parts.withColumn("mix_before", F.coalesce(F.sum("part_size").over(Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_size")
    order = Window.partitionBy("mix_source", "mix_part").orderBy("doc_id", "mix_size", "mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = parted(docs).withColumn("mix_at", F.coalesce(F.sum("mix_size").over(order), F.lit(0)))
    placed = placed.join(parts, ["mix_source", "mix_part"]).withColumn("mix_at", F.col("mix_at") + F.col("mix_before")).drop("mix_before", "mix_part")

    pieces = _taker(plan, before, block, seed)
    if then:
        return placed.mapInArrow(tidy(lambda batches: then(pieces(batches))), schema)
    fields = placed.schema.names + ["mix_taken", "mix_pieces"]
    own = _ddl(placed) + ", mix_taken long, mix_pieces array<struct<shard:int,slot:int,start:long,length:int>>"
    return placed.mapInArrow(tidy(pieces), own).select(*[f for f in fields if f not in ("mix_at", "mix_source", "mix_tie")])


def _taker(plan: list[dict], before: list[list[int]], block: int, seed: int):
    kind = pa.list_(pa.struct([("shard", pa.int32()), ("slot", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))

    def run(batches):
        for batch in batches:
            source, at, size = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("mix_source", "mix_at", "mix_size"))
            n = batch.num_rows
            lo, hi = at // block, np.where(size > 0, -(-(at + size) // block), at // block)
            taken, out = np.zeros(n, dtype=np.int64), [[] for _ in range(n)]
            for s in np.unique(source).tolist():
                p, rows = plan[s], np.flatnonzero((source == s) & (size > 0))
                b, k_all = p["blocks"], p["first"][-1]
                counts = hi[rows] - lo[rows]
                if not len(rows) or not k_all:
                    continue
                owner = np.repeat(rows, counts)
                index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[owner]
                start = np.maximum(index * block - at[owner], 0)
                length = np.minimum((index + 1) * block - at[owner], size[owner]) - start
                for epoch in range(-(-k_all // b)):
                    k = epoch * b + Permutation(b, seed + 1000003 * s + epoch).inverse(index)
                    for j in np.flatnonzero(k < k_all).tolist():
                        shard = bisect_right(p["first"], int(k[j])) - 1
                        out[owner[j]].append((shard, before[shard][s] + int(k[j]) - p["first"][shard], int(start[j]), int(length[j])))
                        taken[owner[j]] += length[j]
            pieces = pa.array([[{"shard": a, "slot": c, "start": d, "length": e} for a, c, d, e in x] for x in out], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken), pieces], names=[*batch.schema.names, "mix_taken", "mix_pieces"])

    return run


def _offsets(text: bytes) -> np.ndarray:
    """Where each word begins, 0 for the first, and the end of the text."""
    is_space = np.zeros(256, dtype=bool)
    is_space[list(SPACES)] = True
    word = np.concatenate(([False], ~is_space[np.frombuffer(text, dtype=np.uint8)]))
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    starts[:1] = 0
    return np.append(starts, len(text))


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns that the mix doesn't read under other names, and the names."""
    used = {c: c for c in ("doc_id", "source", "text")}
    names = [used.get(c, f"kept_{i}") for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: of each document the words taken, in order, one row for each pass; columns as given.

    The words keep the signs that follow them, so line breaks and indents stay. n_chars follows the text.
    """
    apart, names = _apart(docs)
    length = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            rows, texts = [], []
            column = batch.column("text").to_pylist()
            for i, pieces in enumerate(batch.column("mix_pieces").to_pylist()):
                if not pieces:
                    continue
                passes: list[list[tuple[int, int]]] = []
                seen: dict[int, int] = {}
                for p in pieces:
                    k = seen[p["start"]] = seen.get(p["start"], -1) + 1
                    if k == len(passes):
                        passes.append([])
                    passes[k].append((p["start"], p["length"]))
                raw = column[i].encode("utf-8", "surrogatepass")
                at = _offsets(raw)
                for taken in passes:
                    rows.append(i)
                    texts.append(b"".join(raw[at[s] : at[s + n]] for s, n in sorted(taken)).decode("utf-8", "surrogatepass"))
            part = batch.select(names).take(pa.array(rows, pa.int64()))
            columns = {c: part.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if length:
                columns[length] = pa.array([len(x) for x in texts], pa.int64()).cast(part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    rows = sized(apart)
    return mix(rows, stats=materialize(rows.select("doc_id", "source", "mix_size")), then=run, schema=apart.schema, **options).toDF(*docs.columns)


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as shards: (shard, slot, doc_id, source, start, text), a row for each piece, shards whole and in order.

    The pieces of a slot are the words of one block, from the document they begin in on.
    """
    schema = "shard int, slot int, doc_id long, source string, start long, text string"

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, source, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "mix_pieces")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at = _offsets(raw)
                rows += [(p["shard"], p["slot"], i, source, p["start"], raw[at[p["start"]] : at[p["start"] + p["length"]]].decode("utf-8", "surrogatepass")) for p in pieces]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "slot", "doc_id", "source", "start", "text"])

    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    pieces = mix(rows, stats=materialize(rows.select("doc_id", "source", "mix_size")), then=run, schema=schema, **options)
    return pieces.repartition("shard").sortWithinPartitions("shard", "slot", "doc_id", "start")
