"""Language-model scoring by context-tree weighting of bytes.

A byte is eight binary decisions; byte END, which UTF-8 never contains, ends each text and stands before it. The context
of a byte are the bytes before it, latest first, up to DEPTH of them or the latest separator (white space or END), which
ends it: so contexts cross a word, not the one before it. For each decision the tree of contexts holds
Krichevsky-Trofimov estimates at all depths; each node mixes its own estimate with the product of its children's, half
and half, and a byte's probability is the mixture along its contexts, with the counts of the whole corpus.

Texts are cut at separators into pieces (separator, word, separator). A piece's bytes have their contexts within it, so
each different piece is weighed once with its count. The pairs (longest context, byte) of all pieces, a table that grows
with the corpus, are sorted by context: a subtree is a run of rows, and is weighed in the block of rows that holds it.
Nodes that go beyond a block are prefixes of its first or last context; their counts and the products of their closed
children meet on the driver, at most 2 * (DEPTH + 1) nodes a block, and every row then mixes in its open nodes.

Defined cases: null text is empty and still has its end; null ids and repeated rows are documents like others; without
training rows every decision is even; other columns are ignored; an empty table gives no rows. A word of more than LONG
bytes is several pieces that overlap by DEPTH bytes of context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, _powers, as_bytes, batch_word_hashes, forget, lean, materialize, mix, process_cache, tidy

#: Bytes of context; bytes of a piece; the byte that ends a text.
DEPTH, LONG, END = 16, 64, 0xFF
#: Keys whose values are broadcast at most, rows of contexts weighed at once, bytes of text handled at once.
FREQUENT, BLOCK, CHUNK = 1 << 20, 1 << 18, 1 << 19
END_WORD = 0x454E44
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SIGN = np.uint64(1 << 63)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*SPACES, END]] = True


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps of the recurrence."""
    x = np.asarray(x, dtype=float)
    low = np.ones_like(x)
    for i in range(7):
        low = low * (x + i)
    y = x + 7
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(low)


_HALVES = _log_gamma(np.arange(1 << 12) + 0.5) - _log_gamma(np.array(0.5))
_WHOLES = _log_gamma(np.arange(1 << 12) + 1.0)


def _from(table: np.ndarray, x: np.ndarray, shift: float, less: float) -> np.ndarray:
    out = table[np.minimum(x, len(table) - 1).astype(np.int64)]
    big = x >= len(table)
    if big.any():
        out[big] = _log_gamma(x[big] + shift) - less
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    a, b = np.atleast_1d(np.asarray(a, dtype=float)), np.atleast_1d(np.asarray(b, dtype=float))
    half = float(_log_gamma(np.array(0.5)))
    return _from(_HALVES, a, 0.5, half) + _from(_HALVES, b, 0.5, half) - _from(_WHOLES, a + b, 1.0, 0.0)


def _weigh(own: np.ndarray, children: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the mixed probability, and the weight of the node's own estimate."""
    mixed = np.where(leaf, own, np.logaddexp(own, children) - np.log(2.0))
    return mixed, np.where(leaf, 1.0, np.exp(own - np.log(2.0) - mixed))


# ---- pieces


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = process_cache()
    if len(cache.get("piece_powers", ((), ()))[0]) < n:
        cache["piece_powers"] = _powers(_P, max(n, 2 * CHUNK)), _powers(_P_INV, max(n, 2 * CHUNK))
    return cache["piece_powers"]


def pieces(texts: list[bytes]):
    """(hash of each piece, its text, first byte, end, the bytes these refer to) of texts, a few texts at a time."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHUNK):
            held += len(texts[stop]) + 1
            stop += 1
        raw = np.frombuffer(b"\xff" + b"\xff".join(texts[at:stop]) + b"\xff", dtype=np.uint8)
        cuts = np.flatnonzero(_ENDS[raw])
        first, last = cuts[:-1], cuts[1:]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:stop]]), first, side="right")
        times = (last - first + LONG - 1) // LONG
        if (times > 1).any():
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            head, tail = np.repeat(first, times), np.repeat(last, times)
            owner = np.repeat(owner, times)
            last = np.minimum(tail, head + LONG * (part + 1))
            first = np.where(part > 0, head + 1 + LONG * part - DEPTH, head)
        hashes = np.empty(len(first), dtype=np.uint64)
        lo = 0
        while lo < len(first):  # in runs of at most CHUNK bytes or so
            hi = max(int(np.searchsorted(last, first[lo] + CHUNK)), lo + 1)
            start = int(first[lo])
            part = raw[start : last[hi - 1] + 1].astype(np.uint64)
            up, down = _both_powers(len(part))
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part + np.uint64(1)) * up[: len(part)], out=total[1:])
            h = (total[last[lo:hi] + 1 - start] - total[first[lo:hi] - start]) * down[first[lo:hi] - start]
            hashes[lo:hi] = mix(h ^ (last[lo:hi] - first[lo:hi] + (1 << 32)).astype(np.uint64))
            lo = hi
        yield hashes, owner + at, first, last + 1, raw
        at = stop


def _binary(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs raw[first:end] as Arrow binaries."""
    size = end - first
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[take].tobytes())])


def units(raw: np.ndarray, first: np.ndarray, end: np.ndarray):
    """(piece, hi, lo, byte) of the bytes of pieces: the context, latest byte first, as two big-endian numbers."""
    skip = np.where(_ENDS[raw[first]], 1, DEPTH)  # what is context only
    size = end - first - skip
    piece = np.repeat(np.arange(len(first)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first + skip, size)
    low = np.repeat(first, size)
    words = np.zeros((2, len(at)), dtype=np.uint64)
    open_, place = np.arange(len(at)), at - 1  # contexts that go on, and their next byte
    for i in range(DEPTH):
        byte = raw[place]
        words[i // 8, open_] |= byte.astype(np.uint64) << np.uint64(56 - 8 * (i % 8))
        on = ~_ENDS[byte] & (place > low[open_])
        open_, place = open_[on], place[on] - 1
    return piece, words[0], words[1], raw[at]


def unit_keys(hi: np.ndarray, lo: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(hi ^ mix(lo ^ mix(byte.astype(np.uint64) + np.uint64(1))))


def _summed(parts: list[tuple]) -> tuple:
    """Parts (hash, counts of training, counts, binaries) as one, each hash once."""
    key, where, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = [np.bincount(inverse, weights=np.concatenate([p[i] for p in parts]), minlength=len(key)) for i in (1, 2)]
    return key, *n, pa.concat_arrays([p[3] for p in parts]).take(pa.array(where))


def _counts(batches):
    """(kind, key, piece, n, m): 0 pieces, 1 words; n in training texts, m in all; each key about once a task."""
    kept: dict[int, list] = {0: [], 1: []}
    rows = np.zeros(2)

    def out(kind: int):
        key, n, m, piece = _summed(kept[kind])
        kept[kind] = []
        for at in range(0, len(key), 1 << 16):
            s = slice(at, at + (1 << 16))
            k = key[s].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), piece[s], pa.array(n[s].astype(np.int64)), pa.array(m[s].astype(np.int64))], names=["kind", "key", "piece", "n", "m"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            texts = as_bytes(batch.column("text").slice(at, 256))
            seen = ~batch.column("held_out").slice(at, 256).to_numpy(zero_copy_only=False).astype(bool)
            rows += (seen.sum(), len(texts))
            for h, owner, first, end, raw in pieces(texts):
                key, where, inverse, m = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                kept[0].append((key, np.bincount(inverse, weights=seen[owner], minlength=len(key)), m, _binary(raw, first[where], end[where])))
            found = batch_word_hashes(texts)
            h = np.concatenate(found)
            key, inverse, m = np.unique(h, return_inverse=True, return_counts=True)
            kept[1].append((key, np.bincount(inverse, weights=np.repeat(seen, [len(f) for f in found]), minlength=len(key)), m, pa.nulls(len(key), pa.binary())))
            for kind in kept:
                if len(kept[kind]) > 1 and sum(len(p[0]) for p in kept[kind]) > 800_000:
                    kept[kind] = [_summed(kept[kind])]
                    if len(kept[kind][0][0]) > 400_000:
                        yield from out(kind)
    if rows[1]:
        kept[1].append((np.array([END_WORD], dtype=np.uint64), rows[:1], rows[1:], pa.nulls(1, pa.binary())))
    for kind in kept:
        if kept[kind]:
            yield from out(kind)


def _laid(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow binary column as (bytes, first, end)."""
    column = column.cast(pa.binary())
    cuts = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8), cuts[:-1], cuts[1:]


def _contexts(batches):
    """(hi, lo, byte, n) of pieces with their counts, summed within a batch; hi and lo so that signed order is byte order."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        piece, hi, lo, byte = units(*_laid(batch.column("piece")))
        n = batch.column("n").to_numpy()[piece]
        key, where, inverse = np.unique(unit_keys(hi, lo, byte), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((hi[where] ^ _SIGN).view(np.int64)), pa.array((lo[where] ^ _SIGN).view(np.int64)), pa.array(byte[where].astype(np.int32)), pa.array(total)], names=["hi", "lo", "byte", "n"])


# ---- the tree


def _masked(hi: np.ndarray, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``depth`` bytes of contexts."""
    keep = [np.uint64(((1 << 8 * k) - 1) << (64 - 8 * k)) for k in (min(depth, 8), max(depth - 8, 0))]
    return hi & keep[0], lo & keep[1]


def _node_keys(hi: np.ndarray, lo: np.ndarray, depth: int) -> np.ndarray:
    hi, lo = _masked(hi, lo, depth)
    return mix(hi ^ mix(lo ^ mix(np.full(len(hi), depth + 7, dtype=np.uint64))))


def weigh_block(hi: np.ndarray, lo: np.ndarray, byte: np.ndarray, n: np.ndarray):
    """One block of rows sorted by context: (open nodes of each row, P of its bits below these, open nodes' counts).

    Open is what the first or the last row has on its path; a row's open nodes are the first of its path. The counts are
    (depth, hi, lo, node of the byte, zeros, ones, log of the closed children's product).
    """
    rows = len(hi)
    path = np.stack([hi, lo], axis=1).astype(">u8").view(np.uint8).reshape(rows, DEPTH)
    ends = _ENDS[path]
    length = np.where(ends.any(axis=1), ends.argmax(axis=1) + 1, DEPTH)

    def alike(a, b):
        other = a != b
        return np.where(other.any(axis=1), other.argmax(axis=1), DEPTH)

    opened = 1 + np.minimum(np.maximum(alike(path, path[:1]), alike(path, path[-1:])), length)
    before = np.zeros(rows, dtype=np.int64)
    before[1:] = alike(path[1:], path[:-1])
    p = np.zeros((rows, 8))
    byte = byte.astype(np.int64)
    place = np.zeros(rows, dtype=np.int64)
    below: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * 8
    open_nodes = []
    for depth in range(DEPTH, -1, -1):
        alive = np.flatnonzero(length >= depth)
        if not len(alive):
            continue
        group = np.cumsum((before[alive] < depth) if depth else np.zeros(len(alive), dtype=bool))
        key, where, inverse = np.unique(group << 8 | byte[alive], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=n[alive], minlength=len(key))
        place[alive] = inverse
        closed = opened[alive] <= depth
        for k in range(8):
            prefix = key >> (8 - k)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            node = np.cumsum(new) - 1
            size = int(node[-1]) + 1
            one = (key >> (7 - k)) & 1
            ones = np.bincount(node, weights=count * one, minlength=size)
            zeros = np.bincount(node, weights=count, minlength=size) - ones
            rep = alive[where[new]]
            mixed_below, rep_below = below[k]
            children = np.bincount(node[place[rep_below]], weights=mixed_below, minlength=size).astype(float)  # of nothing it is integers
            mixed, own = _weigh(log_kt(zeros, ones), children, length[rep] == depth)
            shut = opened[rep] <= depth
            below[k] = mixed[shut], rep[shut]
            estimate = (np.where(one == 1, ones[node], zeros[node]) + 0.5) / (zeros + ones + 1.0)[node]
            mine = inverse[closed]
            share = own[node[mine]]
            r = alive[closed]
            p[r, k] = share * estimate[mine] + (1 - share) * p[r, k]
            o = rep[~shut]
            h, w = _masked(hi[o], lo[o], depth)
            open_nodes.append((np.full(len(o), depth), h, w, (1 << k) | (byte[o] >> (8 - k)), zeros[~shut], ones[~shut], children[~shut]))
    return opened, p, tuple(np.concatenate(c) for c in zip(*open_nodes, strict=True))


def _weighed(batches):
    """Rows (hi, lo, byte, n, opened, p), and open nodes with their counts where ``depth`` is not null."""
    held, size = [], 0

    def block():
        hi, lo, byte, n = (np.concatenate(c) for c in zip(*held, strict=True))
        opened, p, found = weigh_block(hi, lo, byte, n)
        for at in range(0, len(hi), 1 << 15):
            s = slice(at, at + (1 << 15))
            k = len(hi[s])
            raw = p[s].astype(np.float32)
            packed = pa.Array.from_buffers(pa.binary(32), k, [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            none = [pa.nulls(k, t) for t in (pa.int32(), pa.float64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(hi[s].view(np.int64)), pa.array(lo[s].view(np.int64)), pa.array(byte[s].astype(np.int32)), pa.array(n[s]), pa.array(opened[s].astype(np.int32)), packed, *none], names=names)
        depth, hi, lo, node, zeros, ones, closed = found
        k = len(depth)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(node.astype(np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(depth.astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(closed)],
            names=names,
        )

    names = ["hi", "lo", "byte", "n", "opened", "p", "depth", "zeros", "ones", "closed"]
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK - size)
            held.append(tuple(part.column(c).to_numpy() if i > 1 else part.column(c).to_numpy().view(np.uint64) ^ _SIGN for i, c in enumerate(("hi", "lo", "byte", "n"))))
            at, size = at + part.num_rows, size + part.num_rows
            if size == BLOCK:
                yield from block()
                held, size = [], 0
    if size:
        yield from block()


def open_tree(depth, hi, lo, node, zeros, ones, closed) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the open nodes, and for each (weight, P of zero, P of one) by node of the byte."""
    keys = np.zeros(len(depth), dtype=np.uint64)
    up = np.zeros(len(depth), dtype=np.uint64)
    leaf = depth == DEPTH
    path = np.stack([hi, lo], axis=1).astype(">u8").view(np.uint8).reshape(len(hi), DEPTH)
    for d in range(DEPTH + 1):
        at = depth == d
        keys[at] = _node_keys(hi[at], lo[at], d)
        if d:
            up[at] = _node_keys(hi[at], lo[at], d - 1)
            leaf[at] |= _ENDS[path[at, d - 1]]
    names, which = np.unique(keys, return_inverse=True)
    children = np.zeros((len(names), 256))
    out = np.zeros((len(names), 3, 256), dtype=np.float32)
    children[which, node] = closed
    for d in range(DEPTH, -1, -1):
        at = np.flatnonzero(depth == d)
        if not len(at):
            continue
        w, b = which[at], node[at]
        mixed, own = _weigh(log_kt(zeros[at], ones[at]), children[w, b], leaf[at])
        total = zeros[at] + ones[at] + 1.0
        out[w, 0, b], out[w, 1, b], out[w, 2, b] = own, (zeros[at] + 0.5) / total, (ones[at] + 0.5) / total
        if d:
            np.add.at(children, (np.searchsorted(names, up[at]), b), mixed)
    return names, out


def unit_values(hi, lo, byte, opened, p, names, tree) -> np.ndarray:
    """log10 P of bytes in their contexts: ``p`` below the open nodes, mixed with these."""
    p, byte = p.astype(float), byte.astype(np.int64)
    for d in range(int(opened.max(initial=0)) - 1, -1, -1):
        at = np.flatnonzero(opened > d)
        found = np.searchsorted(names, _node_keys(hi[at], lo[at], d))
        for k in range(8):
            node, one = (1 << k) | (byte[at] >> (8 - k)), (byte[at] >> (7 - k)) & 1
            own = tree[found, 0, node].astype(float)
            p[at, k] = own * tree[found, 1 + one, node] + (1 - own) * p[at, k]
    return np.log10(p.prod(axis=1))


# ---- scores


def _frequent(table: DataFrame, by: str) -> tuple[int, DataFrame]:
    """The least power of two such that at most FREQUENT rows have ``by`` from it on, and these rows."""
    sizes = {r["e"]: r["n"] for r in table.where(F.col(by) > 0).groupBy(F.floor(F.log2(by)).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()}
    left, least = FREQUENT, 64
    for e in sorted(sizes, reverse=True):
        if sizes[e] > left:
            break
        left, least = left - sizes[e], e
    return least, table.where(F.col(by) >= F.lit(float(2**least)))


def _sorted(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    """key as sorted unsigned numbers, and the columns in that order."""
    t = rows.select("key", *columns).toArrow()
    key = t["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    return [key[order], *(t[c].to_numpy()[order] for c in columns)]


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand among sorted ``keys``, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def piece_values(counted: DataFrame) -> DataFrame:
    """(key, value, m) of pieces (key, piece, n, m): log10 P of each piece's bytes by the tree that the counts n make."""
    spark = counted.sparkSession
    grams = counted.select("piece", "n").mapInArrow(tidy(_contexts), "hi long, lo long, byte int, n long").groupBy("hi", "lo", "byte").agg(F.sum("n").alias("n"))
    schema = "hi long, lo long, byte int, n long, opened int, p binary, depth int, zeros double, ones double, closed double"
    weighed = materialize(grams.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "byte").mapInArrow(tidy(_weighed), schema))
    found = weighed.where("depth is not null").groupBy("depth", "hi", "lo", "byte").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("closed").alias("closed")).toArrow()
    c = [found[x].to_numpy() for x in ("depth", "hi", "lo", "byte", "zeros", "ones", "closed")]
    tree = spark.sparkContext.broadcast(open_tree(c[0].astype(np.int64), c[1].astype(np.int64).view(np.uint64), c[2].astype(np.int64).view(np.uint64), *c[3:]))

    def values(batches):
        for batch in batches:
            if batch.num_rows:
                hi, lo = (batch.column(x).to_numpy().view(np.uint64) for x in ("hi", "lo"))
                byte, opened = batch.column("byte").to_numpy(), batch.column("opened").to_numpy()
                raw, first, end = _laid(batch.column("p"))
                p = raw[first[0] : end[-1]].view(np.float32).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([pa.array(unit_keys(hi, lo, byte).view(np.int64)), pa.array(unit_values(hi, lo, byte, opened, p, *tree.value)), batch.column("n")], names=["key", "value", "n"])

    known = materialize(weighed.where("depth is null").select("hi", "lo", "byte", "n", "opened", "p").mapInArrow(tidy(values), "key long, value double, n long"))
    forget(weighed)
    least, top = _frequent(known, "n")
    shared = spark.sparkContext.broadcast(_sorted(top, "value"))

    def first_part(batches):
        keys, value = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            piece, hi, lo, byte = units(*_laid(batch.column("piece")))
            key = unit_keys(hi, lo, byte)
            at, hit = _place(keys, key)
            total = np.bincount(piece[hit], weights=value[at[hit]], minlength=batch.num_rows).astype(float)
            offsets = np.zeros(batch.num_rows + 1, dtype=np.int32)
            np.cumsum(np.bincount(piece[~hit], minlength=batch.num_rows), out=offsets[1:])
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[~hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("m"), pa.array(total), rare], names=["piece", "m", "value", "rare"])

    begun = counted.select("key", "piece", "m").mapInArrow(tidy(first_part), "piece long, m long, value double, rare array<long>")
    rest = begun.select("piece", "m", "value", F.posexplode_outer("rare").alias("pos", "key"))
    few = known.where(F.col("n") < F.lit(float(2**least))).select("key", F.col("value").alias("more"))
    whole = rest.join(few, "key", "left").groupBy("piece", "m").agg((F.max("value") + F.coalesce(F.sum("more"), F.lit(0.0))).alias("value"))
    out = materialize(whole.select(F.col("piece").alias("key"), "value", "m"))
    forget(known)
    return out


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the models learn from the rows not held out.

    base_score: log10 of the words and an end under add-half unigram counts. score: log10 P of the text by the weighted
    context trees; -score / log10(2) / (bytes + 1) is the code length in bits for each byte.
    """
    spark = docs.sparkSession
    lean(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = base.select("text", "held_out").mapInArrow(tidy(_counts), "kind int, key long, piece binary, n long, m long")
    counts = materialize(counts.groupBy("kind", "key", "piece").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    words = counts.where("kind = 1").select("key", F.col("n").alias("c"), "m")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, n_distinct = int(totals[0]), int(totals[1])
    valued = piece_values(counts.where("kind = 0").select("key", "piece", "n", "m"))
    least_word, top_words = _frequent(words, "m")
    least_piece, top_pieces = _frequent(valued, "m")
    shared = spark.sparkContext.broadcast((*_sorted(top_words, "c"), *_sorted(top_pieces, "value")))
    floor = n_train + 0.5 * (n_distinct + 1)

    def run(batches):
        known, count, keys, value = shared.value
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = as_bytes(part.column("text"))
                scores = np.zeros(len(texts))
                rest: list[list[np.ndarray]] = [[] for _ in texts]
                for h, owner, *_ in pieces(texts):
                    place, hit = _place(keys, h)
                    scores += np.bincount(owner[hit], weights=value[place[hit]], minlength=len(texts))
                    missed = h[~hit]
                    cuts = np.searchsorted(owner[~hit], np.arange(len(texts) + 1))
                    for i in np.flatnonzero(np.diff(cuts)):
                        rest[i].append(missed[cuts[i] : cuts[i + 1]])
                rows = []
                for w, others in zip(batch_word_hashes(texts), rest, strict=True):
                    w = np.append(w, np.uint64(END_WORD))
                    place, hit = _place(known, w)
                    c = count[place[hit]]
                    rare, times = np.unique(np.concatenate([w[~hit], *others]), return_counts=True)
                    rows.append((len(w), int((c > 0).sum()), float(np.log10((c + 0.5) / floor).sum()), rare.view(np.int64), times))
                n, k, b, rare, times = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(scores), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=names,
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"
    scored = materialize(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(run), schema))
    few_words = words.where(F.col("m") < F.lit(float(2**least_word))).select("key", F.log10((F.col("c") + 0.5) / F.lit(floor)).alias("b"), (F.col("c") > 0).cast("long").alias("f"), F.lit(0.0).alias("s"))
    few_pieces = valued.where(F.col("m") < F.lit(float(2**least_piece))).select("key", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("f"), F.col("value").alias("s"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    more = rare.join(few_words.union(few_pieces), "key").groupBy("row").agg(*(F.sum(F.col("times") * F.col(a)).alias(a) for a in ("b", "f", "s")))
    return scored.withColumnRenamed("score", "begun").drop("rare", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("f", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("begun") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
