"""Language-model scoring by context-tree weighting of bytes, with contexts of the last DEPTH bytes whatever they are.

A byte is eight binary decisions; byte END, which UTF-8 never contains, ends each text and stands before it. The context
of a byte are the DEPTH bytes before it, latest first, across words and lines; only END, before which there is nothing,
ends it early. For each decision the tree of contexts holds Krichevsky-Trofimov estimates at all depths; each node mixes
its own estimate with the product of its children's, half and half, and a byte's probability is the mixture along its
context, with the counts of the whole corpus.

Every byte of every text goes with its context to the block of sorted contexts it falls into. Blocks follow a sample of
contexts, which decides their sizes only. Equal (context, byte) of a block are one row. A subtree of one row has a closed
form (both terms of each of its mixtures are the same), so a row takes part from the depth on that it shares with another
row: exact, and contexts that occur once cost nothing further. Nodes that a block's bounds cut are open: their counts and
the products of their closed children meet on the driver, and a second walk over the blocks mixes them in. Each walk goes over the
texts RUNS times, for a share of the blocks each time, so that only a share of the contexts lies on disk.

Defined cases: null text is empty and still has its end; null ids and repeated rows are documents like others; without
training rows every decision is even; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_word_hashes, forget, lean, materialize, mix, reclaim, shuffles_go, tidy
from .ctw import END, END_WORD, _frequent, _place, _sorted, _weigh, log_kt

#: Bytes of context; bytes of text cut at once; contexts in one row of the shuffle; about so many contexts in a block.
DEPTH, CHUNK, PART, BLOCK = 16, 1 << 21, 2048, 1 << 18
#: Bytes of a shuffled context with its byte and row; runs over the texts, each for a share of the blocks, and the bytes
#: of text from which there is one run more.
PLANES, RUNS, RUN = DEPTH + 4, 6, 1 << 25
#: Bytes of text from which the bounds of blocks are drawn, about, and contexts drawn for a block.
SAMPLE, DRAWN = 1 << 26, 64
_SIGN = np.uint64(1 << 63)


def _units(raw: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, byte) of the bytes from ``skip`` on: the context, latest byte first, as two big-endian numbers."""
    back = np.concatenate([np.zeros(DEPTH, dtype=np.uint8), raw])
    eight = np.empty(len(raw) + 8, dtype=np.uint64)  # the bytes from k to k + 7 of back, the last one highest
    for k in range(8):
        eight[k::8] = back[k : k + (len(back) - k) // 8 * 8].view("<u8")[: len(eight[k::8])]
    hi, lo = eight[8:], eight[:-8].copy()
    ends = np.flatnonzero(raw == END)
    to = np.minimum(np.append(ends[1:], len(raw) - 1), ends + DEPTH - 1) - ends
    known = np.arange(to.sum()) - np.repeat(np.cumsum(to) - to, to) + 1  # bytes of context, with the END before them
    short = np.repeat(ends, to) + known
    for w, keep in ((hi, np.minimum(known, 8)), (lo, known - 8)):
        less = (64 - 8 * np.maximum(keep, 1)).astype(np.uint64)
        w[short] = np.where(keep > 0, w[short] >> less << less, np.uint64(0))
    return hi[skip:], lo[skip:], raw[skip:]


def contexts(texts: list[bytes]):
    """(text, hi, lo, byte) of all bytes and ends of texts; a long text in several parts."""
    if len(texts) > 1 or len(texts[0]) <= CHUNK:
        raw = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        yield np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), *_units(raw, 1)
        return
    raw = np.frombuffer(b"\xff" + texts[0] + b"\xff", dtype=np.uint8)
    for at in range(1, len(raw), CHUNK):
        lead = max(0, at - DEPTH)
        found = _units(raw[lead : at + CHUNK], at - lead)
        yield np.zeros(len(found[0]), dtype=np.int64), *found


def paths(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.stack([hi, lo], axis=1).astype(">u8").view(np.uint8).reshape(len(hi), DEPTH)


def bounds_of(sample: np.ndarray) -> np.ndarray:
    """Bounds of blocks from sorted ``sample`` (first eight bytes): one in DRAWN or so, where they have few bytes."""
    if len(sample) < 2 * DRAWN:
        return np.zeros(1, dtype=np.uint64)
    path = sample.astype(">u8").view(np.uint8).reshape(-1, 8)
    other = path[1:] != path[:-1]
    need = np.where(other.any(axis=1), other.argmax(axis=1) + 1, 9)  # bytes that tell a context from the one before
    need = need[: len(need) // DRAWN * DRAWN].reshape(-1, DRAWN)
    best = need.argmin(axis=1)
    need = need[np.arange(len(need)), best]
    at = sample[np.arange(len(best)) * DRAWN + best + 1]
    left = (np.uint64(8) * (8 - np.minimum(need, 8)).astype(np.uint64)).astype(np.uint64)
    return np.unique(np.concatenate([[np.uint64(0)], (at >> left << left)[need < 9]]))


def opened_of(hi: np.ndarray, low: np.uint64, high: np.uint64 | None) -> np.ndarray:
    """How many nodes of each path of a block, sorted, reach beyond [low, high), from the root on."""
    out = np.zeros(len(hi), dtype=np.int64)
    for d in range(8):
        span = np.uint64((1 << (64 - 8 * d)) - 1)
        if low & span:
            out[: np.searchsorted(hi, low | span, side="right")] = d + 1
        if high is not None:
            out[np.searchsorted(hi, high & ~span) :] = d + 1
    return out


def _keys(depth: int | np.ndarray, hi: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Keys of (depth, first bytes, node of the byte); open nodes have at most seven bytes."""
    return mix(hi ^ mix((np.asarray(depth, dtype=np.uint64) << np.uint64(8)) + node.astype(np.uint64) + np.uint64(1)))


def _with_end(word: np.ndarray) -> np.ndarray:
    """Whether one of eight bytes is END."""
    return ((~word - np.uint64(0x0101010101010101)) & word & np.uint64(0x8080808080808080)) != 0


def _alike(differs: np.ndarray) -> np.ndarray:
    """How many of eight bytes, the highest first, are zero up to the first other."""
    out = np.zeros(len(differs), dtype=np.int8)
    for k in range(8):
        out += differs < np.uint64(1 << (8 * k + 8)) if k < 7 else np.int8(0)
    return out + (differs == 0)


def _mixed(own: np.ndarray, children: np.ndarray, leaf: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_weigh`` of a node and those above it that have the same counts, ``nodes`` of them in all."""
    half = np.exp2(-nodes)
    near, far = own + np.log1p(-half), children + np.log(half)
    over = far - near
    less = np.exp(-np.abs(over))
    mixed = np.where(leaf, own, np.maximum(near, far) + np.log1p(less))
    return mixed, np.where(leaf, 1.0, np.where(over > 0, less, 1.0) / (1.0 + less))


def walk(hi, lo, byte, n, opened, tree=None):
    """A block of sorted rows (context, byte), each once. Without ``tree``: its open nodes, (depth, first bytes, node of
    the byte, zeros, ones, log of the closed children's product). With it (of ``open_tree``): P of each row's bits.

    A closed context is weighed where others branch off or rows begin, together with those above it up to the next such
    depth: they have its counts. Where one byte only follows, its eight decisions are alike and weighed as one.
    """
    rows = len(hi)
    byte = byte.astype(np.int64)
    length = np.full(rows, DEPTH)
    short = np.flatnonzero(_with_end(hi) | _with_end(lo))
    ends = paths(hi[short], lo[short]) == END
    length[short] = ends.argmax(axis=1) + 1
    same = np.full(rows + 1, -1)
    same[1:-1] = _alike(hi[1:] ^ hi[:-1])
    whole = np.flatnonzero(same[1:-1] == 8)
    same[whole + 1] += _alike(lo[whole + 1] ^ lo[whole])
    entry = np.maximum(np.minimum(length, np.maximum(np.maximum(same[:-1], same[1:]), opened - 1)), 0)
    by_entry = np.argsort(entry.astype(np.int8), kind="stable")
    starts = np.searchsorted(entry[by_entry], np.arange(DEPTH + 2))
    # what waits for the depth it is weighed at next: (row of it, byte, count, number, value), of one byte or of several
    one_byte, several = ([[] for _ in range(DEPTH + 1)] for _ in range(2))
    levels, found, numbers = [], [], [0, 0]
    for depth in range(DEPTH, -1, -1):
        fresh = by_entry[starts[depth] : starts[depth + 1]]
        alone = np.where(length[fresh] == depth, 0.0, log_kt(n[fresh], np.zeros(len(fresh))))
        ones_in = [np.concatenate(c) for c in zip((fresh, byte[fresh], n[fresh], np.empty(0, np.int64), alone), *one_byte[depth], strict=True)]
        if not len(ones_in[0]) and not several[depth]:
            continue
        more = [np.concatenate(c, axis=-1) for c in zip(*several[depth], strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((8, 0))]
        one_byte[depth] = several[depth] = None
        rep, what, count = (np.concatenate(c) for c in zip(ones_in[:3], more[:3], strict=True))
        begins = same[:-1] < depth
        begins[0] = True
        group = np.cumsum(begins, dtype=np.int32)[rep] - 1
        key = group.astype(np.int64) << 8 | what
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        key, rep = key[new], rep[order][new]
        what, group = key & 255, key >> 8
        count = np.bincount(place, weights=count, minlength=len(key))
        single = np.bincount(place[: len(ones_in[0])], weights=ones_in[4], minlength=len(key))
        edge = np.append(np.flatnonzero(begins), rows)
        up = np.maximum(np.maximum(same[edge[group]], same[edge[group + 1]]), opened[rep] - 1)
        shut = opened[rep] <= depth
        up[~shut] = depth - 1
        leaf = length[rep] == depth
        apart = np.concatenate([[True], group[1:] != group[:-1], [True]])
        few = apart[:-1] & apart[1:] & shut
        # one byte
        d, g = np.flatnonzero(few), np.flatnonzero(~few)
        mixed, share = _mixed(log_kt(count[d], np.zeros(len(d))), single[d], leaf[d], (depth - up[d]).astype(float))
        _wait(one_byte, up[d], rep[d], what[d], count[d], numbers[0] + np.arange(len(d)), mixed)
        # several bytes
        at = np.full(len(key), -1)
        at[g] = np.arange(len(g))
        begun, inside = more[4], at[place[len(ones_in[0]) :]]
        single, key, what, rep, up, shut, leaf, count_g = single[g], key[g], what[g], rep[g], up[g], shut[g], leaf[g], count[g]
        nodes = (depth - up).astype(float)
        # where a byte is alone its decisions are alike, as at the last one; the others follow
        last = single + np.bincount(inside, weights=begun[7], minlength=len(g))
        mixed, own = _mixed(log_kt(count_g, np.zeros(len(g))), last, leaf, nodes)
        below, weight, estimate = np.tile(mixed, (8, 1)), None, None
        if tree is not None:
            weight, estimate = np.tile(own, (8, 1)), np.tile((count_g + 0.5) / (count_g + 1.0), (8, 1))
        a = np.arange(len(g))
        for k in range(8) if len(g) else ():
            prefix = key[a] >> (8 - k)
            apart = np.concatenate([[True], prefix[1:] != prefix[:-1], [True]])
            go = ~(apart[:-1] & apart[1:] & shut[a])
            apart, a = apart[:-1][go], a[go]
            if not len(a):
                break
            first = np.flatnonzero(apart)
            head = a[first]
            one = (key[a] >> (7 - k)) & 1
            counted = count_g[a]
            total = np.add.reduceat(counted, first)
            ones = np.add.reduceat(counted * one, first)
            # of several rows that are one node of a child the first has its value
            children = np.add.reduceat((single + np.bincount(inside, weights=begun[k], minlength=len(g)))[a], first)
            closed = shut[head]
            mixed, own = _mixed(log_kt(total - ones, ones), children, leaf[head], nodes[head])
            below[k, a] = 0
            below[k, head[closed]] = mixed[closed]
            if tree is not None:
                node = np.cumsum(apart) - 1
                weight[k, a] = own[node]
                estimate[k, a] = (np.where(one == 1, ones[node], (total - ones)[node]) + 0.5) / (total[node] + 1.0)
                if not closed.all():
                    o = a[~shut[a]]
                    names, values = tree
                    t = np.searchsorted(names, _keys(depth, _first(hi[rep[o]], depth), (1 << k) | (what[o] >> (8 - k))))
                    weight[k, o], estimate[k, o] = values[0][t], np.where((what[o] >> (7 - k)) & 1 == 1, values[2][t], values[1][t])
            elif not closed.all():
                o = head[~closed]
                found.append((np.full(len(o), depth), _first(hi[rep[o]], depth), (1 << k) | (what[o] >> (8 - k)), (total - ones)[~closed], ones[~closed], children[~closed]))
        _wait(several, up, rep, what, count_g, numbers[1] + np.arange(len(g)), below)
        if tree is not None:
            levels.append((fresh, ones_in[3], more[3], place, d, g, at, *numbers, share, (count[d] + 0.5) / (count[d] + 1.0), weight, estimate))
        numbers = [numbers[0] + len(d), numbers[1] + len(g)]
    if tree is None:
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, float, float, float))
    # what nodes above add, and the weight that is left for those below: of several bytes by decision (the last row is
    # of what has nothing above), of one byte from there on
    plus, times = np.zeros((numbers[1] + 1, 8)), np.ones((numbers[1] + 1, 8))
    added, left, above = np.zeros(numbers[0]), np.ones(numbers[0]), np.full(numbers[0], numbers[1])
    value, over = np.empty(rows), np.empty(rows, dtype=np.int64)
    for fresh, ones_in, more, place, d, g, at, by_one, by_several, share, sure, weight, estimate in reversed(levels):
        s, t = slice(by_one, by_one + len(d)), slice(by_several, by_several + len(g))
        added[s] += left[s] * share * sure
        left[s] *= 1 - share
        plus[t] += times[t] * (weight * estimate).T
        times[t] *= (1 - weight).T
        now = np.zeros(len(at)), np.ones(len(at)), at + by_several
        now[0][d], now[1][d], now[2][d] = added[s], left[s], above[s]
        own, rest, tail = (place[a:b] for a, b in itertools.pairwise((0, len(fresh), len(fresh) + len(ones_in), len(place))))
        value[fresh], over[fresh] = now[0][own] + now[1][own] * (n[fresh] + 0.5) / (n[fresh] + 1.0), now[2][own]
        added[ones_in], left[ones_in], above[ones_in] = (x[rest] for x in now)
        plus[more], times[more] = plus[now[2][tail]], times[now[2][tail]]
    p = times[over]
    p *= value[:, None]
    p += plus[over]
    return p


def _wait(lists: list[list], up: np.ndarray, *columns: np.ndarray) -> None:
    """Columns (by position in their last axis) go to the list of the depth ``up``; those of nothing above are done."""
    order = np.argsort(up.astype(np.int8), kind="stable")
    cuts = np.searchsorted(up[order], np.arange(DEPTH + 2)).tolist()
    for depth, (a, b) in enumerate(itertools.pairwise(cuts)):
        if a < b:
            lists[depth].append(tuple(c[..., order[a:b]] for c in columns))


def _first(hi: np.ndarray, depth: int) -> np.ndarray:
    return hi & np.uint64(((1 << 8 * depth) - 1) << (64 - 8 * depth))


def open_tree(depth, hi, node, zeros, ones, closed) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the open nodes, each once in the input, and (weight, P of zero, P of one) of each."""
    keys = _keys(depth, hi, node)
    order = np.argsort(keys)
    names = keys[order]
    depth, hi, node, zeros, ones, children = (x[order] for x in (depth, hi, node, zeros, ones, closed))
    children, total = children.astype(float), zeros + ones + 1.0
    share = np.empty(len(names))
    for d in range(int(depth.max(initial=-1)), -1, -1):
        at = np.flatnonzero(depth == d)
        # END's node is a leaf: contexts that go on behind it do not exist
        leaf = (hi[at] >> np.uint64(64 - 8 * d)) & np.uint64(255) == END if d else np.zeros(len(at), dtype=bool)
        mixed, share[at] = _weigh(log_kt(zeros[at], ones[at]), children[at], leaf)
        if d:
            np.add.at(children, np.searchsorted(names, _keys(d - 1, _first(hi[at], d - 1), node[at])), mixed)
    return names, np.stack([share, (zeros + 0.5) / total, (ones + 0.5) / total])


# ---- blocks


def _texts(batches):
    """(first row, texts, held out) of rows that follow each other, at most CHUNK bytes or one text at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.column("row").to_numpy()
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            for lo in range(at, batch.num_rows, 64):
                more = as_bytes(batch.column("text").slice(lo, 64))
                for t in more:
                    if texts and (size + len(t) > CHUNK or row[at + len(texts)] != row[at] + len(texts)):
                        break
                    texts.append(t)
                    size += len(t) + 1
                else:
                    continue
                break
            yield int(row[at]), texts, held[at : at + len(texts)]
            at += len(texts)


def _cutter(bounds, start: int, stop: int):
    """Rows (block, size, first, data) of blocks from ``start`` to before ``stop``: contexts, bytes and rows after ``first``
    of at most PART bytes of texts, plane by plane of their bytes and packed.
    """
    low, high = _range(bounds.value, start)[0], _range(bounds.value, stop - 1)[1]
    names = ["block", "size", "first", "data"]

    def out(rows, begin):
        blocks, sizes, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sizes, pa.int32()), pa.array([begin] * len(rows), pa.int64()), pa.array(data, pa.binary())], names=names)

    def run(batches):
        for begin, texts, held in _texts(batches):
            for owner, hi, lo, byte in contexts(texts):
                inside = hi >= low
                if high is not None:
                    inside &= hi < high
                order = np.flatnonzero(inside)
                order = order[np.argsort(hi[order])]
                hi, owner = hi[order], owner[order]
                cuts = np.append(np.searchsorted(hi, bounds.value[start:stop]), len(hi)).tolist()
                planes = np.empty((PLANES, len(hi)), dtype=np.uint8)
                for at, whole in ((0, hi), (8, lo[order])):
                    planes[at : at + 8] = whole.view(np.uint8).reshape(-1, 8).T[::-1]
                planes[DEPTH] = byte[order]
                planes[DEPTH + 1 :] = (owner << 1 | held[owner]).astype("<u4").view(np.uint8).reshape(-1, 4).T[: PLANES - DEPTH - 1]
                rows = []
                for b, (first, end) in enumerate(itertools.pairwise(cuts)):
                    for at in range(first, end, PART):
                        part = planes[:, at : min(at + PART, end)]
                        rows.append((start + b, part.shape[1], pa.compress(part.tobytes(), "zstd", asbytes=True)))
                        if len(rows) == 256:
                            yield out(rows, begin)
                            rows = []
                if rows:
                    yield out(rows, begin)

    return run


def _blocks(batches):
    """(block, hi, lo, byte, n, row of each position, its place) from rows of ``_cutter`` sorted by block."""

    def number(planes, kind):
        whole = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
        whole[:, : len(planes)] = planes.T
        return whole.view(kind).ravel()

    def merged(block, held, begin):
        planes = np.concatenate(held, axis=1)
        hi, lo = number(planes[7::-1], "<u8"), number(planes[15:7:-1], "<u8")
        row, byte = number(planes[DEPTH + 1 :], "<u4"), planes[DEPTH]
        order = np.argsort(hi)
        hi, lo, byte = hi[order], lo[order], byte[order]
        tie = np.zeros(len(hi) + 1, dtype=bool)
        tie[1:-1] = hi[1:] == hi[:-1]
        group = np.cumsum(~tie[:-1])
        tie = np.flatnonzero(tie[1:] | tie[:-1])
        # the rank of lo, so that one number has (hi, lo, byte) in order
        by_lo = np.argsort(lo[tie])
        rank, sorted_lo = np.empty(len(tie), dtype=np.int64), lo[tie[by_lo]]
        rank[by_lo] = np.cumsum(np.concatenate([[False], sorted_lo[1:] != sorted_lo[:-1]])[: len(tie)])
        again = tie[np.lexsort((rank << 8 | byte[tie], group[tie]))] if len(order) > 1 << 27 else tie[np.argsort(group[tie] << 35 | rank << 8 | byte[tie])]
        lo[tie], byte[tie], order[tie] = lo[again], byte[again], order[again]
        new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (byte[1:] != byte[:-1])])
        place = np.cumsum(new) - 1
        row = row[order]
        n = np.bincount(place, weights=(row & 1) == 0)
        return block, hi[new], lo[new], byte[new], n, np.repeat(begin, [h.shape[1] for h in held])[order] + (row >> 1), place

    block, held, begin = None, [], []
    for batch in batches:
        for b, size, first, data in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "first")), batch.column("data"), strict=True):
            if b != block and held:
                yield merged(block, held, begin)
                held, begin = [], []
            block = b
            held.append(np.frombuffer(pa.decompress(data.as_buffer(), PLANES * size, "zstd"), dtype=np.uint8).reshape(PLANES, size))
            begin.append(first)
    if held:
        yield merged(block, held, begin)


def _range(bounds: np.ndarray, block: int) -> tuple:
    return bounds[block], bounds[block + 1] if block + 1 < len(bounds) else None


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    row, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(row)
    row = row[order]
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[head], np.add.reduceat(value[order], head)


def text_values(base: DataFrame) -> DataFrame:
    """(row, score) of texts (row, text, held_out): log10 P of each by the tree that those not held out make."""
    spark = base.sparkSession
    total = base.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1), F.lit(0))).first()[0]
    every = max(1, total // SAMPLE)
    often = max(1, BLOCK // DRAWN // every)

    def draw(batches):
        for begin, texts, _ in _texts(batches):
            for _, hi, *_ in contexts(texts):
                yield pa.RecordBatch.from_arrays([pa.array((hi[begin % often :: often] ^ _SIGN).view(np.int64))], names=["hi"])

    few = base.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)
    sample = few.mapInArrow(tidy(draw), "hi long").toArrow()["hi"].to_numpy().view(np.uint64) ^ _SIGN
    bounds = spark.sparkContext.broadcast(bounds_of(np.sort(sample)))
    tasks = max(1, min(len(bounds.value), 1 + total // (16 * BLOCK)))
    shares = np.unique(np.linspace(0, len(bounds.value), min(RUNS, 1 + total // RUN, len(bounds.value)) + 1).astype(int)).tolist()

    def in_runs(run, schema, by):
        """What ``run`` makes of all blocks, added up ``by`` these columns: a share of the blocks at a time, whose shuffle then goes."""
        parts = []
        for start, stop in itertools.pairwise(shares):
            cut = base.mapInArrow(tidy(_cutter(bounds, start, stop)), "block int, size int, first long, data binary").repartition(-(-tasks // (len(shares) - 1)), "block").sortWithinPartitions("block")
            found = cut.mapInArrow(tidy(run), schema).groupBy(*by)
            with shuffles_go(spark):
                parts.append(materialize(found.agg(*(F.sum(c).alias(c) for c in cut.mapInArrow(run, schema).columns if c not in by))))
            reclaim(spark)
        return functools.reduce(DataFrame.union, parts)

    def opened_nodes(batches):
        for block, hi, lo, byte, n, *_ in _blocks(batches):
            depth, first, node, zeros, ones, closed = walk(hi, lo, byte, n, opened_of(hi, *_range(bounds.value, block)))
            yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(first.view(np.int64)), pa.array(node, pa.int32()), pa.array(zeros), pa.array(ones), pa.array(closed)], names=["depth", "hi", "node", "zeros", "ones", "closed"])

    tree = (np.empty(0, np.uint64), np.empty((3, 0)))
    if len(bounds.value) > 1:
        keys = ("depth", "hi", "node")
        found = in_runs(opened_nodes, "depth int, hi long, node int, zeros double, ones double, closed double", keys)
        found = found.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "closed"))).toArrow()
        c = [found[x].to_numpy() for x in ("depth", "hi", "node", "zeros", "ones", "closed")]
        tree = open_tree(c[0].astype(np.int64), c[1].astype(np.int64).view(np.uint64), c[2].astype(np.int64), *c[3:])
    top = spark.sparkContext.broadcast(tree)

    def values(batches):
        kept = []

        def out():
            row, value = kept.pop()
            for at in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(row[at : at + (1 << 16)]), pa.array(value[at : at + (1 << 16)])], names=["row", "score"])

        for block, hi, lo, byte, n, row, place in _blocks(batches):
            p = walk(hi, lo, byte, n, opened_of(hi, *_range(bounds.value, block)), top.value)
            kept.append(_added([(row, np.log10(p.prod(axis=1))[place])]))
            if len(kept) > 1 and sum(len(r) for r, _ in kept) > 1 << 21:
                kept[:] = [_added(kept)]
                if len(kept[0][0]) > 1 << 20:
                    yield from out()
        if kept:
            kept[:] = [_added(kept)]
            yield from out()

    return in_runs(values, "row long, score double", ("row",)).groupBy("row").agg(F.sum("score").alias("score"))


# ---- scores


def _words(batches):
    """(key, c, m) of words and ends: c in training texts, m in all; each key about once a task."""
    kept, rows = [], np.zeros(2)

    def out():
        key, c, m = kept.pop()
        for at in range(0, len(key), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(c[s].astype(np.int64)), pa.array(m[s].astype(np.int64))], names=["key", "c", "m"])

    def summed():
        key, inverse = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        kept[:] = [(key, *(np.bincount(inverse, weights=np.concatenate([k[i] for k in kept]), minlength=len(key)) for i in (1, 2)))]

    for _, texts, held in _texts(batches):
        hashes = batch_word_hashes(texts)
        key, inverse, m = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        kept.append((key, np.bincount(inverse, weights=np.repeat(~held, [len(h) for h in hashes]), minlength=len(key)), m))
        rows += ((~held).sum(), len(texts))
        if sum(len(k[0]) for k in kept) > 800_000:
            summed()
            if len(kept[0][0]) > 400_000:
                yield from out()
    if rows[1]:
        kept.append((np.array([END_WORD], dtype=np.uint64), rows[:1], rows[1:]))
        summed()
        yield from out()


def base_scores(docs: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score), and the stored texts (row, doc_id, text, held_out)
    they are of. base_score: log10 of the words and an end under add-half unigram counts of the rows not held out.
    """
    spark = docs.sparkSession
    lean(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()))
    words = materialize(base.select("row", "text", "held_out").mapInArrow(tidy(_words), "key long, c long, m long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("m").alias("m")))
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, n_distinct = int(totals[0]), int(totals[1])
    least, top = _frequent(words, "m")
    shared = spark.sparkContext.broadcast(_sorted(top, "c"))
    floor = n_train + 0.5 * (n_distinct + 1)

    def run(batches):
        known, count = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for w in batch_word_hashes(as_bytes(part.column("text"))):
                    w = np.append(w, np.uint64(END_WORD))
                    place, hit = _place(known, w)
                    c = count[place[hit]]
                    rare, times = np.unique(w[~hit], return_counts=True)
                    rows.append((len(w), int((c > 0).sum()), float(np.log10((c + 0.5) / floor).sum()), rare.view(np.int64), times))
                n, k, b, rare, times = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "times"],
                )

    scored = materialize(base.mapInArrow(tidy(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, times array<long>"))
    few = words.where(F.col("m") < F.lit(float(2**least))).select("key", F.log10((F.col("c") + 0.5) / F.lit(floor)).alias("b"), (F.col("c") > 0).cast("long").alias("f"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    more = rare.join(few, "key").groupBy("row").agg(*(F.sum(F.col("times") * F.col(a)).alias(a) for a in ("b", "f")))
    found = scored.drop("rare", "times").join(more, "row", "left").select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("f", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
    )
    return found, base


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the models learn from the rows not held out.

    base_score: see ``base_scores``. score: log10 P of the text by the weighted context trees; -score / log10(2) /
    (bytes + 1) is the code length in bits for each byte.
    """
    found, base = base_scores(docs, held_out)
    values = materialize(text_values(base.select("row", "text", "held_out")))
    forget(base)
    return found.join(values, "row", "left").drop("row")
