"""Packing token pieces into windows by non-negative least squares over their length histogram.

Every document becomes token ids and an end id, cut at multiples of the window; what is left over is a shorter piece.
Combinations of at most DEPTH lengths that fill a window exactly are enumerated, their repeat counts solved by
non-negative least squares against the histogram of piece lengths, and rounded to what the histogram holds. What stays
over is packed greedily, longest first, one piece after the other, cut where a window ends. So a piece's place follows
from its length and its rank among the pieces of that length; nothing but the histogram comes to the driver.

Defined cases: null text is empty and still has its end id; null ids and repeated rows are documents like others, in the
order of (id, start, checksum); other columns are ignored; an empty table gives no rows. Only the last window may be
short; it is padded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, process_cache, tidy

#: Tokens of a window, pieces in a combination at most, pieces numbered together.
WINDOW, DEPTH, TOGETHER = 1024, 3, 2048
#: Rows of the table of first ranks up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Characters on which all tokenizers' classes of letters, digits and blanks agree.
PLAIN = r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ‐-‧]|<\|endoftext\|>"


def tokenizer(path: str, ranks: str | None, pattern: str | None) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to arrays of ids, as the tokenizers file at ``path`` gives them.

    ``ranks``: the same vocabulary as a rank file, with its ``pattern``; texts of plain characters go this faster way.
    """
    cache = process_cache()
    key = ("tokenizer", path, ranks)
    if key not in cache:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
        cache[key] = fast, re.compile(PLAIN)
    fast, other = cache[key]

    def exact(text: str) -> list[int]:
        if ("exact", path) not in cache:  # large, so only if a text needs it
            from tokenizers import Tokenizer

            cache["exact", path] = Tokenizer.from_file(path)
        return cache["exact", path].encode(text, add_special_tokens=False).ids

    def run(texts: list[str]) -> list[np.ndarray]:
        return [np.array(fast.encode_ordinary(t) if fast and not other.search(t) else exact(t), dtype="<u4") for t in texts]

    return run


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, a > 0, of sum ``window``; 0 is no piece."""
    a, b = np.meshgrid(np.arange(1, window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    ok = (b <= a) & (c <= b) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def _dropped(gram: np.ndarray, target: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns stay, and their fit: the clearly negative ones go together, then the rest is solved anew."""
    keep = np.arange(len(target))
    while len(keep):
        x = np.linalg.solve(gram[np.ix_(keep, keep)], target[keep])
        if (x > 0).all():
            return keep, x
        stay = x > min(0.0, x.min() * 0.1)
        keep = keep[x > 0] if stay.all() else keep[stay]
    return keep, at[:0]


def _towards(gram: np.ndarray, target: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns stay, and their fit: from ``at`` towards it, as far as no count is negative, and so on without these."""
    keep = np.arange(len(target))
    while len(keep):
        goal = np.linalg.solve(gram[np.ix_(keep, keep)], target[keep])
        low = goal <= 0
        if not low.any():
            return keep, goal
        if (at[low] > 0).all():
            at = at + (at[low] / (at[low] - goal[low])).min() * (goal - at)
        stay = ~low | (at > 1e-12)
        keep, at = keep[stay], at[stay]
    return keep, at


def solve(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and their real repeat counts: the least squares fit to ``histogram`` without negative counts.

    Active sets as Lawson and Hanson's, grown by many combinations at a time: in each round those of the largest gradient
    that share no length. At first what would be negative is dropped at once, as long as the error falls; from then on every
    step goes towards the fit of the active set until a count would be negative, so the error never grows, and a round
    without gain is followed by one of the largest gradient alone. It ends at the optimum, where no combination has a
    gradient above 1e-7 of the largest count.
    """
    h = histogram.astype(float)
    all_ = combinations(window)
    all_ = all_[((h[all_] > 0) | (all_ == 0)).all(axis=1)]
    h[0] = 0.0
    least = 1e-7 * max(1.0, h.max())
    active, x, error = np.empty(0, np.int64), np.empty(0), float(h @ h)
    careful = single = False

    def columns(idx: np.ndarray) -> np.ndarray:
        m = np.zeros((window + 1, len(idx)))
        for k in range(DEPTH):
            m[all_[idx, k], np.arange(len(idx))] += 1.0
        m[0] = 0.0
        return m

    residual = h.copy()
    while len(all_):
        gradient = residual[all_].sum(axis=1)
        gradient[active] = 0.0
        order = np.argsort(-gradient, kind="stable")[: 1 if single else 8 * window]
        used, add = np.zeros(window + 1, bool), []
        for i, row in zip(order.tolist(), all_[order].tolist(), strict=True):
            if gradient[i] <= least:
                break
            if not any(used[v] for v in row if v):
                add.append(i)
                used[row] = True
        if not add:
            break
        trial, at = np.concatenate((active, add)), np.concatenate((x, np.zeros(len(add))))
        m = columns(trial)
        gram, target = m.T @ m + 1e-9 * np.eye(len(trial)), m.T @ h
        keep, at = (_towards if careful else _dropped)(gram, target, at)
        trial = trial[keep]
        left = h - columns(trial) @ at
        now = float(left @ left)
        if now < error * (1 - 1e-12):
            active, x, residual, error, single = trial, at, left, now, False
        elif not careful:
            careful = True
        elif not single:
            single = True
        else:
            break  # no gain within the precision of numbers
    return all_[active], x


class Plan:
    """Where the pieces of each length go, by rank."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, left = window, histogram.astype(np.int64).copy()
        sequence = int(left[window])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]  # (repeats, first sequence, offset)
        runs[window].append((sequence, 0, 0))
        left[window] = 0
        partial = left.copy()
        partial[window] = 0
        rows, x = solve(partial, window)
        for i in np.argsort(-x, kind="stable").tolist():
            row = [v for v in rows[i].tolist() if v]
            n = min([int(x[i] + 0.5), *(int(left[v]) // row.count(v) for v in row)])
            if n > 0:
                offset = 0
                for v in row:
                    runs[v].append((n, sequence, offset))
                    left[v] -= n
                    offset += v
                sequence += n
        self.first = [np.cumsum([0] + [r[0] for r in rs]) for rs in runs]
        self.sequence = [np.array([r[1] for r in rs], np.int64) for rs in runs]
        self.offset = [np.array([r[2] for r in rs], np.int64) for rs in runs]
        # the rest, longest first, lies end to end from here on
        lengths = np.arange(window + 1)[::-1]
        before = np.concatenate(([0], np.cumsum(lengths * left[::-1])))[:-1]
        self.rest = sequence * window + before[::-1]

    def place(self, length: int, rank: np.ndarray) -> np.ndarray:
        """Absolute position, sequence * window + offset, of the pieces of one length."""
        first = self.first[length]
        run = np.searchsorted(first, rank, side="right") - 1
        planned = rank < first[-1]
        out = self.rest[length] + (rank - first[-1]) * length
        r = run[planned]
        out[planned] = (self.sequence[length][r] + rank[planned] - first[r]) * self.window + self.offset[length][r]
        return out


def _pieces(window: int, path: str, ranks: str | None, pattern: str | None, end_id: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches):
        encode = tokenizer(path, ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, owner = [], []
                for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s : s + window]
                        small = piece.astype("<u2") if end_id < 65536 and len(piece) and piece.max() < 65536 else piece
                        owner.append(i)
                        rows.append((s, len(piece), zlib.crc32(piece.tobytes()), len(ids), small.tobytes() if len(piece) < window else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=names)

    return run


def _placed(plan: Plan):
    window = plan.window
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank, start, crc = (batch.column(c).to_numpy() for c in ("length", "rank", "start", "ids_crc32"))
            at = np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length).tolist():
                own = length == v
                at[own] = plan.place(v, rank[own])
            cut = np.flatnonzero(at % window + length > window)
            owner = np.concatenate((np.arange(len(length)), cut))
            start, length, crc, at = (np.concatenate((x, x[cut])) for x in (start, length, crc, at))
            for k, i in enumerate(cut.tolist(), batch.num_rows):
                ids = np.frombuffer(raw := batch.column("ids")[i].as_py(), dtype="<u2" if len(raw) == 2 * length[i] else "<u4").astype("<u4")
                head = int(window - at[i] % window)
                crc[i], crc[k] = zlib.crc32(ids[:head].tobytes()), zlib.crc32(ids[head:].tobytes())
                start[k], length[k], at[k] = start[i] + head, length[i] - head, at[i] + head
                length[i] = head
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), *(pa.array(x) for x in (start, length, crc)), batch.column("doc_tokens").take(take), pa.array(at // window), pa.array(at % window)], names=names)

    return run


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    lean(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(base.mapInArrow(tidy(_pieces(window, path, ranks, pattern, end_id)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"))
    parts = max(64, pieces.count() // TOGETHER // 8)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r["length"]] = r["n"]
    plan = Plan(histogram, window)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(F.broadcast(first) if window * parts <= BROADCAST_ROWS else first, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(tidy(_placed(plan)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
