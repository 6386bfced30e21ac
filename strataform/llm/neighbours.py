"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the signs of the centred vectors under rotations learned on a bounded sample by iterative quantisation (rotate to
the nearest signs, solve the rotation anew, repeat); several rotations give longer codes. A code splits into substrings
of a byte, each with its own index. By the pigeonhole principle a code within Hamming radius r has a substring within
floor(r / substrings): probing these buckets of every index retrieves every code of the radius, whose vectors are then
ranked by exact cosines.

The radius is set for each query: K-th best cosine within the sample, as the angle's expected distance plus MARGIN
standard deviations; any nearer neighbour is then found with that probability at least. Queries with fewer than K found
over all blocks are asked again with a radius of all bits.

Index and queries meet in a grid of blocks of bounded size, each index block with its own tables; every row is indexed
and only each query's K best of a block go on.

Defined cases: vectors that are null or zero or hold null or non-finite components, and those of another dimension than
the most frequent one (ties: the larger), take no part; null ids take no part; rows of one id are different candidates,
but none of them for a query of that id, and queries of one id are one query if their vectors are equal; with fewer
candidates than K all are returned; an empty table gives no rows; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Neighbours, vectors sampled, rotations, rounds of learning, standard deviations of margin, rows of a block.
K, SAMPLE, ROTATIONS, ROUNDS, MARGIN = 5, 4096, 4, 20, 2.0
INDEX_BLOCK, QUERY_BLOCK = 2048, 2048
#: Share of an index's buckets from which a probe looks its bucket numbers up instead of walking the buckets.
WIDE = 0.02

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Codes:
    """The learned code, and the sample for the radius."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS, seed: int = 11):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32) if len(sample) else sample.astype(np.float32)
        self.mean = self.sample.mean(axis=0) if len(sample) else np.zeros(dim, np.float32)
        x = (self.sample - self.mean).astype(float)
        self.rotations = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(rounds if len(sample) >= dim else 0):
                b = np.where(x @ r >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(x.T @ b)
                r = u @ v
            self.rotations.append(r.astype(np.float32))
        self.bits = dim * rotations
        self.pad = -self.bits % 8

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        x = unit - self.mean
        return np.packbits(np.hstack([x @ r >= 0 for r in self.rotations]), axis=1)

    def radius(self, unit: np.ndarray, k: int, margin: float = MARGIN) -> np.ndarray:
        """Hamming radius for each query; every code if the sample has too few vectors."""
        if len(self.sample) <= k:
            return np.full(len(unit), self.bits)
        near = unit @ self.sample.T
        near[near > 1 - 1e-6] = -1.0  # maybe the query itself
        p = np.arccos(np.clip(np.partition(near, -k, axis=1)[:, -k], -1, 1)) / np.pi
        return np.minimum(np.ceil(self.bits * p + margin * np.sqrt(self.bits * p * (1 - p))), self.bits).astype(int)


class MultiIndex:
    """One index for each byte of the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = [np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` away."""
        near = radius // self.codes.shape[1]
        found = np.zeros(len(self.codes), dtype=bool)
        flips = np.flatnonzero(_ONES <= near)
        for j in range(self.codes.shape[1]):
            if len(flips) > WIDE * 256:
                found |= _ONES[self.codes[:, j] ^ code[j]] <= near
            else:
                for v in (flips ^ code[j]).tolist():
                    found[self.order[self.starts[j][v] : self.starts[j][v + 1], j]] = True
        rows = np.flatnonzero(found)
        return rows[_ONES[self.codes[rows] ^ code].sum(axis=1) <= radius]


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    a, b = queries.astype(float), vectors.astype(float)
    return (a @ b.T) / np.linalg.norm(a) / np.linalg.norm(b, axis=1)


def _search(codes_: Codes, k: int, widest: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy()
        ids = pdf["vec_id"].to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        if is_query.any() and not is_query.all():
            vectors = np.array(pdf["v"].tolist(), dtype=np.float64)
            unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
            codes = codes_.encode(unit)
            own, index = np.flatnonzero(~is_query), MultiIndex(codes[~is_query])
            queries = np.flatnonzero(is_query)
            radius = np.full(len(queries), codes_.bits) if widest else codes_.radius(unit[queries], k)
            for q, r in zip(queries.tolist(), radius.tolist(), strict=True):
                rows = own[index.within(codes[q], r)]
                rows = rows[ids[rows] != ids[q]]
                if len(rows):
                    s = cosines(vectors[q], vectors[rows])
                    best = np.lexsort((ids[rows], -s))[:k]
                    out["query_id"] += [ids[q]] * len(best)
                    out["vec_id"] += ids[rows[best]].tolist()
                    out["score"] += s[best].tolist()
        return pd.DataFrame(out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among ``vectors``; both have (vec_id, embedding)."""
    dim = F.size("embedding")
    usable = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    rows = usable(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = dims[0]["d"], dims[0]["n"]
    rows, asked = rows.where(F.size("v") == dim), usable(queries).where(F.size("v") == dim).distinct()
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30) < 1.2 * sample / n).select("vec_id", "v").limit(2 * sample).toPandas().sort_values("vec_id", kind="stable").head(sample)
    codes = Codes(np.array(some["v"].tolist(), dtype=np.float64).reshape(-1, dim))
    blocks = -(-n // index_block)
    grid = lambda d, own, other, first, is_query: d.select(F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"), "vec_id", "v", F.lit(is_query).alias("is_query")).select(*(F.col(c).alias(a) for c, a in zip(first, ("i", "j"), strict=True)), "vec_id", "v", "is_query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(asked: DataFrame, count: int, widest: bool) -> DataFrame:
        asks = max(1, -(-count // query_block))
        cells = grid(rows, blocks, asks, ("own", "other"), False).union(grid(asked, asks, blocks, ("other", "own"), True))
        found = cells.groupBy("i", "j").applyInPandas(_search(codes, k, widest), "query_id long, vec_id long, score double")
        return materialize(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    found = search(asked, asked.count(), False)
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(full, "vec_id", "left_anti"))
    if not (left := short.count()):
        return found
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(found.columns).union(search(short, left, True))
