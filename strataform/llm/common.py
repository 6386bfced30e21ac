"""Helpers shared by the training-data operators: shared storage, word hashing, small graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the ASCII controls tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes hashed at once; a longer text goes through in pieces cut between words.
PIECE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def process_cache() -> dict:
    """What one Python process keeps between tasks (functions of this package travel by value, so modules can't)."""
    return sys.__dict__.setdefault("_strataform_cache", {})


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/strataform-checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.strataform_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.strataform_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Let go of what finished steps hold: Spark's cleaner drops shuffle files and broadcasts once the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
    release()


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Queries that end in here take their shuffle files away as they end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, as texts can be long; a setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def release() -> None:
    """Give unused memory of this process back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` over batches, after which a Python worker gives unused memory back: workers live on for other stages."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def share(spark: SparkSession, what):
    """A broadcast of an object of this package: its class travels with it. Read it with ``shared``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(what))


def shared(box):
    """What ``share`` holds, unpickled once in each Python process."""
    cache = process_cache()
    if cache.get("shared", (None,))[0] != box.value:
        cache["shared"] = box.value, pickle.loads(box.value)
    return cache["shared"][1]


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _hash_piece(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cache, n = process_cache(), len(raw)
    if "powers" not in cache:
        cache["powers"] = _powers(_P, PIECE * 2), _powers(_P_INV, PIECE * 2)
    up, down = cache["powers"] if n < PIECE * 2 else (_powers(_P, n + 1), _powers(_P_INV, n + 1))
    word = np.zeros(n + 2, dtype=np.int8)
    word[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = _LOWER[raw] if lower else raw
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of one text, in order; A-Z count as a-z if ``lower``.

    A word is a run of bytes other than ``SPACES``. Memory follows PIECE, not the text.
    """
    if len(text) <= PIECE:
        return _hash_piece(np.frombuffer(text, dtype=np.uint8), lower)[0] if text else np.empty(0, np.uint64)
    out, at, raw = [], 0, np.frombuffer(text, dtype=np.uint8)
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):  # to the next separator
            gap = np.flatnonzero(_IS_SPACE[raw[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + 4096)
        out.append(_hash_piece(raw[at:end], lower)[0])
        at = end
    return np.concatenate(out)


def batch_word_hashes(texts: list[bytes], lower: bool = True) -> list[np.ndarray]:
    """word_hashes of each text; short texts share one vectorised pass."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            h, start, _ = _hash_piece(np.frombuffer(b"\n".join([texts[i] for i in group]), dtype=np.uint8), lower)
            sizes = np.array([len(texts[i]) + 1 for i in group])
            cuts = np.searchsorted(start, np.cumsum(sizes))
            at = 0
            for i, cut in zip(group, cuts.tolist(), strict=True):
                out[i] = h[at:cut]
                at = cut
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE // 2:
            out[i] = word_hashes(text, lower)
        else:
            if held + len(text) > PIECE:
                flush()
            group.append(i)
            held += len(text) + 1
    flush()
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; with fewer words the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.to_pylist()]


#: A node with more edges than one in HUBS of all is a hub: at most 2 * HUBS of them, so what is broadcast is bounded.
#: Up to so many edges in all none of them is too many for a task.
HUBS, FEW_EDGES = 1000, 50_000


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``edges`` (u, v), about ``count``, joined to ``least`` (u, m, deg) by u; the edges of hubs stay where they are."""
    if count <= FEW_EDGES:
        return edges.join(least, "u").select("u", "v", "m")
    hub = count // HUBS
    hubs = F.broadcast(least.where(F.col("deg") > hub))
    of_hubs = edges.join(hubs, "u").select("u", "v", "m")
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("deg") <= hub), "u").select("u", "v", "m")
    return of_hubs.union(others)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (node, label), label the least node.

    Null edges are ignored, loops and repeats are allowed, no edges give no rows. Every step keeps at most as
    many edges as it got; each is written to the shared folder, and the one before it deleted. Only counts come to the
    driver. Nodes with many edges are joined by a broadcast of bounded size, so that none of them is one task.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    count, last = e.count(), None
    for _ in range(rounds):
        # large star: each larger neighbour of u goes to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
        large = _with_least(both.where("v > u"), least, count).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
        small = _with_least(large, low, count).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(e)
        e = now
        reclaim(e.sparkSession)
        total = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if total == last:
            break
        count, last = total[0], total
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
