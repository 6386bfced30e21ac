"""N-gram Jaccard join: exact near-duplicate links by T-occurrence search (DivideSkip).

Every document becomes the set of its distinct shingles. Two documents link when
``den * |A & B| >= num * |A | B|``. Nothing is sampled, capped or approximated.

1. Equal sets form one class; later steps see one set of each class.
2. Routing, itself a T-occurrence problem: sets that link differ in at most d elements, so of m = d + 1 + k equal
   ranges of the hash space at least k + 1 hold the same elements in both. The inverted lists are keyed by the content
   of a range. As in DivideSkip each set leaves out its k longest lists (the order of lists is the same for all, so
   one common list is left to both). Sets that share a remaining list are neighbours; connected neighbours meet in
   one cell. Where they are more than a cell holds, they are routed again by other ranges, more of them; those that are
   still connected by both meet in a grid of cells of bounded size.
3. In a cell, inverted lists of the shingles; for each set the short lists are merged with a heap, the L long ones are
   probed by binary search only for sets found T - L times, and those that reach the overlap are links.

Defined cases: null or wordless text has an empty set and links with nothing; a null id is never a component's name
unless all ids of the component are null; repeated rows are separate documents that link with each other; other
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch_word_hashes, components, forget, free_name, lean, materialize, mix, reclaim, shingles, tidy

#: Sets that meet in one cell at most, and the rows up to which a list of keys is broadcast.
CELL, BROADCAST_ROWS = 1024, 1_000_000
#: Rows of lists that a task sorts, about.
PART_ROWS = 500_000
#: How often sets are routed again where too many are connected.
AGAIN = 2


def size_levels(most: int, num: int, den: int) -> list[int]:
    """First sizes of the levels up to ``most`` and two beyond; a set links only within its level and the next ones to it."""
    out = [1]
    while len(out) < 3 or out[-3] <= most:
        out.append(out[-1] * den * den // (num * num) + 1)
    return out


def differing(level: int, starts: list[int], num: int, den: int) -> int:
    """Elements at most in which two linked sets differ, the larger of which is of ``level``."""
    return 2 * (starts[level + 1] - 1) * (den - num) // (den + num)


def spare(d: int, again: int = 0) -> int:
    """Ranges beyond d + 1, and so the lists that a set may leave out; more when sets are routed again."""
    return 1 + (d if again else d // 2)


def range_keys(s: np.ndarray, level: int, d: int, again: int = 0, within: int = 0) -> np.ndarray:
    """The keys of the m ranges of one sorted set at one level; ``within``: a group beyond which no key is shared."""
    m = d + 1 + spare(d, again)
    if again:
        s = np.sort(mix(s ^ mix(np.array([again], dtype=np.uint64))))
    cuts = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)
    at = np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))
    total = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(mix(s), out=total[1:])
    i = np.arange(m, dtype=np.uint64)
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(i + np.uint64(level << 32)) ^ np.uint64(within & (1 << 64) - 1))


def set_key(s: np.ndarray) -> int:
    """An even number, so that a set's lists can carry the level they are of in its lowest bit."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) & ~1


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _describe(width: int):
    """(doc_id, tkey, n, h) of each text: the size of its set and the set's key."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(w, width) for w in batch_word_hashes(as_bytes(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "tkey", "n", "h"])

    return run


def _lists(width: int, num: int, den: int, again: int = 0):
    """(tagged, key) of each set's ranges: the set's key, one more for the ranges of the next level than for its own.

    The tag is the set's, not the list's: a list holds the sets of its level and those that reach it from below.

    Of equal sets in one batch the first is enough. When sets are routed ``again``, a row carries its set's key and group.
    """

    def run(batches):
        starts = size_levels(1, num, den)
        for batch in batches:
            seen: set[int] = set()
            for at in range(0, batch.num_rows, 512):
                owners, keys = [], []
                part = batch.slice(at, 512)
                groups = part.column("comp").to_pylist() if again else [0] * part.num_rows
                wanted = part.column("h").to_pylist() if again else [None] * part.num_rows
                for words, group, want in zip(batch_word_hashes(as_bytes(part.column("text"))), groups, wanted, strict=True):
                    s = shingles(words, width)
                    n = len(s)
                    if not n or (h := set_key(s)) in seen or want not in (None, h):
                        continue
                    seen.add(h)
                    if starts[-2] <= n:
                        starts = size_levels(n, num, den)
                    level = int(np.searchsorted(starts, n, side="right")) - 1
                    for upper in range(1 + (n * den // num >= starts[level + 1])):
                        if d := differing(level + upper, starts, num, den):
                            key = range_keys(s, level + upper, d, again, group)
                            keys.append(key)
                            owners.append(np.full(len(key), h | upper, dtype=np.int64))
                for k in range(0, len(keys), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners[k : k + 64])), pa.array(np.concatenate(keys[k : k + 64]).view(np.int64))], names=["tagged", "key"])

    return run


def _texts(width: int):
    """(h, set, ...) of the texts that carry a class; a row whose text isn't the class's is left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(w, width) for w in batch_word_hashes(as_bytes(part.column("text")))]
                want = part.column("h").to_pylist()
                ok = [i for i, (s, h) in enumerate(zip(sets, want, strict=True)) if len(s) and set_key(s) == h]
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(ok, pa.int64())) for c in ("h", "comp", "size", "copies")] + [pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["h", "comp", "size", "copies", "content"])

    return run


class InvertedLists:
    """Inverted lists of the elements of a few sets, and the T-occurrence search over them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.n = num, den, max(1, len(sets))
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        self.tokens, token = np.unique(flat, return_inverse=True)
        self.keys = np.sort(token * self.n + doc)  # all lists, one after the other, as element * n + set
        self.starts = np.searchsorted(self.keys, np.arange(len(self.tokens) + 1) * self.n)

    def search(self, s: np.ndarray, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Sets numbered over ``after`` that link with ``s``, and the overlaps."""
        least = -(-len(s) * self.num // self.den)
        needed = -(-self.num * (len(s) + least) // (self.num + self.den))  # by the smallest set that may link
        at = np.searchsorted(self.tokens, s)
        at = at[at < len(self.tokens)] if not len(self.tokens) else at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == s]
        none = np.empty(0, np.int64)
        if len(at) < needed:
            return none, none
        first = self.starts[at] if after < 0 else np.searchsorted(self.keys, at * self.n + after, side="right")
        length = self.starts[at + 1] - first
        order = np.argsort(-length, kind="stable")
        # the lists set aside: all but needed - 1 would miss nothing, fewer only where merging a list costs less than probing it
        aside = min(needed - 1, int((length > 0).sum()))
        long, short = order[:aside], order[aside:]
        lists = [(self.keys[first[i] : first[i] + length[i]] - at[i] * self.n).tolist() for i in short if length[i]]
        count = needed - aside
        met = [(d, c) for d, c in ((d, sum(1 for _ in g)) for d, g in groupby(heapq.merge(*lists))) if c >= count]
        if not met:
            return none, none
        doc, overlap = np.array(met, dtype=np.int64).T
        fits = (self.sizes[doc] >= least) & (self.sizes[doc] * self.num <= len(s) * self.den)
        doc, overlap = doc[fits], overlap[fits]
        if len(doc):
            probe = at[long][:, None] * self.n + doc[None, :]
            where = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            overlap = overlap + (self.keys[where] == probe).sum(axis=0)
            good = overlap * (self.num + self.den) >= self.num * (len(s) + self.sizes[doc])
            doc, overlap = doc[good], overlap[good]
        return doc, overlap


def _cell(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "side"])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["content"]]
        side, copies, h = (pdf[c].to_numpy() for c in ("side", "copies", "h"))
        order = np.argsort([len(s) for s in sets], kind="stable")
        left, right = ([i for i in order if side[i] != x] for x in (1, 0))  # side 2: both
        lists = InvertedLists([sets[i] for i in right], num, den)
        same = left == right
        degree, parent = np.zeros(len(h), dtype=np.int64), list(range(len(h)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for k, i in enumerate(left):
            found, _ = lists.search(sets[i], k if same else -1)
            for j in (right[x] for x in found.tolist()):
                degree[i] += copies[j]
                degree[j] += copies[i]
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        keep = np.flatnonzero(degree)
        return pd.DataFrame({"h": h[keep], "label": h[[root(i) for i in keep]] if len(keep) else h[keep], "degree": degree[keep], "many": pdf["many"].to_numpy()[keep]})

    return run


def _near(lists: DataFrame, sizes: DataFrame, starts: list[int], num: int, den: int, again: int = 0) -> DataFrame:
    """(h, comp): the sets that share a list which neither leaves out, and the least set connected with each."""
    key = Window.partitionBy("key")
    # each set has about as many keys, of both levels, as its elements times this
    keys = (sizes.agg(F.sum("n")).first()[0] or 0) * 2.2 * 2 * (den - num) / (den + num) * (2.0 if again else 1.5)
    lists = lists.repartition(max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(keys / PART_ROWS)), "key")
    # most lists hold one set; of repeated rows (copies of a text in several parts) one stays
    lists = lists.withColumn("before", F.lag("tagged").over(key.orderBy("tagged"))).where("before is null or before <> tagged")
    lists = kept = materialize(lists.select("tagged", "key", F.count("*").over(key).alias("length")).where("length > 1"))
    reclaim(kept.sparkSession)
    spares = F.array(*(F.lit(spare(differing(x, starts, num, den), again)) for x in range(len(starts) - 1)))
    level = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("n"))) - 1 + F.col("upper")
    lists = lists.select(F.col("tagged").bitwiseAND(F.lit(-2).cast("long")).alias("h"), F.col("tagged").bitwiseAND(F.lit(1).cast("long")).cast("int").alias("upper"), "key", "length")
    # the sets' sizes tell how many lists each leaves out, the longest ones
    lists = lists.join(sizes, "h").withColumn("k", F.get(spares, level))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("h", "upper").orderBy(F.desc("length"), "key"))).where("rank > k")
    star = lists.select(F.col("h").alias("a"), F.min("h").over(key).alias("b")).where("a <> b").distinct()
    # a set and the least ones of its lists all go to the least of these: about an edge a set, however many lists they share
    star = star.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    star = star.select("a", "m").union(star.select("b", "m")).where("a <> m").distinct().withColumnRenamed("m", "b")
    near = components(star).withColumnRenamed("node", "h").withColumnRenamed("label", "comp")
    forget(kept)
    reclaim(kept.sparkSession)
    return near


def ngram_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, cell: int = CELL) -> DataFrame:
    """One row for each document: doc_id, tkey (a key of the text), n_shingles, component_id, n_links, set_key.

    n_links counts the other documents with which it links, copies included.
    """
    if not 0 < num <= den or width < 1:
        raise ValueError("0 < num <= den and width >= 1 are needed")
    lean(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", text_key(F.col("text")))
    t = materialize(base.mapInArrow(tidy(_describe(width)), "doc_id long, tkey long, n long, h long"))
    classes = materialize(t.where("h is not null").groupBy("h").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"), "tkey", "doc_id")).alias("first"), F.min("doc_id").alias("min_doc"), F.count("*").alias("copies"), F.max("n").alias("n")))
    starts = size_levels(t.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], num, den)
    texts = base.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ckey"), "tkey", "text")
    pick = lambda few, n: texts.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, ["ckey", "tkey"])
    sized = lambda d: d.join(d.groupBy("comp").agg(F.count("*").alias("size")), "comp")

    near = _near(base.select("text").mapInArrow(tidy(_lists(width, num, den)), "tagged long, key long"), classes.select("h", "n"), starts, num, den)
    nodes = materialize(sized(near).join(classes, "h").select("h", "comp", "size", "copies", "n", F.col("first.key").alias("ckey"), F.col("first.tkey").alias("tkey")))
    for again in range(1, AGAIN + 1):
        many = nodes.where(F.col("size") > cell)
        if not (n := many.count()):
            break
        lists = pick(many.select("h", "comp", "ckey", "tkey"), n).select("text", "h", "comp").mapInArrow(tidy(_lists(width, num, den, again)), "tagged long, key long")
        near = _near(lists, many.select("h", "n"), starts, num, den, again)
        parted = materialize(nodes.where(F.col("size") <= cell).unionByName(sized(near).join(nodes.drop("comp", "size"), "h").select(nodes.columns)))
        forget(nodes)
        nodes = parted
    total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    found = pick(nodes.drop("n"), total[0]).select("text", "h", "comp", "size", "copies")
    found = found.mapInArrow(tidy(_texts(width)), "h long, comp long, size long, copies long, content binary")

    reclaim(docs.sparkSession)
    buckets = max(1, -(-total[0] // max(1, cell // 4)), -(-total[1] // 100_000))
    blocks = F.ceil(F.col("size") / cell)
    block = F.pmod(F.xxhash64("h", F.lit(1)), blocks)
    grid = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.col("comp").alias("at"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), F.when(block == j, 2).when(block < j, 0).otherwise(1).alias("side"), F.lit(True).alias("many")))
    one = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("at"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(2).alias("side"), F.lit(False).alias("many")))
    cells = found.withColumn("cell", F.explode(F.when(blocks > 1, grid).otherwise(one))).select("h", "copies", "content", "cell.*")
    linked = materialize(cells.groupBy("at", "i", "j").applyInPandas(_cell(num, den), "h long, label long, degree long, many boolean"))

    degrees = linked.groupBy("h").agg(F.sum("degree").alias("degree"))
    labels = linked.where("not many").select("h", "label")
    if total[2] > cell:
        labels = labels.union(components(linked.where("many").select(F.col("h").alias("a"), F.col("label").alias("b"))).select(F.col("node"), F.col("label")))
    named = labels.join(classes.select("h", "min_doc"), "h")
    names = named.groupBy("label").agg(F.min("min_doc").alias("component_id"))
    of_class = classes.join(labels.join(names, "label").drop("label").join(degrees, "h"), "h", "left").select("h", F.coalesce("component_id", "min_doc").alias("component_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    some = t.where("h is not null").join(of_class, "h").select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id", "n_links", F.col("h").alias("set_key"))
    none = t.where("h is null").select("doc_id", "tkey", F.lit(0).cast("long"), "doc_id", F.lit(0).cast("long"), F.lit(None).cast("long"))
    out = materialize(some.union(none))
    forget(t, classes, nodes, linked)
    reclaim(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component one row stays, the one of the least id (then text key).

    Wordless documents link with nothing and all stay; of repeated rows one stays. Columns as given, whatever their names.
    """
    found = ngram_classes(docs, width, num, den)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    k, t = free_name(docs, "near_key"), free_name(docs, "near_text")
    # rows of one component that all lack an id are told apart by the class
    rows = found.where("set_key is not null").select(key.alias(k), F.col("tkey").alias(t), F.coalesce("component_id", "set_key").alias("c"), F.col("component_id").isNull().alias("unnamed"))
    first = rows.groupBy("c", "unnamed").agg(F.min(F.struct(k, t)).alias("first"))
    each = rows.groupBy(k, t, "c", "unnamed").agg(F.count("*").alias("rows"))
    marked = each.join(first, ["c", "unnamed"]).select(k, t, "rows", (F.col("first") == F.struct(k, t)).alias("is_first"))
    gone, again = materialize(marked.where("not is_first").select(k, t)), materialize(marked.where("is_first and rows > 1").select(k, t))
    forget(found)
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    keyed = docs.withColumn(k, key).withColumn(t, text_key(F.col("text").cast("string")))
    stay = keyed.join(small(gone), [k, t], "left_anti")
    repeats = small(again)
    out = stay.join(repeats, [k, t], "left_anti").unionByName(stay.join(repeats, [k, t], "left_semi").dropDuplicates([k, t]))
    return out.select(*docs.columns)
