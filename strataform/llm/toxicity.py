"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated modified Kneser-Ney model of trigrams, bigrams and words. A trigram's
count backs off to the bigram's continuation count in the class (the different words it was seen to follow), that to the
word's continuation count in the class, and that to shared counts and an even share, which both models have in common: the
shared count of a word is the number of different words that it was seen to follow in both classes, so that what is rare
in both is left to the same estimate, and what one class alone has doesn't count for the other. The three
discounts of each order and class are those of the counts of counts n1 to n4: with y = n1 / (n1 + 2 n2), 1 - 2 y n2 / n1,
2 - 3 y n3 / n2 and 3 - 4 y n4 / n3 for counts of one, two and three or more, within 0 and 1, 2, 3; where n3 or n4 is
zero all three are y, where n1 or n2 is they are FALLBACK. Every n-gram counts and every word of a text is scored.

A toxic text is for the most part ordinary language, so its words are taken to come from a mixture, a share of them from
the toxic model and the rest from the ordinary one. The text's log-likelihood under the mixture minus that under the
ordinary model, per word, is taken with the models of one, two and three words. The three are measured from the ordinary
texts' median, in median deviations, on an arcsinh scale, as a few texts have very many toxic words; a logistic function of
them gives the score. The share (one of SHARES), the medians and the function, with no negative weight, are fitted on
labelled rows that the counts leave alone, by the least loss with classes weighing alike.

Training is on a bounded sample: of the different labelled texts of a class (of at most LONGEST bytes each) the least
hashes in each of SALTS ranges of hashes, PER_CLASS in all at most, then the first of them by hash that have TRAIN_BYTES
together; four fifths for the counts and the rest for share and function.

Defined cases: a document without words (null included) gets the score of difference 0; of several labels of one id the
largest counts, null labels none; a text that has both labels counts in both classes; without samples of both classes
every score is 0; repeated rows are rows like others; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bucket_of, forget, lean, materialize, mix, reclaim, share, shared, tidy, word_hashes

#: Sampled texts a class, ranges of hashes they come from, bytes of one and of all of a class's texts.
PER_CLASS, SALTS, LONGEST, TRAIN_BYTES = 2048, 64, 1 << 20, 8 << 20
#: What the toxic model's share in the mixture may be, and the discount where counts of counts give none.
SHARES, FALLBACK = (0.1, 0.03, 0.01, 0.003), 0.5
#: Words scored at once, and the word before the first.
STEP, START = 1 << 17, 1

_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words (runs of letters, A-Z as a-z) of one text."""
    return word_hashes(text.translate(_TABLE), lower=False)


def trigrams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of each text: the word two before, the one before, and the word."""
    w = np.concatenate([*texts, np.empty(0, np.uint64)])
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    starts = starts[[len(t) > 0 for t in texts]]
    v = np.roll(w, 1)
    v[starts] = START
    u = np.roll(v, 1)
    u[starts] = START
    return u, v, w


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ b)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from a count of none, one, two, and three or more."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0, FALLBACK, FALLBACK, FALLBACK])
    y = n1 / (n1 + 2 * n2)
    if not (n3 and n4):
        return np.array([0, y, y, y])
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


def _packed(x: np.ndarray) -> tuple[bytes, str, int]:
    """Numbers with their first bytes together, their second bytes together, and so on, which compress well."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True), x.dtype.str, len(x)


def _unpacked(packed: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


class Index:
    """Where a key is among sorted different hashes; their leading bits lead to it. len(keys) if it isn't there."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys), 2).bit_length()
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.heads = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __reduce__(self):
        return Index._read, _packed(np.diff(self.keys, prepend=np.uint64(0)))

    @staticmethod
    def _read(packed: bytes, kind: str, n: int) -> Index:
        return Index(np.cumsum(_unpacked(packed, kind, n), dtype=np.uint64))

    def find(self, x: np.ndarray) -> np.ndarray:
        top = (x >> self.shift).astype(np.int64)
        at, end = self.heads[top], self.heads[top + 1]
        out = np.full(len(x), len(self.keys), dtype=np.int64)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == x[left]
            out[left[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end)
            left, at, end = left[go], at[go], end[go]
        return out


class Order:
    """Counts of one order in some classes: of n-grams, and by what comes before the last word."""

    def __init__(self, before: np.ndarray, keys: np.ndarray, counts: list[np.ndarray]):
        """``keys`` are different; ``before`` is each one's key without its last word."""
        by = np.argsort(keys)
        self.grams, self.cut = Index(keys[by]), [discounts(c) for c in counts]
        self.counts = [np.append(c[by], 0).astype(np.int32) for c in counts]
        own, at = np.unique(before, return_inverse=True)
        self.contexts = Index(own)
        self.totals = [np.append(np.bincount(at, weights=c, minlength=len(own)), 0).astype(np.int32) for c in counts]
        self.freed = []
        for c, cut in zip(counts, self.cut, strict=True):  # from whole numbers, so the rows' order doesn't matter
            kinds = (np.bincount(at[(c == i) if i < 3 else (c >= 3)], minlength=len(own)) for i in (1, 2, 3))
            self.freed.append(np.append(sum(cut[i] * k for i, k in enumerate(kinds, 1)), 0).astype(np.float32))

    def __getstate__(self):
        return {k: [_packed(x) for x in v] if k in ("counts", "totals", "freed") else v for k, v in vars(self).items()}

    def __setstate__(self, state):
        vars(self).update({k: [_unpacked(*x) for x in v] if k in ("counts", "totals", "freed") else v for k, v in state.items()})

    def interpolate(self, before: np.ndarray, keys: np.ndarray, lower: list[np.ndarray]) -> list[np.ndarray]:
        """The probability in each class; what was not seen before any word has that of the lower order."""
        gram, context, out = self.grams.find(keys), self.contexts.find(before), []
        for counts, cut, totals, freed, low in zip(self.counts, self.cut, self.totals, self.freed, lower, strict=True):
            c, total = counts[gram], totals[context]
            out.append(np.where(total > 0, (c - cut[np.minimum(c, 3)] + freed[context] * low) / np.maximum(total, 1), low))
        return out


class Model:
    """Both Kneser-Ney models, and the logistic function."""

    #: (application, broadcast of the models) once there is one: training and scoring read the same.
    box = None

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "box"}

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, counts: tuple[np.ndarray, np.ndarray]):
        """``counts`` of each different trigram in the toxic and in the ordinary texts."""
        self.part, self.middle, self.spread, self.weights, self.offset = SHARES[-1], np.zeros(3), np.ones(3), np.zeros(3), -np.inf
        uv, vw = pair_key(u, v), pair_key(v, w)
        self.three = Order(uv, pair_key(uv, w), list(counts))
        del u, uv
        keys, first, at = np.unique(vw, return_index=True, return_inverse=True)
        v, w = v[first], w[first]
        seen = [np.bincount(at, weights=c > 0, minlength=len(keys)).astype(np.int64) for c in counts]
        self.two = Order(v, keys, seen)
        own, at = np.unique(w, return_inverse=True)
        nothing = np.zeros(len(own), np.uint64)
        self.one = Order(nothing, own, [np.bincount(at, weights=c > 0, minlength=len(own)).astype(np.int64) for c in seen])
        common = np.bincount(at, weights=(seen[0] > 0) & (seen[1] > 0), minlength=len(own)).astype(np.int64)
        self.both = Order(nothing, own, [common])

    def probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[list[np.ndarray]]:
        """[toxic, ordinary] probability of each word ``w`` by one word, by two and by three."""
        nothing, uv, vw = np.zeros(len(w), np.uint64), pair_key(u, v), pair_key(v, w)
        base = self.both.interpolate(nothing, w, [np.full(len(w), 1 / (len(self.both.grams.keys) + 1))])[0]
        one = self.one.interpolate(nothing, w, [base, base])
        two = self.two.interpolate(v, vw, one)
        return [one, two, self.three.interpolate(uv, pair_key(uv, w), two)]

    def differences(self, texts: list[bytes], parts: tuple[float, ...]) -> np.ndarray:
        """(texts, parts, 3): mixture minus ordinary log-likelihood, per word, by one, two and three words."""
        words = [words_of(t) for t in texts]
        n = np.array([len(x) for x in words])
        u, v, w = trigrams(words)
        owner, out = np.repeat(np.arange(len(texts)), n), np.zeros((len(texts), len(parts), 3))
        for at in range(0, len(w), STEP):
            s = slice(at, at + STEP)
            for k, (toxic, ordinary) in enumerate(self.probabilities(u[s], v[s], w[s])):
                for i, part in enumerate(parts):
                    out[:, i, k] += np.bincount(owner[s], weights=np.log1p(part * (toxic / ordinary - 1)), minlength=len(texts))
        return out / np.maximum(n, 1)[:, None, None]

    def calibrate(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Share and logistic function of ``differences`` x for all SHARES."""
        fits = []
        for i, part in enumerate(SHARES):
            middle = np.median(x[~toxic, i], axis=0)
            spread = np.maximum(np.median(np.abs(x[~toxic, i] - middle), axis=0), 1e-9)
            loss, weights, offset = _logistic(np.arcsinh((x[:, i] - middle) / spread), toxic)
            fits.append((loss, part, middle, spread, weights, offset))
        _, self.part, self.middle, self.spread, self.weights, self.offset = min(fits, key=lambda f: f[:2])

    def fitted(self) -> tuple:
        """What ``calibrate`` finds."""
        return self.part, self.middle, self.spread, self.weights, self.offset

    def scores(self, texts: list[bytes], fitted: tuple | None = None) -> list[float]:
        part, middle, spread, weights, offset = fitted or self.fitted()
        found = np.arcsinh((self.differences(texts, (part,))[:, 0] - middle) / spread) @ weights + offset
        return np.where(np.isfinite(found), 1 / (1 + np.exp(-np.clip(found, -50, 50))), 0.0).tolist()


def _logistic(x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray, float]:
    """Loss, weights (none negative) and offset of a logistic regression, classes weighing alike, by Newton steps."""
    y, heavy = toxic.astype(float), np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    scale = np.maximum(x.std(axis=0), 1e-12)
    use = np.flatnonzero(x.std(axis=0) > 1e-12)
    while True:
        z, t = np.column_stack([x[:, use] / scale[use], np.ones(len(x))]), np.zeros(len(use) + 1)
        small = ridge * np.diag([*np.ones(len(use)), 1e-2])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
            step = np.linalg.solve((z * (heavy * p * (1 - p))[:, None]).T @ z + small, z.T @ (heavy * (y - p)) - small @ t)
            t += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if len(use) and t[:-1].min() < 0:
            use = np.delete(use, int(t[:-1].argmin()))
            continue
        p, weights = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30))), np.zeros(x.shape[1])
        weights[use] = t[:-1] / scale[use]
        return float(-(heavy * np.log(np.where(toxic, p, 1 - p))).sum()), weights, float(t[-1])


def _count(batches):
    """(u, v, w, toxic, ordinary): how often in each class; each trigram once a batch."""
    names = ["u", "v", "w", "toxic", "ordinary"]
    for batch in batches:
        texts = [words_of(t) for t in as_bytes(batch.column("text"))]
        toxic = np.repeat(np.array(batch.column("toxic").to_pylist()) == 1, [len(t) for t in texts])
        if len(toxic):
            own, at = np.unique(np.stack(trigrams(texts), axis=1).view("V24").ravel(), return_inverse=True)
            counts = [np.bincount(at, weights=x, minlength=len(own)).astype(np.int64) for x in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.copy()) for c in own.view(np.int64).reshape(-1, 3).T), *map(pa.array, counts)], names=names)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, test, text): the bounded sample that ``train`` learns from."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    text = text.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= LONGEST).withColumn("h", F.xxhash64("text", F.lit("toxicity")))
    # different texts of each class, ids and hashes only; the texts follow
    some = text.select("doc_id", "h", "bytes").join(labels, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes"))
    some = some.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("toxic", "salt").orderBy("h"))
    some = some.withColumn("rank", rank).where(F.col("rank") <= -(-per_class // SALTS))
    sums = F.sum("bytes").over(Window.partitionBy("toxic").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("sums", sums).where(F.col("sums") <= TRAIN_BYTES)  # of at most per_class rows a class
    picked = F.broadcast(some.select("toxic", "h", "doc_id", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("test")))
    return text.join(picked, ["doc_id", "h"]).dropDuplicates(["toxic", "h"]).select("toxic", "test", "text")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from rows (doc_id, text) and (doc_id, toxic)."""
    found = materialize(sample(docs, labels, per_class))
    counted = found.where("not test").mapInArrow(tidy(_count), "u long, v long, w long, toxic long, ordinary long")
    sums = [F.sum(c).cast("int").alias(c) for c in ("toxic", "ordinary")]
    t = counted.groupBy("u", "v", "w").agg(*sums).toArrow()
    u, v, w = (t[c].to_numpy().view(np.uint64) for c in "uvw")
    counts = tuple(t[c].to_numpy() for c in ("toxic", "ordinary"))
    some = all(c.any() for c in counts)
    del t
    model = Model(u, v, w, counts)
    del u, v, w, counts
    reclaim(docs.sparkSession)
    box = share(docs.sparkSession, model)
    model.box = docs.sparkSession.sparkContext.applicationId, box

    def differ(batches):
        m = shared(box)
        for batch in batches:
            x = m.differences(as_bytes(batch.column("text")), SHARES).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    tests = sorted((r["toxic"], r["x"]) for r in found.where("test").mapInArrow(tidy(differ), "toxic int, x array<double>").collect())
    toxic = np.array([y == 1 for y, _ in tests], dtype=bool)
    if some and toxic.any() and not toxic.all():
        model.calibrate(np.array([x for _, x in tests]).reshape(len(tests), len(SHARES), 3), toxic)
    forget(found)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and toxic_score; a column of this name is replaced."""
    docs = docs.drop("toxic_score")
    lean(docs.sparkSession)
    held = model.box and model.box[0] == docs.sparkSession.sparkContext.applicationId
    box, fitted = model.box[1] if held else share(docs.sparkSession, model), model.fitted()

    def run(batches):
        m = shared(box)
        for batch in batches:
            found = m.scores(as_bytes(batch.column("text")), fitted)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "toxic_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, toxic_score double")


def held_out(docs: DataFrame):
    """The rows of ``docs`` whose labels training leaves alone."""
    return bucket_of(docs["doc_id"], 5) == 0
