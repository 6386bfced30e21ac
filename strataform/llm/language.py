"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features: hashed byte n-grams of the whole text (A-Z as a-z, anything but letters as a blank), square roots of the
counts, scaled to length one. One linear support vector machine separates each pair of families, one each pair of
languages of a family; the family, then the language, with most votes wins.

Training is on a bounded sample: per language the PER_LANGUAGE different labelled texts least by a hash, TOTAL in all.

Defined cases: null text or text without a letter is ``und`` with score 0, and so is everything if nothing was learned;
rows with null text or language teach nothing; copies of a text teach once for each language; other columns are kept; an empty
table gives no rows. A language outside FAMILIES is a family of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, lean, reclaim, share, shared, tidy

#: Families of some languages by code (fixed values).
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
#: Size of the feature space, n-gram lengths, sampled rows per language and in all.
FEATURES, ORDERS, PER_LANGUAGE, TOTAL = 1 << 13, (2, 3, 4), 400, 4000
UNKNOWN = "und"

_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, langs in FAMILIES.items() if code in langs), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of one whole text; memory is a few times its bytes, in pieces of a megabyte."""
    raw = b" " + text.encode("utf-8", "surrogatepass").translate(_TABLE) + b" "
    total = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):
        a = np.frombuffer(raw[at : at + (1 << 20) + 3], dtype=np.uint8).astype(np.uint32)
        for n in ORDERS:
            if len(a) < n:
                continue
            g = np.full(len(a) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                g = g * np.uint32(257) + a[i : len(a) - n + 1 + i]
            total += np.bincount((g * np.uint32(2654435761)) >> np.uint32(19), minlength=FEATURES)
    x = np.sqrt(total.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, steps: int = 3000, batch: int = 32, penalty: float = 1e-4, seed: int = 7, use: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (the last is the bias) of a linear SVM for labels -1 and 1, and the slope that makes margins odds.

    Averaged stochastic subgradient steps on the hinge loss, classes drawn evenly. ``y`` are the labels of the rows
    ``use`` of ``x`` (all of them by default), of which only a few are copied at a time.
    """
    rng = np.random.default_rng(seed)
    use = np.arange(len(x)) if use is None else use

    def taken(rows: np.ndarray) -> np.ndarray:
        return np.hstack([x[use[rows]], np.ones((len(rows), 1), dtype=np.float32)])

    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    w, mean = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        drawn = taken(rows)
        off = y[rows] * (drawn @ w) < 1
        wrong = rows[off]
        rate = 1.0 / (penalty * (t + 1000))
        w *= 1 - rate * penalty
        if len(wrong):
            w += rate / batch * (y[wrong] @ drawn[off])
        if t > steps // 2:
            mean += w
    w = mean / (steps - steps // 2)
    margin = y * np.concatenate([taken(np.arange(at, min(at + 256, len(use)))) @ w for at in range(0, len(use), 256)])
    slope = max((2.0**k for k in range(-2, 6)), key=lambda s: -np.logaddexp(0, -s * margin).mean())
    return w, slope


class Model:
    """Families, their languages and one SVM for each pair."""

    def __init__(self, langs: list[str], x: np.ndarray):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(family_of(lang), []).append(lang)
        names, kin = np.array(langs, dtype=object), np.array([family_of(v) for v in langs], dtype=object)
        self.pairs: list[tuple[str, str, str, float]] = []  # family ("" for the families themselves), first, second, slope
        rows = []
        for group, of, options in [("", kin, sorted(self.members)), *((f, names, v) for f, v in self.members.items())]:
            for a, b in combinations(options, 2):
                use = np.flatnonzero((of == a) | (of == b))
                w, slope = train_svm(x, np.where(of[use] == a, 1.0, -1.0), use=use)
                self.pairs.append((group, a, b, slope))
                rows.append(w)
        self.weights = np.array(rows, dtype=np.float32).reshape(len(rows), FEATURES + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        family, p = self._vote("", sorted(self.members), margins)
        lang, q = self._vote(family, self.members[family], margins)
        return lang, float(p * q)

    def _vote(self, group: str, options: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The option with most votes (then the larger sum of odds, then the first) and the mean of its pairs' probabilities."""
        if len(options) == 1:
            return options[0], 1.0
        votes = {o: [0, 0.0] for o in options}
        for (g, a, b, slope), m in zip(self.pairs, margins.tolist(), strict=True):
            if g == group and a in votes and b in votes:
                p = float(1 / (1 + np.exp(-np.clip(slope * m, -30, 30))))
                votes[a][0] += p >= 0.5
                votes[b][0] += p < 0.5
                votes[a][1] += p
                votes[b][1] += 1 - p
        best = max(options, key=lambda o: (votes[o][0], votes[o][1]))
        return best, votes[best][1] / (len(options) - 1)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Model:
    """Learn from rows (text, lang)."""
    lean(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text", F.lit("language")))
    per = min(per_language, max(2, total // max(1, labelled.select("lang").distinct().count())))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = labelled.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= per).drop("rank")
    some = labelled.join(F.broadcast(picked), ["lang", "h"])

    def run(batches):
        seen = set()
        for batch in batches:
            rows = []
            for text, lang, h in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True):
                if has_letter(text) and (lang, h) not in seen:
                    seen.add((lang, h))
                    x = features(text)
                    at = np.flatnonzero(x)
                    rows.append((lang, h, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "h", "at", "x"])

    found = some.mapInArrow(tidy(run), "lang string, h long, at binary, x binary").dropDuplicates(["lang", "h"]).toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.zeros((found.num_rows, FEATURES), dtype=np.float32)
    for i, (at, v) in enumerate(zip(found["at"].to_pylist(), found["x"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
    model = Model(found["lang"].to_pylist(), x)
    del found, x
    reclaim(labelled.sparkSession)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and lang_pred, lang_score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    lean(docs.sparkSession)
    box = share(docs.sparkSession, model)

    def run(batches):
        m = shared(box)
        for batch in batches:
            found = [m.predict(features(t)) if t and m.members and has_letter(t) else (UNKNOWN, 0.0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, lang_score double")


def held_out(docs: DataFrame):
    """The rows of ``docs`` that training leaves alone."""
    return bucket_of(docs["doc_id"], 4) == 2
