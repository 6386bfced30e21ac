"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples. A token of at least MIN_TOKEN characters outside the pattern matches (also what a match leaves of a
longer one, without the sign that joins them) is reported as ``random`` if the
log-likelihood ratio of the two models, per character, reaches THRESHOLD.

Defined cases: null text is empty and has no spans; rows stay as they are, repeated or not; other columns are kept by
``scan`` and ``redact``, whatever their names, but ``scan`` replaces one named ``secret_spans``; an empty table gives none.
Spans count code points, end exclusive.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Fixed patterns by kind, in order, with the group whose length counts and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short holds no longer match further on
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(TOKEN_CHARS) + 1
#: Shortest token that the models judge, nats per character that make it a secret, and what smooths each count.
MIN_TOKEN, THRESHOLD, SMOOTH = 20, 0.8, 0.5
#: Samples at most that the default training takes of each kind.
SAMPLES = 4000


_SPAN = "array<struct<start:int,rank:int,end:int,match:string>>"


def _let(x: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _blocks(items: Column) -> Column:
    """``items`` in blocks of about the square root of their number.

    Appending to an array copies it and a substring counts characters from the text's start, so what is done block by
    block costs the number to the power of 1.5 in place of 2.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return F.when(F.size(items) > 0, _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / w).cast("int")), lambda b: F.slice(items, b * w + 1, w)))).otherwise(F.array())


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, rank of kind, end) of the matches; ``split`` gives the gaps between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(matches), F.lit(1))).alias("gap"), matches.alias("match"))

    def placed(block: Column, at: Column) -> Column:
        """Spans of a block whose first gap begins at ``at``, and where the last ends."""
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(p["gap"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (acc["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end"), p["match"].alias("match"))).alias("out"),
            ),
        )

    # the positions carry over from block to block
    found = F.aggregate(
        _let(pairs, _blocks),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda acc, block: _let(placed(block, acc["at"]), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out"))),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with ``by(span, first character not yet replaced)`` for each of ``spans`` (sorted, they may overlap)."""

    def block_of(block: Column, stretch: Column, base: Column) -> Column:
        """The stretch of text from ``base`` to the end of a block's spans, replaced."""
        return F.aggregate(
            block,
            F.struct(base.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.array_append(acc["out"], F.concat(F.substring(stretch, acc["at"] - base + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), by(s, acc["at"]))).alias("out"),
            ),
            lambda acc: F.array_join(acc["out"], ""),
        )

    def step(acc: Column, block: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"])))
        return _let(end, lambda end: _let(F.substring(text, acc["at"] + 1, end - acc["at"]), lambda stretch: F.struct(end.alias("at"), F.array_append(acc["out"], block_of(block, stretch, acc["at"])).alias("out"))))

    return F.aggregate(
        _blocks(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), ""),
    )


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with a NUL for every character of ``spans`` and the signs that join them on."""
    done = _replaced(text, spans, lambda s, at: F.repeat(F.lit("\0"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))
    return F.when(F.size(spans) > 0, F.regexp_replace(done, r"(?<=\x00)[+/_=-]|[+/_=-](?=\x00)", "\0")).otherwise(text)


def _base(text: Column) -> Column:
    """The spans of the fixed patterns, in order."""
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _symbols(text: Column) -> Column:
    """The symbol of each character."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(TOKEN_CHARS), c))


def default_samples(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Labelled samples (text, label): 1 for generated random strings, 0 for ordinary identifiers.

    Ordinary are the words of about ``samples`` / 4 documents picked by a hash over all of them, without what the fixed
    patterns find there, these words joined as in
    identifiers and paths, decimal numbers, and rules of one repeated sign.
    """
    n = docs.sparkSession.range(samples)
    digest = F.sha2(F.col("id").cast("string"), 512)
    base = F.regexp_replace(F.base64(F.unhex(digest)), "\\s", "")
    random = n.select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(base, 1, 40), F.translate(F.substring(F.upper(base), 3, 24), "+/=", "ABC"), F.regexp_replace(base, "[+/=]", ""))).alias("text"), F.lit(1).alias("label"))
    numbers = n.select(F.substring(F.regexp_replace(digest, "[^0-9]", ""), 1, 16).alias("text"), F.lit(0).alias("label"))
    rules = n.select(F.explode(F.array(*(F.repeat(F.lit(c), (F.col("id") % 60 + 8).cast("int")) for c in "-=_+/"))).alias("text"), F.lit(0).alias("label"))
    share = max(1, docs.count() * 4 // samples)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    plain = some.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("text", _base(F.col("text")).alias("spans"))
    words = plain.select(F.regexp_extract_all(_blanked(F.col("text"), F.col("spans")), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)).alias("w"))
    sep = lambda i: F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), (i % 4 + 1).cast("int"))
    follow = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    joined = words.select("w", F.transform("w", lambda x, i: F.concat(x, sep(i), follow(i + 1), sep(i), follow(i + 2))).alias("j"))
    return random.union(numbers).union(rules).union(joined.select(F.explode(F.concat("w", "j")), F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, by symbol and the symbol before it (0: any other, or the start), as one list."""
    once = samples.where("length(text) > 0").groupBy("text", "label").count().withColumn("symbols", _symbols(F.col("text")))
    steps = once.select("label", "count", "symbols", F.posexplode("symbols").alias("at", "b"))
    pairs = steps.select("label", "count", F.when(F.col("at") == 0, 0).otherwise(F.get("symbols", F.col("at") - 1)).alias("a"), "b")
    counts = [[[SMOOTH] * SYMBOLS for _ in range(SYMBOLS)] for _ in range(2)]
    for r in pairs.groupBy("label", "a", "b").agg(F.sum("count").alias("n")).collect():  # at most 2 * SYMBOLS ** 2
        counts[r["label"]][r["a"]][r["b"]] += r["n"]
    rows = [[[log(x / sum(row)) for x in row] for row in c] for c in counts]
    return [round(r - o, 6) for a in range(SYMBOLS) for r, o in zip(rows[1][a], rows[0][a], strict=True)]


def score(token: Column, model: list[float]) -> Column:
    """The models' log-likelihood ratio of a token, per character."""
    table, symbols = F.from_json(F.lit(json.dumps(model)), "array<double>"), _symbols(token)
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(symbols, 1, F.greatest(F.size(symbols) - 1, F.lit(0)))), symbols, lambda a, b: a * SYMBOLS + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / F.length(token)


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and ``secret_spans``: array of (start, rank in KINDS, end) in order; a column of this name is replaced."""
    text, given = F.coalesce(F.col("text").cast("string"), F.lit("")), docs.drop("secret_spans")
    base, rest, tokens = (free_name(given, c) for c in ("secret_base", "secret_rest", "secret_tokens"))
    out = given.withColumn(base, _base(text)).withColumn(rest, _blanked(text, F.col(base)))
    out = out.withColumn(tokens, _spans(F.col(rest), f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}", "random"))
    free = F.filter(tokens, lambda t: score(t["match"], model) >= threshold)
    spans = F.transform(F.array_sort(F.concat(base, free)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return out.select(*given.columns, spans.alias("secret_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (spans that overlap by one) and n_chars to match; null stays null."""
    marked = free_name(docs, "found_spans")
    kept = {c: F.col(c) for c in docs.columns}
    found = scan(docs.select(*(x.alias(f"kept_{i}") for i, x in enumerate(kept.values())), F.col("text").alias("text")), model, threshold)
    found = found.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)), F.col("secret_spans").alias(marked))
    text = F.col("text").cast("string")
    clean = F.when(F.size(marked) > 0, _replaced(text, F.col(marked), lambda s, at: F.when(s["start"] >= at, F.lit(mark)).otherwise(""))).otherwise(text)
    changed = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(marked) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
