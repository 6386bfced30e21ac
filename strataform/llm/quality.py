"""Quality rules as a ledger of bits, in DataFrame functions only.

``ledger`` reads each text once: it measures it and evaluates every rule of RULES, whose failures become the bits of one
number (rule k is bit k). Policies are data: which failures reject a text, which are tolerated up to a number. They are
applied to the ledger's bits alone, so a new version of a policy, what each rule removes and what a policy would keep
without a rule (``ablations``) never read a text again.

A rule fails where ``left > right`` for two whole numbers, so no verdict hangs on rounding. Words are runs of
``[^\\x20\\x09-\\x0D]``; lines are split at \\n and count if they have a word.

Defined cases: null text is empty, which fails ``few_words`` and no other rule; rows are judged one by one, repeated or
not; ``ledger`` keeps the columns it is told to and replaces ones named ``measures`` and ``failed``; an empty table gives
no rows, and ablations of zeros. Nothing is shuffled, and memory follows the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_upper", "n_digits", "n_bullets", "n_ellipses")
#: Rules in the order of their bits: name, and ``left > right`` over MEASURES where a text fails.
RULES = (
    ("few_words", "50 > n_words"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "3 * n_words > word_chars"),
    ("long_words", "word_chars > 10 * n_words"),
    ("no_letters", "80 * n_words > 100 * n_letter_words"),
    ("capitals", "100 * n_upper > 30 * word_chars"),
    ("digits", "100 * n_digits > 20 * word_chars"),
    ("bullets", "100 * n_bullets > 90 * n_lines"),
    ("ellipses", "100 * n_ellipses > 30 * n_lines"),
)
NAMES = tuple(name for name, _ in RULES)


@dataclass(frozen=True)
class Policy:
    """A version of a policy: failures of ``hard`` rules reject a text, so do more than ``allowed`` of the ``soft`` ones."""

    name: str
    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    @property
    def hard_bits(self) -> int:
        return sum(1 << NAMES.index(r) for r in self.hard)

    @property
    def soft_bits(self) -> int:
        return sum(1 << NAMES.index(r) for r in self.soft)

    def keeps(self, bits: Column) -> Column:
        """Whether the policy keeps a text of these failures."""
        soft = F.bit_count(bits.bitwiseAND(F.lit(self.soft_bits))) <= self.allowed
        return (bits.bitwiseAND(F.lit(self.hard_bits)) == 0) & soft


BASE = NAMES[:2]
#: Every version stays, so that an older verdict can be had again from the ledger.
POLICIES = (
    Policy("base", 1, BASE),
    Policy("prose", 1, NAMES),
    Policy("prose", 2, (*BASE, "symbols", "repeated_lines", "no_letters", "capitals"), ("short_words", "long_words", "digits", "bullets", "ellipses"), 1),
)


def policy(name: str, version: int | None = None) -> Policy:
    """A policy by name, the latest version if none is named."""
    found = [p for p in POLICIES if p.name == name and version in (None, p.version)]
    if not found:
        raise KeyError(f"no policy {name} {version or ''}")
    return max(found, key=lambda p: p.version)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from (a, b, c, i) in order: equal windows are neighbours."""
    pairs = F.arrays_zip(windows.alias("x"), F.slice(windows, 2, F.size(windows)).alias("y"))
    same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    covered = F.transform(same, lambda p: F.array(*(p[k]["i"] + j for k in "xy" for j in range(3))))
    return F.size(F.array_distinct(F.flatten(covered)))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``measures``, a struct of MEASURES, from the column ``text``."""
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(_WORD + "+"), F.lit(0)), "lines": lines})
    k = F.greatest(F.size("words") - 2, F.lit(0))
    parts = [F.slice("words", 1 + j, k).alias(c) for j, c in enumerate("abc")]
    rows = rows.withColumn("windows", F.sort_array(F.arrays_zip(*parts, F.slice(F.sequence(F.lit(0), F.size("words")), 1, k).alias("i"))))
    chars = F.length(_without(F.col("text"), _SPACES))
    measures = {
        "n_words": F.size("words"),
        "word_chars": chars,
        "n_symbols": F.length("text") - F.length(_without(F.col("text"), _SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("windows")),
        "n_letter_words": F.size(F.filter("words", lambda x: x.rlike(r"\p{L}"))),
        "n_upper": F.length(F.regexp_replace("text", r"\P{Lu}+", "")),
        "n_digits": F.length("text") - F.length(_without(F.col("text"), "0123456789")),
        "n_bullets": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-•*]"))),
        "n_ellipses": F.size(F.filter("lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))),
    }
    return rows.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), F.struct(*(measures[m].cast("long").alias(m) for m in MEASURES)).alias("measures"))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``measures`` and ``failed``: the bits of the rules that the text fails."""
    found = measure(docs, tuple(c for c in keep if c.lower() not in ("measures", "failed")))
    bits = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        said = " ".join(f"measures.{w}" if w in MEASURES else w for w in rule.split())
        bits = bits.bitwiseOR(F.when(F.expr(said), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return found.withColumn("failed", bits)


def apply(rows: DataFrame, by: Policy) -> DataFrame:
    """A ledger with ``kept`` and ``reasons``: the names of the policy's rules that the text fails, in their order."""
    counted = F.col("failed").bitwiseAND(F.lit(by.hard_bits | by.soft_bits))
    names = F.array_compact(F.array(*(F.when(counted.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(NAMES))))
    return rows.withColumns({"kept": by.keeps(F.col("failed")), "reasons": names})


def ablations(rows: DataFrame, by: Policy) -> DataFrame:
    """For each rule of a policy: texts it fails, texts that it alone rejects, and texts kept without it.

    The ledger is counted by its bits first, at most one row for each set of rules, so the rest doesn't grow with it.
    """
    sets = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << NAMES.index(r)).cast("long").alias("bit")) for r in (*by.hard, *by.soft)))
    pairs = rows.sparkSession.range(1).select(F.explode(rules).alias("r")).select("r.rule", "r.bit").join(F.broadcast(sets), F.lit(True), "left")  # rules x sets of rules
    without = by.keeps(F.col("failed").bitwiseAND(F.bitwise_not("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return pairs.groupBy("rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(without & ~by.keeps(F.col("failed"))).alias("n_only"),
        total(without).alias("n_kept_without"),
    )


def fired(rows: DataFrame) -> DataFrame:
    """One row: the rules that some text fails and those that all texts fail, by bitwise aggregation; (docs, any, all)."""
    return rows.agg(F.count("*").alias("docs"), F.coalesce(F.bit_or("failed"), F.lit(0)).alias("any"), F.coalesce(F.bit_and("failed"), F.lit(0)).alias("all"))
