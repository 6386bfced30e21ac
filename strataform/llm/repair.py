"""Conversation structure repair: each distinct signature of roles and faults is solved once, audits are joined back.

A conversation's rows go by turn (null first), then role, then text. Each has at most one fault: ``blank`` (no character
but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (last such character not one of ``.!?``). Its
signature has one character a row: the role's initial (``s``, ``u``, ``a``; ``o`` for any other), as a capital if the row
is truncated, or ``-`` if it has to go. Conversations with the same signature have the same cheapest edits, so only
distinct signatures are solved, by recursion over (row, what the grammar allows next) with every state's cost kept.

Grammar of roles: ``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only way for blank and
duplicate rows), Insert an empty user or assistant row 5; a truncated row that stays costs 5 more. Of the cheapest edits
the audit whose initials are least in ASCII is taken. Which role a row gets follows from the edits before it.

Signatures are joined back under salts of the conversation's id, so that one that many share isn't one task.

Defined cases: null role or text is one space (so the text is blank); an empty role has no initial and counts as ``o``;
null turns come first and count for no gap; null conv_id is one conversation; ties of a turn have one order; other columns
are ignored; an empty table gives no rows. A conversation is one row of the result, so its rows are gathered in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_NOT_SPACE = r"[^\x20\x09-\x0D]"
_TRUNCATED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
_LEGAL = ("su", "ua", "au")
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A signature's conversations are dealt over so many tasks.
SALTS = 64

#: What a conversation has so far: nothing, only its system row, a user row last, an assistant row last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NEVER = 1 << 60


def solve(signature: str) -> tuple[int, str]:
    """Cost and edits of a signature; edits are D, K, U or A (rerole) and u or a (insert), ``audit`` of them the initials.

    The recursion goes from the last row to the first, so each call finds the costs it needs; then the edits are read off
    from the first row on, the least initial that keeps the cost at its least.
    """
    n = len(signature)
    memo: list[tuple[int, ...]] = [()] * (n + 1)

    def kept(i: int, state: int) -> tuple[int, int]:
        """Cost of keeping row i, and the state after it."""
        role = signature[i].lower()
        after = _SYSTEM if role == "s" and state == _START else _NEXT[state] if role == "au"[_NEXT[state] == _USER] else None
        return (_NEVER, state) if after is None else (KEEP + TRUNCATED * signature[i].isupper(), after)

    def here(i: int, state: int) -> int:
        """Least cost from row i on if nothing is inserted before it."""
        if i == n:
            return 0 if state in (_START, _ASSISTANT) else _NEVER
        found = DELETE + memo[i + 1][state]
        if signature[i] != "-":
            cost, after = kept(i, state)
            found = min(found, cost + memo[i + 1][after], REROLE + TRUNCATED * signature[i].isupper() + memo[i + 1][_NEXT[state]])
        return found

    def least(i: int, state: int, inserts: int) -> int:
        found = here(i, state)
        return min(found, INSERT + least(i, _NEXT[state], inserts - 1)) if inserts else found

    for i in range(n, -1, -1):
        memo[i] = tuple(least(i, state, 2) for state in range(4))
    i, state, edits = 0, _START, []
    while i < n or state not in (_START, _ASSISTANT):
        cost, to = memo[i][state], _NEXT[state]
        row = signature[i] if i < n else "-"
        stays, after = kept(i, state) if row != "-" else (_NEVER, state)
        if i < n and DELETE + memo[i + 1][state] == cost:
            edits.append("D")
            i += 1
        elif INSERT + memo[i][to] == cost:
            edits.append("u" if to == _USER else "a")
            state = to
        elif row != "-" and stays + memo[i + 1][after] == cost:
            edits.append("K")
            i, state = i + 1, after
        else:
            edits.append("U" if to == _USER else "A")
            i, state = i + 1, to
    return memo[0][_START], "".join(edits)


def _solved(batches):
    for b in batches:
        yield pd.DataFrame([(s, *solve(s)) for s in b["signature"]], columns=["signature", "cost", "edits"])


def audit(edits: Column) -> Column:
    """The initials of Delete, Insert, Keep and Rerole."""
    return F.translate(edits, "UAua", "RRII")


def _inserted(edits: Column) -> Column:
    of = F.filter(F.split(edits, ""), lambda c: c != "")
    return F.transform(of, lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def replay(rows: Column, edits: Column) -> Column:
    """The repaired conversation, an array of (role, text): ``edits`` done on ``rows``."""
    steps, tail = F.regexp_extract_all(edits, F.lit("[ua]*[DKUA]"), F.lit(0)), F.regexp_extract(edits, r"[ua]*\z", 0)

    def done(row: Column, step: Column) -> Column:
        own = lambda role: F.array(F.struct(role.alias("role"), row["text"].alias("text")))
        last = F.right(step, F.lit(1))
        stays = F.when(last == "K", own(row["role"])).when(last == "U", own(F.lit("user"))).when(last == "A", own(F.lit("assistant")))
        before = _inserted(F.left(step, F.length(step) - 1))
        return F.when(last == "D", before).otherwise(F.concat(before, stays))

    return F.flatten(F.concat(F.zip_with(rows, steps, done), F.array(_inserted(tail))))


def signatures(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, rows (turn, role, text) in order, classes, faults and the signature."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    one = F.struct("turn", text("role"), text("text"))
    found = turns.select("conv_id", (F.when(present, one) if present is not None else one).alias("one"))
    found = found.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("rows"))
    # rows in the order of their texts: an equal one before makes a duplicate
    by_text = F.sort_array(F.transform("rows", lambda r, i: F.struct(r["role"].alias("role"), r["text"].alias("text"), i.alias("i"))))
    found = found.withColumn("by_text", by_text)
    pairs = F.arrays_zip(F.col("by_text").alias("x"), F.slice("by_text", 2, F.size("by_text")).alias("y"))
    again = F.transform(F.filter(pairs, lambda p: (p["x"]["role"] == p["y"]["role"]) & (p["x"]["text"] == p["y"]["text"])), lambda p: F.struct(p["y"]["i"].alias("i"), F.lit(1).alias("k")))
    # marked positions and all positions, sorted together: an equal neighbour says which are marked
    marks = F.sort_array(F.concat(again, F.transform("rows", lambda r, i: F.struct(i.alias("i"), F.lit(0).alias("k")))))
    found = found.withColumn("marks", marks)
    followed = F.arrays_zip(F.col("marks").alias("x"), F.slice("marks", 2, F.size("marks")).alias("y"))
    repeated = F.transform(F.filter(followed, lambda p: p["x"]["k"] == 0), lambda p: F.coalesce(p["y"]["k"] == 1, F.lit(False)))
    fault = lambda r, again: F.when(~r["text"].rlike(_NOT_SPACE), "blank").when(again, "duplicate").when(r["text"].rlike(_TRUNCATED), "truncated").otherwise("")
    initial = lambda r: F.when(F.left(r["role"], F.lit(1)).isin("s", "u", "a"), F.left(r["role"], F.lit(1))).otherwise("o")
    found = found.withColumn("faults", F.zip_with("rows", repeated, fault)).withColumn("classes", F.transform("rows", initial))
    sign = F.zip_with("classes", "faults", lambda c, f: F.when(f.isin("blank", "duplicate"), "-").when(f == "truncated", F.upper(c)).otherwise(c))
    return found.select("conv_id", "rows", "classes", "faults", F.array_join(sign, "").alias("signature"))


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    signature, cost, audit and repaired, an array of (role, text).

    Rows where ``present`` isn't true only say that there is such a conversation.
    """
    found = signatures(turns, present)
    numbers = F.filter(F.transform("rows", lambda r: r["turn"].cast("long")), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    steps = F.zip_with("classes", F.slice("classes", 2, F.size("classes")), lambda a, b: F.concat(a, b))  # null after the last
    count = lambda name: F.size(F.filter("faults", lambda f: f == name)).cast("long").alias(name)
    illegal = F.size(F.filter(steps, lambda p: ~p.isin(*_LEGAL))).cast("long")
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    held = materialize(found.select("conv_id", "rows", "signature", salt, gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated")), illegal.alias("illegal")))
    keys = held.select("signature", "salt").distinct()
    solved = keys.select("signature").distinct().mapInPandas(_solved, "signature string, cost long, edits string")
    out = held.join(keys.join(solved, "signature"), ["signature", "salt"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature", "cost", audit(F.col("edits")).alias("audit"), replay(F.col("rows"), F.col("edits")).alias("repaired"))
