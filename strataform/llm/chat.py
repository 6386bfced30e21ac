"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: conversation = turn*; turn = ``<s>`` role ``[INST] `` text ( `` </s>`` under the loss mask, else `` [/INST]`` ).
A text is rendered as it is at first. The rendered conversation is parsed by the deterministic parser below and its
turns are compared with the source; if they differ, the conversation is rendered again with its control strings escaped,
and parsed again; a conversation that still differed would raise.

Escape: in an opening bracket, backslashes, control body, one more backslash goes after the bracket, so ``</s>`` becomes
``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``: no control string remains, and taking one backslash away restores the text.

Defined cases: null text or role is empty; turns go by turn number (null first), then role, then text, so ties and
repeated rows have one order; null conv_id is one conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
BEGIN, BODY, CLOSE, CLOSE_LOSS = "<s>", "[INST] ", " [/INST]", " </s>"
_BODIES = r"(/?s>|/?INST\])"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_BODIES}", rf"([<\[])\\(\\*){_BODIES}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def render(turns: Column, loss_role: str, escaped: bool) -> Column:
    """The formatted conversation of an array of (role, text)."""
    own = escape if escaped else (lambda x: x)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), own(t["role"]), F.lit(BODY), own(t["text"]), F.when(t["role"] == loss_role, CLOSE_LOSS).otherwise(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text, loss) read back; anything the grammar doesn't hold gives turns that differ from the source."""
    pieces = F.split(formatted, r"<s>")
    return F.transform(
        F.when(pieces[0] == "", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces),
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring(p, F.length(F.substring_index(p, BODY, 1)) + len(BODY) + 1, F.length(p)), r"(?s) (?:</s>|\[/INST\])\z", "")).alias("text"),
            p.endswith(CLOSE_LOSS).alias("loss"),
            F.size(F.split(p, r"</s>|\[/?INST\]")).alias("controls"),
        ),
    )


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (role, text, loss: read back from formatted)."""
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("source"))
    want = F.transform("source", lambda t: F.struct(t["role"], t["text"], (t["role"] == loss_role).alias("loss"), F.lit(3).alias("controls")))
    for level in (False, True):
        if level:
            again = F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("source"), loss_role, True))
            source = source.withColumn("formatted", again)
        else:
            source = source.withColumn("formatted", render(F.col("source"), loss_role, False))
        source = source.withColumn("turns", parse(F.col("formatted"))).withColumn("same", F.col("turns") == want)
    ok = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation differs after its round trip")))
    return source.select("conv_id", ok.alias("formatted"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss"))).alias("turns"))
