"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_classes

    return ngram_classes(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id,
  (SELECT count(*) FROM links WHERE links.a = d.rid)::BIGINT AS n_links
FROM d LEFT JOIN n USING (rid) JOIN reach USING (rid) JOIN d o ON o.rid = reach.other GROUP BY d.rid, d.doc_id
"""


@query
def op10_chat_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    own = spark.sql("""SELECT CAST(-1 AS BIGINT) conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text FROM range(2)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    found = format_chats(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op10_chat_format_roundtrip"] = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS escaped,
             regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS escaped_role FROM own)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(10 + length(escaped_role) + length(escaped) + CASE WHEN role = 'assistant' THEN 5 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import default_samples, listed, scan, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(default_samples(docs)))
    kind = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .mixing import mix, sized

    found = mix(materialize(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")))
    return found.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing with the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    from .packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out(docs)), labels.where(~held_out(labels)))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(found).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bucket_of
    from .context_trees import score

    docs = table(spark, sf_dir, "documents")
    return score(docs, bucket_of(docs["doc_id"], 5) == 1)


@query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair

    turns = table(spark, sf_dir, "conversations")
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")))
    harm = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    harmed = turns.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(harm != 0, F.when(harm == 3, 2).otherwise(1))).alias("present"),
    )
    found = repair(harmed, F.col("present"))
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text in SQL."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
  lambda a, c: list_reduce([xor(a, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _then(way: str, cost: str, edit: str) -> str:
    """A way (its cost in six digits, then its audit) and one more edit."""
    return f"(lpad((left({way}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({way}, 7) || {edit})"


_INS = [_then(f"w[{i}]", "5", "'I'") for i in (1, 2, 3, 4)]
_DEL = [_then(f"b[{i}]", "2", "'D'") for i in (1, 2, 3, 4)]
_STAY = lambda i, role: f"CASE WHEN x[1] <> '-' THEN {_then(f'b[{i}]', f'''(CASE WHEN lower(x[1]) = '{role}' THEN 0 ELSE 1 END + CASE WHEN lower(x[1]) <> x[1] THEN 5 ELSE 0 END)''', f'''CASE WHEN lower(x[1]) = '{role}' THEN 'K' ELSE 'R' END''')} END"
_SYSTEM = f"CASE WHEN lower(x[1]) = 's' THEN {_then('b[1]', '''CASE WHEN x[1] = 'S' THEN 5 ELSE 0 END''', '''\'K\'''')} END"
ORACLE["op11_repair_conversations"] = rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations),
d AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM q),
s AS (SELECT *, left(role, 1) AS c, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS class,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
p AS (SELECT *, lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM s),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (following IS NOT NULL AND c || following NOT IN ('su', 'ua', 'au')) AS illegal,
    list([CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(class) ELSE class END] ORDER BY i) AS signs FROM p GROUP BY conv_id),
-- the cheapest way to each of four states: nothing yet, system, user last, assistant last
w AS (SELECT *, list_reduce(signs, lambda w, x: list_transform([[w[1], w[2], least(w[3], {_INS[0]}, {_INS[1]}, {_INS[3]}), least(w[4], {_INS[2]})]], lambda b: [
    {_DEL[0]}, least({_DEL[1]}, {_SYSTEM}), least({_DEL[2]}, {_STAY(1, "u")}, {_STAY(2, "u")}, {_STAY(4, "u")}), least({_DEL[3]}, {_STAY(3, "a")})])[1], ['000000', NULL, NULL, NULL]) AS w FROM g),
b AS (SELECT *, least(w[1], w[4], {_INS[2]}) AS best FROM w),
e AS (SELECT conv_id, substr(best, 7) AS audit, unnest(range(1, length(best) - 5)) AS pos FROM b),
f AS (SELECT conv_id, pos, audit[pos] AS edit, count(*) FILTER (audit[pos] <> 'I') OVER v AS i, count(*) FILTER (audit[pos] <> 'D') OVER v AS item FROM e WINDOW v AS (PARTITION BY conv_id ORDER BY pos)),
o AS (SELECT f.*, s.role, s.text, max(CASE WHEN item = 1 AND edit = 'K' AND class = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY f.conv_id) AS system
    FROM f JOIN s ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = greatest(f.i, 1)),
a AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (item - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS repaired
    FROM o WHERE edit <> 'D' GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 6)::BIGINT, 0) AS cost, coalesce(substr(best, 7), '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import spliced, trie

    found = trie(spliced(table(spark, sf_dir, "conversations"), family=5, most=8))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE["op12_prefix_trie"] = rf"""
WITH n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id IS NULL THEN 0 ELSE {_crc32("conv_id::VARCHAR")} % 9 END AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
t AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN n ON n.conv_id = base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND pos > h
      UNION ALL SELECT conv_id, -1, 0, '', '' FROM c),
l AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos)[2:] AS turns FROM t GROUP BY conv_id),
m AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM l),
k AS (SELECT turns[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
s AS (SELECT k.*, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(key[depth].t) END AS saved, coalesce(ch.n, 0) AS n_children
      FROM k LEFT JOIN (SELECT key[1:depth - 1] AS up, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1) ch ON ch.up = k.key),
a AS (SELECT key[1:e] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM s) GROUP BY 1)
SELECT s.conv_id, s.depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.n_leaves, a.saved_tokens, s.ends_sha256
FROM s JOIN a ON a.key = s.key LEFT JOIN k q ON s.depth > 0 AND q.key = s.key[1:s.depth - 1]
"""


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, Policy, apply, ledger, policy

    found = apply(ledger(table(spark, sf_dir, "documents")), policy("prose"))
    base = ~Policy("base", 1, BASE).keeps(F.col("failed"))
    return found.select("doc_id", *(f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), F.col("failed").alias("rule_bits"))


_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS ellipses
    FROM d LEFT JOIN p USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * letters < 80 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * upper > 30 * word_chars THEN 128 ELSE 0 END + CASE WHEN 100 * digits > 20 * word_chars THEN 256 ELSE 0 END
    + CASE WHEN 100 * bullets > 90 * n_lines THEN 512 ELSE 0 END + CASE WHEN 100 * ellipses > 30 * n_lines THEN 1024 ELSE 0 END)::BIGINT AS bits FROM m)
"""
ORACLE["op13_quality_rules"] = _RULES_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 207 = 0 AND bit_count(bits & 1840) <= 1 AS kept, bits AS rule_bits FROM b
"""


@query
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op13's policy removes."""
    from .quality import ablations, ledger, policy

    return ablations(ledger(table(spark, sf_dir, "documents")), policy("prose"))


ORACLE["quality_ablations"] = _RULES_SQL + """
, r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'short_words', 'long_words', 'no_letters', 'capitals', 'digits', 'bullets', 'ellipses']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS bit),
k AS (SELECT rule, bits & bit <> 0 AS failed, bits & 207 = 0 AND bit_count(bits & 1840) <= 1 AS kept, bits & ~bit & 207 = 0 AND bit_count(bits & ~bit & 1840) <= 1 AS without FROM b, r)
SELECT rule, count(*) FILTER (failed) AS n_failed, count(*) FILTER (without AND NOT kept) AS n_only, count(*) FILTER (without) AS n_kept_without FROM k GROUP BY rule
"""


# ---- what SQL can express of operators whose whole result it can't: the same results, fewer columns


@query
def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op5."""
    found = op5_mix_sources(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


ORACLE["mixture_targets"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM d GROUP BY source),
-- sources reach three times their size in the order of size / weight: after k of them the others share what is left
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM s),
lead AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
cut AS (SELECT min(k) AS k FROM lead WHERE rest / weights <= 3 * source_size / weight),
level AS (SELECT rest / weights AS each FROM lead JOIN cut USING (k))
SELECT doc_id, size, source_size, round(CASE WHEN o.k < (SELECT k FROM cut) THEN 3.0 * source_size ELSE weight * (SELECT each FROM level) END::DOUBLE, 3) AS target, true AS within
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
"""


@query
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of op6."""
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", F.col("near_edited").between(0, 1).alias("within"))


ORACLE["edited_texts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(following, length(t) // 2)) AS edited_sha256, true AS within FROM n
"""


@query
def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fixed patterns of op7."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE["secret_patterns"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, regexp_extract_all(text, '(?i){_ASSIGN}') AS found, regexp_split_to_array(text, '(?i){_ASSIGN}') AS gaps FROM t
  UNION ALL SELECT doc_id, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT doc_id, 'hex', regexp_extract_all(text, '[0-9a-f]{{24,}}'), regexp_split_to_array(text, '[0-9a-f]{{24,}}') FROM t),
u AS (SELECT doc_id, kind, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m WHERE len(found) > 0),
x AS (SELECT doc_id, kind, i, found[i] AS word, sum(length(gaps[i])) OVER w + sum(length(found[i])) OVER w AS stop FROM u WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
y AS (SELECT doc_id, kind, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS rank, stop - length(word) AS start, stop FROM x
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(word, '(?i){_ASSIGN}', 2)) >= 6 WHEN 'access' THEN length(word) >= 20 ELSE length(word) >= 24 END)
SELECT t.doc_id, count(*) FILTER (rank = 0)::BIGINT AS n_assign, count(*) FILTER (rank = 1)::BIGINT AS n_access, count(*) FILTER (rank = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank), '')) AS base_sha256
FROM t LEFT JOIN y USING (doc_id) GROUP BY t.doc_id
"""


@query
def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word counts and base scores of op9, which need no context trees."""
    from .common import bucket_of, forget
    from .context_trees import base_scores

    docs = table(spark, sf_dir, "documents")
    found, texts = base_scores(docs, bucket_of(docs["doc_id"], 5) == 1)
    forget(texts)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


_CRC32 = _crc32("doc_id::VARCHAR")
ORACLE["unigram_scores"] = rf"""
WITH d AS (SELECT doc_id, {_CRC32} % 5 = 1 AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (word), s GROUP BY doc_id, held_out
"""
