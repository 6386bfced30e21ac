"""Named queries over the test tables and the SQL each is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .functions.times import TimeInterpreter, ulid, uuid_v7, within
from .operators import stats
from .operators.moments import by_form, evidence, moment_table
from .operators.moments import quantiles as moment_quantiles
from .operators.signatures import element_signature
from .operators.walk import levels, values_of, walk
from .plans import itemsets
from .plans.analyze import analyze, shape_of
from .plans.assertions import Assertion, exceptions, violations
from .plans.predicates import Compare, Exists, IsKind, skipping
from .plans.relation import leaf_counts, relation, sketched
from .plans.report import epoch_guess
from .plans.shape import is_map, to_spark, tuple_length
from .plans.stored import from_nodes, nodes
from .plans.tiling import blooms, documents_of, headers, may_hold, promotion
from .sources.decoders import JsonLines as Decoder
from .sources.decoders import records
from .sources.documents import at, from_columns, from_json, levels_of
from .sources.shredded import layout_of, read, whole, write
from .sources.storage import materialize, shared_dir
from .streaming.sessions import close_open, session_events, session_stream, state_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items as documents, numbered by key."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("l_quantity")))).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(items, "o_orderkey", "left")
    return from_columns(orders.withColumn("ord", F.col("o_orderkey")), "ord")


@query("""
SELECT '.' || ltrim(substr(fullkey, 2), '.') AS path,
       CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'f64'
                 WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'i64' END AS kind,
       count(*) AS n, min(event_id) AS first, max(event_id) AS last,
       min(CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(t.value AS DOUBLE) END) AS lo,
       max(CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(t.value AS DOUBLE) END) AS hi
FROM events, json_tree(CAST(props AS JSON)) AS t GROUP BY 1, 2
""")
def path_kinds_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_json(table(spark, sf_dir, "events"), "props", "event_id")
    return walk(docs).groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("num").alias("lo"), F.max("num").alias("hi"))


_ITEMS = """
WITH items AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS INT) AS l_quantity,
                      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, CAST(l_quantity AS INT)) - 1 AS i
               FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
"""


@query(_ITEMS + """
SELECT '.' AS path, 'object' AS kind, count(*) AS n FROM orders
UNION ALL SELECT '.o_orderkey', 'i64', count(*) FROM orders
UNION ALL SELECT '.o_orderstatus', 'string', count(*) FROM orders
UNION ALL SELECT '.o_totalprice', 'f64', count(*) FROM orders
UNION ALL SELECT '.items', 'array', count(DISTINCT l_orderkey) FROM items
UNION ALL SELECT '.items[' || i || ']', 'object', count(*) FROM items GROUP BY i
UNION ALL SELECT '.items[' || i || '].l_linenumber', 'i64', count(*) FROM items GROUP BY i
UNION ALL SELECT '.items[' || i || '].l_returnflag', 'string', count(*) FROM items GROUP BY i
UNION ALL SELECT '.items[' || i || '].l_quantity', 'i64', count(*) FROM items GROUP BY i
""")
def path_kinds_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(order_docs(spark, sf_dir)).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT '.value' AS path, count(*) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 3) AS total,
       count(*) FILTER (value < 0) AS n_neg, count(*) FILTER (value = 0) AS n_zero, count(*) FILTER (value > 0) AS n_pos,
       count(*) FILTER (value = floor(value)) AS n_whole
FROM events WHERE value IS NOT NULL
""")
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_columns(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    found = stats.value_table(walk(docs)).where("n_num > 0")
    return found.groupBy("path").agg(F.sum("n").alias("n"), F.min("min").alias("lo"), F.max("max").alias("hi"), F.round(F.sum("sum"), 3).alias("total"), F.sum("n_neg").alias("n_neg"), F.sum("n_zero").alias("n_zero"), F.sum("n_pos").alias("n_pos"), F.sum("n_whole").alias("n_whole"))


@query("""
SELECT 'ms' AS field, CASE WHEN min(epoch_ms(ts)) >= 9e11 AND max(epoch_ms(ts)) <= 3e12 THEN 'epoch millis' END AS guess FROM events
UNION ALL SELECT 's', CASE WHEN min(epoch_ms(ts)) >= 9e11 AND max(epoch_ms(ts)) <= 3e12 THEN 'epoch seconds' END FROM events
UNION ALL SELECT 'user', NULL
""")
def epoch_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    docs = from_columns(table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), F.floor(ms / 1000).alias("s"), F.col("user_id").alias("user")), "event_id")
    found = analyze(docs).root.fields()
    return spark.createDataFrame([(c.step, epoch_guess(c.number())) for c in found], "field string, guess string")


_TEXTS = """
WITH texts AS (SELECT c_name AS s FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT o_orderstatus FROM orders
               UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM events UNION ALL SELECT strftime(ts, '%Y-%m-%d') FROM events
               UNION ALL SELECT '10.0.' || (user_id % 256) || '.' || (event_id % 256) FROM events UNION ALL SELECT strftime(ts, '%H:%M:%S') FROM events
               UNION ALL SELECT event_type || '@' || event_type || '.org' FROM events UNION ALL SELECT md5(event_type) FROM events)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    e = t("events")
    parts = [
        t("customer").select("c_name"), t("part").select("p_brand"), t("pages").select("url"), t("orders").select("o_orderstatus"), t("orders").select(F.col("o_orderkey").cast("string")),
        e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), e.select(F.date_format("ts", "yyyy-MM-dd")), e.select(F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))),
        e.select(F.date_format("ts", "HH:mm:ss")), e.select(F.concat("event_type", F.lit("@"), "event_type", F.lit(".org"))), e.select(F.md5(F.col("event_type").cast("binary"))),
    ]
    out = parts[0].toDF("s")
    for p in parts[1:]:
        out = out.union(p.toDF("s"))
    return out


@query(_TEXTS + r"""
SELECT CASE
  WHEN regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'uuid'
  WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'iso-timestamp'
  WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'iso-date'
  WHEN regexp_matches(s, '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$') THEN 'ipv4'
  WHEN regexp_matches(s, '^[0-9a-fA-F:]{2,39}$') AND length(s) - length(replace(s, ':', '')) >= 2 THEN 'ipv6'
  WHEN strpos(s, '@') > 1 AND strpos(s, '@') < length(s) AND strpos(s, ' ') = 0 THEN 'email'
  WHEN starts_with(s, 'http://') OR starts_with(s, 'https://') THEN 'url'
  WHEN regexp_matches(s, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(s, '^[A-Za-z]+$') THEN 'alpha'
  WHEN regexp_matches(s, '^[A-Za-z0-9]+$') THEN 'alnum' ELSE 'other' END AS format, count(*) AS n
FROM texts WHERE s IS NOT NULL GROUP BY 1
""")
def string_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("s is not null").groupBy(formats.detect_format(F.col("s")).alias("format")).agg(F.count("*").alias("n"))


@query(_TEXTS + r"""
, k AS (SELECT regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+', '9', 'g'), '\p{L}+', 'A', 'g'), '\s+', ' ', 'g') AS k FROM texts WHERE s IS NOT NULL)
SELECT CASE WHEN length(k) > 16 THEN substr(k, 1, 16) || '…' ELSE k END AS skeleton, count(*) AS n FROM k GROUP BY 1
""")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("s is not null").groupBy(formats.skeleton(F.col("s")).alias("skeleton")).agg(F.count("*").alias("n"))


@query(_TEXTS + "SELECT CASE WHEN strlen(s) < 2 THEN 0 ELSE least(31, floor(log2(strlen(s)))) END::INT AS bucket, count(*) AS n FROM texts WHERE s IS NOT NULL GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("s is not null").groupBy(formats.length_bucket(F.octet_length("s")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT ceil(ln(o_totalprice) / ln(1.02 / 0.98)) AS i, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1),
r AS (SELECT i, sum(n) OVER (ORDER BY i) AS upto, sum(n) OVER () AS total FROM b)
SELECT q, round(min(exp((i - 0.5) * ln(1.02 / 0.98))), 6) AS value FROM r, (VALUES (0.5::DOUBLE), (0.9), (0.99)) AS v(q) WHERE upto >= greatest(1, ceil(q * total)) GROUP BY q
""")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.quantiles(table(spark, sf_dir, "orders").where("o_totalprice > 0"), "o_totalprice", [0.5, 0.9, 0.99])
    return found.select("q", F.round("value", 6).alias("value"))


def _day_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    docs = users.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), F.struct("n")))).alias("m"))
    found = from_json(docs.select(F.datediff("day", F.lit("1970-01-01")).alias("ord"), F.to_json("m").alias("doc")), "doc", "ord")
    found.strataform_levels = levels_of(docs.schema["m"].dataType)
    return found


@query("""
WITH u AS (SELECT CAST(ts AS DATE) AS d, user_id FROM events GROUP BY 1, 2), k AS (SELECT count(DISTINCT user_id) AS keys, count(*) AS pairs, count(DISTINCT d) AS docs FROM u)
SELECT 'users by day' AS docs, keys > 64 OR (keys >= 16 AND keys > 4 * greatest(pairs / docs, 1)) AS is_map FROM k
UNION ALL SELECT 'events', false
""")
def object_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = from_columns(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id")
    return spark.createDataFrame([(name, is_map(analyze(d).root)[0]) for name, d in (("users by day", _day_maps(spark, sf_dir)), ("events", events))], "docs string, is_map boolean")


@query("""
SELECT field, n, n < (SELECT count(*) FROM customer) AS nullable FROM (
  SELECT 'c_custkey' AS field, count(*) AS n FROM customer UNION ALL SELECT 'owed', count(*) FROM customer WHERE c_acctbal < 0)
""")
def field_nullability(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_columns(table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("owed"), F.col("c_custkey").alias("ord")), "ord")
    values = walk(docs)
    total = values.where("parent is null").agg(F.count("*").alias("total"))
    found = values.where("parent = '.'").groupBy(F.col("step").alias("field")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(total), F.lit(True)).select("field", "n", (F.col("n") < F.col("total")).alias("nullable"))  # total: one row


@query("""
WITH l AS (SELECT len(embedding) AS k, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT k, n, sum(n) OVER () AS total FROM l ORDER BY n DESC, k DESC LIMIT 1),
i AS (SELECT c AS k, count(*) AS n FROM (SELECT count(*) AS c FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey) GROUP BY 1), mi AS (SELECT k, n, sum(n) OVER () AS total FROM i ORDER BY n DESC, k DESC LIMIT 1)
SELECT 'embedding' AS field, CASE WHEN (SELECT max(k) FROM l) <= 32 AND k BETWEEN 1 AND 16 AND n >= 0.9 * total THEN k ELSE 0 END AS tuple_length FROM m
UNION ALL SELECT 'items', CASE WHEN (SELECT max(k) FROM i) <= 32 AND k BETWEEN 1 AND 16 AND n >= 0.9 * total THEN k ELSE 0 END FROM mi
UNION ALL SELECT 'pair', 2
""")
def array_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = from_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(F.col("vec_id"), F.col("label").cast("long")).alias("pair")), "vec_id")
    found = [*analyze(vectors).root.fields(), *analyze(order_docs(spark, sf_dir)).root.fields()]
    return spark.createDataFrame([(c.step, tuple_length(c)[0] or 0) for c in found if "array" in c.kinds], "field string, tuple_length int")


@query("""
SELECT CASE event_type WHEN 'purchase' THEN '{"id":i64,"price":f64}' WHEN 'error' THEN '{"code":string}' WHEN 'view' THEN 'i64' ELSE '[i64|string]' END AS signature, count(*) AS n
FROM events GROUP BY 1
""")
def element_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "purchase", F.format_string('{"price": %s, "id": %d}', F.col("value").cast("decimal(20,4)").cast("string"), "event_id")).when(F.col("event_type") == "error", F.lit('{"code": "E"}')).when(F.col("event_type") == "view", F.col("event_id").cast("string")).otherwise(F.lit('["x", 1, "y"]'))
    docs = from_json(e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("doc")), "doc", "user_id")
    first = levels(docs)[0]
    return first.where("pos is not null").groupBy(element_signature(F.col("member")).alias("signature")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.withColumn("at", TimeInterpreter("ms")(F.unix_millis(F.col("ts").cast("timestamp"))))
    return rows.where(within(F.col("at"), datetime(2024, 1, 10), datetime(2024, 2, 1))).select("event_id", "ts")


@query("""
SELECT count(*) AS n, count(ts) AS n_read, sum(floor(epoch(ts)))::BIGINT AS total FROM events
""")
def text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    read = TimeInterpreter("text")(text)
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count(read).alias("n_read"), F.sum(F.unix_seconds(read)).alias("total"))


@query(_ITEMS + "SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM items WHERE i = 0")
def at_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = walk(at(order_docs(spark, sf_dir), ".items[0]"))
    return values.agg(F.count_if(F.col("path") == ".").alias("n"), F.sum(F.when(F.col("path") == ".l_quantity", F.col("num"))).cast("long").alias("quantity"))


@query("SELECT event_id, 1700000000000 + event_id AS ms FROM events")
def uuidv7_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.lower(F.lpad(F.hex(F.col("event_id") + 1700000000000), 12, "0"))
    text = F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.lit("7abc"), F.lit("8123"), F.lit("0123456789ab"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(uuid_v7(text)).alias("ms"))


@query("SELECT event_id, 1700000000000 + event_id AS ms FROM events")
def ulid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") + 1700000000000
    digit = lambda i: F.substring(F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), (F.shiftright(n, 5 * (9 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    text = F.concat(*map(digit, range(10)), F.lit("0123456789ABCDEF"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(ulid(text)).alias("ms"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN embedding IS NULL THEN 'null' ELSE 'array' END AS kind FROM embeddings UNION ALL SELECT 'object' FROM embeddings UNION ALL SELECT 'f64' FROM (SELECT unnest(embedding) FROM embeddings)) GROUP BY 1")
def leaf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_columns(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1e-9).alias("e")), "vec_id")
    found = levels(docs)
    out = values_of(found[0])
    for x in found[1:]:
        out = out.union(values_of(x))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query()
def shape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on orders with their items, a row for each line."""
    lines = analyze(order_docs(spark, sf_dir)).report().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query()
def shape_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark types found for events and orders."""
    events = table(spark, sf_dir, "events").withColumn("props", F.parse_json("props")).select("event_id", "user_id", "event_type", "value", F.to_json("props").alias("props"))
    found = {"events": from_columns(events, "event_id"), "orders": order_docs(spark, sf_dir), "users by day": _day_maps(spark, sf_dir)}
    return spark.createDataFrame([(name, to_spark(shape_of(d)).simpleString()) for name, d in found.items()], "docs string, type string")


def _event_json() -> Column:
    """An event as a document of many structures."""
    k = F.get_json_object("props", "$.k")
    is_ = lambda name: F.col("event_type") == name
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.coalesce(F.format_string("%.4f", "value"), F.lit("null"))
    parts = {
        "type": text(F.col("event_type")),
        "value": F.when(is_("error"), text(value)).otherwise(value),
        "props": F.when(is_("purchase"), F.concat(F.lit('{"k":'), k, F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}"))),
        "seen": F.concat(F.lit('{"'), F.col("user_id").cast("string"), F.lit('":1}')),
        "by": F.concat(F.lit("{"), text(F.col("event_type")), F.lit(":"), F.when(is_("signup"), text(k)).otherwise(k), F.lit("}")),
        "pair": F.when(is_("view"), F.concat(F.lit("["), text(F.col("event_type")), F.lit(","), k, F.lit("]"))).otherwise(F.concat(F.lit("["), k, F.lit(","), text(F.col("event_type")), F.lit("]"))),
        "nums": F.concat(F.lit("["), F.array_join(F.array_repeat(k, (k.cast("int") % 3).cast("int")), ","), F.lit("]")),
        "tags": F.when(k.cast("int") % 7 == 0, F.concat(F.lit('["t",'), k, F.lit("]"))).otherwise(F.concat(F.lit("[null,"), k, F.lit("]"))),
        "list": F.when(is_("click"), F.lit("{}")).otherwise(F.lit("[]")),
    }
    return F.concat(F.lit("{"), *(x for i, (name, c) in enumerate(parts.items()) for x in (F.lit("," * (i > 0) + f'"{name}":'), c)), F.lit("}"))


def _event_docs(events: DataFrame) -> DataFrame:
    """Events as documents (ord, at, config, v), numbered by their ids; the set of assertions changes on the way."""
    config = F.concat(F.lit("v"), F.floor(F.col("event_id") / 3000).cast("string"))
    return events.select(F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("at"), config.alias("config"), F.parse_json(_event_json()).alias("v"))


ASSERTIONS = (
    Assertion("values are numbers", ".value", "type", ("f64", "null"), tolerance=3),
    Assertion("props have a key", ".props", "arm", ('{"k":i64}',)),
    Assertion("lists", ".list", "list"),
    Assertion("tags alike", ".tags", "bag", tolerance=10),
    Assertion("few users", ".seen", "record", cap=20, tolerance=2),
    Assertion("counts", ".by", "map"),
    Assertion("triples", ".nums", "tuple", tolerance=1),
    Assertion("key, type", ".pair", "order", tolerance=1),
    Assertion("no paths below", ".*[*]", "type", ("i64", "string", "null")),
)


@query(r"""
WITH e AS (SELECT event_id, event_type AS t, user_id, value, CAST(props->>'$.k' AS INT) AS k FROM events),
single AS (
  SELECT 'values are numbers' AS assertion, event_id AS ord, '.value' AS path, 3 AS tolerance FROM e WHERE t = 'error'
  UNION ALL SELECT 'props have a key', event_id, '.props', 0 FROM e WHERE t = 'purchase'
  UNION ALL SELECT 'lists', event_id, '.list', 0 FROM e WHERE t = 'click'
  UNION ALL SELECT 'tags alike', event_id, '.tags', 10 FROM e WHERE k % 7 = 0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY assertion ORDER BY ord) AS r FROM single),
items AS (  -- what lines count, with the first document of each
  SELECT 'few users' AS assertion, '.seen' AS path, 20 AS allowed, 2 AS tolerance, min(event_id) AS ord FROM e GROUP BY user_id
  UNION ALL SELECT 'counts', '.by', 1, 0, min(event_id) FROM e GROUP BY t = 'signup'
  UNION ALL SELECT 'triples', '.nums', 1, 1, min(event_id) FROM e GROUP BY k % 3
  UNION ALL SELECT 'key, type', '.pair', 0, 1, max(ord) FROM (SELECT t = 'view' AS kind, min(event_id) AS ord FROM e GROUP BY 1) HAVING count(*) > 1
  UNION ALL SELECT 'key, type', '.pair', 0, 1, max(ord) FROM (SELECT t = 'view' AS kind, min(event_id) AS ord FROM e GROUP BY 1) HAVING count(*) > 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY assertion ORDER BY ord) AS n FROM items),
beyond AS (SELECT assertion, path, tolerance, ord, dense_rank() OVER (PARTITION BY assertion ORDER BY ord) AS d FROM placed p WHERE ord >= (SELECT min(ord) FROM placed q WHERE q.assertion = p.assertion AND q.n > q.allowed))
SELECT assertion, 'document' AS mode, ord, path, NULL::BIGINT AS tipped_at FROM ranked WHERE r > tolerance
UNION ALL SELECT DISTINCT assertion, 'aggregate', ord, path, (SELECT count(*) FROM items i WHERE i.assertion = b.assertion AND i.ord <= b.ord) FROM beyond b WHERE d = tolerance + 1
""")
def assertion_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_event_docs(table(spark, sf_dir, "events")), ASSERTIONS).select("assertion", "mode", "ord", "path", "tipped_at")


#: Broken often, by values of several shapes, and some by the same value.
_STORMS = tuple(a for a in ASSERTIONS if a.target in ("type", "arm", "list")) + (Assertion("no props", ".props", "type", ("null",)),)
_IDLE = 600

_SESSIONS = r"""
WITH e AS (SELECT event_id AS ord, epoch_ms(ts) AS ms, 'v' || (event_id // 3000) AS config, event_type AS t, user_id AS u, value, CAST(props->>'$.k' AS INT) AS k FROM events),
x AS (
  SELECT ord, ms, config, ['values are numbers'] AS refs, '.value' AS pattern, '"' || coalesce(printf('%.4f', value), 'null') || '"' AS observed, 'string' AS shape FROM e WHERE t = 'error'
  UNION ALL SELECT ord, ms, config, ['lists'], '.list', '{}', '{}' FROM e WHERE t = 'click'
  UNION ALL SELECT ord, ms, config, ['no props'], '.props', '{"k":' || k || '}', '{"k":i64}' FROM e WHERE t <> 'purchase'
  UNION ALL SELECT ord, ms, config, ['no props', 'props have a key'], '.props', '{"k":' || k || ',"user":' || u || '}', '{"k":i64,"user":i64}' FROM e WHERE t = 'purchase'),
b AS (SELECT *, coalesce(ms - lag(ms) OVER w > 600000 OR config <> lag(config) OVER w, true) AS starts FROM x WINDOW w AS (PARTITION BY refs, pattern ORDER BY ord)),
n AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY refs, pattern ORDER BY ord) AS nth FROM b),
s AS (SELECT refs, pattern, nth, min(ord) AS first, max(ord) AS last, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS occurrences, min_by(observed, ord) AS opened FROM n GROUP BY refs, pattern, nth),
f AS (SELECT *, lead(start_ms) OVER (PARTITION BY refs, pattern ORDER BY nth) AS following FROM s),
o AS (SELECT n.*, f.first, f.opened, row_number() OVER (PARTITION BY n.refs, n.pattern, n.nth, n.shape ORDER BY ord) = 1 AS new FROM n JOIN f USING (refs, pattern, nth))
SELECT concat_ws('|', array_to_string(refs, '|'), pattern, first) AS session, CASE WHEN ord = first THEN 'open' WHEN new THEN 'grow' ELSE 'fit' END AS event, ord,
  CASE WHEN ord = first OR observed <> opened THEN observed END AS observed, CASE WHEN new THEN shape END AS shape, NULL AS reason, NULL::BIGINT AS occurrences, NULL::BIGINT AS last FROM o
UNION ALL SELECT concat_ws('|', array_to_string(refs, '|'), pattern, first), 'close', NULL, NULL, NULL,
  CASE WHEN following - end_ms <= 600000 THEN 'config_changed' WHEN following IS NOT NULL OR end_ms + 600000 < (SELECT max(ms) FROM x) THEN 'evicted' ELSE 'stream_end' END, occurrences, last FROM f
"""
_SESSION_COLUMNS = ("session", "event", "ord", "observed", "shape", "reason", "occurrences", "last")


@query(_SESSIONS)
def exception_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a whole table."""
    found = exceptions(_event_docs(table(spark, sf_dir, "events")), _STORMS, ("ord", "at", "config"))
    until = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("at")).first()["at"]
    return session_events(found, _IDLE, F.lit(until)).select(*_SESSION_COLUMNS)


@query(_SESSIONS)
def exception_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from the table read as a stream."""
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    found = session_stream(exceptions(_event_docs(events), _STORMS, ("ord", "at", "config")), _IDLE)
    with state_store(spark):
        found.writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/events").unionByName(close_open(spark, f"{path}/checkpoint")).select(*_SESSION_COLUMNS)


_EVENT_PATHS = r"""
WITH e AS (SELECT event_id AS ord, event_id // 2048 AS tile, event_type AS t, user_id AS u, value, CAST(props->>'$.k' AS INT) AS k FROM events),
p AS (  -- each document's paths with their kinds
  SELECT ord, tile, '.' AS path, 'object' AS kind FROM e
  UNION ALL SELECT ord, tile, '.type', 'string' FROM e
  UNION ALL SELECT ord, tile, '.value', CASE WHEN t = 'error' THEN 'string' WHEN value IS NULL THEN 'null' ELSE 'f64' END FROM e
  UNION ALL SELECT ord, tile, unnest(['.props', '.seen', '.by']), 'object' FROM e
  UNION ALL SELECT ord, tile, '.props.k', 'i64' FROM e
  UNION ALL SELECT ord, tile, '.props.user', 'i64' FROM e WHERE t = 'purchase'
  UNION ALL SELECT ord, tile, '.seen."' || u || '"', 'i64' FROM e
  UNION ALL SELECT ord, tile, '.by.' || t, CASE WHEN t = 'signup' THEN 'string' ELSE 'i64' END FROM e
  UNION ALL SELECT ord, tile, unnest(['.pair', '.nums', '.tags']), 'array' FROM e
  UNION ALL SELECT ord, tile, '.pair[*]', unnest(['i64', 'string']) FROM e
  UNION ALL SELECT ord, tile, '.nums[*]', 'i64' FROM e, range(2) r(i) WHERE i < k % 3
  UNION ALL SELECT ord, tile, '.tags[*]', unnest(['i64', CASE WHEN k % 7 = 0 THEN 'string' ELSE 'null' END]) FROM e
  UNION ALL SELECT ord, tile, '.list', CASE WHEN t = 'click' THEN 'object' ELSE 'array' END FROM e),
h AS (SELECT tile, path, count(DISTINCT ord) AS n, count(DISTINCT ord) FILTER (kind = 'null') AS n_null FROM p GROUP BY tile, path),
k AS (SELECT tile, path, kind, count(*) AS n FROM p GROUP BY tile, path, kind),
d AS (SELECT tile, count(*) AS docs FROM e GROUP BY tile)
"""


def _event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(_event_docs(table(spark, sf_dir, "events")).select("ord", "v"))


@query(_EVENT_PATHS + "SELECT tile, path, docs, n, n_null, (SELECT string_agg(kind || ':' || k.n, ',' ORDER BY kind) FROM k WHERE k.tile = h.tile AND k.path = h.path) AS kinds FROM h JOIN d USING (tile)")
def tile_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return _event_headers(spark, sf_dir).select("tile", "path", "docs", "n", "n_null", kinds.alias("kinds"))


@query(_EVENT_PATHS + "SELECT tile, path, ord FROM p WHERE path LIKE '%user%' OR path LIKE '.by%' OR path = '.nums[*]' GROUP BY ALL")
def tile_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that some paths are in, out of the presence bitmaps."""
    some = F.col("path").contains("user") | F.col("path").startswith(".by") | (F.col("path") == ".nums[*]")
    return documents_of(_event_headers(spark, sf_dir).where(some))


@query(_EVENT_PATHS + "SELECT tile, count(*) AS n_paths, 0 AS missed, true AS few_false FROM h GROUP BY tile")
def tile_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bloom filters of tiles asked for all their paths and as many that they don't have: none is missed, few are let through."""
    held = materialize(_event_headers(spark, sf_dir).select("tile", "path"))
    asked = held.select("tile", F.explode(F.array(F.struct("path", F.lit(True).alias("has")), F.struct(F.concat("path", F.lit(".no")).alias("path"), F.lit(False).alias("has")))).alias("x")).select("tile", "x.*")
    answers = asked.join(blooms(held), "tile").withColumn("may", may_hold(F.col("path")))
    found = answers.groupBy("tile", "n_paths").agg(F.count_if(F.col("has") & ~F.col("may")).alias("missed"), F.count_if(~F.col("has") & F.col("may")).alias("false"))
    return found.select("tile", "n_paths", "missed", (F.col("false") <= 0.05 * F.col("n_paths")).alias("few_false"))


#: Sets of frequent paths by document; the sets that intersections of them make, of which the frequent and largest are kept.
_PATH_SETS = """
, fp AS (SELECT path, count(DISTINCT ord) AS n FROM p WHERE path <> '.' GROUP BY path HAVING count(DISTINCT ord) >= (SELECT ceil(count(*) * 0.1) FROM e)),
ds AS (SELECT ord, list_sort(list(DISTINCT path)) AS own FROM p WHERE path IN (SELECT path FROM fp) GROUP BY ord),
w AS (SELECT own, count(*) AS n FROM ds GROUP BY own),
closed AS (SELECT own FROM w UNION SELECT list_sort(list_intersect(c.own, w.own)) FROM closed c, w),
counted AS (SELECT c.own AS paths, sum(w.n)::BIGINT AS n FROM closed c, w WHERE list_has_all(w.own, c.own) GROUP BY c.own HAVING sum(w.n) >= (SELECT ceil(count(*) * 0.1) FROM e)),
largest AS (SELECT row_number() OVER (ORDER BY n DESC, paths) - 1 AS set_id, n, paths FROM counted a WHERE NOT EXISTS (FROM counted b WHERE b.paths <> a.paths AND list_has_all(b.paths, a.paths))),
part AS (SELECT own, coalesce(list_sort(list(x) FILTER (x NOT IN (SELECT path FROM fp WHERE n = (SELECT count(*) FROM e)))), []) AS rare FROM (SELECT own, unnest(own) AS x FROM w) GROUP BY own),
fits AS (SELECT own, arg_min(set_id, (-len(list_intersect(rare, paths)), len(paths), set_id)) AS set_id FROM part, largest WHERE list_has_any(rare, paths) GROUP BY own),
placed AS (SELECT ord, ds.own, ord // 16384 * 16384 + row_number() OVER (PARTITION BY ord // 16384 ORDER BY set_id NULLS LAST, CASE WHEN len(rare) > 0 THEN md5(array_to_string(rare, chr(10))) END NULLS LAST, ord) - 1 AS place FROM ds JOIN part USING (own) LEFT JOIN fits USING (own))
"""


def _event_path_sets(spark: SparkSession, sf_dir: str) -> itemsets.PathSets:
    return itemsets.mine(_event_docs(table(spark, sf_dir, "events")).select("ord", "v"), 0.1)


@query(_EVENT_PATHS.replace("WITH", "WITH RECURSIVE", 1) + _PATH_SETS + "SELECT set_id::INTEGER AS set_id, n, array_to_string(paths, ',') AS paths FROM largest")
def frequent_path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal sets of paths that a tenth of the events hold together."""
    return _event_path_sets(spark, sf_dir).sets.select("set_id", "n", F.array_join("paths", ",").alias("paths"))


@query(
    _EVENT_PATHS.replace("WITH", "WITH RECURSIVE", 1) + _PATH_SETS
    + """, old AS (SELECT ord // 2048 AS tile, count(DISTINCT own) AS before FROM placed GROUP BY 1), new AS (SELECT place // 2048 AS tile, count(*) AS docs, count(DISTINCT own) AS after FROM placed GROUP BY 1)
SELECT tile, coalesce(docs, 0) AS docs, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM old FULL JOIN new USING (tile)"""
)
def tile_reordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different path sets in each tile before and after events move to others of their kind among eight tiles."""
    mined = _event_path_sets(spark, sf_dir)
    return itemsets.kinds_of_tiles(mined, itemsets.reordered(mined))


_PROMOTED = """
, s AS (SELECT path, kind, sum(n)::BIGINT AS n, (SELECT count(*) FROM e) AS docs FROM k WHERE kind IN ('bool', 'i64', 'u64', 'f64', 'string') AND path NOT LIKE '%[%' GROUP BY path, kind),
c AS (SELECT path, kind, count(*) AS tiles FROM k JOIN d USING (tile) WHERE k.n > 0.6 * docs GROUP BY path, kind),
plan AS (SELECT path, kind, n, docs, coalesce(tiles, 0) AS tiles FROM s LEFT JOIN c USING (path, kind) WHERE n > 0.6 * docs)
"""


@query(_EVENT_PATHS + _PROMOTED + "SELECT * FROM plan")
def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion(_event_headers(spark, sf_dir))


@query(_EVENT_PATHS + _PROMOTED + """
SELECT path, kind, CASE WHEN path = '.value' THEN (SELECT count(*) FROM e WHERE t <> 'error' AND value_text NOT LIKE '%.0000') ELSE n END AS in_column, docs, 0 AS differing FROM plan
""".replace("value_text", "printf('%.4f', value)"))
def shredded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in columns and residuals by their promotion plan, read back and compared as JSON. Whole numbers
    among decimals stay in the residual, as a double would be written as another text."""
    docs = _event_docs(table(spark, sf_dir, "events")).select("ord", "v")
    path = f"{shared_dir(spark)}/shredded-{uuid.uuid4().hex}"
    write(docs, layout_of(promotion(headers(docs))), path)
    rows, layout = read(spark, path)
    back = whole(rows, layout).select("ord", F.to_json("v").alias("back"))
    pairs = docs.select("ord", F.to_json("v").alias("own")).join(back, "ord", "full")
    differing = pairs.agg(F.count_if(~F.col("own").eqNullSafe(F.col("back"))).alias("differing"))
    counts = rows.agg(F.count("*").alias("docs"), *(F.count(f"c{i}").alias(f"c{i}") for i in range(len(layout.columns))))
    each = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("in_column")) for i, (p, k) in enumerate(layout.columns)))
    return counts.select("docs", F.explode(each).alias("x")).join(F.broadcast(differing), F.lit(True)).select("x.*", "docs", "differing")  # one row each


_FACTS = ((".", "object"), (".value", ""), (".value", "f64"), (".value", "string"), (".props", "object"), (".props.user", ""), (".by.click", ""), (".by.signup", ""), (".list", "object"), (".nums[0]", ""))
PREDICATES = {
    "purchases of user 7": Compare(".props.user", "=", 7),
    "text values": IsKind(".value", "string"),
    "no text values": ~IsKind(".value", "string"),
    "click or signup": Exists(".by.click") | Exists(".by.signup"),
    "neither": ~(Exists(".by.click") | Exists(".by.signup")),
    "click below 10": Exists(".by.click") & Compare(".by.click", "<", 10),
    "not below 10": ~Compare(".by.click", "<", 10),
    "k or type": Compare(".props.k", ">=", 90) | Compare(".type", "=", "view"),
    "some number": Exists(".nums[0]") & ~Exists(".props.user"),
    "dear": Compare(".value", ">", 40.5) & ~IsKind(".list", "object"),
}


@query("""
WITH e AS (SELECT event_type AS t, user_id AS u, CAST(printf('%.4f', value) AS DOUBLE) AS value, CAST(props->>'$.k' AS INT) AS k FROM events),
m AS (
  SELECT 'purchases of user 7' AS predicate, t = 'purchase' AND u = 7 AS hit FROM e UNION ALL SELECT 'text values', t = 'error' FROM e UNION ALL SELECT 'no text values', t <> 'error' FROM e
  UNION ALL SELECT 'click or signup', t IN ('click', 'signup') FROM e UNION ALL SELECT 'neither', t NOT IN ('click', 'signup') FROM e
  UNION ALL SELECT 'click below 10', t = 'click' AND k < 10 FROM e UNION ALL SELECT 'not below 10', NOT (t = 'click' AND k < 10) FROM e
  UNION ALL SELECT 'k or type', k >= 90 OR t = 'view' FROM e UNION ALL SELECT 'some number', k % 3 > 0 AND t <> 'purchase' FROM e
  UNION ALL SELECT 'dear', t NOT IN ('error', 'click') AND value > 40.5 FROM e)
SELECT predicate, count(*) AS rows, count(*) FILTER (hit) AS hits, 0 AS missed FROM m GROUP BY predicate
""")
def predicate_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tests on sidecars let through of a stored table: every match."""
    docs = _event_docs(table(spark, sf_dir, "events")).select("ord", "v")
    path = f"{shared_dir(spark)}/shredded-{uuid.uuid4().hex}"
    write(docs, layout_of(promotion(headers(docs)), _FACTS), path)
    rows, layout = read(spark, path)
    return skipping(rows, PREDICATES, layout).select("predicate", "rows", "hits", "missed")


@query(r"""
WITH e AS (SELECT event_id AS ord, event_type AS t, user_id AS u, value, CAST(props->>'$.k' AS INT) AS k FROM events),
n AS (SELECT count(*) AS n, count(*) FILTER (t = 'purchase') AS purchases, count(*) FILTER (t <> 'error' AND value IS NULL) AS nulls,
        count(*) FILTER (t <> 'error' AND value IS NOT NULL) AS numbers, count(*) FILTER (t = 'error') AS texts, count(*) FILTER (t = 'view') AS views, count(*) FILTER (k % 7 = 0) AS tagged FROM e),
-- users that came after the first 64 are counted together
late AS (SELECT u FROM (SELECT u, row_number() OVER (ORDER BY min(ord), u::VARCHAR) AS r FROM e GROUP BY u) WHERE r > 64),
rows AS (
  SELECT '.' AS path, 'record' AS kind, NULL AS of, NULL::BOOLEAN AS nullable, n AS count FROM n
  UNION ALL SELECT '.type', 'type', 'string', false, n FROM n
  UNION ALL SELECT '.value', 'variant', NULL, nulls > 0, n FROM n
  UNION ALL SELECT '.value|null', 'type', 'null', NULL, nulls FROM n WHERE nulls > 0
  UNION ALL SELECT '.value|f64', 'type', 'f64', NULL, numbers FROM n
  UNION ALL SELECT '.value|string', 'type', 'string', NULL, texts FROM n
  UNION ALL SELECT '.props', 'record', NULL, false, n FROM n
  UNION ALL SELECT '.props.k', 'type', 'i64', false, n FROM n
  UNION ALL SELECT '.props.user', 'type', 'i64', true, purchases FROM n
  UNION ALL SELECT '.seen', 'map', NULL, false, n FROM n
  UNION ALL SELECT '.seen.*', 'type', 'i64', NULL, count(*) FROM e WHERE u IN (SELECT u FROM late)
  UNION ALL SELECT '.by', 'record', NULL, false, n FROM n
  UNION ALL SELECT '.by.' || t, 'type', CASE WHEN t = 'signup' THEN 'string' ELSE 'i64' END, true, count(*) FROM e GROUP BY t
  UNION ALL SELECT '.pair', 'tuple', NULL, false, n FROM n
  UNION ALL SELECT unnest(['.pair[0]', '.pair[1]']), 'variant', NULL, NULL, n FROM n
  UNION ALL SELECT '.pair[0]|i64', 'type', 'i64', NULL, n - views FROM n
  UNION ALL SELECT '.pair[0]|string', 'type', 'string', NULL, views FROM n
  UNION ALL SELECT '.pair[1]|i64', 'type', 'i64', NULL, views FROM n
  UNION ALL SELECT '.pair[1]|string', 'type', 'string', NULL, n - views FROM n
  UNION ALL SELECT '.nums', 'array', NULL, false, n FROM n
  UNION ALL SELECT '.nums[*]', 'type', 'i64', NULL, 0
  UNION ALL SELECT '.tags', 'tuple', NULL, false, n FROM n
  UNION ALL SELECT '.tags[0]', 'variant', NULL, NULL, n FROM n
  UNION ALL SELECT '.tags[0]|null', 'type', 'null', NULL, n - tagged FROM n
  UNION ALL SELECT '.tags[0]|string', 'type', 'string', NULL, tagged FROM n
  UNION ALL SELECT '.tags[1]', 'type', 'i64', NULL, n FROM n
  UNION ALL SELECT '.list', 'variant', NULL, false, n FROM n
  UNION ALL SELECT unnest(['.list|record', '.list|array']), unnest(['record', 'array']), NULL, NULL, n FROM n
  UNION ALL SELECT '.list|array[*]', 'absent', NULL, NULL, 0)
SELECT * FROM rows
""")
def shape_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of events, a row for each node, written as a table and read back."""
    found = analyze(_event_docs(table(spark, sf_dir, "events")).select("ord", "v"))
    kept = materialize(nodes(spark, found.shape))
    return nodes(spark, from_nodes(kept)).select("path", "kind", "of", "nullable", "count")


@query("""
SELECT event_type AS type, count(*) AS n, sum(user_id)::BIGINT AS users, sum(CAST(props->>'$.k' AS INT))::BIGINT AS k FROM events GROUP BY 1
""")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of JSON and read by a decoder in splits of 256 KiB."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", "user_id", "props"))).write.text(path)
    v = records(spark, path, Decoder(), split=1 << 18).select(F.parse_json("record").alias("v"))
    found = v.select(*(F.try_variant_get("v", f"$.{c}", t).alias(c) for c, t in (("event_type", "string"), ("user_id", "long"), ("props", "string"))))
    return found.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query(_EVENT_PATHS + r"""
, v AS (
  SELECT ord, '.type' AS path, t AS text FROM e
  UNION ALL SELECT ord, '.value', CASE WHEN t = 'error' THEN 'text' ELSE '' END || coalesce(printf('%.4f', value), 'null') FROM e
  UNION ALL SELECT ord, '.props.k', k::VARCHAR FROM e
  UNION ALL SELECT ord, '.props.user', u::VARCHAR FROM e WHERE t = 'purchase'
  UNION ALL SELECT ord, '.by.' || t, k::VARCHAR FROM e
  UNION ALL SELECT ord, '.pair[*]', unnest([k::VARCHAR, t]) FROM e
  UNION ALL SELECT ord, '.nums', '[]' FROM e WHERE k % 3 = 0
  UNION ALL SELECT ord, '.nums[*]', k::VARCHAR FROM e, range(2) r(i) WHERE i < k % 3
  UNION ALL SELECT ord, '.tags[*]', unnest([k::VARCHAR, CASE WHEN k % 7 = 0 THEN 't' ELSE 'null' END]) FROM e
  UNION ALL SELECT ord, '.list', CASE WHEN t = 'click' THEN '{}' ELSE '[]' END FROM e)
SELECT path, count(*) AS n, max(ord) AS last, count(DISTINCT text) AS distinct_values, true AS near FROM v GROUP BY path
""")
def relation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and sketches of events' most frequent paths, and how near the sketches are to exact counts."""
    counts = materialize(leaf_counts(_event_docs(table(spark, sf_dir, "events")).select("ord", "v")))
    shown = relation(sketched(counts)).where(~F.col("path").startswith(".seen."))
    exact = counts.groupBy("path").agg(F.count_distinct("text").alias("distinct_values"))
    near = F.abs(F.col("distinct") - F.col("distinct_values")) <= F.greatest(F.lit(1.0), 0.06 * F.col("distinct_values"))
    return shown.join(exact, "path").select("path", "n", "last", "distinct_values", near.alias("near"))


def _moment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times, in the form that their type uses."""
    us, text = F.unix_micros(F.col("ts").cast("timestamp")), lambda f: F.concat(F.lit('"'), F.date_format("ts", f), F.lit('"'))
    at_ = F.when(F.col("event_type") == "view", text("yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")).when(F.col("event_type") == "click", text("yyyy-MM-dd HH:mm:ss")).when(F.col("event_type") == "error", F.floor(us / 1000).cast("string"))
    at_ = at_.when(F.col("event_type") == "signup", F.concat(F.lit('"'), F.floor(us / 1000000).cast("string"), F.lit('"'))).otherwise(us.cast("string"))
    doc = F.concat(F.lit('{"at":'), at_, F.lit(',"type":"'), F.col("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit("}"))
    return walk(from_json(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "doc", "event_id"))


@query("""
WITH e AS (SELECT event_type AS t, epoch_us(ts) AS us FROM events),
m AS (SELECT CASE WHEN t IN ('view', 'click') THEN 'text' WHEN t = 'signup' THEN 'digits' ELSE 'number' END AS source, CASE WHEN t IN ('view', 'error') THEN 'ms' WHEN t IN ('click', 'signup') THEN 's' ELSE 'us' END AS resolution,
  CASE t WHEN 'view' THEN 'zoned' WHEN 'click' THEN 'naive' END AS zone,
  CASE t WHEN 'view' THEN us // 1000 * 1000 - 7200000000 WHEN 'error' THEN us // 1000 * 1000 WHEN 'purchase' THEN us ELSE us // 1000000 * 1000000 END AS us FROM e),
h AS (SELECT us // 3600000000 AS hour, count(*) AS n FROM m GROUP BY 1), r AS (SELECT hour, sum(n) OVER (ORDER BY hour) AS upto, sum(n) OVER () AS total FROM h)
SELECT '.at' AS path, source, resolution, zone, count(*) AS n, min(us) AS first, max(us) AS last, (SELECT min(hour) * 3600000000 + 1800000000 FROM r WHERE upto >= ceil(0.5 * total)) AS median FROM m GROUP BY source, resolution, zone
""")
def timestamp_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(moment_table(evidence(_moment_values(spark, sf_dir))))
    median = moment_quantiles(found, [0.5]).select("path", F.unix_micros("at").alias("median"))
    return by_form(found).join(median, "path")
