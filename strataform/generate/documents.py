"""Seeded documents: of a subset of JSON Schema, and unruly ones."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import from_json

#: How often an optional property is there, and ranges of generated values (fixed values).
OPTIONAL, INTEGERS, FLOATS, LETTERS, YEARS = 0.7, 10_000, 1_000.0, (3, 12), (2020, 2026)
_SUPPORTED = {"string", "integer", "number", "boolean", "null", "array", "object"}


class SchemaError(ValueError):
    pass


def check(schema: dict, where: str = "#") -> dict:
    """The schema itself if it is within the subset: type, const, enum, oneOf/anyOf, format, items, prefixItems,
    minItems, maxItems, properties, required, additionalProperties, minProperties, maxProperties, propertyNames."""
    if "const" in schema or "enum" in schema:
        return schema
    for key in ("oneOf", "anyOf"):
        if key in schema:
            for i, s in enumerate(schema[key]):
                check(s, f"{where}/{key}/{i}")
            return schema
    if schema.get("type") not in _SUPPORTED:
        raise SchemaError(f"{where}: type {schema.get('type')!r} isn't supported")
    for name, s in schema.get("properties", {}).items():
        check(s, f"{where}/properties/{name}")
    for i, s in enumerate(schema.get("prefixItems", [])):
        check(s, f"{where}/prefixItems/{i}")
    for key in ("items", "additionalProperties"):
        if isinstance(schema.get(key), dict):
            check(schema[key], f"{where}/{key}")
    return schema


def _word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(*LETTERS)))


def _text(r: random.Random, form: str | None) -> str:
    if form == "uuid":
        return str(uuid.UUID(int=r.getrandbits(128), version=4))
    if form == "email":
        return f"{_word(r)}@{_word(r)}.example"
    if form == "uri":
        return f"https://{_word(r)}.example/{_word(r)}"
    if form == "date-time":
        return f"{r.randint(*YEARS)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}Z"
    return _word(r)


def instance(schema: dict, r: random.Random):
    """One value of a schema."""
    if "const" in schema:
        return schema["const"]
    if "enum" in schema:
        return r.choice(schema["enum"])
    for key in ("oneOf", "anyOf"):
        if key in schema:
            return instance(r.choice(schema[key]), r)
    kind = schema["type"]
    if kind == "null":
        return None
    if kind == "boolean":
        return r.random() < 0.5
    if kind == "integer":
        return r.randint(int(schema.get("minimum", -INTEGERS)), int(schema.get("maximum", INTEGERS)))
    if kind == "number":
        return r.uniform(schema.get("minimum", -FLOATS), schema.get("maximum", FLOATS))
    if kind == "string":
        return _text(r, schema.get("format"))
    if kind == "array":
        fixed = [instance(s, r) for s in schema.get("prefixItems", [])]
        more = r.randint(schema.get("minItems", 2), schema.get("maxItems", 6)) if isinstance(schema.get("items"), dict) else 0
        return fixed + [instance(schema["items"], r) for _ in range(more - len(fixed))]
    out = {k: instance(s, r) for k, s in schema.get("properties", {}).items() if k in schema.get("required", ()) or r.random() < OPTIONAL}
    if isinstance(schema.get("additionalProperties"), dict):
        for _ in range(r.randint(schema.get("minProperties", 2), schema.get("maxProperties", 8)) - len(out)):
            out[_text(r, schema.get("propertyNames", {}).get("format"))] = instance(schema["additionalProperties"], r)
    return out


@dataclass(frozen=True)
class Generator:
    """Endless documents of a schema, the same for the same seed."""

    schema: dict
    seed: int = 0

    def __iter__(self) -> Iterator:
        r = random.Random(self.seed)
        while True:
            yield instance(self.schema, r)

    def take(self, n: int) -> list:
        return [x for _, x in zip(range(n), self, strict=False)]

    def documents(self, spark: SparkSession, n: int, partitions: int = 8) -> DataFrame:
        """n documents (ord, v), made where they are used; each depends on the seed and its number only."""
        check(self.schema)

        def make(i: int) -> str:
            return json.dumps(instance(schema, random.Random(seed * 1_000_003 + i)))

        schema, seed = self.schema, self.seed
        rows = spark.range(0, n, 1, partitions).select("id", F.udf(make, "string")("id").alias("t"))
        return from_json(rows, "t", "id")


def chaos(r: random.Random, depth: int = 6, width: int = 8):
    """Any value at all, at most so deep and wide."""
    kind = r.randrange(8 if depth else 6)
    if kind < 6:
        return (None, r.random() < 0.5, r.randint(-(10**6), 10**6), r.randint(2**63, 2**64 - 1), r.uniform(-1e9, 1e9), _word(r))[kind]
    members = [chaos(r, depth - 1, width) for _ in range(r.randint(0, width))]
    return members if kind == 6 else {_word(r): m for m in members}


def spine(depth: int, leaf=1):
    """Objects and arrays in turn around a leaf."""
    for i in range(depth):
        leaf = {"next": leaf} if i % 2 else [leaf]
    return leaf
