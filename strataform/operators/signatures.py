"""Signatures of values: texts that are equal for values of one structure.

A leaf is its kind, an array ``[...]`` of its elements' signatures without repeats in order, joined by ``|``, an object
``{key:signature,...}``; ``[]`` and ``{}`` are the empty ones.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of signatures in a union: leaves as listed, then arrays, then objects (fixed values).
_ORDER = ("null", "bool", "i64", "u64", "f64", "string")


def rank(signature: str) -> tuple[int, str]:
    return (_ORDER.index(signature) if signature in _ORDER else len(_ORDER) + (signature[0] == "{"), signature)


def union(signatures) -> str:
    """Several signatures as one, without repeats and in order."""
    return "|".join(sorted(set(signatures), key=rank))


def signature(value) -> str:
    """The signature of a value. Decimals, as of numbers with a fraction, are floats."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "i64" if -(2**63) <= value < 2**63 else "u64" if 0 <= value < 2**64 else "f64"
    if isinstance(value, Decimal):
        return "u64" if value == int(value) and 2**63 <= value < 2**64 else "f64"
    if isinstance(value, float):
        return "f64"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return f"[{union(map(signature, value))}]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{signature(v)}" for k, v in sorted(value.items())) + "}"


def _nested(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else signature(x.toPython()))


#: Variant types whose values all have one signature; an array's type merges what its elements are.
_LEAVES = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "i64", "DOUBLE": "f64", "FLOAT": "f64"}
_PART = re.compile(r"OBJECT<|>|, |`((?:[^`]|``)*)`: |([^:<>,`]+): |([A-Z][A-Z_]*(?:\([0-9,]*\))?)")


def signature_of_type(text: str) -> str:
    """The signature that follows from the type of a value without arrays, as ``schema_of_variant`` writes it."""
    fields: list[list[tuple[str, str]]] = [[]]
    names: list[str] = []
    for m in _PART.finditer(text):
        token = m[0]
        if token == "OBJECT<":
            fields.append([])
        elif token == ">":
            inner = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in sorted(fields.pop())) + "}"
            fields[-1].append((names.pop() if names else "", inner))
        elif m[3]:
            leaf = "f64" if token.startswith("DECIMAL") else _LEAVES.get(token, "string")
            fields[-1].append((names.pop() if names else "", leaf))
        elif token != ", ":
            names.append(m[1].replace("``", "`") if m[1] is not None else m[2])
    return fields[0][0][1]


def _of_type(text: pd.Series) -> pd.Series:
    known = {t: signature_of_type(t) for t in text.dropna().unique()}
    return pd.Series([known.get(t) for t in text], index=text.index, dtype=object)


def type_tells(schema: Column) -> Column:
    """Whether a container's type says all of its signature: it holds no array and no decimal that may be a u64."""
    return ~schema.rlike(r"ARRAY<|DECIMAL\((19|20),0\)")


def element_signature(v: Column) -> Column:
    """The signature of a variant: leaves by their type in the JVM, containers by their type or, with arrays, their JSON."""
    from .walk import kind_of

    schema = F.schema_of_variant(v)
    leaf = kind_of(schema, F.when(schema.startswith("DECIMAL"), F.try_variant_get(v, "$", "decimal(38,0)")))
    container = schema.startswith("OBJECT") | schema.startswith("ARRAY")
    told = container & type_tells(schema)
    of_type, nested = F.pandas_udf(_of_type, "string"), F.pandas_udf(_nested, "string")
    return F.when(told, of_type(F.when(told, schema))).when(container, nested(F.when(container & ~type_tells(schema), v))).otherwise(leaf)


def signature_of_types(counts: DataFrame) -> DataFrame:
    """(path, bucket, n) of counts (path, type, n) of types that tell their signature."""
    return counts.select("path", F.pandas_udf(_of_type, "string")("type").alias("bucket"), "n")


def signature_counts(elements: DataFrame) -> DataFrame:
    """(path, bucket, n) of elements (path, member): values whose type tells their signature are counted by type first."""
    schema = F.schema_of_variant("member")
    rows = elements.select("path", "member", schema.alias("schema"))
    told = F.col("schema").startswith("OBJECT") & type_tells(F.col("schema"))
    by_type = signature_of_types(rows.where(told).groupBy("path", F.col("schema").alias("type")).agg(F.count("*").alias("n")))
    others = rows.where(~told).select("path", element_signature(F.col("member")).alias("bucket")).groupBy("path", "bucket").agg(F.count("*").alias("n"))
    return by_type.union(others).groupBy("path", "bucket").agg(F.sum("n").alias("n"))


def parse(text: str):
    """A signature as nested tuples: ("scalar", kind), ("array", [...]), ("record", [(key, arms)]); arms are lists."""
    out, at = _arms(text, 0)
    if at != len(text):
        raise ValueError(f"not a signature: {text!r}")
    return out


def _arms(text: str, at: int) -> tuple[list, int]:
    arms = []
    while True:
        if text[at] == "[":
            inner, at = ([], at + 1) if text[at + 1] == "]" else _arms(text, at + 1)
            arms.append(("array", inner))
            at += 1
        elif text[at] == "{":
            fields, at = [], at + 1
            while text[at] != "}":
                at += text[at] == ","
                key, end = json.JSONDecoder().raw_decode(text, at)
                inner, at = _arms(text, end + 1)
                fields.append((key, inner))
            arms.append(("record", fields))
            at += 1
        else:
            name = next(k for k in sorted(_ORDER, key=len, reverse=True) if text.startswith(k, at))
            arms.append(("scalar", name))
            at += len(name)
        if at >= len(text) or text[at] != "|":
            return arms, at
        at += 1
