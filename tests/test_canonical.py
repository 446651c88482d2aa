"""Canonical JSON against Python's encoder, on odd rows."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from trailspark.functions import canonical

STRINGS = ["", "plain", 'quo"te', "back\\slash", "\\u00e9 literal", "\\\\u00E9", "é", "ßĀ￿", "😀 a\U0010ffff", "\x00\x01\x1f\x7f\x80", "\b\t\n\f\r\x0b", "</script>", "  ", "a" * 50_000 + "é", "\\" * 999, None]
FLOATS = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 2e23, 1e-4, 1e-5, 0.00012345, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**-44, 2.0**63, 100.0, 123.456, float("nan"), float("inf"), -float("inf"), None]


def encoded(df, column="v"):
    return [r[0] for r in df.select(canonical.dumps(F.col(column), df.schema[column].dataType)).collect()]


def test_strings(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "v string").coalesce(1)
    assert encoded(df) == [json.dumps(s) for s in STRINGS]


def test_every_code_point_of_the_first_blocks(spark):
    text = [chr(i) for i in (*range(0x3000), *range(0xD700, 0xD800), *range(0xE000, 0xE100), *range(0x1F300, 0x1F400))]
    df = spark.createDataFrame([("".join(text[i : i + 97]),) for i in range(0, len(text), 97)], "v string").coalesce(1)
    assert encoded(df) == [json.dumps("".join(text[i : i + 97])) for i in range(0, len(text), 97)]


def test_floats(spark):
    rng = random.Random(8)
    some = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(20_000)] + [rng.uniform(-1e3, 1e3) for _ in range(20_000)] + [round(rng.uniform(0, 1e6), 2) for _ in range(5000)] + [2.0**i for i in range(-1074, 1024)]
    some = FLOATS + some
    df = spark.createDataFrame([(x,) for x in some], "v double").coalesce(1)
    assert [(a, b) for a, b in zip(encoded(df), map(json.dumps, some), strict=True) if a != b] == []


def test_nested_values_and_sorted_keys(spark):
    schema = "v struct<z: long, `é`: string, B: array<struct<y: boolean, x: double>>, a: map<string, array<int>>, n: map<int, string>, `q\"k`: string>"
    values = [
        {"z": -(2**63), "é": "é", "B": [{"y": True, "x": 1e-7}, None, {"y": None, "x": None}], "a": {"b": [1, None], "Z": [], "é": None}, "n": {10: "x", 9: "y", -1: None}, 'q"k': None},
        {"z": None, "é": None, "B": [], "a": {}, "n": None, 'q"k': "😀"},
        None,
    ]
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    assert encoded(df) == [json.dumps(v, sort_keys=True) for v in values]


def test_key_of_an_object(spark):
    df = spark.createDataFrame([(7, "x = 'é'\n")], "id long, code string")
    got = df.select(F.sha2(canonical.object_of({"task": (F.col("id"), df.schema["id"].dataType), "code": (F.col("code"), df.schema["code"].dataType)}), 256)).first()[0]
    assert got == hashlib.sha256(json.dumps({"task": 7, "code": "x = 'é'\n"}, sort_keys=True).encode()).hexdigest()


def test_types_without_json_are_errors(spark):
    for name in ("date", "decimal(5,2)", "binary", "timestamp", "map<double,int>"):
        with pytest.raises(TypeError, match="no JSON"):
            encoded(spark.createDataFrame([], f"v {name}"))
