"""JSON schemas compiled to columns."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import schema

NESTED = {
    "$defs": {"name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}},
    "type": "object",
    "required": ["a", "b"],
    "properties": {
        "a": {"$ref": "#/$defs/name"},
        "b": {"type": ["integer", "null"], "minimum": 1, "maximum": 5},
        "c": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["x"], "properties": {"x": {"enum": ["p", "q", None]}}, "additionalProperties": False}},
        "d": {"anyOf": [{"type": "string", "format": "date-time"}, {"type": "number"}]},
    },
    "allOf": [{"if": {"properties": {"a": {"const": "if"}}}, "then": {"required": ["c"]}, "else": {"not": {"required": ["z"]}}}],
}
CASES = [
    ({"a": "ok", "b": 1}, []),
    ({"a": "ok", "b": None, "d": 1.5, "c": [{"x": "p"}, {"x": None}]}, []),
    ({"a": "O", "b": 1.0}, ["$.a: pattern", "$.a: minLength"]),
    ({"b": 1.5}, ["$.a: required", "$.b: type", "$.c: required"]),
    ({"a": 3, "b": 9}, ["$.a: type", "$.b: maximum"]),
    ({"a": "ok", "b": 0, "c": []}, ["$.b: minimum", "$.c: minItems"]),
    ({"a": "ok", "b": 1, "c": [{"x": "r"}, 1, {"y": 1, "x": "q"}, {}]}, ["$.c[0].x: enum", "$.c[1]: type", "$.c[2].y: additional", "$.c[3].x: required"]),
    ({"a": "if", "b": 1}, ["$.c: required"]),
    ({"a": "ok", "b": 1, "z": 1}, ["$: not"]),
    ({"a": "ok", "b": 1, "d": "yesterday"}, ["$.d: anyOf"]),
    ({"a": "ok", "b": 1, "d": "2024-01-01T00:00:00Z"}, []),
    ([1], ["$: type"]),
]


def test_violations(spark):
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(CASES)] + [(98, None), (99, "{broken")]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("f", schema.violations(F.try_parse_json("j"), NESTED))
    got = {r.i: r.f for r in df.collect()}
    for i, (value, want) in enumerate(CASES):
        assert got[i] == want, value
    assert got[98] == got[99] == ["$: json"]


def test_foreign_references_are_errors():
    with pytest.raises(ValueError, match="within the schema"):
        schema.Compiler({})._resolve({"$ref": "other.json#/a"})


def test_a_value_is_computed_once_where_rules_nest(spark):
    found = schema.violations(F.try_parse_json(F.col("j")), NESTED)  # spark: a column needs a session
    assert str(found).count("try_parse_json") == 1  # once for each use by the rules of the first level before
