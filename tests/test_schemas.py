"""The compiled schema against a plain walk of the documents."""

import json
import random

import pytest

from plumbline.operators import schemas


def plain_errors(value: object, schema: dict, root: dict, path: str = "") -> list[tuple[str, str]]:
    """(path, message) of each place where a JSON value departs from a schema (draft 2020-12, the keywords of result documents)."""
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return plain_errors(value, target, root, path)
    out: list[tuple[str, str]] = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, int | float) and not isinstance(value, bool)
    own = {"null": value is None, "boolean": isinstance(value, bool), "string": isinstance(value, str), "object": isinstance(value, dict), "array": isinstance(value, list), "number": number, "integer": number and float(value).is_integer()}
    if kinds and not any(own[k] for k in kinds):
        return [(path, "must be " + " or ".join(kinds))]
    if "const" in schema and value != schema["const"]:
        out.append((path, f"must be {schema['const']}"))
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        out.append((path, "must be one of " + ", ".join(map(str, schema["enum"]))))
    if number:
        out += [(path, f"must be at least {schema['minimum']}")] if value < schema.get("minimum", value) else []
        out += [(path, f"must be at most {schema['maximum']}")] if value > schema.get("maximum", value) else []
        out += [(path, f"must be above {schema['exclusiveMinimum']}")] if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] else []
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append((path, f"must have {schema['minLength']} characters or more"))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [(f"{path}/{k}", "is missing") for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += plain_errors(v, known[k], root, f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{path}/{k}", "is not allowed"))
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append((path, "must have another number of entries"))
        first = schema.get("prefixItems", [])
        for k, v in enumerate(value):
            rule = first[k] if k < len(first) else schema.get("items", {})
            out += [(f"{path}/{k}", "is not allowed")] if rule is False else plain_errors(v, rule if isinstance(rule, dict) else {}, root, f"{path}/{k}")
    return out


SCHEMA = {
    "type": "object",
    "required": ["id", "size"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2},
        "size": {"$ref": "#/$defs/size"},
        "kind": {"enum": ["a", "b", 3, None, True]},
        "version": {"const": 2},
        "count": {"type": ["integer", "null"], "minimum": 0, "maximum": 10},
        "points": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "array", "prefixItems": [{"type": "number"}, {"type": "integer"}], "items": False, "minItems": 2}},
        "parts": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "size": {"$ref": "#/$defs/size"}}}},
        "any": {},
    },
    "$defs": {"size": {"type": "number", "exclusiveMinimum": 0}},
}


def value(r, depth=0):
    simple = [None, True, False, 0, 1, -3, 2.0, 2.5, 11, "", "a", "ab", "é", 3]
    if depth > 2 or r.random() < 0.6:
        return r.choice(simple)
    if r.random() < 0.5:
        return [value(r, depth + 1) for _ in range(r.randrange(5))]
    return {r.choice(["name", "size", "x"]): value(r, depth + 1) for _ in range(r.randrange(4))}


def document(r):
    good = {"id": "ab", "size": 1.5, "kind": "a", "version": 2, "count": 4, "points": [[1.5, 2], [0, 0]], "parts": [{"name": "n", "size": 2}], "any": {"z": [1]}}
    for _ in range(r.randrange(4)):
        key = r.choice([*good, "extra", "more/x"])
        if r.random() < 0.2:
            good.pop(key, None)
        else:
            good[key] = value(r)
    return good if r.random() < 0.95 else value(r)


def test_compiled_schema_equals_plain_walk(spark):
    r = random.Random(9)
    docs = [document(r) for _ in range(600)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, doc string").repartition(3)
    got = sorted(tuple(x) for x in schemas.conforms(df, "k", "doc", SCHEMA).collect())
    assert got == sorted((str(k), p, m) for k, d in enumerate(docs) for p, m in plain_errors(d, SCHEMA, SCHEMA)) and len(got) > 300


def test_what_is_no_json(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, '{"id":"ab","size":1}')], "k int, doc string")
    assert [tuple(x) for x in schemas.conforms(df, "k", "doc", SCHEMA).collect()] == [(k, "", "must be JSON") for k in "123"]
    assert schemas.conforms(df.where("false"), "k", "doc", SCHEMA).count() == 0
    with pytest.raises(ValueError, match="refers to itself"):
        schemas.conforms(df, "k", "doc", {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}})


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "{}")], "k int, doc string")
    plan = schemas.conforms(df, "k", "doc", SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_documents_are_dealt_over_tasks_and_judged_once(spark):
    """A sort reads its input twice, and one split of a file would be one task."""
    df = spark.range(40).selectExpr("id AS k", """'{"id":"a"}' AS doc""").coalesce(1)
    got = schemas.conforms(df, "k", "doc", SCHEMA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert "hashpartitioning(key" in above and "hashpartitioning(key" in below
    assert [tuple(r) for r in got.collect()] == sorted((str(k), *e) for k in range(40) for e in plain_errors({"id": "a"}, SCHEMA, SCHEMA))
