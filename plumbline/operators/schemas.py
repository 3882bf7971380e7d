"""JSON Schema as column expressions: conformance of documents without a Python worker.

A schema (draft 2020-12, the keywords of result documents) is compiled once, on the driver, into one
expression over VARIANT that gives a document's departures as an array; Spark evaluates it in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import dealt

ERRORS = "array<struct<path:string,message:string>>"
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_KINDS = {"null": ("VOID",), "boolean": ("BOOLEAN",), "string": ("STRING",), "object": ("OBJECT",), "array": ("ARRAY",), "number": NUMBERS}


def none() -> Column:
    return F.array().cast(ERRORS)


def say(condition: Column, path: Column, message: str) -> Column:
    error = F.array(F.struct(path.alias("path"), F.lit(message).alias("message")))
    return F.when(F.coalesce(condition, F.lit(False)), error).otherwise(none())


def get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def present(v: Column) -> Column:
    """An entry that is there: taking maps and arrays apart makes JSON's null a missing value."""
    return F.coalesce(v, F.parse_json(F.lit("null")))


def equals(v: Column, kind: Column, value: object) -> Column:
    """Is a variant this scalar? Numbers compare by value."""
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (get(v, "boolean") == F.lit(value))
    if isinstance(value, int | float):
        return kind.isin(*NUMBERS) & (get(v, "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "STRING") & (get(v, "string") == F.lit(value))
    raise ValueError("const and enum must be scalars")


def resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    """The schema that a chain of references ends in; one that comes back to itself can't be compiled."""
    while "$ref" in schema:
        name = schema["$ref"]
        if name in seen:
            raise ValueError(f"{name} refers to itself")
        seen, schema_ = (*seen, name), root
        for part in name.removeprefix("#/").split("/"):
            schema_ = schema_[part]
        schema = schema_
    return schema, seen


def compiled(schema: dict, root: dict, value: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
    """The departures of a variant from a schema: array<struct<path, message>>."""
    schema, seen = resolved(schema, root, seen)

    def body(v: Column, kind: Column) -> Column:
        number, parts = kind.isin(*NUMBERS), []
        if "const" in schema:
            parts.append(say(~equals(v, kind, schema["const"]), path, f"must be {schema['const']}"))
        if "enum" in schema:
            any_of = F.lit(False)
            for option in schema["enum"]:
                any_of = any_of | equals(v, kind, option)
            parts.append(say(~any_of, path, "must be one of " + ", ".join(map(str, schema["enum"]))))
        size = get(v, "double")
        bounds = {"minimum": (size.__lt__, "at least"), "maximum": (size.__gt__, "at most"), "exclusiveMinimum": (size.__le__, "above")}
        parts += [say(number & beyond(float(schema[k])), path, f"must be {word} {schema[k]}") for k, (beyond, word) in bounds.items() if k in schema]
        if "minLength" in schema:
            parts.append(say((kind == "STRING") & (F.length(get(v, "string")) < schema["minLength"]), path, f"must have {schema['minLength']} characters or more"))
        parts += members(v, kind) + items(v, kind)
        checks = F.concat(*parts) if parts else none()
        wanted = schema.get("type", [])
        wanted = [wanted] if isinstance(wanted, str) else wanted
        if not wanted:
            return checks
        fits = F.lit(False)
        for name in wanted:
            whole = number & (size == F.floor(size)) if name == "integer" else kind.isin(*_KINDS[name])
            fits = fits | whole
        error = F.array(F.struct(path.alias("path"), F.lit("must be " + " or ".join(wanted)).alias("message")))
        return F.when(F.coalesce(fits, F.lit(False)), checks).otherwise(error)

    def members(v: Column, kind: Column) -> list[Column]:
        known, required = schema.get("properties", {}), schema.get("required", [])
        closed = schema.get("additionalProperties") is False
        if not (known or required or closed):
            return []
        held = get(v, "map<string,variant>")
        below = lambda k: F.concat(path, F.lit(f"/{k}"))
        parts = [say((kind == "OBJECT") & ~F.map_contains_key(held, k), below(k), "is missing") for k in required]
        for k, rule in known.items():
            own = present(F.try_element_at(held, F.lit(k)))
            parts.append(F.when((kind == "OBJECT") & F.map_contains_key(held, k), compiled(rule, root, own, below(k), seen)).otherwise(none()))
        if closed:
            strange = F.filter(F.map_keys(held), lambda k: ~k.isin(*known)) if known else F.map_keys(held)
            errors = F.transform(strange, lambda k: F.struct(F.concat(path, F.lit("/"), k).alias("path"), F.lit("is not allowed").alias("message")))
            parts.append(F.when(kind == "OBJECT", errors).otherwise(none()))
        return parts

    def items(v: Column, kind: Column) -> list[Column]:
        first, rest = schema.get("prefixItems", []), schema.get("items", {})
        entries = get(v, "array<variant>")
        parts = []
        if "minItems" in schema or "maxItems" in schema:
            few, many = F.size(entries) < schema.get("minItems", 0), F.size(entries) > schema.get("maxItems", 2**31 - 1)
            parts.append(say((kind == "ARRAY") & (few | many), path, "must have another number of entries"))
        for n, rule in enumerate(first):
            own = present(F.get(entries, F.lit(n)))
            parts.append(F.when((kind == "ARRAY") & (F.size(entries) > n), compiled(rule, root, own, F.concat(path, F.lit(f"/{n}")), seen)).otherwise(none()))
        if rest is False or (isinstance(rest, dict) and rest):
            at = lambda k: F.concat(path, F.lit("/"), k.cast("string"))
            each = F.transform(entries, lambda x, k: F.when(k < len(first), none()).otherwise(say(F.lit(True), at(k), "is not allowed") if rest is False else compiled(rest, root, present(x), at(k), seen)))
            parts.append(F.when(kind == "ARRAY", F.flatten(each)).otherwise(none()))
        return parts

    # A value and its kind are bound once, by a transform of one element.
    kind = F.split(F.schema_of_variant(value), "[<(]")[0]
    return F.transform(F.array(F.struct(value.alias("v"), kind.alias("k"))), lambda t: body(t["v"], t["k"]))[0]


def conforms(documents: DataFrame, key: str, json: str, schema: dict) -> DataFrame:
    """(key, path, message) of all departures of JSON documents from a schema, by path; what isn't JSON has one at the top.

    Documents are dealt over all tasks, since many of them fit one split of a file. Departures are shuffled before they
    are sorted: a sort reads its input twice, first for the bounds of its ranges, and the schema is evaluated once.
    """
    texts = dealt(documents.select(F.col(key).cast("string").alias("key"), F.col(json).alias("_json")), "key", "_json")
    rows = texts.select("key", F.try_parse_json("_json").alias("_v"))
    broken = say(F.lit(True), F.lit(""), "must be JSON")
    found = F.when(F.col("_v").isNull(), broken).otherwise(compiled(schema, schema, F.col("_v"), F.lit("")))
    errors = rows.select("key", F.explode(found).alias("_e")).select("key", "_e.path", "_e.message")
    return dealt(errors, "key", "path").orderBy("key", "path", "message")
