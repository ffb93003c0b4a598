"""Validation of JSON rows against a schema, every fault of a row at once.

A schema is compiled to one expression over the row's text, parsed once as a variant: for each field whether it is there, of
a type it may have, one of its values, of its pattern, length and range, and for the items of lists their type. Fields the
schema doesn't know are faults too. No row is looked at twice and none moves.

A schema is {"required": [...], "properties": {name: {"type": one or several, "enum", "pattern", "minLength", "minimum", "maximum",
"items": {"type": ...}}}}, the part of JSON Schema that records use.

Defined cases: text that is no JSON object has the one fault ("", "not_an_object"), null text too; of a field of the wrong type
nothing else is judged; a null where null is allowed is judged no further; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.logic import let

FAULT = "struct<path:string,code:string>"
#: What a variant's type is called, for each type of a schema.
TYPES = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "null": ("VOID",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _named(kind: Column, types: str | list[str]) -> Column:
    """Whether a variant's type name is one of the types."""
    wanted = [types] if isinstance(types, str) else types
    return F.exists(F.array(*[F.lit(p) for t in wanted for p in TYPES[t]]), lambda p: F.startswith(kind, p))


def _fault(path: str, code: str, wrong: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")).cast(FAULT))


def field_faults(v: Column, name: str, spec: dict, required: bool) -> Column:
    """The faults a field may have, each null where it has it not; the field is taken out of its row once."""
    path = f"$.{name}"

    def judged(field: Column) -> Column:
        value, kind = field["value"], field["kind"]
        there = value.isNotNull()
        found = [_fault(name, "required", ~there)] if required else []
        right = _named(kind, spec["type"]) if "type" in spec else F.lit(True)
        if "type" in spec:
            found.append(_fault(name, "type", there & ~right))
        text, number = F.try_variant_get(v, path, "string"), F.try_variant_get(v, path, "double")
        said, counted = there & right & _named(kind, "string"), there & right & _named(kind, "number")
        if "enum" in spec:
            null = F.lit(None in spec["enum"]) & _named(kind, "null")
            known = [e for e in spec["enum"] if e is not None]
            found.append(_fault(name, "enum", there & right & ~null & ~F.coalesce(text.isin(known), F.lit(False))))
        if "pattern" in spec:
            found.append(_fault(name, "pattern", said & ~text.rlike(spec["pattern"])))
        if "minLength" in spec:
            found.append(_fault(name, "minLength", said & (F.length(text) < spec["minLength"])))
        if "minimum" in spec:
            found.append(_fault(name, "minimum", counted & (number < spec["minimum"])))
        if "maximum" in spec:
            found.append(_fault(name, "maximum", counted & (number > spec["maximum"])))
        if "items" in spec:
            items = F.try_variant_get(v, path, "array<variant>")
            found.append(_fault(name, "items", there & right & F.exists(items, lambda x: ~_named(F.schema_of_variant(x), spec["items"]["type"]))))
        return F.array(*found).cast(f"array<{FAULT}>")

    value = F.try_variant_get(v, path, "variant")
    return let(value, lambda x: let(F.struct(x.alias("value"), F.schema_of_variant(x).alias("kind")), judged))


def faults(line: Column, schema: dict) -> Column:
    """Every (path, code) of a JSON text, in order of the schema's fields and then of unknown ones."""
    known = F.array(*[F.lit(n) for n in schema["properties"]])
    strange = F.transform(F.array_sort(F.filter(F.json_object_keys(line), lambda k: ~F.array_contains(known, k))), lambda k: F.struct(k.alias("path"), F.lit("unknown").alias("code")).cast(FAULT))

    def judged(v: Column) -> Column:
        of_fields = [field_faults(v, name, spec, name in schema.get("required", ())) for name, spec in schema["properties"].items()]
        whole = F.concat(F.array_compact(F.concat(F.array().cast(f"array<{FAULT}>"), *of_fields)), F.coalesce(strange, F.array().cast(f"array<{FAULT}>")))
        is_object = v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        return F.when(F.coalesce(is_object, F.lit(False)), whole).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("not_an_object").alias("code")).cast(FAULT)))

    return let(F.try_parse_json(line), judged)


def problems(rows: DataFrame, line: str, schema: dict) -> DataFrame:
    """rows with each of their faults, a row a fault, as path and code; rows without one are gone."""
    return rows.withColumn("_f", F.explode(faults(F.col(line), schema))).select(*rows.columns, "_f.path", "_f.code")


def unknown_references(rows: DataFrame, key: str, references: str) -> DataFrame:
    """(key, reference): entries of a list of keys that no row has."""
    each = rows.select(key, F.explode(references).alias("reference"))
    return each.join(rows.select(F.col(key).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that several rows have; counted after sums in each task."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
