"""Nested values: redaction at any depth, objects out of free text, delimited evidence. All of it is compiled to expressions.

A schema is walked once, on the driver, into one expression: structs by field, arrays and maps by their elements. A VARIANT column takes the schema
that all its rows share (one aggregate, one text of schema on the driver) and is then walked like any other; where rows disagree on a type, the value is
redacted as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType, VariantType

from emberline.functions import text


def _as_text(value: Column, kind: DataType) -> Column:
    return value.cast("string") if not isinstance(kind, StructType | ArrayType | MapType | VariantType) else F.to_json(value)


def _covered(value: Column, kind: DataType, salt: str) -> Column:
    """A value under a sensitive key of a map, whose type stays: texts by pseudonyms, numbers by null."""
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), text.pseudonym(value, salt))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_covered(value.getField(f.name), f.dataType, salt).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _covered(v, kind.elementType, salt))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: _covered(v, kind.valueType, salt))
    return F.lit(None).cast(kind)


def redacted(value: Column, kind: DataType, salt: str = "") -> Column:
    """`value` without secrets: what a sensitive field or key holds becomes its pseudonym (a text, whatever it was), texts elsewhere are
    redacted as messages. Field names and keys are judged in any case. Null stays null; redacting twice changes nothing.

    In a map whose values are no texts, the texts under a sensitive key become pseudonyms and its other values null.
    """
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), text.redact_message(value))
    if isinstance(kind, StructType):
        fields = []
        for f in kind:
            inner = value.getField(f.name)
            sensitive = F.when(inner.isNotNull(), text.pseudonym(_as_text(inner, f.dataType), salt)) if _sensitive(f.name) else redacted(inner, f.dataType, salt)
            fields.append(sensitive.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redacted(v, kind.elementType, salt))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.transform_values(value, lambda k, v: F.when(text.is_sensitive(k), _covered(v, kind.valueType, salt)).otherwise(redacted(v, kind.valueType, salt)))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: redacted(v, kind.valueType, salt))
    if isinstance(kind, VariantType):
        return F.when(value.isNotNull(), text.redact_message(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))))
    return value


def _sensitive(name: str) -> bool:
    lower = name.lower()
    return lower in text.SENSITIVE_LABELS or any(x in lower for x in text.SENSITIVE_FRAGMENTS)


def redact_columns(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """These columns redacted, each by its own type and name; VARIANT columns become the type their rows share."""
    for name in columns:
        kind, value = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, VariantType):
            df, kind = typed_variant(df, name)
        if _sensitive(name):
            df = df.withColumn(name, F.when(value.isNotNull(), text.pseudonym(_as_text(value, kind), salt)))
        else:
            df = df.withColumn(name, redacted(value, kind, salt))
    return df


def typed_variant(df: DataFrame, name: str) -> tuple[DataFrame, DataType]:
    """`df` with a VARIANT column as the type that all rows share, and that type. Rows without a value are null."""
    found = df.agg(F.schema_of_variant_agg(f"`{name}`")).first()[0] or "VOID"
    ddl = found.replace("OBJECT<", "STRUCT<")
    if ddl == "VOID":
        ddl = "STRING"
    typed = df.withColumn(name, F.try_variant_get(F.col(f"`{name}`"), "$", ddl) if ddl != "VARIANT" else F.col(f"`{name}`"))
    return typed, typed.schema[name].dataType


#: How evidence is set off from instructions.
OPENING, CLOSING = "<untrusted-evidence source=", "</untrusted-evidence>"


def sorted_keys(value: Column, kind: DataType) -> Column:
    """Fields of structs and keys of maps in order of their names, at any depth."""
    if isinstance(kind, StructType) and len(kind):
        return F.when(value.isNotNull(), F.struct(*[sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: sorted_keys(v, kind.elementType))
    if isinstance(kind, MapType):
        inner = F.transform_values(value, lambda k, v: sorted_keys(v, kind.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(inner), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def _sorted(kind: DataType) -> DataType:
    """The type that sorted_keys gives."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _sorted(f.dataType)) for f in sorted(kind, key=lambda f: f.name)])
    if isinstance(kind, ArrayType):
        return ArrayType(_sorted(kind.elementType))
    return MapType(kind.keyType, _sorted(kind.valueType)) if isinstance(kind, MapType) else kind


def delimited(value: Column, kind: DataType, source: Column) -> Column:
    """`value` redacted, as JSON with keys in order, between plain-text marks; no angle bracket of it can end the block."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    body = F.to_json(F.struct(redacted(sorted_keys(value, kind), _sorted(kind)).alias("v")), {"ignoreNullFields": "false"})
    body = F.substring(body, F.lit(6), F.length(body) - 6)
    name = F.to_json(F.struct(F.coalesce(source, F.lit("")).alias("v")))
    name = F.substring(name, F.lit(6), F.length(name) - 6)
    return F.concat(F.lit(OPENING), escaped(name), F.lit(">\n"), escaped(body), F.lit("\n" + CLOSING))


def _balanced(value: Column) -> Column:
    """The first `{` and what belongs to it, up to its `}`; signs in quotes don't count. Null without both."""
    tail = F.substring(value, F.instr(value, "{"), F.length(value))
    signs = F.split(tail, "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        inside = s["quoted"]
        quoted = F.when(inside & ~s["escaped"] & (c == '"'), False).when(~inside & (c == '"'), True).otherwise(inside)
        depth = s["depth"] + F.when(inside, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        end = F.when((s["end"] == 0) & ~inside & (c == "}") & (depth == 0), at).otherwise(s["end"])
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), (inside & (c == "\\") & ~s["escaped"]).alias("escaped"), end.alias("end"))

    end = F.aggregate(signs, start, step, lambda s: s["end"])
    return F.when(F.instr(value, "{") > 0, F.when(end > 0, F.substring(tail, F.lit(1), end)))


def found_object(said: Column) -> Column:
    """struct<object VARIANT, method>: the JSON object of an answer in free text, from its first brace to the one that closes it.

    Method says what that is: the `whole` text, all between the first and the last of its `braces`, the first `balanced` object of more text with braces;
    `none` with a null object for null and empty texts, texts without an object, and broken JSON.
    """
    candidate = _balanced(said)
    parsed = F.try_parse_json(candidate)
    method = F.when(parsed.isNull(), "none").when(F.regexp_replace(said, r"^\s+|\s+$", "") == candidate, "whole").when(F.regexp_substr(said, F.lit(r"(?s)\{.*\}")) == candidate, "braces").otherwise("balanced")
    return F.struct(parsed.alias("object"), F.coalesce(method, F.lit("none")).alias("method"))
