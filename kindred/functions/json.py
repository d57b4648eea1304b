"""JSON values in string columns. Text that isn't JSON gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member(c: Column, key: str, kind: str = "string") -> Column:
    """The top-level member `key` as `kind`; null where it is missing or of another kind. Of repeated keys the last counts."""
    plain = F.try_variant_get(F.try_parse_json(c), f"$['{key}']", kind)
    same = F.filter(F.map_entries(F.from_json(c, "map<string,variant>")), lambda e: e["key"] == key)
    last = F.try_variant_get(F.try_element_at(same, F.lit(-1))["value"], "$", kind)
    return F.coalesce(plain, last)


def element(c: Column, place: int, kind: str = "string") -> Column:
    """The array's element at a place from 0, as `kind`; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(c), f"$[{place}]", kind)


def strict(c: Column, key: str, kind: str) -> Column:
    """The member `key` if it is of the kind: "string", "boolean" or "double" (any number); null otherwise, without a cast."""
    found = F.try_variant_get(F.try_parse_json(c), f"$['{key}']", "variant")
    named = F.schema_of_variant(found)
    fits = {"string": named == "STRING", "boolean": named == "BOOLEAN", "double": named.rlike("^(BIGINT|DOUBLE|DECIMAL)")}[kind]
    return F.when(fits, F.try_variant_get(found, "$", kind))


def keys(c: Column) -> Column:
    return F.json_object_keys(c)


def length(c: Column) -> Column:
    return F.json_array_length(c)


def kind(c: Column) -> Column:
    """The value's type: OBJECT<...>, ARRAY<...>, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.schema_of_variant(F.try_parse_json(c))


def printed(c: Column) -> Column:
    """The value in its shortest form."""
    return F.to_json(F.try_parse_json(c))


def string_attributes(specs: DataFrame, json_col: str = "json") -> DataFrame:
    """(…, key, value): a row for each top-level member that is a string; numbers, arrays and nested objects are no text. Of repeated keys the last counts."""
    every = F.map_entries(F.from_json(json_col, "map<string,variant>"))
    last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda x: x["key"] == e["key"]))
    found = specs.withColumn("__e", F.explode(last)).select(*[F.col(f"`{c}`") for c in specs.columns], F.col("__e.key").alias("key"), F.col("__e.value").alias("__m"))
    return found.where(F.schema_of_variant("__m") == "STRING").withColumn("value", F.expr("try_variant_get(__m, '$', 'string')")).drop("__m")
