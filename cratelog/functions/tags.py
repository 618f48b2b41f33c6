"""Free JSON tags: tolerant parsing, merging, and a key under which equal values compare equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "{}"


def parse(json: Column) -> Column:
    """VARIANT; null, empty and invalid JSON, and JSON that is no object, are an empty object."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit(EMPTY)))


def parse_strict(json: Column) -> Column:
    """VARIANT; invalid JSON fails."""
    return F.parse_json(json)


def canonical(value: Column) -> Column:
    """A string that is the same for values that compare equal.

    Numbers and booleans compare by value, strings without regard to case, all else by its JSON.
    """

    def told(kind: Column) -> Column:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        as_double = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
        text = F.lower(F.try_variant_get(value, "$", "string"))
        return F.when(kind == "STRING", F.concat(F.lit("s:"), text)).when(number, F.concat(F.lit("n:"), as_double.cast("string"))).otherwise(F.concat(F.lit("j:"), F.to_json(value)))

    return _let(F.schema_of_variant(value), told)


def listed(json: Column) -> Column:
    """The top-level tags as an array of (tag, value), the value canonical; null for what ``parse`` makes empty because it is no object. The text is parsed once."""
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("tag"), canonical(e["value"]).alias("value")))


def explode(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """(keep, tag, value): a row for each top-level tag, the value canonical."""
    each = rows.select(*keep, F.explode(listed(F.col(json))).alias("__t"))
    return each.select(*keep, F.col("__t.tag").alias("tag"), F.col("__t.value").alias("value"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON texts, the right one winning: JSON text with its keys in order. Each text is parsed once."""
    kind = "map<string,variant>"

    def merged(s: Column) -> Column:
        both = F.concat(F.map_entries(F.map_filter(s["a"], lambda k, _: ~F.map_contains_key(s["b"], k))), F.map_entries(s["b"]))
        return F.to_json(F.map_from_entries(F.array_sort(both, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))

    return _let(F.struct(*(parse(c).cast(kind).alias(n) for c, n in ((left, "a"), (right, "b")))), merged)


def has_key(json: Column, key: str) -> Column:
    """Whether the key is there, even with a null value."""
    return F.try_variant_get(parse(json), f"$['{key}']", "variant").isNotNull()


def get(json: Column, key: str, default: str | None = None) -> Column:
    """The value as text; the default only if the key is absent, not if it is null."""
    there = lambda v: F.when(v.isNotNull(), F.try_variant_get(v, "$", "string")).otherwise(F.lit(default))
    return _let(F.try_variant_get(parse(json), f"$['{key}']", "variant"), there)
