"""Metadata of JSON documents without Python: texts become VARIANT values, whose leaves are found by functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, is_iso_date, is_structured

#: Objects within objects that are followed; the expression grows with it.
DEPTH = 6
ENTRY = "array<struct<key:string,value:string>>"


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value) == "OBJECT", F.lit(False))


def _text(value: Column, of: Column) -> Column:
    """Numbers and flags as the flattener writes them; a number with a point keeps one."""
    as_text = F.variant_get(value, "$", "string")
    point = F.when(F.contains(as_text, F.lit(".")) | F.contains(as_text, F.lit("E")), as_text).otherwise(F.concat(as_text, F.lit(".0")))
    return F.when(of == "BOOLEAN", F.initcap(as_text)).when(of.isin("DECIMAL", "DOUBLE"), point).otherwise(as_text)


def _leaf(name: Column, key: Column, value: Column) -> Column:
    """The entries that a value which is no object gives: none or one."""
    entry = lambda k, v: F.array(F.struct(k.alias("key"), v.alias("value")))

    def of_text(of: Column, text: Column) -> Column:
        # no date has 50 characters
        plain = of.isin("BOOLEAN", "BIGINT", "DECIMAL", "DOUBLE") | ((of == "STRING") & (is_structured(key, text) | F.when(F.length(text) < 50, is_iso_date(text)).otherwise(F.lit(False))))
        return F.when(plain, entry(name, text)).when((of == "STRING") & (F.length(text) < 100), entry(F.concat(name, F.lit("_short")), text)).otherwise(F.array().cast(ENTRY))

    def of_array() -> Column:
        return bound(F.size(F.variant_get(value, "$", "array<variant>")), lambda n: F.when(n > 0, entry(F.concat(name, F.lit("_count")), n.cast("string"))).otherwise(F.array().cast(ENTRY)))

    return bound(kind(value), lambda of: F.when(of == "ARRAY", of_array()).otherwise(bound(_text(value, of), lambda text: of_text(of, text))))


def _leaves(value: Column, prefix: Column, depth: int) -> Column:
    """name (the path), key and value of what is no object in an object; null if objects are nested deeper."""
    below = F.map_entries(F.variant_get(value, "$", "map<string,variant>"))

    def of(e: Column) -> Column:
        name = F.concat(prefix, e["key"])
        own = F.array(F.struct(name.alias("name"), e["key"].alias("key"), e["value"].alias("value")))
        if depth == 1:
            return F.when(~is_object(e["value"]), own)
        return F.when(is_object(e["value"]), _leaves(e["value"], F.concat(name, F.lit(".")), depth - 1)).otherwise(own)

    return F.flatten(F.transform(below, of))


def _last_of_each(entries: Column) -> Column:
    """Of entries with one key the last."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))


def json_metadata(text: Column, depth: int = DEPTH) -> Column:
    """struct(metadata, error) of JSON texts: the metadata of the flattener (``markup.flatten_json``), whose entries are
    here in the order of their keys. Texts that are no JSON object, that name a key twice in an object, or that have
    objects deeper than ``depth`` have an error instead. A null text has neither."""
    nothing = F.lit(None).cast("string")

    def made(entries: Column, error: Column) -> Column:
        return F.struct(bound(entries, lambda e: F.map_from_entries(_last_of_each(e))).alias("metadata"), error.cast("string").alias("error"))

    def of_leaves(leaves: Column) -> Column:
        entries = F.flatten(F.transform(leaves, lambda x: _leaf(x["name"], x["key"], x["value"])))
        return made(entries, F.when(leaves.isNull(), F.lit(f"objects are nested deeper than {depth}")))

    def of_value(value: Column) -> Column:
        error = F.when(text.isNull(), nothing).when(value.isNull(), "no JSON, or a key that is named twice").otherwise("the document is not an object")
        return F.when(is_object(value), bound(_leaves(value, F.lit(""), depth), of_leaves)).otherwise(made(F.lit(None).cast(ENTRY), error))

    return bound(F.try_parse_json(text), of_value)
