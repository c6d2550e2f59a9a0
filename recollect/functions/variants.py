"""JSON of any shape as VARIANT columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A value that no text holds by chance: what the parser finds behind the text's own value.
_END = "\\u0001end\\u0001"


def one_json(text: Column) -> Column:
    """The text as a variant where it is one JSON value and nothing else, else null; so are objects that name a key twice.

    Spark's parser stops after the first value, so the text stands in an array before a sign that must come second and last.
    """

    def first(both: Column) -> Column:
        second = F.try_variant_get(both, "$[1]", "string") == F.lit("\x01end\x01")
        ends = F.coalesce(second, F.lit(False)) & F.try_variant_get(both, "$[2]", "variant").isNull()
        return F.when(ends, F.try_variant_get(both, "$[0]", "variant"))

    # bound by a lambda, the text is parsed once and not for each mention
    return F.get(F.transform(F.array(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))), first), F.lit(0))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY or the type of a plain value, VOID for JSON's null; null for null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    """A variant's text: a string as it is, all else as JSON."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
