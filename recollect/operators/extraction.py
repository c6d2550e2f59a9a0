"""Entities, relations, events and triples that chunks of text state outright, in lines or as JSON; front matter of cards.

Chunks have source_id, chunk_id and content; null is no content. Statements come by explode, row by row; only merging entities shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import variants as V

# Fields that name an entity, the type and name of one that has none, and the kinds of lines.
NAMING = ("application_id", "entity_id", "entity_type", "name")
TYPE, NAME = "LoanApplication", "Application "
LINES = ("ENTITY", "RELATION", "EVENT", "TRIPLE")


def _digest(prefix: str, *parts: Column | str) -> Column:
    """An id of parts that a bar joins; parts may be arrays."""
    return F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def _once(value: Column) -> Column:
    """A value that is computed once a row: filters on a generated column are not pushed below it, which would compute it again."""
    return F.explode(F.array(value))


def stated(chunks: DataFrame) -> DataFrame:
    """Every statement: source_id, chunk_id, pos and nth (its line or record, and its field), kind, id, subject, predicate, object, value (JSON) and participants (FN13).

    A chunk that begins with a bracket and is JSON gives an entity for each record with an id and a triple for each of its other fields;
    every other chunk gives the statements of its lines. An entity has its type as predicate and its name as object; an event its type as
    predicate and its time as object.
    """
    begun = F.ltrim("content").startswith("{") | F.ltrim("content").startswith("[")
    parsed = chunks.select("source_id", "chunk_id", "content", _once(F.when(begun, V.one_json(F.col("content")))).alias("_json"))
    return _of_lines(parsed.where("_json is null")).unionByName(_of_json(parsed.where("_json is not null")))


def _of_lines(chunks: DataFrame) -> DataFrame:
    line = chunks.select("source_id", "chunk_id", F.posexplode(F.split("content", "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]")).alias("pos", "line"))
    part = F.transform(F.split("line", r"\|"), lambda x: F.btrim(x, F.lit(" \t")))
    line = line.select("source_id", "chunk_id", "pos", _once(part).alias("part")).withColumn("kind", F.upper(F.col("part")[0]))
    n, first, second, third = F.size("part"), *(F.get("part", F.lit(i)) for i in (1, 2, 3))
    is_event = F.col("kind") == "EVENT"
    line = line.where(F.col("kind").isin(*LINES) & F.when(is_event, n >= 3).otherwise(n == 4))
    people = F.when(is_event, F.filter(F.transform(F.split(second, ","), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != ""))
    when = F.when(third != "", third)
    ids = F.when(F.col("kind") == "ENTITY", first).when(F.col("kind") == "RELATION", _digest("relation", first, second, third, "source_id")).when(is_event, _digest("event", first, people, F.coalesce(when, F.lit(""))))
    is_entity, is_triple = F.col("kind") == "ENTITY", F.col("kind") == "TRIPLE"
    return line.select(
        "source_id", "chunk_id", "pos", F.lit(0).alias("nth"), F.lower("kind").alias("kind"), ids.alias("id"),
        F.when(~is_entity & ~is_event, first).alias("subject"), F.when(is_event, first).otherwise(second).alias("predicate"),
        F.when(is_event, when).when(~is_triple, third).alias("object"), F.when(is_triple, coerced(third)).alias("value"), people.alias("participants"),
    )


def coerced(text: Column) -> Column:
    """A field as JSON: true and false in any case, whole numbers, other numbers, else a string."""
    whole = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^(-?)0+(?=[0-9])", "$1")
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(F.lower(text).isin("true", "false"), F.lower(text)).when(text.rlike("^[+-]?[0-9]+$"), whole).when(number, text.cast("double").cast("string")).otherwise(_quoted(text))


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _of_json(chunks: DataFrame) -> DataFrame:
    several = V.kind(F.col("_json")) == "ARRAY"
    records = F.when(several, F.col("_json").cast("array<variant>")).otherwise(F.array("_json"))
    each = chunks.select("source_id", "chunk_id", F.posexplode(records).alias("pos", "record")).where(V.kind(F.col("record")) == "OBJECT")
    fields = each.select("source_id", "chunk_id", "pos", _once(F.col("record").cast("map<string, variant>")).alias("field"))
    given = lambda name: _given(F.try_element_at("field", F.lit(name)))
    entity = F.trim(F.coalesce(given("application_id"), given("entity_id"), F.lit("")))
    named = fields.select("source_id", "chunk_id", "pos", "field", _once(entity).alias("entity")).where("entity <> ''")
    blank, no_people = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    own = F.struct(
        F.lit(0).alias("nth"), F.lit("entity").alias("kind"), F.col("entity").alias("id"), blank.alias("subject"), F.coalesce(given("entity_type"), F.lit(TYPE)).alias("predicate"),
        F.coalesce(given("name"), F.concat(F.lit(NAME), "entity")).alias("object"), blank.alias("value"), no_people.alias("participants"),
    )
    triple = lambda key, i: F.struct(
        (i + 1).alias("nth"), F.lit("triple").alias("kind"), blank.alias("id"), F.col("entity").alias("subject"), key.alias("predicate"),
        blank.alias("object"), F.to_json(F.try_element_at("field", key)).alias("value"), no_people.alias("participants"),
    )
    others = F.filter(F.array_sort(F.map_keys("field")), lambda k: ~k.isin(*NAMING))
    return named.select("source_id", "chunk_id", "pos", F.inline(F.concat(F.array(own), F.transform(others, triple))))


def _given(value: Column) -> Column:
    """A field's text, null where it counts as not given: null, false, zero, an empty string, array or object."""

    def text(x: Column) -> Column:
        empty = F.to_json(x).isin("null", "false", "0", "0.0", '""', "[]", "{}") | (V.kind(x) == "VOID")
        return F.when(~empty, V.text_of(x))

    return F.get(F.transform(F.array(value), text), F.lit(0))


def entities(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities by id with the type and name stated first (by source, chunk and place), and a row for each chunk that states one."""
    stated_ = statements.where("kind = 'entity'")
    first = stated_.groupBy("id").agg(F.min_by(F.struct("predicate", "object"), F.struct("source_id", "chunk_id", "pos")).alias("_first"))
    return first.select("id", F.col("_first.predicate").alias("type"), F.col("_first.object").alias("name")), stated_.select("id", "source_id", "chunk_id").distinct()


def front_matter(cards: DataFrame) -> DataFrame:
    """source_id, key and value of each field between two lines of dashes; a value is a variant: JSON, else text, or a list (FN17).

    Of a key that stands twice the last counts. A card whose head does not close has no fields.
    """
    head = F.regexp_extract("content", r"(?s)\A[^\S\n]*---[^\S\n]*\n(.*?)(?<=\n)[^\S\n]*---[^\S\n]*(?:\n|\z)", 1)
    field = r"(?m)^([^:\n]*):[^\S\n]*(?:(\S[^\n]*)|((?:\n  - [^\n]*)*))$"
    pairs = F.arrays_zip(*(F.regexp_extract_all(head, F.lit(field), i).alias(n) for i, n in ((1, "key"), (2, "one"), (3, "items"))))
    each = cards.select("source_id", F.posexplode(pairs).alias("nth", "field")).select("source_id", "nth", F.trim("field.key").alias("key"), F.rtrim("field.one").alias("one"), F.col("field.items").alias("items"))
    item = lambda x: F.coalesce(V.text_of(V.one_json(F.trim(x))), F.trim(x))
    listed = F.transform(F.split("items", "\n  - "), item)
    value = F.when(F.col("one") != "", F.coalesce(V.one_json(F.col("one")), F.col("one").cast("variant"))).otherwise(F.to_variant_object(F.slice(listed, F.lit(2), F.size(listed))))
    last = Window.partitionBy("source_id", "key").orderBy(F.desc("nth"))
    return each.withColumn("value", value).withColumn("_n", F.row_number().over(last)).where("_n = 1").select("source_id", "key", "value")
