"""Functions that Spark has no expression for, as pandas UDFs: Unicode forms, HTML text, canonical JSON, keyed ids."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
import uuid
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _each(function):
    """A pandas UDF that maps strings, nulls to null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


#: What is not ASCII, with the ASCII character before it.
_RUN = r"[\x00-\x7f]?[^\x00-\x7f]+"
#: Texts that are made Python strings in one go.
STEP = 128


def compatible_texts(values: pa.Array) -> pa.Array:
    """NFKC of each text, ``STEP`` of them at a time."""

    def some(part: pa.Array) -> pa.Array:
        return pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in part.to_pylist()], pa.string())

    return pa.concat_arrays([some(values.slice(i, STEP)) for i in range(0, len(values), STEP)] or [pa.nulls(0, pa.string())])


def compatible(text: Column) -> Column:
    """Compatibility characters as those they stand for (Unicode's NFKC), which no expression of Spark gives.

    Only what is not ASCII goes through Python, with the character before it, which marks may join; no form reaches over an ASCII character from
    behind it, so the rest stays as it is.
    """

    def nfkc(values: pa.Array) -> pa.Array:
        ends = pc.cumulative_sum(pc.list_value_length(values).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), compatible_texts(values.flatten()))

    nfkc.__annotations__ = {"values": pa.Array, "return": pa.Array}
    runs = F.coalesce(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), F.array().cast("array<string>"))
    normal = F.arrow_udf(nfkc, ArrayType(StringType()))(runs)
    return F.array_join(F.zip_with(F.split(text, _RUN), normal, lambda rest, run: F.concat(rest, F.coalesce(run, F.lit("")))), "")


def normal_text(text: Column) -> Column:
    """Compatible characters, one blank between words, no blanks at the ends of lines, no blank lines (FN7)."""
    lines = F.split(compatible(text), "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]")
    plain = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def html_nodes(html: Column) -> Column:
    """Every text node that is not blank, as it is, a line each, those of scripts and styles included (FN10)."""

    def one(s: str) -> str:
        nodes = _Nodes()
        nodes.feed(s)
        nodes.close()
        return "\n".join(filter(str.strip, nodes.found))

    return _each(one)(html)


def canonical_json(text: Column) -> Column:
    """The JSON with keys sorted at every depth, a blank after commas and colons; null where it is none (FN11)."""

    def one(s: str) -> str | None:
        try:
            return json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return _each(one)(text)


def first_json(text: Column) -> Column:
    """The text of the JSON value that begins at the first bracket; null where none does, or a further bracket follows it."""
    opening = re.compile(r"[\[{]")

    def one(s: str) -> str | None:
        begin = opening.search(s)
        if begin is None:
            return None
        try:
            end = json.JSONDecoder().raw_decode(s, begin.start())[1]
        except ValueError:
            return None
        return None if opening.search(s, end) else s[begin.start() : end]

    return _each(one)(text)


def fenced_json(text: Column) -> Column:
    """The JSON of a text, of its only fenced block, or, where there is no fence, of what begins at its first bracket (FN29).

    Null where none parses, for several fences, and where a further bracket follows what was found. Fences divide the text: what stands
    between an opening and a closing one is every second part.
    """
    parts = F.split(text, "```")
    closed = F.floor((F.size(parts) - 1) / 2)
    inside = F.regexp_replace(F.get(parts, F.lit(1)), "(?i)^json", "")
    return F.coalesce(canonical_json(text), canonical_json(F.when(closed == 1, inside).when(closed == 0, first_json(text))))


# Fixed value: the form of ids.
def keyed_id(value: Column, secret: bytes, label: str) -> Column:
    """An id of a user, session or workspace that tells nothing of the value without the secret (FN22)."""
    return _each(lambda s: f"dream-v1-{hmac.new(secret, f'dream-v1:{label}:{s}'.encode(), hashlib.sha256).hexdigest()}")(value)


def job_id(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The same UUID for the same name (FN23)."""
    return _each(lambda s: str(uuid.uuid5(namespace, s)))(name)


def folded(text: Column) -> Column:
    """Full case folding, for the few letters where lower case is another (FN6)."""
    return _each(str.casefold)(text)
