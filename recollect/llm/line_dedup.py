"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Lines: a text is cut after every line end, and long lines are folded at spaces, after every word whose last character has a
code that three does not divide, or one above 255; two words of three or so, in any language. In texts of mostly kana or
Chinese characters, which have no spaces, every one of these ends a line. So a passage is cut alike wherever it stands,
inside a line or across line ends.

Chunks: every line is hashed, and a hash rolls over ``ROLL`` line hashes in a row. A chunk begins where the rolling hash is
below those of the ``NEAR`` places before and not above those of the ``NEAR`` behind; so boundaries shift with the text. A
chunk has over ``NEAR`` lines, twice as many and one on average, fifteen words or so; a text without boundaries is one chunk, however short.

A chunk that several documents have belongs to the first of them (by row). Every other document's chunk of that hash is
compared with the owner's byte for byte; equal ones are removed, and with them the lines in front and behind (``EDGE`` at
most on either side) that the owner has there, too, as a passage rarely begins and ends with a chunk. Exact copies of a
whole text lose all of it; which of the rows that are left go is the business of near-duplicate removal.

Counting is partly aggregated before each shuffle, joins are on hashes or row numbers, which adaptive execution can split,
and a document's list of shared chunks is bounded by the document. Texts are hashed once and shuffled once.

Defined cases: null texts stay null, empty ones empty; a document all of whose text is removed stays with an empty text;
repeats within one document stay; repeated rows and ids count as documents of their own, told apart by row numbers (so
``docs`` must give its rows in the same order twice, as a table does; a row whose columns are not those that its number had
before stays whole); other columns are kept, whatever their names; very long texts are cut like others, and one without
boundaries (a word repeated for ever) is one chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from recollect.llm.common import row_number, unused_name, written

ROLL, NEAR, EDGE = 2, 5, 10
#: Characters of scripts without spaces: kana, Chinese, and the punctuation among them.
_DENSE = "[、-ヿ㐀-鿿！，？]"
_LOW = (1 << 32) - 1
#: A space at which a line ends.
_FOLD = f" (?<=[\\n{''.join(f'\\x{c:02x}' for c in range(33, 256) if c % 3)}\\u0100-\\uffff] )"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once (an expression named in a lambda is evaluated at every call)."""
    return F.transform(F.array(value), body)[0]


def _dense(text: Column) -> Column:
    return F.octet_length(text) >= 2 * F.length(text)


def lines(text: Column) -> Column:
    """The text's lines. A space stands between each two, which after line ends (and in dense texts characters) is put in here."""
    spaced = F.when(_dense(text), F.regexp_replace(text, f"\n|{_DENSE}", "$0 ")).otherwise(F.replace(text, F.lit("\n"), F.lit("\n ")))
    return F.split(spaced, _FOLD)


def joined(u: Column, text: Column) -> Column:
    """Lines of the text (all, or what is left of them) as text, without the spaces that ``lines`` put in."""
    spaced = F.array_join(u, " ")
    return F.when(_dense(text), F.regexp_replace(spaced, f"(\n|{_DENSE}) ", "$1")).otherwise(F.replace(spaced, F.lit("\n "), F.lit("\n")))


def _hashes(u: Column) -> Column:
    return F.transform(u, lambda x: F.xxhash64(x))


def _rolled(h: Column) -> Column:
    """At each line the hash that rolls over it and the ``ROLL`` - 1 lines before (null where there are none)."""

    def at(x: Column, i: Column) -> Column:
        for k in range(1, ROLL):
            x = x.bitwiseXOR(F.shiftleft(F.get(h, i - k), k))
        return x

    return F.transform(h, at)


def _bounds(h: Column) -> Column:
    """Where chunks begin, but for the first."""

    def inner(r: Column) -> Column:
        def least(i: Column) -> Column:
            ok = r[i] < r[i - 1]
            for k in range(1, NEAR + 1):
                ok = (ok & (r[i] < r[i - k]) if k > 1 else ok) & (r[i] <= r[i + k])
            return ok

        return F.filter(F.sequence(F.lit(NEAR + ROLL - 1), F.size(r) - NEAR - 1), least)

    return F.when(F.size(h) >= 2 * NEAR + ROLL, _let(_rolled(h), inner)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column) -> Column:
    """The text's chunks in order: the hashes h of their lines' hashes, and the lines e behind the last of each."""

    def of_lines(h: Column) -> Column:
        def one(b: Column) -> Column:
            e = F.concat(b, F.array(F.size(h)))
            return F.struct(F.zip_with(F.concat(F.array(F.lit(0)), b), e, lambda s, x: F.xxhash64(F.slice(h, s + 1, x - s))).alias("h"), e.alias("e"))

        return _let(_bounds(h), one)

    return _let(_hashes(lines(text)), of_lines)


def shared_chunks(docs: DataFrame) -> DataFrame:
    """row, its chunks that an earlier document has, too, by place (``others``), and those that it is the first to have (``own``, each hash once).

    A chunk is its hash h and its place: the first line times 2 ** 32, and the line behind the last. Empty texts have none.
    """
    found = F.when(F.col("text") != "", chunks(F.col("text")))
    rows = written(docs.select(row_number().alias("row"), found.alias("c")).select("row", "c.h", "c.e")).where("h is not null")
    before = lambda i: F.coalesce(F.get("e", i - 1), F.lit(0)).cast("long")
    each = rows.select("row", F.explode(F.transform("h", lambda h, i: F.struct(h.alias("h"), (F.shiftleft(before(i), 32) + F.col("e")[i]).alias("at")))).alias("c")).select("row", "c.*")
    owners = each.groupBy("h").agg(F.min("row").alias("owner"), F.max("row").alias("last")).where("owner < last").select("h", "owner")
    shared = each.join(owners, "h").select("row", F.struct("h", "at").alias("c"), (F.col("row") == F.col("owner")).alias("owner"))
    listed = shared.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("owner"), F.col("c")))).alias("own"), F.collect_list(F.when(~F.col("owner"), F.col("c"))).alias("others"))
    first = F.filter("own", lambda c, i: (i == 0) | (F.get(F.col("own"), i - 1)["h"] != c["h"]))
    return listed.select("row", first.alias("own"), F.array_sort("others", lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)).alias("others"))


def _piece(u: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(u, start + 1, end - start), " ")


def _same(a: Column, b: Column, backwards: bool) -> Column:
    """How many lines two pieces have in common from their beginnings (or ends) on; white space at the ends of lines is not compared."""

    def listed(piece: Column) -> Column:
        each = F.transform(F.split(piece, _FOLD), lambda x: F.rtrim(x, F.lit(" \n")))
        return F.reverse(each) if backwards else each

    differs = F.zip_with(listed(a), listed(b), lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    same = _let(differs, lambda d: F.coalesce(F.nullif(F.array_position(d, True), F.lit(0)) - 1, F.size(d)).cast("int"))
    return F.when((a != "") & (b != ""), same).otherwise(0)


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines from a up to b of each span in ``removed`` (ascending; spans may overlap)."""

    def of_lines(u: Column) -> Column:
        start, end = removed["a"], removed["b"]
        kept = F.zip_with(F.concat(F.array(F.lit(0)), end), F.concat(start, F.array(F.size(u))), lambda a, b: F.when(a < b, F.slice(u, a + 1, b - a)).otherwise(F.array().cast("array<string>")))
        return joined(F.flatten(kept), text)

    return _let(lines(text), of_lines)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks removed from ``text``."""
    number, other, listed, gone, sign = (unused_name(docs, x) for x in ("row", "other_row", "listed", "removed", "sign"))
    found = shared_chunks(docs).withColumnRenamed("row", other)
    numbered = docs.withColumn(number, row_number())
    # a digest of all columns, which tells whether a number still means the same row; as all three joins below read all
    # columns, they can share one shuffle of the texts
    digest = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)))

    def met(which: str) -> DataFrame:
        """The chunks listed as the owner's or the others', with their texts and the lines in front and behind.

        Others' chunks have none on a side where the next chunk is listed, too.
        """
        mine = found.select(other, F.col(which).alias(listed)).where(F.size(listed) > 0)

        def occurrences(u: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                place = F.struct(F.shiftright(c["at"], 32).cast("int").alias("a"), c["at"].bitwiseAND(_LOW).cast("int").alias("b"))
                return _let(place, lambda p: placed(c["h"], p["a"], p["b"], i))

            def placed(h: Column, a: Column, b: Column, i: Column) -> Column:
                front, behind = _piece(u, F.greatest(a - EDGE, F.lit(0)), a), _piece(u, b, b + EDGE)
                if which == "others":
                    front = F.when(F.coalesce(F.get(F.col(listed), i - 1)["at"].bitwiseAND(_LOW) == a, F.lit(False)), "").otherwise(front)
                    behind = F.when(F.coalesce(F.shiftright(F.get(F.col(listed), i + 1)["at"], 32) == b, F.lit(False)), "").otherwise(behind)
                return F.struct(h.alias("h"), a.alias("a"), b.alias("b"), _piece(u, a, b).alias("t"), front.alias("front"), behind.alias("behind"))

            return F.transform(F.col(listed), one)

        rows = numbered.join(mine, F.col(number) == F.col(other))
        return rows.select(F.col(number).alias("row"), digest.alias("sign"), F.explode(_let(lines(F.col("text")), occurrences)).alias("p")).select("row", "sign", "p.*")

    owned = met("own").select("h", F.col("sign").alias("sign0"), F.col("t").alias("t0"), F.col("front").alias("front0"), F.col("behind").alias("behind0"))
    equal = met("others").join(owned, "h").where("t = t0")
    spans = equal.select("row", "sign", "sign0", F.struct((F.col("a") - _same(F.col("front"), F.col("front0"), True)).alias("a"), (F.col("b") + _same(F.col("behind"), F.col("behind0"), False)).alias("b")).alias("p"))
    removed = spans.groupBy(F.col("row").alias(other)).agg(F.min("sign").alias(sign), F.max("sign0").alias("sign0"), F.array_sort(F.collect_list("p")).alias(gone)).where("sign0 is not null").drop("sign0")
    out = numbered.join(removed, F.col(number) == F.col(other), "left")
    clean = F.when(F.col(gone).isNotNull() & (F.col(sign) == digest), _without(F.col("text"), F.col(gone))).otherwise(F.col("text"))
    return out.withColumn("text", clean).select(*(f"`{c}`" for c in docs.columns))
