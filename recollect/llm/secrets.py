"""Secret scans with patterns and character Markov models, in DataFrame functions only.

Base spans come from three patterns: assignments to names of secrets, access keys and long hexadecimal runs. The models add
to them: every run of ``RUN`` = 16 or more identifier characters is scored by the logarithm of its likelihood under a
first-order character model of random strings, over that under a model of ordinary identifiers. Runs whose ratio exceeds
``LIMIT`` and that touch no base span are added as kind ``markov``.

Training: labelled samples. ``labelled`` makes random strings of several alphabets and ordinary identifiers of several
styles by a fixed rule, of which one half trains and the other is held out. To these come samples from the documents, so that the
models know the corpus: of at most ``RANDOM_DOCS`` and ``ORDINARY_DOCS`` documents (the first by a hash of the id), values
that the base patterns find are random strings, other runs of ``WORD`` or more identifier characters are ordinary. Either
kind counts as ``WEIGHT`` pairs of characters altogether, so neither the samples' nor the corpus' size shifts the ratio. Document
pairs are counted by Spark; a table of a fixed size (a row for each pair) comes to the driver and goes back into the plan as
one constant. Counts are smoothed. ``LIMIT`` was chosen on the training half: there it
finds 97 % of the random strings and no identifier.

Spans are found by splitting a text at its matches: the lengths of the parts, summed up in order by a window over the
document's matches, give places in code points. Only matches are shuffled, never texts.

Defined cases: null and empty texts have no spans; rows are kept one to one, repeated and null ids included, told apart by
row numbers (so ``docs`` must give its rows in the same order twice, as a table does); other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import row_number

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs too short are no matches of these two: a run is matched whole or not at all.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN, WORD, LIMIT = 16, 6, 4.0
RANDOM_DOCS, ORDINARY_DOCS, WEIGHT, SMOOTH = 20_000, 2_000, 50_000, 2.0
RUNS = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}"
WORDS = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WORD},}}"
KINDS = ("assign", "access", "hex", "markov")
_TYPE = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, kind: int, pattern: str, ok) -> Column:
    """Each match with the length of what stands between it and the match before; ok: of the matches, whether each counts."""

    def laid(found: Column) -> Column:
        parts = _let(F.split(text, F.lit(pattern)), lambda g: _let(ok(found), lambda fits: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(g[i]).alias("gap"), F.length(m).alias("size"), fits[i].alias("ok")))))
        return F.when(F.size(found) > 0, parts).otherwise(F.array().cast(_TYPE))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), laid)


def _always(found: Column) -> Column:
    return F.transform(found, lambda _: F.lit(True))


def _long_values(text: Column, least: int = 12):
    return lambda _: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= least)


def _pairs(values: DataFrame) -> dict[str, int]:
    """Counts of character pairs of the column v; at most a row for each pair of LETTERS."""
    pair = F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, F.lit(2)))
    counts = values.where(F.length("v") >= 2).select(F.explode(pair).alias("p")).where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return {r.p: r.n for r in counts.groupBy("p").agg(F.count("*").alias("n")).collect()}


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """Texts of the first n ids by their hash (of all rows with such an id)."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")


_STEMS = "get set user account name list order item count index cache value table column create update delete request response server client handler service manager config default option message event queue worker session document parser reader writer buffer stream error status version number string object method class module package import export function return static public private final report invoice payment address customer product category".split()


def labelled(n: int = 6_400, seed: int = 5) -> list[tuple[str, bool]]:
    """Runs of at least ``RUN`` characters and whether each is random: half of them are, in turns, whatever ``n``."""
    rng = random.Random(seed)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [upper + upper.lower() + digits, upper + upper.lower() + digits + "+/", upper + "234567", digits + "ABCDEF", upper.lower() + digits, upper + upper.lower() + digits + "-_"]
    styles = [
        "_".join,
        "-".join,
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
        lambda w: "".join(x.capitalize() for x in w),
        lambda w: "_".join(w).upper(),
        lambda w: "/".join(w),
        lambda w: "".join(w),
        lambda w: "_".join([*w, str(rng.randrange(2000, 2030))]),
    ]
    out = []
    for i in range(n):
        if i % 2:
            out.append(("".join(rng.choices(alphabets[i // 4 % len(alphabets)], k=rng.randrange(RUN, 49))), True))
            continue
        words = rng.sample(_STEMS, rng.randrange(2, 6))
        while len(styles[i // 4 % len(styles)](words)) < RUN:
            words.append(rng.choice(_STEMS))
        out.append((styles[i // 4 % len(styles)](words), False))
    return out


def halves(samples: list[tuple[str, bool]]) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """The half that trains and the half that is held out."""
    return [x for i, x in enumerate(samples) if i // 2 % 2 == 0], [x for i, x in enumerate(samples) if i // 2 % 2]


def _pairs_in(values: list[str]) -> dict[str, int]:
    return Counter(a + b for v in values for a, b in zip(v, v[1:]))


def ratios(random_: list[dict[str, int]], ordinary: list[dict[str, int]]) -> list[float]:
    """The table of log-likelihood ratios of a character after another, row by row in the order of LETTERS, from counts of pairs."""

    def model(sources: list[dict[str, int]]) -> list[float]:
        counts: Counter = Counter()
        for source in sources:
            total = sum(source.values())
            counts.update({p: WEIGHT / len(sources) * c / total for p, c in source.items()})
        out = []
        for a in LETTERS:
            row = [counts[a + b] + SMOOTH for b in LETTERS]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [r - o for r, o in zip(model([s for s in random_ if s]), model([s for s in ordinary if s]), strict=True)]


def ratio_of(table: list[float], run: str) -> float:
    """A run's ratio, as the scan computes it."""
    at = [LETTERS.index(c) for c in run]
    return sum(table[a * len(LETTERS) + b] for a, b in zip(at, at[1:]))


def train(docs: DataFrame, random_docs: int = RANDOM_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> list[float]:
    """The table of ratios from the labelled samples and those of the documents."""
    text = F.col("text")
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    found = _pairs(_sample(docs, random_docs).select(F.explode(values).alias("v")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    others = _pairs(_sample(docs, ordinary_docs).select(F.explode(F.regexp_extract_all(bare, F.lit(WORDS), F.lit(0))).alias("v")))
    trains, _ = halves(labelled())
    return ratios([_pairs_in([v for v, r in trains if r]), found], [_pairs_in([v for v, r in trains if not r]), others])


def _unlikely(table: list[float]):
    """Of runs, whether each is likelier a random string."""
    ratios, n = F.expr(f"array({','.join(f'{x!r}D' for x in table)})"), len(LETTERS)  # the optimizer folds it to one constant

    def ratio(run: Column) -> Column:
        place = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)
        return _let(place, lambda p: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: ratios[a * n + b]), F.lit(0.0), lambda s, x: s + x))

    return lambda found: F.transform(found, lambda m: ratio(m) > LIMIT)


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """row, doc_id, and the spans of each row of ``docs``: kind (place in KINDS), start and end, by start and kind."""
    text = F.col("text")
    numbered = docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), "text")
    none = F.array().cast(_TYPE)
    # no assignment without a colon or an equals sign and a name; no other match without a run, which has no space within
    low = F.lower(text)
    named = (text.contains("=") | text.contains(":")) & (low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api"))
    runs = F.exists(F.split(text, " "), lambda w: (F.octet_length(w) >= RUN) & w.rlike(f"[A-Za-z0-9+/_=-]{{{RUN}}}"))
    in_runs = F.concat(_matches(text, 1, ACCESS, _always), _matches(text, 2, HEX, _always), _matches(text, 3, RUNS, _unlikely(table)))
    every = F.concat(F.when(named, _matches(text, 0, ASSIGN, _long_values(text))).otherwise(none), F.when(runs, in_runs).otherwise(none))
    matches = numbered.where("text is not null").select("row", F.explode(every).alias("m")).select("row", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far)
    placed = matches.withColumn("end", end).where("ok").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    # markov spans that touch base spans go: in order of starts, neither does an earlier base span reach in, nor does a later one begin inside
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") < 3
    free = placed.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    kept = free.where(base | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return numbered.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.lit(list(KINDS))[s["kind"]], s["start"], s["end"])), ",")

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
