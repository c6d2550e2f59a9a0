"""Toxicity from a weighted lexicon, found by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding: letters in lower case, wide and styled forms as plain ones, look-alikes of other scripts and digit substitutions as the letters they
stand for, everything else a space. Lexicon entries are words or beginnings of words of the folded text.

Learning: a bounded sample of labelled rows (``SAMPLE_ROWS`` = 20,000, the first by a hash of the id; all where there are
fewer) gives every word and word beginning its document counts by label. Entries are chosen greedily: the purest that
explain most toxic documents not yet explained ``TIMES`` times. Of sampled documents that share the smallest hash of
their three-word shingles only one is kept: copies of one toxic document would make all its words look toxic. An entry
weighs the logarithm of its odds. Phrases of an entry and a neighbouring word that are found in documents of label 0
only are exceptions: there the entry does not count. The sum of weights over a power of the number of words goes into a
logistic curve; power and curve are fitted on the sample. ``LEXICON_SIZE`` bounds entries and exceptions, ``CANDIDATES``
what may become an entry: sizes of the model, which do not depend on the input. Scoring reads all rows and whole texts, very
long ones, too: finding takes time in proportion to the text, its entries and phrases.

Defined cases: null and empty texts score as texts without an entry; labels that are null, or whose doc_id has no
document, are not used; ids labelled differently twice count as often as they are; with no labels at all every score is
the prior 0; rows are kept one to one, repeated and null ids included; other columns are ignored by ``score``.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from recollect.llm.common import arrow_rows, cut, emit, kept_in_worker, new_key

SAMPLE_ROWS, LEXICON_SIZE, CANDIDATES, LEAST_DOCS = 20_000, 2_000, 100_000, 4
#: Least weight of an entry, and how many entries a toxic document is looked through for: chosen on the training rows of the
#: sf0.1 table whose crc32 modulo 7 is 0, with the others to learn from (5 entries halve the loss of 10; 1.0 to 2.0 are alike).
LEAST_WEIGHT, TIMES = 1.5, 5
PREFIXES = range(4, 9)
POWERS = (0.0, 0.25, 0.5, 1.0)
#: Letters of other scripts that look like Latin ones.
LOOKS = dict(zip("аеорсухіјѕһԁԛԝвкмнтӏɡαεοριυνκτχγβոսօցհɑı", "aeopcyxijshdqwbkmhtlgaeopiuvktxybnuoghai", strict=True))
#: Digits and signs that stand for letters. Signs that mostly end sentences or part words (! and |) are none.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class _Folding(dict):
    """Character codes to folded letters, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        whole = unicodedata.normalize("NFKC", chr(code).lower()).lower()
        plain = (LOOKS.get(c, SIGNS.get(c, c)) for c in whole)
        self[code] = "".join(c if c.isalpha() else " " for c in plain)
        return self[code]


_FOLD = _Folding()


def fold(text: str | None) -> str:
    """The folded text with a space at either end."""
    return f" {text.translate(_FOLD)} " if text else " "


@dataclass
class Model:
    #: " begin" (of a word) or " word " with its weight
    weights: dict[str, float] = field(default_factory=dict)
    #: " word entry" and the like, folded
    exceptions: tuple[str, ...] = ()
    power: float = 0.0
    slope: float = 1.0
    bias: float = -30.0


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = None
        if model.weights:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in model.weights.items():
                self.automaton.add_word(entry, (len(entry.rstrip()), weight))
            for phrase in model.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            self.automaton.make_automaton()

    def found(self, folded: str) -> list[tuple[int, float]]:
        """Start and weight of the entries found, the longest of each place, without those inside exception phrases."""
        if self.automaton is None:
            return []
        at: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(folded):
            if weight is None:
                spared.append((end + 1 - n, end))
                continue
            start = end + 1 - n - (folded[end] == " ")  # entries that are whole words end in a space
            if start not in at or at[start][0] < n:
                at[start] = n, weight
        spared.sort()
        out, i, reach = [], 0, -1
        for s, (_, w) in sorted(at.items()):
            while i < len(spared) and spared[i][0] <= s:
                reach, i = max(reach, spared[i][1]), i + 1
            if s >= reach:
                out.append((s, w))
        return out

    def measure(self, text: str | None, power: float) -> float:
        folded = fold(text)
        total = sum(w for _, w in self.found(folded))
        return total / max(1, len(folded.split())) ** power if total else 0.0

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.measure(text, self.model.power) + self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if z > -30 else 0.0


def _features(text: str | None) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def _least_shingle(text: str) -> int:
    words = fold(text).split()
    return min(map(xxh64_intdigest, map(" ".join, zip(words, words[1:], words[2:]))), default=xxh64_intdigest(" ".join(words))) >> 1


def _sample(docs: DataFrame, labels: DataFrame, rows: int, learns: Callable[[Column], Column]) -> DataFrame:
    """toxic and text of the bounded sample; repeated texts once."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    chosen = usable.where(learns(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = ((t, x, _least_shingle(x)) for t, x in arrow_rows(batches, ["toxic", "text"]))
        return emit(rows_, pa.schema([("toxic", pa.int32()), ("text", pa.string()), ("sketch", pa.int64())]), 512)

    sketched = found.mapInArrow(sketch, "toxic int, text string, sketch long")
    return cut(sketched.groupBy("toxic", "sketch").agg(F.min("text").alias("text")).select("toxic", "text"))


def train(docs: DataFrame, labels: DataFrame, learns: Callable[[Column], Column] = lambda doc_id: F.lit(True), rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """The lexicon and its curve, from labelled rows for which ``learns`` of the doc_id holds.

    The sample is bounded, and so is what comes to the driver: counts of features that are clearly toxic, and for each
    row of the sample which of these it has.
    """
    sample = _sample(docs, labels, rows, learns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n = Counter()
        for toxic, text in arrow_rows(batches, ["toxic", "text"]):
            seen[toxic].update(_features(text))
            n[toxic] += 1
        out = ((f, seen[1][f], seen[0][f]) for f in {*seen[0], *seen[1]})
        return emit([("", n[1], n[0]), *out], pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    counts = sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counts.where("feature = ''").first()
    n_pos, n_neg = (totals.pos, totals.neg) if totals else (0, 0)
    if not n_pos:
        return Model()
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    clear = counts.where(f"feature <> '' and pos >= {LEAST_DOCS}").withColumn("weight", weight).where(f"weight > {LEAST_WEIGHT}").orderBy(F.desc(F.col("weight") * F.col("pos")), "feature").limit(CANDIDATES)
    candidates = {r.feature: (r.weight, r.pos, r.neg) for r in clear.toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = ((sorted(_features(text) & shared.value),) for toxic, text in arrow_rows(batches, ["toxic", "text"]) if toxic)
        return emit(rows_, pa.schema([("features", pa.list_(pa.string()))]), 256)

    explained = sample.mapInArrow(which, "features array<string>")
    chosen = _choose([r.features for r in explained.toLocalIterator()], candidates)
    model = Model({f: candidates[f][0] for f in chosen}, tuple(" " + " ".join(fold(p).split()) for p in exceptions))
    return _fit(sample, model)


def _choose(docs: list[list[str]], candidates: dict[str, tuple[float, int, int]]) -> list[str]:
    """Greedy cover: again and again the entry with most weight over toxic documents that fewer than TIMES entries explain.

    A beginning whose words are all entries already, or the other way round, adds nothing: it is left out.
    """
    docs = sorted(docs)
    of = defaultdict(set)
    for i, features in enumerate(docs):
        for f in features:
            of[f].add(i)
    gain = {f: len(x) for f, x in of.items()}
    times = [0] * len(docs)
    chosen: list[str] = []
    while gain and len(chosen) < LEXICON_SIZE:
        best = max(gain, key=lambda f: (gain[f] * candidates[f][0], len(f), f))
        if gain[best] < LEAST_DOCS:
            break
        del gain[best]
        if any((best.startswith(c.rstrip()) or c.startswith(best.rstrip())) and of[best] <= of[c] for c in chosen):
            continue
        chosen.append(best)
        for i in of[best]:
            times[i] += 1
            if times[i] == TIMES:
                for f in docs[i]:
                    if f in gain:
                        gain[f] -= 1
    return chosen


def _fit(sample: DataFrame, model: Model) -> Model:
    """Exceptions, power and curve from the sample; each row of it comes to the driver as a few numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(shared.value), Counter()
        for toxic, text in arrow_rows(batches, ["toxic", "text"]):
            folded = " " + " ".join(fold(text).split()) + " "
            for start, _ in scorer.found(folded):
                end = folded.index(" ", start + 1)
                before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
                if before >= 0:
                    seen[folded[before : end + 1], toxic] += 1
                if after > 0:
                    seen[folded[start : after + 1], toxic] += 1
        return emit(((p, t, n) for (p, t), n in seen.items()), pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    by = sample.mapInArrow(near, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    harmless = [r.phrase for r in by.where(f"pos = 0 and neg >= {LEAST_DOCS}").orderBy(F.desc("neg"), "phrase").limit(LEXICON_SIZE).collect()]
    model = Model(model.weights, (*model.exceptions, *harmless))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        rows = ((toxic, scorer.measure(text, 0.0), max(1, len(fold(text).split()))) for toxic, text in arrow_rows(batches, ["toxic", "text"]))
        return emit(rows, pa.schema([("toxic", pa.int32()), ("total", pa.float64()), ("words", pa.int64())]))

    got = sample.mapInArrow(measures, "toxic int, total double, words long").orderBy("toxic", "total", "words").toLocalIterator()
    toxic, total, words = (np.array(x, float) for x in zip(*got))
    best = None
    for power in POWERS:
        slope, bias, loss = _logistic(total / words**power, toxic)
        if best is None or loss < best[0] - 1e-9:
            best = loss, power, slope, bias
    return Model(model.weights, model.exceptions, *best[1:])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Slope, bias and loss of the logistic curve, by Newton's method with a small ridge."""
    scale = x.max() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0] / scale), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learnt from: crc32 of the id as text is divisible by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), new_key()
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker("toxicity", key, shared, Scorer)
        rows = ((i, h, s, int(s >= 0.5)) for i, h, t in arrow_rows(batches, ["doc_id", "held_out", "text"]) for s in (scorer.score(t),))
        return emit(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker("toxicity", key, shared, Scorer)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
