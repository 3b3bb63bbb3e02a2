"""Operator 8: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digits or signs
that stand for letters become Latin letters, everything else that is not a letter a blank.
A term is the beginning of a word.  Its weight is learned from labelled documents: the log
ratio of its document frequencies in toxic and other ones.  A text's weight is the sum over
its matches, but for those inside an exception phrase; the score is logistic in that weight
and in the weight per word.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches, set_aside
from vigipanel.session import materialise

# At most so many labelled documents are fitted on, those with the least hash of their id.
FIT_ROWS = 30_000
MAX_TERMS = 2_000
SHORTEST, LONGEST = 3, 8
# A term needs this many toxic documents and this ratio of frequencies.
LEAST_DOCS, LEAST_WEIGHT = 4, math.log(12)

# Letters of other scripts that look like Latin ones, and substitutions.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ʟ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "sore loser", "weight loser", "idiot proof", "idiotproof",
    "pond scum", "stupid easy", "disgusting weather", "pathetic fallacy",
)

FULL_WIDTH = {chr(0xFF41 + i): c for i, c in enumerate(string.ascii_lowercase)}
INVISIBLE = {c: "" for c in "​‌‍⁠﻿­"}


class _Fold(dict):
    """Character by character; letters that are not listed stay, other characters are blanks."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = value = char if char.isalpha() else " "
        return value


FOLD = _Fold({ord(k): v for k, v in {**LOOK_ALIKES, **SUBSTITUTES, **FULL_WIDTH, **INVISIBLE}.items()})


def folded(text: str | None) -> str:
    """Words between single or more blanks, with a blank at both ends."""
    return f" {(text or '').lower().translate(FOLD)} "


@dataclass
class Model:
    """A lexicon and how its weights make a score."""

    weights: dict[str, float]
    coefficients: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(" " + term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(f" {folded(phrase).strip()} ", (len(phrase), None))
        out.make_automaton()
        return out


def weigh(text: str, automaton) -> tuple[float, int]:
    """The weight of a folded text's matches, and its number of words.

    Of the terms that begin one word the heaviest counts.
    """
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(text):
            start = end - size if weight is not None else end - size - 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    return sum(best[start] for start in outside(sorted(best), spared)), len(text.split())


def outside(places: list[int], spans: list[tuple[int, int]]) -> Iterator[int]:
    """The rising places that lie in no span, both lists read once."""
    spans, at, reach = sorted(spans), 0, 0
    for place in places:
        while at < len(spans) and spans[at][0] <= place:
            reach, at = max(reach, spans[at][1]), at + 1
        if place >= reach:
            yield place


def inputs(total: float, words: int) -> tuple[float, float]:
    """What the score sees: the weight, and the weight per hundred words, on log scales."""
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            words = set(folded(text.as_py()).split())
            counts[toxic.as_py()].update({w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)})
        terms = list(counts[0].keys() | counts[1].keys())
        arrays = [pa.array(terms, pa.string()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "n_toxic", "n_other"])


def _weights(rows: list, n_toxic: int, n_other: int) -> dict[str, float]:
    """Terms by length; a longer one stays only if it weighs clearly more than its beginning."""
    out: dict[str, float] = {}
    for term, toxic, other in sorted(((r.term, r.n_toxic, r.n_other) for r in rows), key=lambda r: (len(r[0]), r[0])):
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
        begun = max((out.get(term[:n], 0.0) for n in range(SHORTEST, len(term))), default=0.0)
        if weight > max(LEAST_WEIGHT, begun + 0.7):
            out[term] = weight
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-penalised logistic regression by Newton's method (three coefficients)."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Learn from (doc_id, text, toxic); rows with a null label are left out.

    Terms are counted on one half of the documents and the score is fitted on the other, so
    that terms found by chance get no credit.  With no toxic documents, or no others, the
    score is the share of toxic ones throughout.
    """
    sample = labelled.where("toxic in (0, 1)").select(
        "doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("draw")
    )
    chosen = sample.select("draw").orderBy("draw").limit(fit_rows).agg(F.max("draw").alias("last")).first().last
    sample = materialise(sample.where(F.col("draw") <= (chosen if chosen is not None else 0)))
    for_terms = sample.where("draw % 2 = 0").select("text", "toxic")
    totals = {r.toxic: r["count"] for r in for_terms.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    counts = map_batches(for_terms, _terms, "term string, n_toxic bigint, n_other bigint")
    summed = counts.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))
    ratio = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n_other") + 0.5) / (n_other + 1))
    # The heaviest by weight times root of frequency, at most max_terms rows for the driver.
    best = summed.where(F.col("n_toxic") >= LEAST_DOCS).where(ratio >= LEAST_WEIGHT)
    rows = best.orderBy(F.desc(ratio * F.sqrt("n_toxic")), "term").limit(max_terms).collect()
    model = Model(_weights(rows, n_toxic, n_other), (0.0, 0.0, 0.0))
    points = weights_of(sample.where("draw % 2 <> 0").select("doc_id", "text", "toxic"), model, ("toxic",)).collect()
    y = np.array([p.toxic for p in points], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(model.weights, (math.log(share / (1 - share)), 0.0, 0.0))
    x = np.array([inputs(p.weight, p.n_words) for p in points])
    return Model(model.weights, _logistic(x, y))


def weights_of(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, weight and n_words; the model is at most MAX_TERMS terms."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    out = list(dict.fromkeys(["doc_id", *carry]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = handle.value.automaton()
        for batch in batches:
            pairs = [weigh(folded(t.as_py()), automaton) for t in batch.column("text")]
            arrays = [pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, out), *arrays], [*out, "weight", "n_words"])

    rows = docs.select(*dict.fromkeys([*out, "text"]))
    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out]
    return map_batches(rows, work, ", ".join([*schema, "weight double, n_words bigint"]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (score >= 0.5), and the carried columns.

    A null or empty text has no matches and gets the lowest score.  Rows are independent:
    repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    others = tuple(c for c in carry if c not in ("doc_id", "text"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others)
    weighed = weights_of(source, model, carry)
    a, b, c = model.coefficients
    line = a + b * F.log1p("weight") + c * F.log1p(100 * F.col("weight") / F.greatest("n_words", F.lit(1)))
    value = 1 / (1 + F.exp(-line))
    return weighed.select(*dict.fromkeys(["doc_id", *carry]), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever they are called.

    Null and empty texts have no matches and are judged by the intercept; repeated rows are kept
    or dropped together; an empty table gives an empty one.
    """
    apart, back = set_aside(docs, "doc_id", "text")
    kept = score(apart, model, carry=("text", *back)).where("predicted = 0")
    return kept.drop("score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """One document in five is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labels of documents that are not held out.

    Labels without an id or a mark are left out; of several for one id the highest counts.  Rows
    without an id are not learned from, repeated ones count repeatedly.  Without labelled rows the
    lexicon is empty.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(~held_out()).join(marks, "doc_id")
    return fit(rows)
