"""Operator 12: hard negatives by a BOND vertical scan.

A block holds its vectors by dimension.  For an anchor the dimensions are read in descending
order of the anchor's magnitudes, and each row's partial score is kept.  What the dimensions
not yet read can add lies between sums of least and greatest contributions, from the block's
minimum and maximum in each dimension.  A row leaves the candidate bitmap when these bounds
show that it can't be among the results any more, by the block's own rows or by those that a task
has already found in other blocks; rows that stay to the end have exact scores.

Two scans use this.  The first finds each anchor's positives, the best rows of its label.  The
second looks below each positive: the best rows of other labels whose score lies in a window
relative to the positive's.  Parts are whole numbers, so scores and windows are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.llm.vector_blocks import blocks_for, met, numbers, packed, sets_for, valid_rows
from vigipanel.session import materialise

# Anchors of a block, and dimensions read between two looks at the bounds.
ANCHORS, STRIP = 256, 8
# Candidates that are no longer looked at window by window.
FEW = 64
POSITIVE = "anchor_id bigint, anchor_alt bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "anchor_id bigint, anchor_alt bigint, place int, negative_id bigint, negative_score bigint"
NOTHING = np.zeros(0, np.int64), np.zeros(0)


class Columns:
    """A block's vectors by dimension, with its ids and labels; rows are sorted by label and id."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.ids, self.labels, self.alts = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "alts"))
        self.rows = numbers(row["vectors"], n * dims).reshape(n, dims)
        self.columns = np.ascontiguousarray(self.rows.T)
        self.low, self.high = self.columns.min(1), self.columns.max(1)
        self.length = longest(self.rows)

    @functools.cached_property
    def single(self) -> np.ndarray:
        return self.columns.astype(np.float32)


def longest(rows: np.ndarray) -> float:
    return float(np.sqrt((rows * rows).sum(1).max()))


def bounds_of(falling: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the dimensions from a place on can add, at the least and at the most, by place."""
    ends, none = (falling * low, falling * high), np.zeros((*falling.shape[:-1], 1))
    least, most = (np.concatenate([x[..., ::-1].cumsum(-1)[..., ::-1], none], -1) for x in (np.minimum(*ends), np.maximum(*ends)))
    return least, most


class Scan:
    """One anchor's way through the dimensions of a block."""

    # Dimensions already read, the scores so far of the rows from `start` on; rows before and after the first look.
    read, head, start, given, left = 0, None, 0, 0, 0

    def __init__(self, anchor: np.ndarray, block: Columns):
        self.anchor, self.block, self.columns = anchor, block, block.columns
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        self.least, self.most = bounds_of(anchor[self.order], block.low[self.order], block.high[self.order])

    def run(self, rows: np.ndarray | None, shrink) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of what `shrink(scores so far, least rest, most rest)` keeps to the end;
        None for all rows that the scan has begun on."""
        if self.head is None:
            scores = np.zeros(len(rows))
        else:
            scores = self.head if rows is None else self.head[rows - self.start]
            keep = np.flatnonzero(shrink(scores, float(self.least[self.read]), float(self.most[self.read])))
            self.given, self.left = len(scores), len(keep)
            rows, scores = keep + self.start if rows is None else rows[keep], scores[keep]
        for at in range(self.read, len(self.order), STRIP):
            if not len(rows):
                break
            strip = self.order[at : at + STRIP]
            # While most rows are candidates, whole columns are read rather than gathered.
            if 2 * len(rows) < self.columns.shape[1]:
                scores += self.anchor[strip] @ self.columns[strip[:, None], rows]
            else:
                scores += (self.anchor[strip] @ self.columns[strip])[rows]
            end = at + len(strip)
            keep = shrink(scores, float(self.least[end]), float(self.most[end]))
            if not keep.all():
                rows, scores = rows[keep], scores[keep]
        return rows, scores


class Pace:
    """How many dimensions are read before the first look."""

    def __init__(self):
        self.strips, self.given, self.left = None, 0, 0

    def read(self, dims: int) -> int:
        """More where the last looks have left many rows, fewer where hardly any; not all."""
        last = max(0, (dims - 1) // STRIP)
        if self.strips is None:
            self.strips = 3 * last // 4
        self.strips = min(max(0, self.strips + int(32 * self.left > self.given) - int(256 * self.left < self.given)), last)
        self.given = self.left = 0
        return self.strips * STRIP


class Anchors:
    """A block of anchors, sorted by label, with their orders of the dimensions.

    A look at the first few dimensions lets no row go.  So these are read without one, for all
    anchors at once: as a product of matrices, in which an anchor has only its own greatest
    dimensions.  How many they are follows from how many rows the first look has left before, in
    all scans of a task.
    """

    def __init__(self, row: dict, pace: Pace):
        n, dims = row["n"], row["dims"]
        self.ids, self.labels, self.alts = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "alts"))
        self.rows = numbers(row["vectors"], n * dims).reshape(n, dims)
        self.length, self.pace = longest(self.rows), pace
        self.order = np.argsort(-np.abs(self.rows), axis=1, kind="stable").astype(np.int32)
        self.falling = np.take_along_axis(self.rows, self.order, 1)

    def scans(self, block: Columns, same: bool) -> Iterator[tuple[int, Scan]]:
        """Each anchor's place and scan, begun on the rows of its label or on those of all others."""
        order, falling, read = self.order, self.falling, self.pace.read(self.rows.shape[1])
        least, most = bounds_of(falling, block.low[order], block.high[order])
        # Whole numbers are exact in single precision as far as no sum of some dimensions can reach 2^24.
        columns = block.single if self.length * block.length < 2**24 else block.columns
        rows = self.rows.astype(columns.dtype)
        most_first = np.zeros_like(rows)
        np.put_along_axis(most_first, order[:, :read], falling[:, :read].astype(columns.dtype), 1)
        labels, begin = np.unique(self.labels, return_index=True)
        ranges = [(a, b, *np.searchsorted(block.labels, [label, label + 1])) for label, a, b in zip(labels, begin, [*begin[1:], len(rows)])]
        if not same:
            heads = most_first @ columns
            for a, b, start, end in ranges:
                heads[a:b, start:end] = -np.inf
        for a, b, start, end in ranges:
            own = most_first[a:b] @ columns[:, start:end] if same else heads[a:b]
            for i in range(a, b):
                scan = object.__new__(Scan)
                scan.anchor, scan.block, scan.columns, scan.order = rows[i], block, columns, order[i]
                scan.least, scan.most = least[i], most[i]
                scan.read, scan.head, scan.start = read, own[i - a], start if same else 0
                yield i, scan
                self.pace.given += scan.given
                self.pace.left += scan.left


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def better(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of (ids, scores)."""
    if not len(other[0]):
        return one
    ids, scores = (np.concatenate(x) for x in zip(one, other))
    best = first(scores, ids, k)
    return ids[best], scores[best]


def bar_of(held: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """What a score must reach to be among the k best with those held."""
    return float(held[1][-1]) if len(held[1]) == k else -np.inf


def best_of_label(scan: Scan, own: int, label: int, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's k best rows of the label that reach the bar, but for the anchor's own."""
    block = scan.block
    rows = np.arange(*np.searchsorted(block.labels, [label, label + 1]))
    rows = rows[block.ids[rows] != own]

    def shrink(scores, least, most):
        if bar > -np.inf:
            return scores >= bar - most
        if len(scores) <= k:
            return np.ones(len(scores), bool)
        return scores >= float(np.partition(scores, -k)[-k]) + least - most  # k rows reach this for sure

    rows, scores = scan.run(rows, shrink)
    if not len(rows):
        return NOTHING
    best = first(scores, block.ids[rows], k)
    return block.ids[rows[best]], scores[best]


def best_in_windows(scan: Scan, windows: list[tuple[int, int]], bars: list[float], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (low, high), the (ids, scores) of the k best rows of the scan that are within and
    reach its bar."""
    block = scan.block
    ranges = [(float(max(low, bar)), float(high)) for (low, high), bar in zip(windows, bars)]
    open_ = [r for r in ranges if r[0] <= r[1]]
    if not open_:
        return [NOTHING] * len(windows)
    lowest, highest = min(r[0] for r in open_), max(r[1] for r in open_)
    settled = min(bars) > -np.inf

    def shrink(scores, least, most):
        keep = (scores >= lowest - most) & (scores <= highest - least)
        if settled or keep.sum() <= FEW:
            return keep
        keep = np.zeros(len(scores), bool)
        for low, high in open_:
            into = (scores >= low - most) & (scores <= high - least)
            sure = scores[(scores >= low - least) & (scores <= high - most)]
            if len(sure) > k:
                into &= scores >= float(np.partition(sure, -k)[-k]) + least - most
            keep |= into
        return keep

    rows, scores = scan.run(None, shrink)
    out = [NOTHING] * len(windows)
    for place, (low, high) in enumerate(ranges if len(rows) else []):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        if len(inside):
            best = inside[first(scores[inside], block.ids[rows[inside]], k)]
            out[place] = block.ids[rows[best]], scores[best]
    return out


def _columns(parts: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *p]).astype(np.int64)).cast(k) for p, k in zip(parts, kinds)], names)


def _positives(k: int):
    def work(asked: list[dict], blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        pace = Pace()
        held = [(Anchors(row, pace), [NOTHING] * row["n"]) for row in asked]
        for block in map(Columns, blocks):
            for anchors, best in held:
                for i, scan in anchors.scans(block, same=True):
                    found = best_of_label(scan, anchors.ids[i], anchors.labels[i], k, bar_of(best[i], k))
                    best[i] = better(best[i], found, k)
        for anchors, best in held:
            sizes = [len(ids) for ids, _ in best]
            out = [[np.repeat(anchors.ids, sizes)], [np.repeat(anchors.alts, sizes)], *map(list, zip(*best))]
            yield _columns(out, [pa.int64()] * 4, ["anchor_id", "anchor_alt", "positive_id", "positive_score"])

    return work


def _negatives(k: int, low: int, high: int):
    def windows_of(row: dict, anchors: Anchors) -> list[list[tuple[int, int]]]:
        """Whole scores s with low * p <= 100 * s <= high * p, in whole numbers."""
        score_of = {(r["id"], r["alt"]): r["scores"] for r in row["bars"]}
        scores = (score_of.get(key) or [] for key in zip(anchors.ids.tolist(), anchors.alts.tolist()))
        return [[(-(-low * p // 100), high * p // 100) for p in own] for own in scores]

    def work(asked: list[dict], blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held, pace = [], Pace()
        for row in asked:
            windows = windows_of(row, anchors := Anchors(row, pace))
            held.append((anchors, windows, [[NOTHING] * len(w) for w in windows]))
        for block in map(Columns, blocks):
            for anchors, windows, best in held:
                for i, scan in anchors.scans(block, same=False):
                    if windows[i]:
                        found = best_in_windows(scan, windows[i], [bar_of(b, k) for b in best[i]], k)
                        best[i] = [better(*both, k) for both in zip(best[i], found)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for anchors, _, best in held:
            lists = [(i, place, *b) for i, own in enumerate(best) for place, b in enumerate(own)]
            whose, places, ids, scores = map(list, zip(*lists)) if lists else [[]] * 4
            sizes, whose = [len(x) for x in ids], np.array(whose, np.int64)
            out = [[np.repeat(anchors.ids[whose], sizes)], [np.repeat(anchors.alts[whose], sizes)], [np.repeat(np.array(places, np.int64), sizes)], ids, scores]
            yield _columns(out, kinds, ["anchor_id", "anchor_alt", "place", "negative_id", "negative_score"])

    return work


def _ranked(df: DataFrame, group: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k of each group; a task keeps k of each before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    per_block: int | None = None,
) -> DataFrame:
    """A row per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    `anchors` is a condition on vec_id.  A part x counts as floor(scale * x), a score is the
    inner product; ties go to the smaller id.  An anchor's positives are its best rows of the
    same label; a positive's negatives are the best rows of other labels with
    low * positive <= 100 * negative <= high * positive, ranked from 1.

    Rows with a null id, label, vector or part, or a part that is not finite, take no part;
    vectors are scored against those of their own length only (an empty one scores 0 with other empty
    ones).  Repeated rows are one; rows of the anchor's id are not its positives.  Scores are
    exact below 2^53.  Tables without anchors or without other labels give no rows.  Other
    columns are ignored, so their names can't clash.

    A set of anchors and a team of row blocks are a group and give at most `positives` (times
    `negatives`) rows per anchor, so no label or vector is hot.
    """
    source = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("embedding")
    ).where("vec_id is not null and label is not null")
    rows = materialise(valid_rows(source, scale))
    asked = rows.where(anchors)
    n_rows, n_asked = rows.count(), asked.count()
    in_rows, in_asked = blocks_for(n_rows, per_block), blocks_for(n_asked, per_block or ANCHORS)
    blocks, questions = materialise(packed(rows, in_rows)), materialise(packed(asked, in_asked))

    sets = sets_for(n_asked, in_asked)
    found = met(blocks, in_rows, questions, sets, _positives(positives), POSITIVE)
    key = ["anchor_id", "anchor_alt"]
    best = _ranked(found, key, [F.desc("positive_score"), F.asc("positive_id")], positives, "nth")
    best = materialise(best.withColumn("place", F.col("nth") - 1))

    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
    bars = best.groupBy(*key).agg(scores.alias("scores"))
    block = F.pmod(F.xxhash64(*key), in_asked).cast("int").alias("block")
    dims = asked.select(F.col("vec_id").alias("anchor_id"), F.col("alt").alias("anchor_alt"), "dims").distinct()
    bars = bars.join(dims, key).select("dims", block, F.struct(F.col("anchor_id").alias("id"), F.col("anchor_alt").alias("alt"), "scores").alias("bar"))
    # As many entries as a block has anchors.
    bars = bars.groupBy("dims", "block").agg(F.collect_list("bar").alias("bars"))
    with_bars = materialise(questions.join(bars, ["dims", "block"]))

    hard = met(blocks, in_rows, with_bars, sets, _negatives(negatives, low, high), NEGATIVE)
    hard = _ranked(hard, [*key, "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives, "rank")
    return best.join(hard, [*key, "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
