"""Operator 11: filter interaction audit by min-plus removal ranks.

A document is known by the set of filters that it fails, a bit mask.  For each order of the
filters, the filter that removes it is the first of the order that it fails.  As matrices: a row
of the mask matrix has 0 for a failed filter and infinity for another, a column of the position
matrix is the inverse permutation of an order, and their product with minimum for the sum and
addition for the product holds every mask's removal step in every order.  The steps then drive
weighted scatter counts: what a step removes, what is left, what it would have removed again.

Documents are counted per mask before they meet the orders, so the product is of masks and
orders and its size does not depend on the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches
from vigipanel.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"
# The limits of the five quality filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
CELL = "array<struct<mask:int,docs:bigint,good:bigint,toxic:bigint>>"
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
NEVER = 1 << 30


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product of (masks x filters), 0 where it fails and NEVER elsewhere, and
    (filters x orders), each filter's step: the step that removes a mask, NEVER or more if none."""
    steps = np.full((len(fails), positions.shape[1]), NEVER)
    for cost, position in zip(fails.T, positions):
        np.minimum(steps, cost[:, None] + position[None, :], out=steps)
    return steps


def orders_of(n: int) -> np.ndarray:
    """All orders of n filters, a row each."""
    return np.array([*itertools.permutations(range(n))]).reshape(-1, n)


def tally(masks: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """(orders x steps) counts of one part from its masks and their (documents, good, toxic)."""
    n_orders, n = orders.shape
    fails = (masks[:, None] >> np.arange(n)) & 1 == 1
    positions = np.argsort(orders, axis=1).T + 1
    steps = removal_steps(np.where(fails, 0, NEVER), positions)
    cell, order = np.nonzero(steps < NEVER)
    lost = np.zeros((n_orders, n, weights.shape[1]), np.int64)
    np.add.at(lost, (order, steps[cell, order] - 1), weights[cell])
    removed = lost[:, :, 0]
    failing = (fails * weights[:, :1]).sum(0)
    alone = (fails * weights[:, :1])[fails.sum(1) == 1].sum(0)
    credit = np.zeros(n, np.int64)
    np.add.at(credit, orders, removed)
    return {
        "kept": weights[:, 0].sum() - removed.cumsum(1),
        "removed": removed,
        "redundant": failing[orders] - removed,
        "unique_fails": alone[orders],
        "good_lost": lost[:, :, 1],
        "toxic_lost": lost[:, :, 2],
        "shapley": credit[orders],
    }


def _audited(names: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = orders_of(len(names))
        labels = ["".join(names[f] for f in order) for order in orders]
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                masks = np.array([c["mask"] for c in cells])
                weights = np.array([[c["docs"], c["good"], c["toxic"]] for c in cells], np.int64)
                found = tally(masks, weights, orders)
                step = np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))
                head = [pa.array([part] * len(step)), pa.array(np.repeat(labels, len(names))), pa.array(step)]
                counts = [pa.array(found[c].ravel()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*head, *counts], ["part", "filter_order", "step", *COUNTS])

    return work


def audit(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from (part, mask, docs, good, toxic).

    Bit i of a mask says that filter names[i], one letter, fails.  Counts are of documents:
    kept after the step, removed by it, redundant (failing its filter but removed before),
    unique_fails (failing its filter alone), good and toxic ones removed by it, and shapley,
    its filter's removals summed over all orders.  Every part has all rows, with zeros where
    nothing happens; an empty table gives an empty one.  A part has at most 2^filters masks.
    """
    sums = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))
    by_part = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).cast(CELL).alias("cells"))
    return map_batches(by_part, _audited(names), AUDIT)


def text_flags(text: Column, words: Column) -> list[Column]:
    """The filters that look at one text: too short, too repetitive, too many capitals, signs."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(SIGNS),
    ]


def document_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, docs, good, toxic) of the five filters of `FILTERS` over all documents.

    E fails where a row with a smaller id has the same text, in any part.  A null text is an
    empty one, a null part the empty string.  Rows of one id are not each other's copies, and
    each counts; a row without an id copies nothing, is no original and has no labels.  A
    document is good or toxic if any of its label rows says 1.  Other columns are ignored.

    Equal rows are added up before anything is joined, and copies of a text once more before
    their smallest id is looked up, so that no key gathers the rows of a hot text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.array_remove(F.split(text, BLANKS), "").alias("words"),
    )
    bits = text_flags(F.col("text"), F.col("words"))
    mask = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))
    rows = split.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
    rows = rows.groupBy("doc_id", "part", "mask", "key").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    marked = named.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    group = ["key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # The first of a group is its smallest id with the number of its rows.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    texts = materialise(marked.groupBy(*group).agg(first, nameless, F.sum("n").alias("n")))
    origin = texts.groupBy("key").agg(F.min("first.doc_id").alias("origin"), F.sum("n").alias("times")).where("times > 1").drop("times")
    joined = texts.join(origin, "key", "left")
    originals = F.col("nameless") + F.when(F.col("origin").isNull() | (F.col("first.doc_id") == F.col("origin")), F.col("first.n")).otherwise(0)
    originals = F.coalesce(originals, F.col("nameless"))
    copy = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask"), originals.alias("docs")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - originals).alias("docs")),
    )
    cells = joined.select("part", "good", "toxic", F.explode(both).alias("cell")).where("cell.docs > 0")
    good, toxic = (F.when(F.col(c), F.col("cell.docs")).otherwise(0).alias(c) for c in ("good", "toxic"))
    return cells.select("part", F.col("cell.mask").alias("mask"), F.col("cell.docs").alias("docs"), good, toxic)


def oracle_sql() -> str:
    """The audit of `documents` by `labels` in SQL, masks first and then orders."""
    place = ", ".join(f"case when {c} then strpos(filter_order, '{c}') else 9 end" for c in FILTERS)
    own = " ".join(f"when '{c}' then {c}" for c in FILTERS)
    alone = " + ".join(f"cast({c} as int)" for c in FILTERS)
    five = ", ".join(f"('{c}')" for c in FILTERS)
    return rf"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as o from d),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
m as (select part, len(w) < {LEAST_WORDS} as A, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) as B,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) as C,
    regexp_matches(t, '{SIGNS}') as D, coalesce(doc_id > o, false) as E,
    coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l using (doc_id)),
cells as (select part, A, B, C, D, E, {alone} as fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from m group by all),
f as (select * from (values {five}) x(f)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = {len(FILTERS)}),
ranked as (select *, least({place}) as rank from cells, orders),
credit as (select part, substr(filter_order, rank, 1) as name, sum(n) as shapley from ranked where rank < 9 group by all),
steps as (select *, substr(filter_order, step, 1) as name from ranked, (select unnest(range(1, {len(FILTERS) + 1})) as step)),
tested as (select *, case name {own} end as failing from steps),
counted as (select part, filter_order, cast(step as int) as step, name, coalesce(sum(n) filter (rank > step), 0) as kept,
    coalesce(sum(n) filter (rank = step), 0) as removed, coalesce(sum(n) filter (failing and rank < step), 0) as redundant,
    coalesce(sum(n) filter (failing and fails = 1), 0) as unique_fails, coalesce(sum(good) filter (rank = step), 0) as good_lost,
    coalesce(sum(toxic) filter (rank = step), 0) as toxic_lost from tested group by all)
select part, filter_order, step, {', '.join(f'cast({c} as bigint) as {c}' for c in COUNTS[:-1])},
    cast(coalesce(shapley, 0) as bigint) as shapley from counted left join credit using (part, name)"""
