"""Operator 13: nearest neighbours by multi-index hashing of learned binary codes.

A vector's code has a bit for each of a few hundred directions: is the centred unit vector on its
positive side?  The directions are learned on a bounded sample: its principal axes, rotated so
that the projections lie as near to the corners of a cube as they can (iterative quantisation),
with several such rotations where a vector has fewer dimensions than the code has bits.

Codes are split into substrings of one byte and each block of vectors keeps an index of every
substring: the codes in order of that byte, and where each value starts.  By the pigeonhole
principle a code within m * t + j - 1 bits of the query's, m substrings, has a substring within
t bits if it is one of the first j, or within t - 1 if not.  So a query probes the substrings at
distance 0, 1, 2 ... one after another, and after each probe knows every code within a radius
that has grown by one.  It stops when that radius holds enough different codes, and ranks the
vectors behind all of them by their cosine in double precision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches
from vigipanel.llm.vector_blocks import BLOCK, blocks_for, met, numbers, packed, sets_for, valid_rows
from vigipanel.session import materialise

# Least bits of a code (a vector of many dimensions has two for each), vectors that it is learned
# from, different codes a query looks at in a block.
BITS, SAMPLE, POOL = 192, 4096, 96
# Queries of a block, and rounds of the rotation's fit.
QUERIES, ROUNDS = 256, 10
MODEL = "dims int, mean binary, directions binary"
INDEXED = BLOCK + ", codes binary, places binary, members binary, starts binary"
FOUND = "query_id bigint, query_alt bigint, vec_id bigint, score double"


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; parts of any size neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def learn(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions by column) by iterative quantisation of a sample of unit vectors."""
    bits = -(-max(bits, 2 * sample.shape[1]) // 64) * 64
    mean = sample.mean(0)
    z = sample - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :bits]
    y, out = z @ axes, []
    for turn in range(-(-bits // axes.shape[1])):
        rotation = np.linalg.qr(np.random.default_rng(turn).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(y @ rotation > 0, 1.0, -1.0).T @ y)
            rotation = (u @ v).T
        out.append(axes @ rotation)
    return mean, np.hstack(out)[:, :bits]


def codes_of(vectors: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ directions > 0, axis=1)


@functools.lru_cache(maxsize=1)
def rings() -> list[np.ndarray]:
    """The byte masks of 0, 1, ... 8 bits."""
    return [np.flatnonzero(np.bitwise_count(np.arange(256)) == t).astype(np.uint8) for t in range(9)]


class Index:
    """The different codes of a block, each substring's values in order, and who has a code."""

    def __init__(self, codes: np.ndarray, places: np.ndarray, members: np.ndarray, starts: np.ndarray):
        self.codes, self.places, self.members, self.starts = codes, places, members, starts

    @classmethod
    def of(cls, codes: np.ndarray) -> Index:
        different, back = np.unique(codes, axis=0, return_inverse=True)
        places = np.argsort(different, axis=0, kind="stable").T.astype("<i4")
        in_order = np.take_along_axis(different.T, places, 1)
        starts = np.stack([np.searchsorted(row, np.arange(257)) for row in in_order]).astype("<i4")
        return cls(different, places, np.asarray(back).reshape(-1).astype("<i4"), starts)

    @classmethod
    def read(cls, row: dict) -> Index:
        whole = lambda c: np.frombuffer(row[c], "<i4")
        m = len(row["starts"]) // 4 // 257
        codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, m)
        return cls(codes, whole("places").reshape(m, -1), whole("members"), whole("starts").reshape(m, 257))

    def within(self, asked: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each code asked, the members of every code within the least radius that holds
        `enough` codes, or of all codes if there are no more.

        All codes asked go through the probes together; those that have enough leave.
        """
        (n, m), q, top = self.codes.shape, len(asked), 8 * self.codes.shape[1]
        own, words = (np.ascontiguousarray(np.ascontiguousarray(x).view("<u8").T) for x in (self.codes, asked))
        # By query and code in one row of numbers, a power of two for each query.
        shift = (n - 1).bit_length()
        seen = np.zeros(q << shift, bool)
        distance = np.full(q << shift, top + 1, np.int16)
        # How many codes seen so far are at each distance.
        counts = np.zeros((q, top + 1), np.int64)
        limit, active = np.full(q, top), np.arange(q)
        for t, masks in enumerate(rings()):
            for j in range(m):
                values = (asked[active, j][:, None] ^ masks).astype(np.int64).ravel()
                begin = self.starts[j].take(values)
                size = self.starts[j].take(values + 1) - begin
                total = int(size.sum())
                if total:
                    # A query's hits in one bucket after another: places of the index, then the query's own numbers.
                    hit = np.repeat(begin - np.concatenate([[0], size[:-1].cumsum()]), size)
                    hit += np.arange(total)
                    place = np.repeat(active << shift, size.reshape(len(active), -1).sum(1))
                    place += self.places[j].take(hit)
                    place = place.compress(~seen.take(place))
                    seen[place] = True
                    row, hit = place >> shift, place & ((1 << shift) - 1)
                    apart = sum(np.bitwise_count(word.take(hit) ^ other.take(row)).astype(np.int64) for word, other in zip(own, words))
                    distance[place] = apart
                    counts += np.bincount(row * (top + 1) + apart, minlength=counts.size).reshape(counts.shape)
                # Complete up to here: each substring but the first j + 1 was probed to t - 1.
                radius = m * t + j
                whole = counts[active].sum(1) == n
                done = whole | (counts[active, : radius + 1].sum(1) >= enough)
                for i in active[done & whole]:
                    limit[i] = np.searchsorted(counts[i].cumsum(), min(enough, n))
                limit[active[done & ~whole]] = radius
                active = active[~done]
                if not len(active):
                    return [np.flatnonzero(near[self.members]) for near in distance.reshape(q, -1)[:, :n] <= limit[:, None]]
        return [np.flatnonzero(near[self.members]) for near in distance.reshape(q, -1)[:, :n] <= limit[:, None]]


def _learned(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            mean, directions = learn(units(np.stack(held)), bits)
            row = [[key], [mean.astype("<f8").tobytes()], [directions.astype("<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["dims", "mean", "directions"])

        for batch in batches:
            for dims, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if dims != key:
                    if held:
                        yield done()
                    key, held = dims, []
                held.append(numbers(data, dims))
        if held:
            yield done()

    return work


def learned(rows: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """(dims, mean, directions), from at most `sample` vectors of each length: those with the least hash."""
    order = Window.partitionBy("dims").orderBy(F.xxhash64("alt"), "vec_id")
    drawn = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    dealt = drawn.select("dims", "vector").repartition("dims").sortWithinPartitions("dims", "vector")
    return materialise(map_batches(dealt, _learned(bits), MODEL))


def _vectors(row: dict) -> np.ndarray:
    """A block's unit vectors."""
    return units(numbers(row["vectors"], row["n"] * row["dims"]).reshape(-1, row["dims"]))


def _codes(row: dict) -> np.ndarray:
    """The codes of a block that has its model beside it."""
    directions = np.frombuffer(row["directions"], "<f8").reshape(row["dims"], -1)
    return codes_of(_vectors(row), np.frombuffer(row["mean"], "<f8"), directions)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in BLOCK.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.slice(i, 1)
            codes = pa.array([_codes(own.to_pylist()[0]).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), codes], [*names, "codes"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in BLOCK.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.slice(i, 1)
            index = Index.of(_codes(own.to_pylist()[0]))
            made = [index.codes, index.places, index.members, index.starts]
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in made]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), *arrays], [*names, "codes", "places", "members", "starts"])


def build_index(rows: DataFrame, n_blocks: Column, models: DataFrame) -> DataFrame:
    """Every row's code in the index of its block."""
    return materialise(map_batches(packed(rows, n_blocks).join(models, "dims"), _indexed, INDEXED))


def nearest(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the k nearest of `rows`, but for the query's own."""
    rows = rows[ids[rows] != own]
    # Row by row in one order, so that equal vectors have equal scores.
    scores = np.einsum("ij,j->i", vectors[rows], query)
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[best]], scores[best]


def _searched(k: int, pool: int):
    def work(asked: list[dict], blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in asked:
            own, alts = (np.frombuffer(row[c], "<i8") for c in ("ids", "alts"))
            codes = np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1)
            held.append((_vectors(row), codes, own, alts, [(np.zeros(0, np.int64), np.zeros(0))] * row["n"]))
        for row in blocks:
            index, ids, vectors = Index.read(row), np.frombuffer(row["ids"], "<i8"), _vectors(row)
            for queries, codes, own, _, best in held:
                for i, near in enumerate(index.within(codes, pool)):
                    found = nearest(vectors, ids, queries[i], own[i], near, k)
                    both, scores = (np.concatenate(x) for x in zip(best[i], found))
                    first = np.lexsort((both, -scores))[:k]
                    best[i] = both[first], scores[first]
        for _, _, own, alts, best in held:
            sizes = [len(ids) for ids, _ in best]
            out = [np.repeat(own, sizes), np.repeat(alts, sizes), *(np.concatenate(x) for x in zip(*best))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "query_alt", "vec_id", "score"])

    return work


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    bits: int = BITS,
    pool: int = POOL,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    per_block: int | None = None,
) -> DataFrame:
    """Each query's k nearest rows found, by cosine: query_id, rank (from 1), vec_id, score.

    `queries` is a condition on vec_id; a row of the query's id is no candidate for it.  Ties
    go to the smaller id.  With fewer candidates than k, all of them are returned.  Vectors
    that are null, empty, zero, or hold null or non-finite parts take no part, nor do rows without an
    id; vectors meet those of their own length only.  Repeated rows are one.  A table without
    queries gives an empty result.  Other columns are ignored, so their names can't clash.

    Every row is indexed, from a code learned on a bounded sample.  A query looks at every code
    within the least radius that holds `pool` different codes of a block, and at all rows of
    those, so copies take no one's place; with `pool` codes or fewer in a block, all are looked at
    and the result is exact.
    """
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("label"), F.col(vector_col).alias("embedding"))
    given = source.where("vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)")
    rows = materialise(valid_rows(given))
    asked = rows.where(queries)
    n_rows, n_asked = rows.count(), asked.count()
    in_rows, in_asked = blocks_for(n_rows, per_block), blocks_for(n_asked, per_block or QUERIES)
    models = learned(rows, bits, sample)
    index = build_index(rows, in_rows, models)
    # Queries are stored with their codes: a model can be larger than the block beside it.
    questions = materialise(map_batches(packed(asked, in_asked).join(models, "dims"), _asked, BLOCK + ", codes binary"))
    found = met(index, in_rows, questions, sets_for(n_asked, in_asked), _searched(k, pool), FOUND)
    order = Window.partitionBy("query_id", "query_alt").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
