"""Vectors in blocks of bounded size, and a set of queries in blocks against all of them.

A block is one row: the ids, labels and values of its vectors as binary columns.  Blocks are
dealt by a hash of their rows, so work is dealt evenly whatever the vectors or labels are.  Where
queries meet rows, a task holds a set of query blocks while a team of row blocks passes by.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches

# A block holds at most about this many vectors, fewer of long ones.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
# Teams have a block each up to this many, then more of them up to TEAM_BLOCKS; a set of queries is
# held in about so many bytes, in double precision.
TEAMS, TEAM_BLOCKS, HELD_BYTES = 24, 32, 32 << 20
# Partitions that teams are dealt to, at most.
MOST_PARTITIONS = 4096
ROW = "vec_id bigint, label bigint, alt bigint, dims int, vector binary"
BLOCK = "dims int, block int, n int, ids binary, labels binary, alts binary, vectors binary"


def narrow(v: np.ndarray) -> np.ndarray:
    """Single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return single if (single == v).all() else v.astype("<f8")


def numbers(data: bytes, n: int) -> np.ndarray:
    """n values in double precision, from single or double ones."""
    return np.frombuffer(data, "<f8" if n and len(data) == 8 * n else "<f4").astype(np.float64)


def rows_of(scale: float | None):
    """Finite vectors as bytes; with a scale, each part becomes floor(scale * part)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, data, alt = [], [], [], []
            for i, vector in enumerate(batch.column(2).to_pylist()):
                if vector is None or None in vector:
                    continue
                v = np.asarray(vector, np.float64) + 0.0
                if not np.isfinite(v).all():
                    continue
                packed = narrow(v if scale is None else np.floor(scale * v)).tobytes()
                keep.append(i)
                dims.append(len(v))
                data.append(packed)
                alt.append(xxhash.xxh3_64_intdigest(packed))
            taken = [batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)]
            rest = [pa.array(np.array(alt, np.uint64).view(np.int64)), pa.array(dims, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*taken, *rest], ["vec_id", "label", "alt", "dims", "vector"])

    return work


def valid_rows(vectors: DataFrame, scale: float | None = None) -> DataFrame:
    """(vec_id, label, alt, dims, vector) of the vectors without null or non-finite parts;
    repeated rows are one."""
    return map_batches(vectors, rows_of(scale), ROW).dropDuplicates(["vec_id", "label", "alt", "dims"])


def block_rows(dims: str = "dims") -> F.Column:
    """How many vectors of this length make a block."""
    return F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col(dims), F.lit(1))))))


def blocks_for(n: int, per_block=None) -> F.Column:
    """The number of blocks for n vectors."""
    return F.ceil(F.lit(float(max(n, 1))) / (block_rows() if per_block is None else F.lit(per_block))).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []

    def done() -> pa.RecordBatch:
        ids, labels, alts, vectors = zip(*held)
        joined = narrow(np.concatenate([numbers(v, key[0]) for v in vectors]))
        whole = lambda x: np.array(x, "<i8").tobytes()
        row = [[key[0]], [key[1]], [len(held)], [whole(ids)], [whole([0 if x is None else x for x in labels])], [whole(alts)], [joined.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["dims", "block", "n", "ids", "labels", "alts", "vectors"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("dims", "block", "vec_id", "label", "alt", "vector")]
        for dims, block, *row in zip(*columns):
            if (dims, block) != key:
                if held:
                    yield done()
                key, held = (dims, block), []
            held.append(row)
    if held:
        yield done()


def packed(rows: DataFrame, n_blocks: F.Column) -> DataFrame:
    """Blocks of the rows, dealt by a hash of id and values; inside, rows are sorted by label and id."""
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "alt"), n_blocks).cast("int"))
    dealt = numbered.repartition("dims", "block").sortWithinPartitions("dims", "block", "label", "vec_id", "alt")
    return map_batches(dealt.select("dims", "block", "vec_id", "label", "alt", "vector"), _packed, BLOCK)


def sets_for(n: int, n_blocks: F.Column) -> F.Column:
    """The number of sets that n queries in so many blocks are held in."""
    needed = F.ceil(F.lit(8.0 * n / HELD_BYTES) * F.col("dims"))
    return F.least(n_blocks, F.greatest(F.lit(1), needed)).cast("int")


def teams_for(n_blocks: F.Column) -> F.Column:
    """The number of teams of so many row blocks."""
    return F.least(n_blocks, F.greatest(F.lit(TEAMS), F.ceil(n_blocks / F.lit(TEAM_BLOCKS)))).cast("int")


def _meeting(work: Callable[[list[dict], Iterator[dict]], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for _, group in itertools.groupby(records, lambda r: (r["dims"], r["team"], r["held"])):
            asked: list[dict] = []
            for side, part in itertools.groupby(group, lambda r: r["side"]):
                if side == 0:
                    asked = list(part)
                elif asked:
                    yield from work(asked, part)

    return run


def met(
    rows: DataFrame, n_rows: F.Column, queries: DataFrame, n_sets: F.Column,
    work: Callable[[list[dict], Iterator[dict]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """What `work(blocks of queries, blocks of rows)` makes of every block of queries and every
    block of rows of the same length of vectors.

    It is called once for each set and team, and gets the set as a list and the team's blocks one
    at a time.  Rows are dealt once for each set and queries once for each team.  There is no join:
    the planner would take the copies of a block for one, and broadcast them all.
    """
    teams = teams_for(n_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = queries.withColumn("held", F.pmod("block", n_sets)).withColumn("team", each(teams)).withColumn("side", F.lit(0))
    passing = rows.withColumn("held", each(n_sets)).withColumn("team", F.pmod("block", teams)).withColumn("side", F.lit(1))
    # Long vectors have the most blocks.  Twice as many partitions as groups, so that few hold several.
    groups = rows.agg(F.max("dims").alias("dims")).select(teams * n_sets).first()[0] or 1
    key = ["dims", "team", "held"]
    dealt = asked.unionByName(passing, allowMissingColumns=True).repartition(min(2 * groups, MOST_PARTITIONS), *key)
    return map_batches(dealt.sortWithinPartitions(*key, "side", "block"), _meeting(work), schema)
