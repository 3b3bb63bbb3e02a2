"""Operator 5: embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: after a random rotation the dimensions
are cut into three blocks with CODES random unit vectors each, and every triple is a direction,
so a vector's best directions are list-decoded from 3 * CODES inner products.  A vector's caps
are the `caps` directions nearest to it, in each of `ROTATIONS` independent codes; vectors that
share a cap meet there and are verified by their cosine in double precision.  The number of
directions grows with the number of vectors, so a cap holds few unrelated ones; finer directions
part near vectors sooner, so a vector's caps grow too, by `caps_for`.  How many directions and
caps a length of vectors needs besides is measured before: `settings_for` draws pairs at exactly the
wanted cosine and takes the cheapest setting in which every one of them meets.  It knows the
length, the cosine and the number of vectors, and nothing of the vectors themselves.

Within a cap nothing is paired off in rows: a task holds at most two chunks of a cap's
members, compares them as matrices, counts each link in its first common cap only, and
returns one row per member.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches
from vigipanel.llm.components import components
from vigipanel.session import materialise, small_side

BLOCKS, ROTATIONS, CAPS = 3, 3, 12
# Vectors up to which CAPS are enough; beyond, caps grow with the cube root of the vectors.
CAPS_ENOUGH_FOR = 50_000
# Pairs that must all meet, and the nearest directions of a vector that are tried for it.
PAIRS, TRIED = 1000, 256
# What shipping a vector to a cap costs, in comparisons.
SHIPPING = 50
# Bits of a direction's number; above them stand the length and the rotation.
DIRECTION_BITS = 44
# Members of a cap that are compared as one matrix; larger caps are cut into chunks.
CHUNK = 1024
NODE = "vec_id bigint, node binary, dims int, vector binary"
SETTINGS = "dims int, n_codes int, n_caps int"
FILTERED = "node binary, copies bigint, dims int, vector binary, caps array<bigint>"
COUNTED = "node binary, links bigint, root binary"


def packed(vector: list | None) -> bytes | None:
    """A vector's bytes, in single precision where that loses nothing; None if it is null or
    zero, or has null or non-finite parts."""
    if not vector or None in vector:
        return None
    v = np.asarray(vector, np.float64) + 0.0  # makes -0.0 and 0.0 one
    if not np.isfinite(v).all() or not v.any():
        return None
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return (single if (single == v).all() else v.astype("<f8")).tobytes()


def unit(data: bytes, dims: int) -> np.ndarray:
    """The vector at length one, in double precision."""
    v = np.frombuffer(data, "<f8" if len(data) == 8 * dims else "<f4").astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [v.as_py() for v in batch.column(1)]
        data = [packed(v) for v in vectors]
        node = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
        dims = [None if d is None else len(v) for v, d in zip(vectors, data)]
        arrays = [pa.array(node, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["vec_id", "node", "dims", "vector"])


@functools.lru_cache(maxsize=64)
def code(dims: int, codes: int, rotation: int) -> list[np.ndarray]:
    """For each block, a matrix from a vector to its inner products with the block's codes."""
    rng = np.random.default_rng([dims, codes, rotation])
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    out = []
    for block in np.array_split(np.arange(dims), min(BLOCKS, dims)):
        words = rng.normal(size=(codes, len(block)))
        out.append(turn[:, block] @ (words / np.linalg.norm(words, axis=1)[:, None]).T)
    return out


@functools.lru_cache(maxsize=64)
def corner(width: int, height: int, caps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two falling lists whose sum can be among the `caps` largest."""
    return np.nonzero(np.outer(np.arange(1, width + 1), np.arange(1, height + 1)) <= caps)


def nearest_directions(scores: list[np.ndarray], codes: int, caps: int) -> np.ndarray:
    """List decoding: the `caps` best sums of one score from each block, best-first pruned.

    Only sums of prefixes that are themselves among the best can be among the best.
    """
    total, name = np.zeros(1), np.zeros(1, np.int64)
    for score in scores:
        best = np.argsort(-score, kind="stable")[:caps]
        i, j = corner(len(total), len(best), caps)
        sums = total[i] + score[best][j]
        names = name[i] * codes + best[j]
        keep = np.argsort(-sums, kind="stable")[:caps]
        total, name = sums[keep], names[keep]
    return name


def caps_for(n_vectors: int, caps: int = CAPS) -> int:
    """Caps of a vector in each rotation, by the number of vectors."""
    return math.ceil(caps * max(1.0, n_vectors / CAPS_ENOUGH_FOR) ** (1 / 3))


def codes_for(n_vectors: int, caps: int) -> int:
    """Codes of a block: directions in proportion to the places, so that a cap's load stays the same."""
    return max(16, round((n_vectors * caps / 3) ** (1 / BLOCKS)))


def caps_of(vector: np.ndarray, codes: int, caps: int) -> np.ndarray:
    dims = len(vector)
    out = []
    for rotation in range(ROTATIONS):
        scores = [vector @ block for block in code(dims, codes, rotation)]
        out.append(nearest_directions(scores, codes, caps) + (dims * ROTATIONS + rotation << DIRECTION_BITS))
    return np.sort(np.concatenate(out))


def pairs_at(least: float, dims: int, pairs: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors in pairs whose cosine is `least`."""
    rng = np.random.default_rng([dims, pairs, seed])
    a, b = rng.normal(size=(2, pairs, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if dims == 1:
        return a, a
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    return a, least * a + math.sqrt(max(0.0, 1 - least * least)) * b


def caps_needed(a: np.ndarray, b: np.ndarray, codes: int, tried: int) -> np.ndarray:
    """For each pair of rows, with how many caps a rotation they first share one; beyond
    `tried`, infinity."""
    needed = np.full(len(a), np.inf)
    for rotation in range(ROTATIONS):
        blocks = code(a.shape[1], codes, rotation)
        scores_a, scores_b = [a @ m for m in blocks], [b @ m for m in blocks]
        for i in range(len(a)):
            left, right = (nearest_directions([x[i] for x in scores], codes, tried) for scores in (scores_a, scores_b))
            _, at, to = np.intersect1d(left, right, assume_unique=True, return_indices=True)
            if len(at):
                needed[i] = min(needed[i], np.maximum(at, to).min() + 1)
    return needed


@functools.lru_cache(maxsize=256)
def settings_for(dims: int, n_vectors: int, least: float, caps: int = CAPS) -> tuple[int, int]:
    """(codes, caps) for the vectors of one length.

    Fewer directions part fewer pairs and hold more strangers each.  From the finest on, the
    directions become fewer until comparing would cost more; with few enough, every vector
    is in every cap, so there always is a setting.
    """
    floor = caps_for(n_vectors, caps)
    tried = max(TRIED, 2 * floor)
    a, b = pairs_at(least, dims, PAIRS)
    codes, best = codes_for(n_vectors, floor), (math.inf, 0, 0)
    while codes >= 1:
        needed = caps_needed(a, b, codes, tried).max()
        if needed < math.inf:
            own = max(floor, int(needed))
            cost = own * (SHIPPING + n_vectors * min(1.0, own / codes ** min(BLOCKS, dims)))
            if cost >= best[0]:
                break
            best = cost, codes, own
        codes = codes * 3 // 5
    code.cache_clear()
    return best[1:]


def _settings(least: float, caps: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("dims").to_pylist(), batch.column("n").to_pylist())
            found = [settings_for(dims, n, least, caps) for dims, n in sizes]
            arrays = [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("dims"), *arrays], ["dims", "n_codes", "n_caps"])

    return work


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("vector", "dims", "n_codes", "n_caps")))
        found = [caps_of(unit(data, dims), codes, caps) for data, dims, codes, caps in rows]
        names = ["node", "copies", "dims", "vector"]
        cols = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.int64()))], [*names, "caps"])


def compare(cap: int, chunks: np.ndarray, units: np.ndarray, caps: list[np.ndarray], copies: np.ndarray, least: float, cross: bool):
    """Links of one cap: for each member the linked vectors first met here, and its least
    member reachable by this cap's links."""
    near = units @ units.T >= least
    np.fill_diagonal(near, False)
    if cross:
        near &= chunks[:, None] != chunks[None, :]
    links, labels = np.zeros(len(units), np.int64), np.arange(len(units))
    a, b = np.nonzero(np.triu(near))
    if not len(a):
        return links, labels
    width = max(map(len, caps))
    table = np.full((len(units), width), -1, np.int64)
    for i, own in enumerate(caps):
        earlier = own[own < cap]
        table[i, : len(earlier)] = earlier
    used = max(1, int((table >= 0).sum(1).max()))
    table = table[:, :used]
    step = max(1, min(4096, 2**23 // used**2))
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        left = table[i]
        met = ((left[:, :, None] == table[j][:, None, :]) & (left >= 0)[:, :, None]).any((1, 2))
        i, j = i[~met], j[~met]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
    while True:
        least_near = np.where(near, labels[None, :], len(labels)).min(1)
        new = np.minimum(labels, least_near)
        new = new[new]
        if (new == labels).all():
            return links, labels
        labels = new


def _compare(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            chunks = np.array([r["chunk"] for r in held])
            cross = held[0]["low"] != held[0]["high"]
            units = np.stack([unit(r["vector"], r["dims"]) for r in held])
            copies = np.array([r["copies"] for r in held], np.int64)
            caps = [np.asarray(r["caps"], np.int64) for r in held]
            links, labels = compare(held[0]["cap"], chunks, units, caps, copies, least, cross)
            out = [i for i in range(len(held)) if links[i] or labels[i] != i]
            if out:
                rows = [[held[i]["node"] for i in out], [int(links[i]) for i in out], [held[labels[i]]["node"] for i in out]]
                kinds = [pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["node", "links", "root"])

        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cap", "low", "high"))))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                if keys[start] != key:
                    yield from done()
                    key, held = keys[start], []
                held += batch.slice(start, end - start).to_pylist()
        yield from done()

    return work


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    caps: int = CAPS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors of one length whose cosine is at least `least` are linked.  Null or zero vectors
    and those with null or non-finite parts are linked with nothing.  Equal vectors are one
    node that counts its rows.  Rows without an id take part; they are kept only if no row of
    their component has an id.  An empty table gives an empty one; other columns are ignored.
    A cosine of exactly `least` links.  Ids are whole numbers or text of them; the cast of
    another id fails.
    """
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = materialise(map_batches(source, _nodes, NODE))
    valid = rows.where("node is not null")
    nodes = materialise(
        valid.groupBy("node").agg(F.min("vec_id").alias("own_id"), F.count("*").alias("copies"), F.min("dims").alias("dims"), F.min("vector").alias("vector"))
    )
    sizes = nodes.groupBy("dims").agg(F.count("*").alias("n"))
    settings = small_side(map_batches(sizes, _settings(least, caps), SETTINGS))
    filtered = map_batches(nodes.select("node", "copies", "dims", "vector").join(settings, "dims"), _filters, FILTERED)
    counted = materialise(_verified(materialise(filtered), least, chunk))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(counted.selectExpr("node a", "root b"))
    named = nodes.join(found, "node").groupBy("component").agg(F.min("own_id").alias("component_id"))
    joined = found.join(named, "component").select("node", F.col("component_id").alias("joined_id"))
    table = nodes.select("node", "own_id", "copies").join(links, "node", "left").join(joined, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    linked = valid.select("vec_id", "node").join(table, "node").select(
        "vec_id", n_links.alias("n_links"), F.coalesce("joined_id", "own_id").alias("component_id")
    )
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)


def _verified(filtered: DataFrame, least: float, chunk: int) -> DataFrame:
    """Members of every cap with two or more, dealt by chunk pairs and compared."""
    places = filtered.select("node", F.explode("caps").alias("cap"))
    loads = places.groupBy("cap").count().where("count > 1")
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    places = places.join(loads, "cap").select("cap", "node", chunks.alias("chunks"))
    places = places.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # A chunk meets every chunk of its cap, itself included, in a group of its own.
    places = places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = places.select("cap", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node")
    dealt = keyed.join(filtered, "node").repartition("cap", "low", "high").sortWithinPartitions("cap", "low", "high")
    return map_batches(dealt, _compare(least), COUNTED)
