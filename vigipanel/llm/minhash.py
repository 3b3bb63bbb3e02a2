"""Operator 2: near-duplicates by one-permutation hashing, banded buckets and stars.

Documents with equal shingle sets are one node.  A node's shingle hashes are cut into BINS
ranges; the least hash of each range is its signature, and empty ranges borrow from a fixed
random order of the others (optimal densification).  ROWS bins make a band and nodes with an
equal band share a bucket: two sets of similarity 0.85 miss each other in all 32 bands with
probability (1 - 0.85 ** 5) ** 32 < 1e-8.

In a bucket, members are compared with one centre, the one that shares the most buckets with
others, so pairs grow with members and not with their square.  A star alone would lose a link
whose ends are both far from the centre.  So a second round takes other centres where a bucket
still holds several components, and of what is left every pair of different components is looked
at: in buckets of a FEW members as it stands, among the members of larger ones by an exact join,
for sets of the threshold's similarity must share a shingle among the rarest few of both, at
places that leave room for the overlap.

Each set has PARITY bits: whether an odd or even number of its shingles falls on each.  Where two
sets' bits differ, so do the sets, and at least in so many shingles.  Pairs that differ too much by
their bits are left out in the join itself, so a large group of texts that are nearly, but not
quite, similar enough does not make all of its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches
from vigipanel.llm.components import components
from vigipanel.session import materialise, small_side

BINS, ROWS = 160, 5
EDGES = (np.arange(BINS + 1, dtype=np.float64) / BINS * 2.0**64)[1:-1].astype(np.uint64)
STAR_ROUNDS = 2
# Bits of a set, and the members of a bucket that are paired as they stand.
PARITY, FEW = 1024, 32
SKETCH = "doc_id bigint, alt bigint, n_shingles bigint, node binary, bands array<bigint>"
SHINGLES = "doc_id bigint, alt bigint, node binary, n bigint, parity array<bigint>, shingles array<bigint>"
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

# Characters that are taken apart at a time, a longer text at once; longer words are hashed one by one.
GROUP_CHARS, LONG_WORD = 1 << 18, 128
ASCII_BLANK = bytes(c in b" \t\n\r\x0b\x0c" for c in range(256))
# The first bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs between blanks start and end."""
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edges[::2], edges[1::2]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the bytes of each span, eight bytes of all spans at a time; those of long spans one by one."""
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    hashes, at, left = size.astype(np.uint64), 0, np.flatnonzero((size > 0) & (size <= LONG_WORD))
    while len(left):
        part = eight[starts[left] + at] & FIRST[np.minimum(size[left] - at, 8)]
        hashes[left] = mixed(hashes[left] * ODD[0] + part * ODD[1])
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of about GROUP_CHARS characters together."""
    first = chars = 0
    for i, text in enumerate(texts, 1):
        chars += len(text or "")
        if chars >= GROUP_CHARS or i == len(texts):
            yield first, i
            first, chars = i, 0


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mixed(total * ODD[0] + words[i : i + n] * ODD[1])
    return total


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Of each text the rising distinct 64-bit hashes of its word shingles, empty without words.

    Lower-case A-Z, words between ASCII blanks; a text of fewer words is one shingle.
    """
    for first, last in groups(texts):
        parts = [(text or "").encode() for text in texts[first:last]]
        data = b"\n".join(parts).lower()
        starts, ends = spans(np.frombuffer(data.translate(ASCII_BLANK), np.bool_))
        words = span_hashes(data, starts, ends)
        whole = _shingles(words, size) if len(words) >= size else words[:0]
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(part) + 1 for part in parts)])).tolist()
        for a, b in zip(bounds, bounds[1:]):
            own = np.sort(whole[a : b - size + 1] if b - a >= size else _shingles(words[a:b], b - a) if a < b else words[:0])
            yield own[np.append(True, own[1:] != own[:-1])[: len(own)]]


@functools.lru_cache(maxsize=1)
def borrow_order() -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    rng = np.random.default_rng(2017)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def signature_of(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a rising, non-empty set."""
    first = np.concatenate([[0], np.searchsorted(shingles, EDGES)])
    filled = np.diff(np.concatenate([first, [len(shingles)]])) > 0
    signature = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = borrow_order()[empty]
        donor = order[np.arange(len(empty)), filled[order].argmax(1)]
        signature[empty] = signature[donor]
    return signature


def bands_of(signatures: list[np.ndarray]) -> np.ndarray:
    """Band hashes, a row for each signature."""
    rows = np.array(signatures, np.uint64).reshape(len(signatures), BINS // ROWS, ROWS)
    total = np.tile(np.arange(BINS // ROWS, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        total = mixed(total * ODD[2] + rows[:, :, i] * ODD[3])
    return total


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits in words of 64: whether an odd number of the hashes falls on each."""
    count = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _sketch(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, node, signatures = [], [], []
            for shingles in shingle_sets(batch.column(2).to_pylist(), size):
                count.append(len(shingles))
                node.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                if len(shingles):
                    signatures.append(signature_of(shingles))
            found = iter(bands_of(signatures).view(np.int64))
            bands = [next(found) if n else None for n in count]
            arrays = [pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["doc_id", "alt", "n_shingles", "node", "bands"]
            )

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingle_sets(batch.column(2).to_pylist(), size)]
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            lists = [pa.array(of, pa.list_(pa.int64())) for of in ([*map(parity_of, sets)], [s.view(np.int64) for s in sets])]
            arrays = [pa.array(node, pa.binary()), pa.array([*map(len, sets)], pa.int64()), *lists]
            names = ["doc_id", "alt", "node", "n", "parity", "shingles"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return work


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold; `pairs` is a stored table."""
    # Up to a bound only the sets that a pair needs are shuffled.
    wanted = small_side(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = sets.select("node", "shingles").join(wanted, "node", "left_semi")
    for end in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    # 100 * both >= percent * union, with the union spelt out, so that the intersection is made once.
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where((100 + percent) * both >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _comparable(percent: int):
    """Sets of too different sizes can't be similar."""
    return f"100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)"


def _alike(percent: int):
    """Nor can sets whose bits differ in more places than similar sets have shingles of their own."""
    differ = "aggregate(zip_with(parity, centre_parity, (x, y) -> bit_count(x ^ y)), 0, (total, x) -> total + x)"
    return f"{100 + percent} * (n + centre_n - {differ}) >= {2 * percent} * (n + centre_n)"


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar by their bits."""
    ends = sets.select(F.col("node").alias("a"), "n", "parity")
    pairs = pairs.join(ends, "a").join(ends.toDF("b", "centre_n", "centre_parity"), "b")
    return pairs.where(_alike(percent)).select("a", "b")


def _star_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """One pair per member at most: with a bucket's centre from another component.

    The first centres are the members with the most company over all their buckets, the
    later ones are drawn.
    """
    rank = -F.col("company") if turn == 0 else F.xxhash64("node", F.lit(turn))
    centre = F.min(F.struct(rank.alias("rank"), "node", "component", "n")).alias("centre")
    stars = members.groupBy("bucket").agg(centre).select(
        "bucket",
        F.col("centre.rank").alias("rank"),
        F.col("centre.node").alias("centre"),
        F.col("centre.component").alias("centre_component"),
        F.col("centre.n").alias("centre_n"),
    )
    pairs = members.join(stars, "bucket").where(F.col("component") != F.col("centre_component")).where(_comparable(percent))
    best = F.min(F.struct("rank", "centre")).alias("best")
    return pairs.groupBy(F.col("node").alias("a")).agg(best).select("a", F.col("best.centre").alias("b"))


def _remaining_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that share a bucket and can still be similar.

    Buckets of up to FEW members are joined with themselves, so pairs grow with members; of the
    larger ones only pairs that shared shingles leave possible are looked at.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    sized = materialise(members.select("bucket", "node", "n", "component").join(sizes, "bucket"))
    few = sized.where(F.col("size") <= FEW).drop("size").join(sets.select("node", "parity"), "node")
    centres = few.select("bucket", *(F.col(c).alias(f"centre_{c}") for c in ("node", "n", "component", "parity")))
    once = F.col("centre_node") < F.col("node")
    apart = F.col("component") != F.col("centre_component")
    pairs = few.join(centres, "bucket").where(once & apart).where(_comparable(percent)).where(_alike(percent))
    pairs = pairs.select(F.col("centre_node").alias("a"), F.col("node").alias("b"))
    nodes = sized.where(F.col("size") > FEW).select("node", "n", "component").distinct()
    if not nodes.isEmpty():
        pairs = pairs.unionByName(_rarest_pairs(nodes, sets, percent))
    return pairs.distinct()


def _rarest_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components among `nodes` that can be similar by their rarest shingles.

    Shingles are put in one order: first those that a single component has, then by their
    frequency among the nodes.  With the common part of two sets at least `need` long, their
    first common shingle has at least that many behind it in both, so each set is entered under
    its first few shingles only, and under none that its component has for itself: those are
    only counted.  Under a shingle, the nodes outside its main component are paired with all others.
    """
    shingles = nodes.join(sets, "node").select("node", F.xxhash64("component").alias("part"), F.explode("shingles").alias("shingle"))
    spread = (F.count("*").alias("times"), F.min("part").alias("low"), F.max("part").alias("high"))
    known = shingles.groupBy("shingle").agg(*spread).where("low <> high").select("shingle", "times")
    ordered = (
        shingles.select("node", "shingle").join(known, "shingle")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("rarest"))  # one text's shingles
    )
    before = F.col("n") - F.size("rarest")
    first = F.slice("rarest", F.lit(1), F.greatest(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - before, F.lit(0)).cast("int"))
    entries = nodes.join(ordered, "node").select("node", "n", "component", before.alias("before"), F.posexplode(first).alias("place", "entry"))
    place = (F.col("before") + F.col("place")).alias("place")
    entries = materialise(entries.select("node", "n", "component", place, "entry.shingle"))
    sizes = entries.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    marked = entries.join(main.where("parts > 1").select("shingle", F.col("main.component").alias("main")), "shingle")
    marked = marked.join(sets.select("node", "parity"), "node")
    centres = marked.where("component <> main").select(
        "shingle",
        F.col("node").alias("centre"),
        F.col("component").alias("centre_component"),
        F.col("n").alias("centre_n"),
        F.col("place").alias("centre_place"),
        F.col("parity").alias("centre_parity"),
    )
    once = (F.col("component") == F.col("main")) | (F.col("centre") < F.col("node"))
    apart = F.col("component") != F.col("centre_component")
    room = F.least(F.col("n") - F.col("place"), F.col("centre_n") - F.col("centre_place"))
    fits = room * (100 + percent) >= (F.col("n") + F.col("centre_n")) * percent
    pairs = centres.join(marked, "shingle").where(apart & once & fits).where(_comparable(percent)).where(_alike(percent))
    return pairs.select(F.col("centre").alias("a"), F.col("node").alias("b"))


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    spread = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(spread.where("low <> high").select("bucket"), "bucket")


def _in_company(banded: DataFrame) -> DataFrame:
    """Members of the buckets with others, and how many others all their buckets hold."""
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(banded.join(sizes, "bucket"))
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    return materialise(shared.drop("size").join(company, "node"))


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Rows whose `size`-word shingle sets have a Jaccard similarity of at least `percent` / 100
    are linked; component_id is the smallest id reachable and kept says that it is the row's
    own.  A text without words is linked with nothing.  Rows of one id count as one document,
    so all of them are kept or none.  Rows without an id take part; they are kept only if no
    row of their component has an id.  An empty table gives an empty one; other columns are ignored.
    A text of any length is taken whole; a similarity of exactly the threshold links.  Ids are whole
    numbers or text of them; the cast of another id fails.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("alt"),
        F.col(text_col).alias("text"),
    )
    sketched = materialise(map_batches(rows, _sketch(size), SKETCH))
    filled = sketched.where("n_shingles > 0")
    nodes = materialise(
        filled.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("alt").alias("alt"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")
        )
    )
    found = _node_components(rows, nodes, size, percent)
    named = nodes.select("node", "doc_id").join(found, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = found.join(named, "component").select("node", F.col("component_id").alias("joined_id"))
    own = nodes.select("node", F.col("doc_id").alias("own_id")).join(joined, "node", "left")
    component = F.coalesce("joined_id", "own_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    with_words = filled.join(own, "node").select("doc_id", "n_shingles", component.alias("component_id"))
    without = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).withColumn("kept", kept)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates, with all columns: of each component the one with
    the smallest id.  Repeated rows leave one row.  A row without an id goes by a stand-in made
    of its text, above all real ids, so of a group without ids one text stays.
    """
    stand_in = F.lit(1 << 62) + F.abs(F.xxhash64("text") % (1 << 61))
    marked = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), stand_in), "_text": F.xxhash64("text")})
    found = near_duplicates(marked.select(F.col("_id").alias("doc_id"), "text"), size, percent)
    kept = materialise(found.where("kept").select(F.col("doc_id").alias("_id")).distinct())
    return marked.join(kept, "_id", "left_semi").dropDuplicates(["_id", "_text"]).select(*docs.columns)


def _node_components(rows: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that are linked with another."""
    banded = nodes.select(F.explode("bands").alias("bucket"), "node", "n", F.col("node").alias("component"))
    members = _in_company(banded)
    own = members.select("node").distinct().join(nodes.select("node", "doc_id", "alt"), "node")
    sets = materialise(_shingle_sets(rows, own, size))
    links, found = nodes.selectExpr("node a", "node b").limit(0), None
    for turn in range(STAR_ROUNDS + 1):
        if members.isEmpty():
            break
        last = turn == STAR_ROUNDS
        pairs = _remaining_pairs(members, sets, percent) if last else _close(_star_pairs(members, turn, percent), sets, percent)
        links = links.unionByName(materialise(linked(materialise(pairs), sets, percent)))
        found = components(links)
        if not last:
            named = members.drop("component").join(found, "node", "left")
            members = materialise(_mixed_buckets(named.withColumn("component", F.coalesce("component", "node"))))
    return components(links) if found is None else found


def _shingle_sets(rows: DataFrame, own: DataFrame, size: int) -> DataFrame:
    """The sets of the given nodes, from one document each (by id, or by text where it has none).

    Up to a bound the ids are broadcast, so that the texts need not be shuffled.
    """
    ids = small_side(own.where("doc_id is not null").select("doc_id").distinct())
    alts = small_side(own.where("doc_id is null").select("alt").distinct())
    by_id = rows.where("doc_id is not null").join(ids, "doc_id", "left_semi")
    by_text = rows.where("doc_id is null").join(alts, "alt", "left_semi")
    sets = map_batches(by_id.unionByName(by_text, allowMissingColumns=True).select("doc_id", "alt", "text"), _sets(size), SHINGLES)
    wanted = own.select("node").distinct()
    return sets.drop("doc_id", "alt").join(wanted, "node", "left_semi").dropDuplicates(["node"])
