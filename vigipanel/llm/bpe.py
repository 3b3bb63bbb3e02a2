"""Operator 9: byte-level BPE by prefix dynamic programming, and back to bytes.

For every prefix of a piece there is exactly one token that can end it: the last token of the
prefix's own encoding.  Storing that token per prefix gives the encoding of any prefix by
walking back, makes an append exact (earlier entries never change) and lets an edit keep all
entries before it.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import ChunkCache, keep, latin_pattern, map_batches

TOKENS = "doc_id bigint, ids array<int>"
DECODED = TOKENS + ", bytes binary"
# Caches are kept under this name between tasks.
OWNER = "byte-level BPE"
NEVER = 1 << 60
# Entries of a generation of the caches, of pieces and of neighbours: a task has a worker that
# encodes and one that decodes, beside those that earlier operators have left idle.
PIECES = CACHE_ENTRIES = 200_000


class Vocabulary:
    """The tokens of a rank file, and which of them may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.size = {i: len(token) for i, token in self.tokens.items()}
        self.longest = max(self.size.values(), default=1)
        # Finds the tokens that end at each place, longest first; bytes stand as Latin-1.
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        # Known neighbours, in two generations.
        self.pairs: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self._spines: dict[int, tuple[list, list] | None] = {}

    def merges(self, data: bytes) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
        """The definition of BPE: merge the neighbours of lowest rank, leftmost first.

        Returns the parts that are left and the merges made, in order.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        made = []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            made.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def spines(self, token: int) -> tuple[list, list] | None:
        """How a token grows at its two edges: (part, rank of the merge that takes the part),
        from the single byte to the token itself, at its left and at its right edge.

        None if merging can't make the token, or if it makes a part that ranks above a later
        one; such tokens are left to the definition.
        """
        if token not in self._spines:
            parts, made = self.merges(self.tokens[token])
            ranks = [self.ranks[a + b] for a, b in made]
            if len(parts) > 1 or ranks != sorted(ranks):
                self._spines[token] = None
            else:
                made_by = {a + b: (a, b) for a, b in made}
                edges = []
                for side in (0, 1):
                    spine, part = [(parts[0], NEVER)], parts[0]
                    while part in made_by:
                        rank, part = self.ranks[part], made_by[part][side]
                        spine.append((part, rank))
                    edges.append(spine[::-1])
                self._spines[token] = (edges[0], edges[1])
        return self._spines[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two.

        They do unless, at some moment of the merging, the parts on both sides of the border
        merge with each other before either is taken by its own token.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.older.get(key)
            if known is None:
                known = self._fits(left, right)
            if len(self.pairs) >= CACHE_ENTRIES:
                self.older = dict(self.pairs)
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def forget(self) -> None:
        self.pairs.clear()
        self.older = {}

    def _fits(self, left: int, right: int) -> bool:
        a, b = self.spines(left), self.spines(right)
        if a is None or b is None:
            return self.merges(self.tokens[left] + self.tokens[right])[0] == [self.tokens[left], self.tokens[right]]
        a, b, i, j, ranks = a[1], b[0], 0, 0, self.ranks
        while True:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            rank = ranks.get(x + y, NEVER)
            if rank < x_taken and rank <= y_taken and rank != NEVER:
                return False
            if x_taken == y_taken == NEVER:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def stands_alone(self, token: int) -> bool:
        """Whether merging can make this token at all."""
        return self.spines(token) is not None or len(self.merges(self.tokens[token])[0]) == 1


class Prefixes:
    """One piece of text with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = array("q")
        self.append(data)

    def append(self, data: bytes) -> None:
        """Lengthen the piece; the entries so far hold."""
        at = len(self.data)
        self.data += data
        own, last = self.vocabulary, self.last
        size, known, adjacent = own.size, own.pairs.get, own.adjacent
        text, done = self.data.decode("latin-1"), at - 1
        for end, token in own.ends.iter(text, max(0, at - own.longest)):
            if end <= done:
                continue
            before = end - size[token]
            if before < 0:
                fits = own.stands_alone(token)
            else:
                fits = known(last[before] << 32 | token)
                if fits is None:
                    fits = adjacent(last[before], token)
            if fits:
                last.append(token)
                done = end
        if len(last) != len(text):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace bytes start..end; the entries before `start` are kept."""
        rest = bytes(self.data[end:])
        del self.data[start:], self.last[start:]
        self.append(data + rest)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes (of all, if None)."""
        end = len(self.data) if end is None else end
        out, size = [], self.vocabulary.size
        while end:
            out.append(self.last[end - 1])
            end -= size[out[-1]]
        return out[::-1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkCache:
    """Ids of a chunk as int32 bytes: its matches of the pattern, each encoded apart.

    A match that is itself a token is that token; else the prefix table gives the ids.
    """
    import regex

    own, matches, latin = vocabulary(path), regex.compile(pattern).findall, latin_pattern(pattern)

    def word(piece: str) -> bytes:
        data = piece.encode()
        whole = own.ranks.get(data)
        return array("i", [whole] if whole is not None else Prefixes(own, data).tokens()).tobytes()

    cache = ChunkCache(matches, word, latin and latin.findall, PIECES)
    for held in (cache, own):
        keep(OWNER, held.forget)
    return cache


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ids of every whole text, in any order.

    A null or empty text has no ids.  Rows are independent: repeated rows and null ids are
    passed on as they are, an empty table gives an empty one, other columns are ignored.  A text of
    any length is encoded whole.  Ids are whole numbers or text of them; the cast of
    another id fails.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(path, pattern)
        for batch in batches:
            coded = [b"".join(cache.values_of(text.as_py() or "")) for text in batch.column(1)]
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), work, TOKENS, OWNER)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the bytes they stand for; null ids give no bytes, an unknown id fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(path).__getitem__
        for batch in batches:
            column = batch.column(1)
            ids, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
            data = [b"".join(map(token, ids[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            arrays = [batch.column(0), batch.column(1), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "bytes"])

    return map_batches(tokens.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids"), work, DECODED, OWNER)


def digests(decoded: DataFrame) -> DataFrame:
    """n_tokens, and SHA-256 of the decimal ids and of the decoded bytes, per document."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
