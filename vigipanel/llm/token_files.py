"""Operator 3: token ids in binary shards with Elias-Fano document boundaries.

A token file is a Parquet folder, so that Spark's committer writes it and a lost executor's
shards are simply written again.  Each row is one shard:

    part, seq     place in the order of documents
    part_start    ids before this shard within its part
    n_ids         ids in the shard
    doc_ids       the documents, in order
    payload       "TIDS", bytes of an id (2 or 4), length of the boundary code, Elias-Fano code
                  of the end of every document, then the ids, little-endian, in one array
"""

from __future__ import annotations

import functools
import os
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigipanel.llm.common import BEYOND_LATIN, ChunkCache, keep, latin_pattern, map_batches
from vigipanel.llm.elias_fano import EliasFano

# Caches are kept under this name between tasks.
OWNER = "token files"
MAGIC = struct.Struct("<4sBQ")
# A shard is closed at this many ids; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
SHARD = "part int, seq int, part_start bigint, n_ids bigint, doc_ids array<bigint>, payload binary"
DOCUMENT = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids binary"


# The library's byte alphabet: printable bytes stand for themselves, the others for the
# characters from 256 on, in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}
# Of printable ASCII only the space has another character.
SPACE = chr(BYTE_CHARS[32])
# Entries of a generation of the cache of pieces.
PIECES = 600_000


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkCache:
    """Ids of a chunk as little-endian uint32 bytes, by the tokenizers library.

    Texts of Latin letters are cut here as the library cuts them; other chunks it cuts itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # a special token's name in a text is ordinary text
    latin = latin_pattern(public_tokenizers.PATTERN)
    matches, model = (latin or regex.compile(public_tokenizers.PATTERN)).findall, library.model

    def split(text: str) -> list[str]:
        return [text] if BEYOND_LATIN.search(text) else matches(text)

    def encode(piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", SPACE)
        elif not BEYOND_LATIN.search(piece):
            mapped = piece.encode().decode("latin-1").translate(BYTE_CHARS)
        else:
            return array("I", library.encode(piece, add_special_tokens=False).ids).tobytes()
        return array("I", [t.id for t in model.tokenize(mapped)]).tobytes()

    cache = ChunkCache(split, encode, latin and latin.findall, PIECES)
    keep(OWNER, cache.forget)
    return cache


def pack_shard(ids: list[bytes]) -> bytes:
    """One shard from the documents' ids (uint32 bytes)."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    code = EliasFano.of(ends, int(ends[-1])).to_bytes()
    array = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(array) or array.max() < 1 << 16 else 4
    return MAGIC.pack(b"TIDS", width, len(code)) + code + array.astype(f"<u{width}").tobytes()


class Shard:
    """A shard read back: `ids(i)` selects one document without decoding the others."""

    def __init__(self, payload: bytes):
        magic, width, n_code = MAGIC.unpack_from(payload)
        if magic != b"TIDS":
            raise ValueError("not a token shard")
        start = MAGIC.size + n_code
        self.ends = EliasFano.from_bytes(payload[MAGIC.size : start])
        self.array = np.frombuffer(payload, f"<u{width}", offset=start)

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.array[self.start(i) : self.ends.select(i)]


def _shards(path: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, ids = [], []

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [before], [held], [docs], [pack_shard(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "part_start", "n_ids", "doc_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = b"".join([*cache.values_of(text.as_py() or ""), end])
                if docs and held + len(coded) // 4 > SHARD_IDS:
                    yield shard()
                    seq, before, held, docs, ids = seq + 1, before + held, 0, [], []
                docs.append(doc)
                ids.append(coded)
                held += len(coded) // 4
        if docs:
            yield shard()

    return work


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> None:
    """Encode every whole text and write the ids in ascending order of the document id.

    A null or empty text gives the end id alone.  Documents without an id come first; rows of
    equal ids keep the order of the input.  Ids are whole numbers or text of them.  Other columns are ignored; an empty table gives
    an empty folder of shards.  Texts are dealt by ranges of (id, place in the input), so rows
    of one id do not meet in one task, and are tokenised once, after the only shuffle.
    """
    ordered = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    dealt = ordered.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    map_batches(dealt.select("doc_id", "text"), _shards(tokenizer, end_id), SHARD, OWNER).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, before, doc_ids, payload = (batch.column(c)[row].as_py() for c in range(4))
            shard = Shard(payload)
            ends = shard.ends.all().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            flat = shard.array.astype("<u4").tobytes()
            ids = [flat[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts + before),
                    pa.array(ends - starts),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, and ids
    as little-endian unsigned 32-bit integers.

    Where a part starts follows from the sums of the parts before it; there are no more of
    them than tasks that wrote, so that table is small whatever the data.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = map_batches(shards.select("part", "part_start", "doc_ids", "payload"), _documents, DOCUMENT, OWNER)
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )
