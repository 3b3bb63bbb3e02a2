"""What the operators share: reading tables, Arrow batches, chunk-wise token caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vigipanel.session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of an Arrow batch, and the rows of it that an operator works on at a time.
BATCH_BYTES = "8m"
SLICE_ROWS = 256

# Entries of a generation of a cache; it holds two at most, so that memory stays bounded.
CACHE_ENTRIES = 400_000
# Longer chunks are not worth keeping: they hardly ever come back.
CACHE_CHARS = 40
# Letters, digits and blanks below this character are the same in every Unicode version.
LATIN = "\u0250"
BEYOND_LATIN = re.compile(f"[^\x00-{chr(ord(LATIN) - 1)}]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What worker processes keep between the tasks of one operator, by its name: how to let go of it.
_KEPT: dict[str, list[Callable[[], None]]] = {}


def keep(owner: str, forget: Callable[[], None]) -> None:
    """Note that this process holds something of an operator, and how to forget it."""
    _KEPT.setdefault(owner, []).append(forget)


def leave_to(owner: str) -> None:
    """Forget what other operators have left in this process: its memory is `owner`'s now."""
    others = [forget for name, forgets in _KEPT.items() if name != owner for forget in forgets]
    for forget in others:
        forget()
    if others:
        pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = ""
) -> DataFrame:
    """`mapInArrow` with the package on every worker.

    The session's batches are bounded to BATCH_BYTES, for each is held several times between
    Spark and Python; `work` gets them in slices, so that what it makes of one is small too.
    Workers serve one task after another: caches of the operator called `owner` stay, those of
    others go when the task starts.
    """
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_to(owner)
        return work(b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))

    return df.mapInArrow(sliced, schema)


def set_aside(df: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with every column but the kept ones under a name that clashes with nothing,
    and the names to give back."""
    back = {f"_aside{i}": c for i, c in enumerate(c for c in df.columns if c not in kept)}
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def latin_pattern(pattern: str) -> re.Pattern | None:
    """A splitting pattern as the standard library's, for texts below LATIN: classes of letters,
    digits and blanks are written out as ranges.  None if the pattern has classes beyond these.

    It finds the same pieces several times as fast.
    """
    import regex

    below = [chr(c) for c in range(ord(LATIN))]

    def ranges(name: str) -> str:
        member = regex.compile(name).fullmatch
        runs: list[list[str]] = []
        for c in filter(member, below):
            if runs and ord(c) == ord(runs[-1][1]) + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)

    named = {r"\s": ranges(r"\s"), r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}")}
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\^?\w+\}|\\.|.", pattern, re.DOTALL):
        if part in named:
            out.append(named[part] if inside else f"[{named[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{named[r'\s']}]")
        elif part[0] == "\\" and part[1:2].isalpha() and part not in (r"\r", r"\n", r"\t"):
            return None
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Cache(dict):
    """A bounded memo of a function of short strings, in two generations.

    When the young one is full it becomes the old one, and what is asked for again moves back
    to the young one; so frequent strings stay while rare ones go, and nothing is computed
    anew for all at once.
    """

    def __init__(self, make: Callable, entries: int | None = None):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= (self.entries or CACHE_ENTRIES):
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class ChunkCache(Cache):
    """Token ids of a text by its chunks between single spaces.

    The splitting pattern of byte-level BPE never takes white space except in a run of white
    space or as the one space before a word.  So a text may be cut before every space that
    stands between two non-space characters, and the chunks tokenised apart.  `split` cuts a
    text into pieces and `encode` gives the ids of a piece as bytes; a piece that is a space
    and a word is kept under the word, as the chunk of that word alone would be.
    Texts with other runs of spaces have their chunks merged until each starts and ends with a
    non-space character.

    A text below LATIN needs none of this where `latin` cuts it into pieces at once.
    """

    def __init__(
        self, split: Callable[[str], list[str]], encode: Callable[[str], bytes],
        latin: Callable[[str], list[str]] | None = None, entries: int | None = None,
    ):
        super().__init__(self._chunk, entries)
        self.split, self.encode, self.latin = split, encode, latin
        self.others = Cache(encode, entries)

    def forget(self) -> None:
        super().forget()
        self.others.forget()

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.split(" " + chunk)
        return self.encode(pieces[0]) if len(pieces) == 1 else self._joined(pieces)

    def _joined(self, pieces: list[str]) -> bytes:
        word = lambda p: len(p) > 1 and p[0] == " " and not (p[1].isspace() or p[-1].isspace())
        return b"".join([self[p[1:]] if word(p) else self.others[p] for p in pieces])

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise KeyError(chunk)
        return super().__missing__(chunk)

    def values_of(self, text: str) -> list[bytes]:
        """The ids of a text's chunks, in order."""
        if not text:
            return []
        if self.latin is not None and not BEYOND_LATIN.search(text):
            return [*map(self.others.__getitem__, self.latin(text))]
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return [self._joined(self.split(first)), *map(self.__getitem__, rest)]
            except KeyError:
                pass
        return self._merged([first, *rest])

    def _merged(self, parts: list[str]) -> list[bytes]:
        """A cut needs a non-space character on both sides; other neighbours stay together."""
        chunks = [parts[0]]
        for part in parts[1:]:
            before = chunks[-1]
            if before and part and not before[-1].isspace() and not part[0].isspace():
                chunks.append(part)
            else:
                chunks[-1] = f"{before} {part}"
        first, *rest = chunks
        return [self._joined(self.split(first)), *(self._joined(self.split(" " + c)) for c in rest)]
