"""Operator 4: benchmark decontamination by a generalised suffix automaton.

The automaton of the normalised items has a state for every class of word sequences that end
at the same places.  Streaming a document's words through it gives, at each word, the length
of the longest match that ends there; from WINDOW words on, the match covers whole windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches, set_aside
from vigipanel.session import materialise

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
# Items go into one automaton up to this many words (some 200 MB); beyond it, into several,
# which read the documents one after another, so that no broadcast grows with the benchmark.
BLOCK_WORDS = 200_000
FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs of other than ASCII controls, blanks and punctuation."""
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences; `scan` finds their windows in a document."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._name(items)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of `target` for the sequences that are no longer than state + word."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.step[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            longer = self.length[target] != self.length[state] + 1
            self.link[new] = self._split(state, word, target) if longer else target
        return new

    def _name(self, items: list[tuple[int, list[int]]]) -> None:
        """Which items each window belongs to, at the state that holds the window.

        `windows[state]` are the items whose window ends a match in that state; a short item
        is a window of its own length.
        """
        self.windows: dict[int, dict[int, set[int]]] = {}
        for item, words in items:
            size = min(self.window, len(words))
            state, held = 0, 0
            for word in words:
                state, held = self.step[state][word], held + 1
                at = state
                while at and self.length[self.link[at]] >= size:
                    at = self.link[at]
                if held >= size:
                    self.windows.setdefault(at, {}).setdefault(size, set()).add(item)
        # What a match in a state holds: the windows of all states on its suffix path.
        self.found: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            own = tuple((size, frozenset(x)) for size, x in sorted(self.windows.get(state, {}).items()))
            self.found[state] = self.found[self.link[state]] + own

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit word spans (start, end exclusive; merged, rising) and the items found."""
        ids, step, link, length, found = self.ids.get, self.step, self.link, self.length, self.found
        state = held = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for place, word in enumerate(map(ids, words), 1):
            if word is None:
                state = held = 0
                continue
            while word not in step[state] and state:
                state = link[state]
                held = length[state]
            state = step[state].get(word, 0)
            if not state:
                held = 0
                continue
            held += 1
            if found[state]:
                for size, named in found[state]:
                    if size <= held:
                        items |= named
                        start = place - size
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, place))
        return spans, items


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of a bounded number of words, read one after another.

    A longer item is cut into runs that share WINDOW - 1 words, so no window is lost.
    """
    block, size = [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of(text)
        if item is None or not words:
            continue
        for start in range(0, max(1, len(words) - WINDOW + 1), max(1, block_words - WINDOW + 1)):
            run = words[start : start + block_words]
            if block and size + len(run) > block_words:
                yield block
                block, size = [], 0
            block.append((item, run))
            size += len(run)
    if block:
        yield block


def _scanner(handle, first: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = handle.value if handle else None
        for batch in batches:
            cols = {"n_words": [], "spans": [], "items": []}
            old = zip(batch.column("spans"), batch.column("items")) if not first else iter(())
            for text in batch.column("text"):
                words = words_of(text.as_py())
                spans, items = automaton.scan(words) if automaton else ([], set())
                if not first:
                    was_spans, was_items = next(old)
                    spans = merged([(s["start"], s["end"]) for s in was_spans.as_py()] + spans)
                    items = items | set(was_items.as_py())
                cols["n_words"].append(len(words))
                cols["spans"].append([{"start": a, "end": b} for a, b in spans])
                cols["items"].append(sorted(items))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(cols["n_words"], pa.int64()), pa.array(cols["spans"], kind), pa.array(cols["items"], pa.list_(pa.int64()))]
            keep = [n for n in batch.schema.names if n not in cols]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *arrays], [*keep, *cols])

    return work


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, text, n_words, hit word spans and the items found; and the
    columns named in `carry`, which must not be called n_words, spans or items.

    A null or empty text has no words and no hits; items without an id or words match nothing.
    Rows are independent, so repeated rows and null ids pass on as they are; an empty table on
    either side gives no hits.  Other columns are ignored.  Spans merge where they touch.
    A text of any length is scanned whole, in time proportional to it.  Each `block_words` words of
    the benchmark are one broadcast automaton and one more Python step of the stage.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), FOUND])
    spark, first = docs.sparkSession, True
    for block in blocks_of(benchmark, item_col, item_text_col, block_words):
        handle = spark.sparkContext.broadcast(Automaton(block))
        out, first = map_batches(out, _scanner(handle, first), schema), False
    return map_batches(out, _scanner(None, True), schema) if first else out


def summary(scanned: DataFrame) -> DataFrame:
    """Counts per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def clean(
    docs: DataFrame, benchmark: DataFrame, max_words: int = 0, max_coverage: float = 0.5, **names: str
) -> DataFrame:
    """The documents without benchmark passages, with all columns of `docs`.

    Hit spans of more than `max_words` words are cut out; a document of whose words they make
    up more than the share `max_coverage` goes as a whole.  Other texts stay as they are, null and
    empty ones among them; repeated rows are treated alike, rows without an id like others, an
    empty table on either side changes nothing.  Columns are kept whatever they are called.
    What the scan finds is stored, so that no task holds workers that scan and one that cuts.
    """
    text_col = names.get("text_col", "text")
    id_col = names.get("id_col", "doc_id")
    apart, back = set_aside(docs, id_col, text_col)
    carry = tuple(back)
    found = materialise(scan(apart, benchmark, carry=carry, **names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema[: len(carry) + 2])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = [], []
            for text, n, spans in zip(*(batch.column(c) for c in ("text", "n_words", "spans"))):
                long = [(s["start"], s["end"]) for s in spans.as_py() if s["end"] - s["start"] > max_words]
                covered = sum(b - a for a, b in long)
                kept.append(covered <= max_coverage * n.as_py())
                whole = text.as_py()
                texts.append(without_spans(whole, long) if long and kept[-1] else whole)
            out = batch.set_column(1, "text", pa.array(texts, pa.string()))
            yield out.select([f"{n}" for n in out.schema.names[: len(carry) + 2]]).filter(pa.array(kept))

    out = map_batches(found, work, schema)
    return out.withColumnsRenamed({**back, "doc_id": id_col, "text": text_col}).select(*docs.columns)
