"""Operator 7: line dedup by a log-template tree.

Lines, and in running text sentences, are parsed down a tree of fixed depth: first by their
number of tokens, then by their leading tokens, where tokens with digits or addresses count as
one variable field.  What follows the leading tokens is generalised: it is cut into four
interleaved slices, and each half of the slices that a line can share with others of its leaf
is a template.  So a leaf has as many templates as it needs, and two lines of a leaf that agree
in half of their tails always meet in one.  Templates that stand in several otherwise
different documents recur; unbroken runs of recurring lines are dropped from all documents.  A recurring line that
stands alone and is short goes as well if more documents have it.

A template is known by 128 bits: 64 of its leaf and 64 of its half of the tail.

Copies of a whole document share all their lines.  So the documents around a template are not
counted themselves: near-dedup's components are, and all copies of a document have one vote
together.  A template recurs by the number of its votes alone, however many copies there are
and however much of its documents it makes up.  Near-dedup looks only at documents of whose
lines at least a third have a leaf in common with another document: copies of one share far more.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches, set_aside
from vigipanel.llm.minhash import ODD, groups, mixed, near_duplicates, span_hashes, spans
from vigipanel.session import materialise, small_side

# Up to a line break, or to a sentence's end before a blank.
SEGMENT = re.compile(r"\S(?:[^\n.!?]++|[.!?](?!\s))*[.!?]?")
VARIABLE = re.compile(r"[0-9@]|://")
# Leading tokens of the tree, and the tokens a line needs to be looked at.
DEPTH, LEAST_TOKENS = 6, 4
SLICES = 4
# Different documents that a template must stand in.
LEAST_DOCS = 2
# A run of recurring lines is dropped from this many tokens on.  Fewer could be a saying, so a
# line in a shorter run must stand in more documents (each form of it counted in each of them).
RUN_TOKENS, SHORT_DOCS = 20, 10
# Documents are copies of one if near-dedup links them: words of a shingle, similarity; and the
# share of its lines, one in COPY_LINES, that a document must have in common with others for that.
COPY_WORDS, COPY_PERCENT, COPY_LINES = 5, 80, 3

PARSED = "text_key bigint, at int, n_lines int, leaf bigint, low bigint, high bigint"
CLEANED = "n_dropped bigint, text string"
HALF = (1 << 32) - 1
# Blanks beyond ASCII, and classes of bytes: blanks, punctuation, what makes a token a field ("@" is both).
BLANKS = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]
BLANK, SIGN, MARK = 1, 2, 4
CLASSES = bytes(
    BLANK * chr(c).isspace() + SIGN * (chr(c) in string.punctuation) + MARK * (chr(c) in "0123456789@") if c < 128 else 0 for c in range(256)
)
# The hash of a variable field.
FIELD = np.uint64(xxhash.xxh3_64_intdigest("<*>") | 1)


def _tokens(line: str) -> list[str]:
    """Lower-case words without punctuation around them; signs alone are no tokens."""
    return [*filter(None, map(str.strip, line.lower().split(), itertools.repeat(string.punctuation)))]


def _mask(token: str) -> str:
    return "<*>" if VARIABLE.search(token) else token


def parse(text: str | None) -> list[tuple[int, int, list[str], int | None]]:
    """(start, end, masked tokens, leaf) of each line; short lines have no leaf."""
    out = []
    for m in SEGMENT.finditer(text or ""):
        line = m[0]
        tokens = own = _tokens(line)
        leaf = None
        if len(tokens) >= LEAST_TOKENS:
            if VARIABLE.search(line):
                tokens = [*map(_mask, own)]
            lead = tokens[:DEPTH]
            # Fields alone are no template: rows of numbers recur only as they are.
            if all(t == "<*>" for t in lead):
                lead = own[:DEPTH]
            leaf = xxhash.xxh3_64_intdigest(f"{len(own)} {' '.join(lead)}")
        out.append((*m.span(), tokens, leaf))
    return out


def tail_of(tokens: list[str]) -> tuple[int, int]:
    """128 bits of the tokens behind the leading ones, which are cut into interleaved slices.

    A template of three or four slices takes two of them, so 32 bits of each make 64; where it
    takes one slice, the slice has 64 bits.
    """
    n = min(SLICES, len(tokens) - DEPTH)
    if n <= 0:
        return 0, 0
    hashes = [xxhash.xxh3_64_intdigest(" ".join(tokens[DEPTH + i :: SLICES])) for i in range(n)]
    if n <= 2:
        return hashes[0] or 1, hashes[1] or 1 if n == 2 else 0
    parts = [h & HALF or 1 for h in hashes] + [0] * (SLICES - n)
    return parts[0] | parts[1] << 32, parts[2] | parts[3] << 32


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, and where words start and end."""
    classes = np.frombuffer(data.translate(CLASSES), np.uint8)
    return classes, *spans(classes == BLANK)


def _word_hashes(data: bytes, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each lower-case word without the punctuation around it: 0 for signs alone, odd for a variable field."""
    starts, ends, sign = starts.copy(), ends.copy(), (classes & SIGN) > 0
    for side, step, inside in ((starts, 1, 0), (ends, -1, -1)):
        bare = np.flatnonzero(sign[side + inside] & (starts < ends))
        for _ in range(8):
            side[bare] += step
            bare = bare[starts[bare] < ends[bare]]
            bare = bare[sign[side[bare] + inside]]
        for i in bare.tolist():
            word = data[starts[i] : ends[i]].strip(string.punctuation.encode())
            starts[i] = data.index(word, starts[i])
            ends[i] = starts[i] + len(word)
    hashes = np.maximum(span_hashes(data, starts, ends) & ~np.uint64(1), np.uint64(2)) * (starts < ends)
    schemes = np.array([m.start() for m in re.finditer(b"://", data)], np.int64)
    for found, length in ((np.flatnonzero(classes >= MARK), 1), (schemes, 3)):
        word = np.searchsorted(starts, found, side="right") - 1
        word = word[(word >= 0) & (found + length <= ends[word])]
        hashes[word] |= np.uint64(1)
    return hashes


def _last_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are the last of their line, as SEGMENT cuts it: those that end in one of its
    signs, or stand before a line break.  A sign by itself that opens a line does not end it."""
    codes = np.frombuffer(data, np.uint8)
    broken = np.zeros(len(starts) + 1, bool)
    broken[np.searchsorted(starts, np.flatnonzero(codes == ord("\n"))) - 1] = True
    broken[len(starts) - 1] = True
    end = codes[ends - 1]
    sign = (end == ord(".")) | (end == ord("!")) | (end == ord("?"))
    last = broken[:-1] | sign
    for i in np.flatnonzero(sign & (ends - starts == 1)).tolist():
        if i == 0 or last[i - 1]:
            last[i] = broken[i]
    return last


def lines_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all lines that `parse` gives a leaf: number of the text, start, number of tokens, leaf, low, high.

    The same as `parse` and `tail_of` of each line, on arrays of the words of all texts: the hash of
    a leaf or of a slice is a sum over its words, each mixed with its place.
    """
    text = "\n".join(texts)
    plain = text.isascii()
    for blank in () if plain else BLANKS:
        text = text.replace(blank, " ")
    data, low = text.encode(), text.lower().encode()
    classes, starts, ends = _words(data)
    words = _word_hashes(low, *((classes, starts, ends) if plain else _words(low)))
    last = _last_words(data, starts, ends)
    line = np.cumsum(last) - last
    begins = starts[np.append(True, last[:-1])[: len(last)]]
    if not plain:
        # From bytes to characters.
        begins = begins - np.searchsorted(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80), begins)
    there = words != 0
    size = np.bincount(line[there], minlength=len(begins))
    there &= (size >= LEAST_TOKENS)[line]
    words, line = words[there], line[there]
    begins, size = begins[size >= LEAST_TOKENS], size[size >= LEAST_TOKENS]
    first = np.cumsum(size) - size
    place = np.arange(len(words)) - np.repeat(first, size)
    varies = (words & np.uint64(1)).astype(bool)
    masked = np.where(varies, FIELD, words)
    seed = place.astype(np.uint64) * ODD[1]
    total = lambda of, where: np.add.reduceat(np.where(where, of, np.uint64(0)), first) if len(first) else of
    lead, parts = place < DEPTH, mixed(masked * ODD[0] + seed)
    fields = np.logical_and.reduceat(varies | ~lead, first) if len(first) else varies
    # Fields alone are no template.
    own = total(mixed(words * ODD[0] + seed), lead & np.repeat(fields, size)) if fields.any() else np.uint64(0)
    leaf = mixed(np.where(fields, own, total(parts, lead)) + size.astype(np.uint64) * ODD[2])
    slices = np.clip(size - DEPTH, 0, SLICES)
    slot = np.where(lead, SLICES, (place - DEPTH) % SLICES)
    found = [mixed(total(parts, slot == i)) for i in range(SLICES)]
    whole = [np.maximum(h, np.uint64(1)) for h in found]
    half = [np.maximum(h & np.uint64(HALF), np.uint64(1)) * (slices > i) for i, h in enumerate(found)]
    few, shift, none = slices <= 2, np.uint64(32), np.uint64(0)
    low = np.where(few, np.where(slices > 0, whole[0], none), half[0] | half[1] << shift)
    high = np.where(few, np.where(slices > 1, whole[1], none), half[2] | half[3] << shift)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(offsets, begins, side="right") - 1
    return owner, begins - offsets[owner], size, leaf, low, high


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        rows = [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        # Texts of ASCII alone take fewer steps, so they stand together.
        for plain in (True, False):
            keys, texts = np.array([k for k, t in rows if t.isascii() == plain], np.int64), [t for _, t in rows if t.isascii() == plain]
            for a, b in groups(texts):
                owner, at, size, *bits = lines_of(texts[a:b])
                # How many slices a tail has follows from the number of tokens.
                count = np.bincount(owner, minlength=b - a)[owner] << 3 | np.clip(size - DEPTH, 0, SLICES)
                arrays = [keys[a:b][owner], at.astype(np.int32), count.astype(np.int32), *(x.view(np.int64) for x in bits)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names)


def templates():
    """A line's templates: its leaf with each choice of half of its slices."""
    n = F.col("n_lines").bitwiseAND(F.lit(7))
    quarter = [F.shiftrightunsigned(c, by).bitwiseAND(F.lit(HALF)) for c in ("low", "high") for by in (0, 32)]
    out = F.array(F.xxhash64("leaf"))
    for slices in range(1, SLICES + 1):
        parts = [F.col("low"), F.col("high")] if slices <= 2 else quarter
        halves = itertools.combinations(range(slices), (slices + 1) // 2)
        named = F.array(*(F.xxhash64("leaf", F.lit(" ".join(map(str, half))), *(parts[i] for i in half)) for half in halves))
        out = F.when(n == slices, named).otherwise(out)
    return out


def voters(texts: DataFrame) -> DataFrame:
    """(text_key, voter): texts that are near copies of each other are one voter."""
    found = near_duplicates(texts, COPY_WORDS, COPY_PERCENT, id_col="text_key")
    return found.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("voter")).distinct()


def recurring_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """(text_key, at, alone) of the lines that belong to a recurring template: where the line
    starts in its text, and whether it stands in enough documents to go without a run.

    Only leaves of several texts go on, and only texts with many such leaves are compared with
    each other; the others vote for themselves.  Every step is an aggregation with partial sums
    or a join on hashed keys.
    """
    line = ["leaf", "low", "high"]
    texts = rows.where("length(text) > 0").select("text_key", "text")
    # Hashes hardly repeat, so that a dictionary of them is only work.
    parsed = materialise(map_batches(texts, _parsed, PARSED), **{"parquet.enable.dictionary": "false"})
    ends = parsed.groupBy("leaf").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    # Few leaves are shared, so that those of a partition are hashed rather than all lines sorted.
    several = ends.where("least <> most").select("leaf").hint("shuffle_hash")
    lines = materialise(parsed.join(several, "leaf").distinct())
    shared = lines.groupBy("text_key").agg(F.count("*").alias("shared"), F.max(F.shiftright("n_lines", 3)).alias("n"))
    # Where there are few of them, their texts are picked out without a shuffle of all texts.
    alike = small_side(shared.where(COPY_LINES * F.col("shared") >= F.col("n")).select("text_key"))
    found = materialise(voters(texts.join(alike, "text_key", "left_semi")))
    voted = lines.join(found, "text_key", "left").withColumn("voter", F.coalesce("voter", "text_key"))
    # Equal lines are one from here on, however many texts have them.
    kinds = voted.select(*line, F.col("n_lines").bitwiseAND(F.lit(7)).alias("n_lines"), "voter").distinct()
    spread = (F.min("voter").alias("least"), F.max("voter").alias("most"), F.count("*").alias("docs"))
    different = materialise(kinds.groupBy(*line, "n_lines").agg(*spread))
    members = different.select(*line, "least", "most", "docs", F.explode(templates()).alias("template"))
    spread = (F.min("least").alias("least"), F.max("most").alias("most"), F.sum("docs").alias("docs"))
    # Two voters are enough to recur.
    recurring = members.groupBy("template").agg(*spread).where((F.col("least") != F.col("most")) & (F.col("docs") >= least_docs))
    marked = members.select(*line, "template").join(recurring.select("template", "docs"), "template")
    marks = small_side(marked.groupBy(*line).agg((F.max("docs") >= short_docs).alias("alone")))
    return lines.select("text_key", "at", *line).join(marks, line).select("text_key", "at", "alone")


def drop_marked(text: str, marks: dict[int, bool]) -> tuple[str, int]:
    """The text without its runs of recurring lines, and how many lines were dropped.

    `marks` has the starts of the recurring lines, and whether each goes alone; a start that is
    no line's is of another text with the same hash.  Short lines between two recurring ones
    belong to the run.  Of a run with too few tokens the lines that go alone are dropped.
    """
    if not marks:
        return text, 0
    # Lines end at line breaks, so those before the first mark and after the last one are as they are.
    first, last = text.rfind("\n", 0, min(marks)) + 1, text.find("\n", max(marks))
    lines = [m.span() for m in SEGMENT.finditer(text, first, len(text) if last < 0 else last)]
    numbers = {start: i for i, (start, _) in enumerate(lines)}
    alone = {numbers[start]: by_itself for start, by_itself in marks.items() if start in numbers}
    size = functools.cache(lambda at: len(_tokens(text[slice(*lines[at])])))
    groups: list[list[int]] = []
    for at in sorted(alone):
        if groups and all(size(i) < LEAST_TOKENS for i in range(groups[-1][-1] + 1, at)):
            groups[-1].append(at)
        else:
            groups.append([at])
    runs: list[tuple[int, int]] = []
    for group in groups:
        if any(n >= RUN_TOKENS for n in itertools.accumulate(map(size, range(group[0], group[-1] + 1)))):
            runs.append((group[0], group[-1]))
        else:
            runs += [(at, at) for at in group if alone[at]]
    if not runs:
        return text, 0
    out, at = [], 0
    for first, end in runs:
        out.append(text[at : lines[first][0]])
        at = lines[end][1]
        # Of the white space around the run one piece is enough.
        while at < len(text) and text[at].isspace() and (not out[-1] or out[-1][-1].isspace()):
            at += 1
    out.append(text[at:])
    return "".join(out), sum(end - first + 1 for first, end in runs)


def drop_lines(text: str, recurring: set[tuple[int, int, int]], alone: set[tuple[int, int, int]] = frozenset()) -> tuple[str, int]:
    """The same for lines given as (leaf, tail), those in `alone` going without a run."""
    keys = {start: (leaf, *tail_of(tokens)) for start, _, tokens, leaf in parse(text) if leaf is not None}
    return drop_marked(text, {start: key in alone for start, key in keys.items() if key in recurring})


def _cleaner(carried: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped, column = [], [], batch.column("marks")
            at, alone = (part.to_pylist() for part in column.flatten().flatten())
            marks = iter(zip(at, alone))
            for text, n in zip(batch.column("text").to_pylist(), pc.list_value_length(column).to_pylist()):
                gone = 0
                if n:
                    text, gone = drop_marked(text, dict(itertools.islice(marks, n)))
                texts.append(text)
                dropped.append(gone)
            arrays = [pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *arrays], [*carried, "n_dropped", "text"])

    return work


def drop_recurring(docs: DataFrame, text_col: str = "text", count_col: str = "n_dropped", **limits) -> DataFrame:
    """All rows and columns of `docs` with recurring lines dropped, and how many, as `count_col`.

    A null or empty text stays as it is.  Repeated rows are treated alike and
    count once; null ids do no harm, for texts are known by their hash.  An empty table gives
    an empty one.  A text of any length is parsed whole, in time proportional to it.  Ties do
    not arise: a template recurs or not.  Other columns are kept whatever they are called; a
    column called `count_col` gives way to the count.
    """
    apart, back = set_aside(docs.drop(count_col) if count_col != text_col else docs, text_col)
    carried = [*back]
    rows = apart.select(*carried, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    # A text's recurring lines are no more than its lines.
    lines = recurring_lines(rows, **limits)
    marks = lines.groupBy("text_key").agg(F.collect_list(F.struct("at", "alone")).alias("marks"))
    # Marks are hashed, so that texts need not be sorted.
    marked = rows.join(materialise(marks).hint("shuffle_hash"), "text_key", "left").select(*carried, "text", "marks")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema[: len(carried)]), CLEANED])
    out = map_batches(marked, _cleaner(carried), schema).withColumnsRenamed({"text": text_col, "n_dropped": "_count"})
    out = out.withColumnsRenamed(back).withColumnRenamed("_count", count_col)
    return out.select(*[c for c in docs.columns if c != count_col], count_col)
