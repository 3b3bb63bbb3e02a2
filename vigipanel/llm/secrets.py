"""Operator 10: secrets by patterns and by a battery of randomness tests.

Besides the base patterns, long runs of key characters are tested, whole and in their parts
between '=', '/', '+', '-' and '_', as a key may stand behind a name or in a path.  The alphabet
is inferred from the characters; against it, three tests look for structure: chi-squared
uniformity of the characters, the number of runs above and below the middle of the alphabet, and the serial
correlation of neighbours.  Their p-values combine by Fisher's method, and a run is random if
the battery finds no structure.  What remains could still be chance: ordinary text has runs
that look random if they are short.  So each random run also gets a p-value against the
character frequencies of words (the likelihood ratio of uniform to text, whose inverse
bounds that p-value whatever the length, so longer runs need less per character).  These are
counted over the corpus without its long runs, on top of a fixed model of prose, so that keys do not
make themselves look ordinary however many there are.  The
Benjamini-Hochberg rule over all runs of the corpus keeps the share of false ones below FDR.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches
from vigipanel.session import materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 20}

KEY_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST["random"])
# Between '='; what ends a run may be padding.  Then the longest stretches of an alphabet.
PARTS = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
STRETCHES = [re.compile(r"[A-Za-z0-9%s]+=*" % signs) for signs in ("+/", "_-", "")]
# Alphabets from the narrowest; a run belongs to the first that has all its characters.
# Plain numbers and words of one case are identifiers and prose, not keys.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("number", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("word", LOWER),
    ("WORD", LOWER.upper()),
    ("base32", LOWER.upper() + "234567"),
    ("lower36", LOWER + DIGITS),
    ("upper36", LOWER.upper() + DIGITS),
    ("base62", LOWER.upper() + LOWER + DIGITS),
    ("base64", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", LOWER.upper() + LOWER + DIGITS + "-_"),
)
NOT_KEYS = {"number", "word", "WORD"}
# Structure is claimed at this level; the share of false discoveries stays below FDR.
ALPHA, FDR = 0.001, 0.01
# p-values are counted in bins of exp(-0.5).
BINS_PER_E, MAX_BIN = 2, 2000

# Per mille of the letters in running prose, and the shares of what is no small letter.
LETTERS = dict(
    a=82, b=15, c=28, d=43, e=127, f=22, g=20, h=61, i=70, j=2, k=8, l=40, m=24, n=67, o=75, p=19, q=1, r=60, s=63, t=91, u=28,
    v=10, w=24, x=2, y=20, z=1,
)
CAPITALS, FIGURES, SIGNS = 0.03, 0.02, 0.01
# Characters that the fixed model counts for.
PROSE_CHARS = 10_000

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
FOUND = f"doc_id bigint, base {SPAN}, runs array<struct<start:bigint,end:bigint,encoding:string,random:double,bin:int>>"


def _mask(chars: bytes) -> bytes:
    return bytes(120 if b in chars else 32 for b in range(256))


HEX_MASK, KEY_MASK = _mask(b"0123456789abcdef"), _mask(KEY_CHARS)
LONG_HEX, LONG_KEY = b"x" * LEAST["hex"], b"x" * LEAST["random"]


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; `data` are the text's bytes."""
    data = text.encode() if data is None else data
    lower, out = data.lower(), []
    if any(word in lower for word in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if LONG_HEX in data.translate(HEX_MASK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * df)
    return normal_tail(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def battery(values: np.ndarray, size: int) -> float:
    """Combined p-value of the three tests that the values are uniform and independent."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    uniform = chi_squared_tail(float((counts**2).sum() * size / n - n), size - 1)
    high = values >= size / 2
    n_high = int(high.sum())
    n_low = n - n_high
    if n_high and n_low:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        expected = 2 * n_high * n_low / n + 1
        variance = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
        run = 2 * normal_tail(abs(runs - expected) / math.sqrt(variance))
    else:
        run = 2.0 ** (1 - n)
    centred = values - values.mean()
    power = float(centred @ centred)
    serial = 2 * normal_tail(abs(float(centred[1:] @ centred[:-1])) / power * math.sqrt(n)) if power else 2.0 ** (1 - n)
    total = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, run, serial))
    half = total / 2
    return math.exp(-half) * (1 + half + half * half / 2)


def encoding_of(run: str) -> tuple[str, str] | None:
    """Name and alphabet of a run without its padding; None if no alphabet has them all."""
    chars = set(run)
    for name, alphabet in ALPHABETS:
        if chars <= set(alphabet):
            return name, alphabet
    return None


def parts_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run of key characters, sorted: its parts between '=',
    whole if they have an alphabet, and their longest stretches of each alphabet."""
    out = set()
    for part in PARTS.finditer(run):
        if encoding_of(part[0].rstrip("=")) is not None:
            out.add(part.span())
        out.update((part.start() + m.start(), part.start() + m.end()) for pattern in STRETCHES for m in pattern.finditer(part[0]))
    return sorted((a, b) for a, b in out if b - a >= LEAST["random"])


def beside(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of a run."""
    for a, _, b in spans:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def test_run(run: str, log_share: dict[str, float]) -> tuple[str, float, int] | None:
    """Encoding, battery p-value, and the bin of the p-value against ordinary text."""
    run = run.rstrip("=")
    found = encoding_of(run)
    if found is None or found[0] in NOT_KEYS or len(run) < LEAST["random"]:
        return None
    name, alphabet = found
    values = np.array([alphabet.index(c) for c in run])
    evidence = -len(run) * math.log(len(alphabet)) - sum(log_share[c] for c in run)
    return name, battery(values, len(alphabet)), min(MAX_BIN, max(0, int(evidence * BINS_PER_E)))


def _count_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for text in batch.column(0):
            whole = text.as_py()
            if whole:
                data = whole.encode()
                if LONG_KEY in data.translate(KEY_MASK):
                    data = RUN.sub(" ", whole).encode()  # runs that may be keys say nothing about words
                total += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["byte", "n"])


def prose() -> dict[int, float]:
    """The fixed model: how often each key character stands among PROSE_CHARS of prose."""
    letters, signs = sum(LETTERS.values()), [b for b in KEY_CHARS if not chr(b).isalnum()]
    small = 1 - CAPITALS - FIGURES - SIGNS
    out = {ord(c): small * n / letters for c, n in LETTERS.items()}
    out |= {ord(c.upper()): CAPITALS * n / letters for c, n in LETTERS.items()}
    out |= {ord(c): FIGURES / len(DIGITS) for c in DIGITS} | {b: SIGNS / len(signs) for b in signs}
    return {b: PROSE_CHARS * share for b, share in out.items()}


def char_shares(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Log share of every key character among those of all words and of the fixed model (256 sums)."""
    counts = map_batches(docs.select(text_col), _count_chars, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    n = {b: known for b, known in prose().items()}
    for row in counts.collect():
        if row.byte in n:
            n[row.byte] += row.n
    total = sum(n.values())
    return {chr(b): math.log(n[b] / total) for b in KEY_CHARS}


def _find(log_share: dict[str, float]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        run_kind = pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("random", pa.float64()), ("bin", pa.int32())]
        )
        for batch in batches:
            bases, runs = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                data = text.encode()
                base, tested = base_spans(text, data), []
                if LONG_KEY in data.translate(KEY_MASK):
                    for m in RUN.finditer(text):
                        for left, right in beside(*m.span(), base):
                            for a, b in parts_of(text[left:right]):
                                result = test_run(text[left + a : left + b], log_share)
                                if result:
                                    values = (left + a, left + b, *result)
                                    tested.append(dict(zip(("start", "end", "encoding", "random", "bin"), values)))
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                runs.append(tested)
            arrays = [pa.array(bases, pa.list_(span)), pa.array(runs, pa.list_(run_kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "base", "runs"])

    return work


def discovery_bin(found: DataFrame, fdr: float) -> int:
    """The Benjamini-Hochberg threshold over all tested runs, as a bin (its counts are few rows)."""
    counts = found.select(F.explode("runs").alias("run")).groupBy(F.col("run.bin").alias("bin")).agg(
        F.count("*").alias("tested"), F.count_if(F.col("run.random") >= ALPHA).alias("random")
    )
    rows = sorted(((r.bin, r.tested, r.random) for r in counts.collect()), reverse=True)
    tested, passed, best = sum(r[1] for r in rows), 0, MAX_BIN + 1
    for at, _, random in rows:
        passed += random
        if math.exp(-at / BINS_PER_E) <= fdr * passed / tested:
            best = at
    return best


def find_secrets(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and all spans as arrays of (start, kind, end) in code points.

    Kinds are numbered as in KINDS; spans are sorted by start, then kind.  Of a run that overlaps a
    base span the rest is tested; of random parts inside each other the widest is reported.  Null and empty texts have no spans.  Rows are independent but for
    the corpus' character counts and the discovery threshold: repeated rows count repeatedly,
    null ids pass on, an empty table gives an empty one, other columns are ignored.  A text of any length
    is searched whole.  Ids are whole numbers or text of them; the cast of
    another id fails.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(map_batches(source, _find(char_shares(source, "text")), FOUND))
    return map_batches(found, _reported(discovery_bin(found, fdr)), f"doc_id bigint, base {SPAN}, spans {SPAN}")


def widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other, sorted; one look at each."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def _reported(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, runs in zip(batch.column("base"), batch.column("runs")):
                passed = [(r["start"], r["end"]) for r in runs.as_py() if r["random"] >= ALPHA and r["bin"] >= least]
                random = [{"start": a, "kind": KINDS.index("random"), "end": b} for a, b in widest(passed)]
                spans.append(sorted(base.as_py() + random, key=lambda s: (s["start"], s["kind"], s["end"])))
            kept = [batch.column(c) for c in ("doc_id", "base")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, batch.column("base").type)], ["doc_id", "base", "spans"])

    return work


def _written(spans: str):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def summary(found: DataFrame) -> DataFrame:
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", *map(count, range(3)), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )
