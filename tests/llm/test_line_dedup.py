"""Line dedup against a plain implementation of its templates."""

import itertools
import random

import pyarrow as pa
from llm.test_dedup import brute as near_groups
from pyspark.sql import functions as F

from vigipanel.llm import line_templates as L


def plain(texts):
    """{text: (text left, lines dropped)}: every pair of lines of different voters is compared."""
    own = [t for t in dict.fromkeys(texts) if t]
    voter = {i: g for i, (_, g, _) in near_groups([*enumerate(own)], L.COPY_WORDS, L.COPY_PERCENT).items()}
    lines = {}
    for i, text in enumerate(own):
        for _, _, tokens, leaf in L.parse(text):
            if leaf is not None:
                lines.setdefault((i, tuple(tokens)), leaf)
    docs = {}
    for (i, a), leaf in lines.items():
        tail = a[L.DEPTH :]
        n = min(L.SLICES, len(tail))
        best = 0
        for half in itertools.combinations(range(n), (n + 1) // 2) if n else [()]:
            near = {
                voter[j]
                for (j, b), other in lines.items()
                if other == leaf and len(a) == len(b) and all(tail[s :: L.SLICES] == b[L.DEPTH :][s :: L.SLICES] for s in half)
            }
            forms = {(b, voter[j]) for (j, b), other in lines.items() if other == leaf and len(a) == len(b) and all(tail[s :: L.SLICES] == b[L.DEPTH :][s :: L.SLICES] for s in half)}
            if len(near) >= L.LEAST_DOCS:
                best = max(best, len(forms))
        docs[i, a] = best
    out = {}
    for i, text in enumerate(own):
        keys = {(lines[k], *L.tail_of(list(k[1]))): n for k, n in docs.items() if k[0] == i}
        found = {k for k, n in keys.items() if n >= L.LEAST_DOCS}
        out[text] = L.drop_lines(text, found, {k for k in found if keys[k] >= L.SHORT_DOCS})
    return out


def corpus():
    draw = random.Random(11)
    say = lambda n: " ".join(f"w{draw.choice('abcdefgh')}{draw.choice('xyz')}q{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(n))
    sentence = lambda: say(draw.randrange(4, 22)) + "."
    passages = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
    line = "This article was first published on day 4 of the month by the desk of {} and {}."
    texts = [None, "", "...", "one two three", "a b c d."]
    for i in range(60):
        parts = [sentence() for _ in range(draw.randrange(3, 9))]
        if i % 3 == 0:
            parts.insert(draw.randrange(len(parts)), draw.choice(passages))
        if i % 4 == 0:
            parts.insert(draw.randrange(len(parts)), line.format(say(1), "news"))
        if i % 5 == 0:
            parts.insert(0, "Click here to subscribe to our newsletter today.")
        texts.append(" ".join(parts))
    whole = texts[10] + " " + " ".join(sentence() for _ in range(6))
    for _ in range(12):
        words = whole.split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, texts[20], texts[20]]


def test_templates_equal_brute_force(spark):
    texts = corpus()
    table = spark.createDataFrame([(i if i % 7 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, marks string, text_key int")
    got = L.drop_recurring(table)
    assert got.columns == [*table.columns, "n_dropped"]
    want = plain(texts)
    assert sum(n for _, n in want.values()) > 60
    rows = got.collect()
    assert len(rows) == len(texts) and all(r.marks == "x" and r.text_key == 3 for r in rows)
    left = sorted(((r.text, r.n_dropped) for r in rows), key=str)
    assert left == sorted(((t, 0) if not t else want[t] for t in texts), key=str)


def test_lines_that_differ_never_meet(spark):
    """Six leading tokens in common and another last word: 20,000 lines, no template twice."""
    lines = [f"the quick brown fox jumps over {a}{b}{c}e." for a in "bcdfghjklmnpqrstvwxz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyzáéíóúäëïöüâê"]
    assert len(lines) > 19_000
    assert len({L.tail_of(L.parse(line)[0][2]) for line in lines}) == len(lines)
    rows = [(i, " ".join(lines[i::500])) for i in range(500)]
    got = L.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.agg(F.sum("n_dropped")).first()[0] == 0


def test_a_long_text_is_parsed_whole(spark):
    draw = random.Random(3)
    say = lambda n: " ".join(chr(97 + draw.randrange(26)) * draw.randrange(2, 9) for _ in range(n))
    passage = " ".join(say(15) + "." for _ in range(4))
    long = " ".join(say(20) + "." for _ in range(20_000))
    rows = [(1, f"{long} {passage}"), (2, f"{say(60)}. {passage} {say(40)}."), (3, "word " * 200_000)]
    got = {r.doc_id: r for r in L.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_dropped == got[2].n_dropped == 4 and got[1].text.startswith(long) and got[3].n_dropped == 0


def test_a_column_called_like_the_count(spark):
    table = spark.createDataFrame([(1, "a b c d.", 9)], "doc_id bigint, text string, n_dropped bigint")
    assert L.drop_recurring(table).collect()[0].asDict() == {"doc_id": 1, "text": "a b c d.", "n_dropped": 0}
    assert L.drop_recurring(table, count_col="gone").columns == ["doc_id", "text", "n_dropped", "gone"]


def test_starts_that_are_no_lines_of_the_text():
    """Marks of another text with the same hash do nothing; short lines inside a run go with it."""
    first, second = "one two three four five six seven eight nine ten eleven.", "a b c d e f g h i j k."
    text = f"{first} Yes. {second} The end is not in it."
    assert L.drop_marked(text, {3: True, 10_000: True}) == (text, 0)
    marks = {text.index(first): False, text.index(second): False, 7: True}
    assert L.drop_marked(text, marks) == ("The end is not in it.", 3)
    assert L.drop_marked(text, {text.index(second): True}) == (f"{first} Yes. The end is not in it.", 1)
    assert L.drop_marked(text, {text.index(second): False}) == (text, 0)
    assert L.drop_marked("", {0: True}) == ("", 0)


def test_lines_on_arrays_are_those_of_the_parse():
    """Starts and tokens of every line as `parse` has them, and equal bits just where those are equal."""
    draw = random.Random(7)
    parts = ["a", "b", "Word", "x1", "@", "z@z", "12", "http://x", "://", "...", ".", "!", "?", "-", "(a)", "1.", "2!", "a.b", "==" * 20]
    parts += ["\n", "\n\n", " ", "\u00a0", "\u3000", "\r", "\x1c", "\x85", "\u0130", "\u0391\u03a3", "\u00e9.", "\U0001f600", "w" * 128, "w" * 129]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " ", " "]) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += [t for t in corpus() if t]
    for own in ([t for t in texts if t.isascii()], texts, ["", " \n"]):
        want = [(i, at, len(tokens), leaf, *L.tail_of(tokens)) for i, t in enumerate(own) for at, _, tokens, leaf in L.parse(t) if leaf is not None]
        got = [*zip(*(column.tolist() for column in L.lines_of(own)))]
        assert [row[:3] for row in got] == [row[:3] for row in want]
        for bits in (slice(2, 4), slice(2, 6)):
            pairs = {(a[bits], b[bits]) for a, b in zip(got, want)}
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_lines_take_no_python_step_for_each(monkeypatch):
    """The parse of all lines goes by arrays: the plain one, line by line, is not called."""
    monkeypatch.setattr(L, "parse", None)
    monkeypatch.setattr(L, "tail_of", None)
    texts = ["One two three four five six seven. Yes. Eight nine ten eleven\ntwelve.", "\u00e9l\u00e8ve a b c d.", ""]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(texts)], ["text_key", "text"])
    rows = [row for out in L._parsed(iter([batch])) for row in out.to_pylist()]
    assert [(r["text_key"], r["at"], r["n_lines"]) for r in rows] == [(7, 0, 2 << 3 | 1), (7, 40, 2 << 3), (8, 0, 1 << 3)]


def test_only_lines_around_the_marks_are_cut_again(monkeypatch):
    """Line breaks bound lines, so paragraphs before the first mark and after the last one are left alone."""
    before, after = "Some other words. " * 50, "Still other words! " * 50
    line = " ".join(f"w{i}" for i in range(L.RUN_TOKENS)) + "."
    text = f"{before}\n{line}\n\n{after}"
    cut = []
    segment = L.SEGMENT
    monkeypatch.setattr(L, "SEGMENT", type("Cut", (), {"finditer": lambda _, *a: [cut.append(m) or m for m in segment.finditer(*a)]})())
    assert L.drop_marked(text, {len(before) + 1: False}) == (f"{before}\n{after}", 1)
    assert [m[0] for m in cut] == [line]
