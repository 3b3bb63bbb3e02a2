"""Near-duplicates of texts and vectors against brute force; components; the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

from vigipanel.llm import embedding_dedup, minhash
from vigipanel.llm.components import components

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components_of_any_shape(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(3, 3), (5, 4), (5, 4)]
    links += [(draw.randrange(300), draw.randrange(300)) for _ in range(150)]
    draw.shuffle(links)
    want = Groups()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: want.find(n) for n in want if any(a != b and n in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute(rows, size, percent):
    sets, groups = {}, Groups()
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
        groups.find(i)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def family(draw, n, words, edits):
    base = [f"w{draw.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(500)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("rounds", [2, 0])
@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, percent, rounds):
    """Stars, repeated stars and the remaining pairs find the same links."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    draw = random.Random(size)
    texts = [None, "", " \n ", "one", "One", "one two", "a b c d e f g", "A b c d\te f G", *family(draw, 60, 120, 6), *family(draw, 25, 30, 2)]
    texts += [" ".join(f"u{draw.randrange(10_000)}" for _ in range(40)) for _ in range(30)] + ["long " * 5000]
    ids = draw.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id bigint, text string, bands string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size, percent).collect()}
    assert got == brute(list(zip(ids, texts)), size, percent)


def test_a_group_just_below_the_threshold_does_not_make_all_its_pairs(spark, monkeypatch):
    """Copies of one text with four edits each: every two of them have a rare shingle in common."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(100):
        own = list(base)
        for place in draw.sample(range(2, 150, 5), 4):
            own[place] = f"x{i}_{place}"
        rows.append((i, " ".join(own)))
    rows += [(100, rows[5][1] + " y"), (101, " ".join(base[:-1]))]
    made, linked = [], minhash.linked
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash, "linked", lambda pairs, *rest: made.append(pairs.count()) or linked(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute(rows, 3, 85)
    assert sum(made) < 5 * len(rows)


def test_parity_never_differs_in_more_places_than_sets(spark):
    draw = np.random.default_rng(3)
    for n, m, both in ((1, 1, 0), (40, 45, 38), (3000, 2000, 900)):
        hashes = draw.integers(0, 1 << 64, n + m, dtype=np.uint64)
        bits = [np.unpackbits(minhash.parity_of(np.sort(s)).view(np.uint8)) for s in (hashes[:n], hashes[n - both : n - both + m])]
        assert len(bits[0]) == minhash.PARITY
        assert (bits[0] != bits[1]).sum() <= n + m - 2 * both
    assert not minhash.parity_of(hashes[:0]).any()


def test_near_duplicates_without_ids_and_repeated(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u v"), (7, "q r s t u v"), (None, "q r s t u v"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [("7", "7", True), ("7", "7", True), ("None", "7", False), *[("None", "None", True)] * 3]
    left = minhash.one_of_each(docs).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == ["(7, 'q r s t u v')", "(None, 'a b c d e f')", "(None, None)"]
    assert minhash.near_duplicates(docs.limit(0)).count() == minhash.one_of_each(docs.limit(0)).count() == 0


def vectors(seed=4, clusters=12, dims=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(2, 40)):
            out.append((centre + rng.normal(size=dims) * 0.035).astype(np.float32))
    out += list(rng.normal(size=(150, dims)).astype(np.float32))
    return [v.tolist() for v in out] + [out[0].tolist(), out[0].tolist(), (2 * out[1]).tolist()]


@pytest.mark.parametrize("chunk", [embedding_dedup.CHUNK, 5])
def test_embedding_links_equal_brute_force(spark, chunk):
    own = vectors()
    rows = list(enumerate(own))
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [None] * 32), (9003, [float("nan")] * 32), (9004, [1.0, 0.0]), (9005, [2.0, 0.1]), (9006, []), (None, own[0])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<float>, links int")
    got = embedding_dedup.near_duplicates(table, chunk=chunk).collect()
    assert len(got) == len(rows) + len(odd)
    units = np.array(own, np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    near = units @ units.T >= 0.9
    near[np.arange(len(own)), np.arange(len(own))] = False
    groups = Groups()
    for i in range(len(own)):
        groups.find(i)
    for i, j in zip(*np.nonzero(near)):
        groups.join(int(i), int(j))
    with_none = near[:, 0].astype(int)  # the row without an id equals row 0
    with_none[0] = 1
    by_id = {r.vec_id: r for r in got}
    want = near.sum(1) + with_none
    # Filters may miss a link; at this size they find all but a few.
    assert sum(by_id[i].n_links for i in range(len(own))) >= 0.99 * want.sum()
    assert all(by_id[i].n_links <= want[i] for i in range(len(own)))
    assert np.mean([by_id[i].component_id == groups.find(i) for i in range(len(own))]) > 0.99
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in (9000, 9001, 9002, 9003, 9006))
    assert (by_id[9005].n_links, by_id[9005].component_id, by_id[9005].kept) == (1, 9004, False)
    assert not by_id[None].kept and by_id[None].component_id == 0


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_chunks_do_not_change_the_links(spark):
    table = spark.createDataFrame(list(enumerate(vectors(9, 3))), "vec_id bigint, embedding array<float>")
    one, many = (sorted(map(tuple, embedding_dedup.near_duplicates(table, chunk=c).collect())) for c in (1024, 3))
    assert one == many


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from vigipanel.llm.common import table

    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        empty = stage(spark, kept.limit(0), SF)
        assert empty.count() == 0 and empty.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
        assert kept.count() > 0.5 * docs.count() and kept.where("length(text) <> n_chars").count() == 0
    ids = kept.select("doc_id").distinct().count()
    assert ids == kept.count()
    assert pipeline.STAGES[-1][1](spark, kept, SF).count() == ids


def test_queries_are_registered_and_run_with_nulls():
    import __spark_entry__ as contract

    names = [q for q in contract.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("n_vectors", [10_000, 1_000_000, 100_000_000])
def test_links_meet_however_large_the_table(n_vectors):
    rng = np.random.default_rng(7)
    dims, n = 64, 200
    caps = embedding_dedup.caps_for(n_vectors)
    codes = embedding_dedup.codes_for(n_vectors, caps)
    x, z = rng.normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1)[:, None]
    met = [len(np.intersect1d(*(embedding_dedup.caps_of(v, codes, caps) for v in pair))) > 0 for pair in zip(x, y)]
    assert np.mean(met) >= 0.99


@pytest.mark.parametrize("dims,n_vectors,least", [(8, 10_000, 0.9), (8, 1_000_000, 0.9), (64, 1_000_000, 0.8), (384, 1_000_000, 0.9), (768, 10_000, 0.9)])
def test_settings_follow_length_and_cosine(dims, n_vectors, least):
    """Pairs at the very threshold, other than those that the setting was chosen by."""
    codes, caps = embedding_dedup.settings_for(dims, n_vectors, least)
    a, b = embedding_dedup.pairs_at(least, dims, 400, seed=77)
    assert (embedding_dedup.caps_needed(a, b, codes, caps) <= caps).mean() >= 0.99


def test_few_and_mixed_dimensions(spark):
    """Short vectors of several lengths: links equal those of a comparison of all."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(1, 2, 3, 8)[i % 4]).tolist()) for i in range(400)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = dict.fromkeys(range(400), 0)
    for size in (1, 2, 3, 8):
        ids = [i for i, v in rows if len(v) == size]
        units = np.array([rows[i][1] for i in ids])
        units /= np.linalg.norm(units, axis=1)[:, None]
        want |= {i: int(n) - 1 for i, n in zip(ids, (units @ units.T >= 0.9).sum(1))}
    assert sum(want.values()) > 5000 and got == want


def test_shingle_sets_equal_a_plain_cut():
    """Sets of a group of texts: as many shingles as a plain cut finds, equal where its sets are."""
    draw = random.Random(5)
    words = ["a", "B", "b", "\u00c9", "x" * 129, "\x1c", "12345678", "123456789"]
    texts = [None, "", " ", *("".join(draw.choice(words) + draw.choice([" ", "\t\n", "\x0b"]) for _ in range(draw.randrange(9))) for _ in range(500))]
    plain = []
    for text in texts:
        own = (text or "").encode().lower().split()
        plain.append(frozenset(tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))) if own else frozenset())
    got = [tuple(s.tolist()) for s in minhash.shingle_sets(texts, 3)]
    assert [len(s) for s in got] == [len(s) for s in plain] and all(list(s) == sorted(set(s)) for s in got)
    assert len(set(zip(got, plain))) == len(set(got)) == len(set(plain))
