"""Filter audit, hard negatives and nearest neighbours against brute force on small tables."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigipanel.llm import filter_audit, hard_negatives, multi_index, vector_blocks
from vigipanel.llm.vector_blocks import BLOCK_BYTES, BLOCK_ROWS

# filter interaction audit

DOCS = "doc_id bigint, text string, source string, mask int, part string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int, n int"


def documents():
    draw = random.Random(5)
    long = lambda n, kinds: " ".join(f"w{draw.randrange(kinds)}" for _ in range(n))
    texts = [None, "", "  \t\n", "A", "a b c", "Price $5 & more", long(250, 400), long(250, 20), "UPPER " * 210, long(300, 1000) + " #x", "w " * 200_000]
    texts += [texts[6]] * 5 + ["a b c", "A  b\x0bc\x0cd\re"] + [draw.choice(texts) for _ in range(30)]
    rows = [(draw.randrange(1000), t, draw.choice(["x", "y", None, ""]), 1, "p", 2) for t in texts]
    rows += [rows[6], rows[6], (None, texts[6], "x", 1, "p", 2), (None, None, None, None, None, None), (rows[3][0], "other text", "y", 1, "p", 2)]
    labels = [(r[0], draw.choice([0, 1, None]), draw.choice([0, 1]), 7) for r in rows[::2]] + [(rows[0][0], 1, 0, 7), (None, 1, 1, 7)]
    return rows, labels


def audited(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marks = {i: [max([0] + [r[c] or 0 for r in labels if r[0] == i]) for c in (1, 2)] for i in {r[0] for r in rows} if i is not None}
    found = []
    for i, text, part, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        found.append((part or "", {c for c in fails if fails[c]}, marks.get(i, [0, 0])))
    out, orders = [], ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {f[0] for f in found}:
        own, credit, made = [f for f in found if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in orders:
            left = own
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                credit[c] += len(gone)
                again = sum(c in f[1] for f in own) - len(gone)
                made.append((part, order, step, len(left), len(gone), again, sum(f[1] == {c} for f in own), *(sum(f[2][k] for f in gone) for k in (0, 1))))
        out += [(*m, credit[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def test_audit_equals_brute_force_and_sql(spark):
    rows, labels = documents()
    cells = filter_audit.document_cells(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    got = sorted(map(tuple, filter_audit.audit(cells).collect()))
    assert got == audited(rows, labels)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar, mask int, part varchar, n bigint)")
    con.execute("create table labels(doc_id bigint, quality int, toxic int, n int)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?, ?)", rows)
    con.executemany("insert into labels values (?, ?, ?, ?)", labels)
    assert sorted(con.execute(filter_audit.oracle_sql()).fetchall()) == got


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.document_cells(docs, labels)).count() == 0
    rows = [(1, "a", "s", 1, "p", 1)]
    assert filter_audit.audit(filter_audit.document_cells(spark.createDataFrame(rows, DOCS), labels)).count() == 600


def test_removal_steps_are_the_first_failing_filter():
    orders = filter_audit.orders_of(4)
    masks = np.arange(16)
    fails = (masks[:, None] >> np.arange(4)) & 1 == 1
    steps = filter_audit.removal_steps(np.where(fails, 0, filter_audit.NEVER), np.argsort(orders, axis=1).T + 1)
    for m, o in itertools.product(masks, range(len(orders))):
        want = next((s for s, f in enumerate(orders[o], 1) if fails[m, f]), None)
        assert (steps[m, o] if steps[m, o] < filter_audit.NEVER else None) == want


def test_audit_gathers_no_hot_text(spark):
    rows = [(i, "the same text", "x", 1, "p", 1) for i in range(3000)] + [(7, "the same text", "x", 1, "p", 1)] * 2000
    cells = filter_audit.document_cells(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).collect()
    counts = {r["mask"]: r["docs"] for r in cells}
    assert counts == {0b00001: 1, 0b10001: 4999}


# hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, block int, score double, n int"


def vector_rows(seed=3, n=400, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    x = rng.normal(size=(n, dims)) * 0.4 + centres[rng.integers(0, 4, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[20:40] = x[20]  # ties
    labels = rng.integers(0, 3, n).tolist()
    rows = [(int(i), v.tolist(), l) for i, v, l in zip(rng.permutation(n), x, labels)]
    none, nan = [None] + [0.1] * (dims - 1), [float("nan")] * dims
    odd = [(1000, None, 1), (1050, none, 1), (1100, nan, 2), (1150, [0.0] * dims, 0), (1200, [], 1), (1250, [0.5, 0.5], 0), (1251, [0.4, 0.5], 0)]
    odd += [(1252, [0.3, 0.5], 1), (None, x[3].tolist(), 1), (1300, x[5].tolist(), None), (1350, [float("inf")] * dims, 1)]
    return [(*r, 1, 0.5, 9) for r in [*rows, *odd, rows[0], rows[0], rows[25]]]


def mined(rows, positives=5, negatives=3):
    own, seen = [], set()
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(p is not None and np.isfinite(p) for p in v):
            continue
        q = tuple(int(np.floor(256 * p)) for p in v)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            own.append((i, label, q))
    out = []
    for i, label, q in own:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, r[2])), r[0], r[1]) for r in own if len(r[2]) == len(q)))
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != i][:positives]:
            inside = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, p, k, r[1], -s, -r[0]) for k, r in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("per_block", [None, 30])
def test_hard_negatives_equal_brute_force(spark, per_block):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 50 == 0, per_block=per_block).collect()))
    assert got == mined(rows) and len(got) > 50


def test_hard_negatives_of_little(spark):
    anchors = F.col("vec_id") % 50 == 0
    for rows in ([], [(0, [1.0], 1, 1, 1.0, 1)], [(0, [1.0], 1, 1, 1.0, 1), (1, [1.0], 1, 1, 1.0, 1)], [(3, [1.0], 1, 1, 1.0, 1)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, VECTORS), anchors).count() == 0


def test_scan_drops_rows_before_the_last_dimension():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(500, 64)) * np.linspace(1, 0.01, 64))
    block = object.__new__(hard_negatives.Columns)
    block.ids, block.labels, block.alts, block.rows = np.arange(500), np.zeros(500, np.int64), np.arange(500), rows
    block.columns = np.ascontiguousarray(rows.T)
    block.low, block.high = block.columns.min(1), block.columns.max(1)
    left = []
    scan = hard_negatives.Scan(rows[7], block)
    run = scan.run
    scan.run = lambda r, shrink: run(r, lambda s, a, b: left.append(int((keep := shrink(s, a, b)).sum())) or keep)
    ids, scores = hard_negatives.best_of_label(scan, 7, 0, 5)
    want = sorted((-int(rows[i] @ rows[7]), i) for i in range(500) if i != 7)[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    assert left == sorted(left, reverse=True) and left[-2] < 100


# nearest neighbours


def true_neighbours(rows, k=5):
    own, seen = [], set()
    for i, v, *_ in rows:
        if i is None or not v or not all(p is not None and np.isfinite(p) for p in v) or not any(v) or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        u = np.array(v, float) / np.linalg.norm(v)
        own.append((i, u))
    out = {}
    for i, u in own:
        if i % 50 == 0:
            out[i] = sorted((-float(u @ w), j) for j, w in own if j != i and len(w) == len(u))[:k]
    return out


@pytest.mark.parametrize("pool, per_block", [(10_000, None), (10_000, 30), (12, 100)])
def test_neighbours_equal_brute_force(spark, pool, per_block):
    rows = vector_rows(8)
    table = spark.createDataFrame(rows, VECTORS)
    found, want = {}, true_neighbours(rows)
    for r in multi_index.search(table, F.col("vec_id") % 50 == 0, pool=pool, per_block=per_block).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found.keys() == {i for i, near in want.items() if near}
    hits = 0
    for i, near in found.items():
        near.sort()
        assert [r for r, _, _ in near] == [*range(1, len(near) + 1)] and len(near) == len(want[i])
        assert all(a[2] >= b[2] for a, b in zip(near, near[1:]))
        hits += sum(any(abs(s + t) < 1e-12 for t, _ in want[i]) for _, _, s in near)
        if pool == 10_000:
            assert np.allclose([s for _, _, s in near], [-t for t, _ in want[i]], atol=1e-12)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_probing_retrieves_every_code_of_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (700, 8), dtype=np.uint8)
    codes[:200] = codes[0]
    codes[200:300] = codes[200] ^ (1 << rng.integers(0, 8, (100, 8))).astype(np.uint8)
    index = multi_index.Index.of(codes)
    for q in (0, 200, 250, 650):
        distance = np.unpackbits(codes ^ codes[q], axis=1).sum(1)
        different = {tuple(c): d for c, d in zip(codes, distance)}
        for enough in (1, 5, 40, 10_000):
            radius = sorted(different.values())[min(enough, len(different)) - 1]
            got = set(index.within(codes[[q, 3]], enough)[0].tolist())
            assert {*np.flatnonzero(distance <= radius).tolist()} <= got
            assert got == {*np.flatnonzero(distance <= max(distance[list(got)])).tolist()}


@pytest.mark.parametrize("dims", [8, 64, 384])
def test_recall_on_vectors_without_structure(dims):
    """Random directions are the hard case: the nearest are hardly nearer than the others."""
    rng = np.random.default_rng(dims)
    x = multi_index.units(rng.normal(size=(min(BLOCK_ROWS, BLOCK_BYTES // 8 // dims), dims)))
    mean, directions = multi_index.learn(x[:2000])
    codes = multi_index.codes_of(x, mean, directions)
    index, ids, hits = multi_index.Index.of(codes), np.arange(len(x)), 0
    asked = range(0, len(x), len(x) // 100)
    for q, near in zip(asked, index.within(codes[asked], multi_index.POOL)):
        found, _ = multi_index.nearest(x, ids, x[q], q, near, 5)
        best, _ = multi_index.nearest(x, ids, x[q], q, ids, 5)
        hits += len(set(found) & set(best))
    assert hits >= 0.9 * 5 * len(asked)


def test_neighbours_of_little(spark):
    queries = F.col("vec_id") % 50 == 0
    assert multi_index.search(spark.createDataFrame([], VECTORS), queries).count() == 0
    one = [(0, [1.0, 2.0], 1, 1, 1.0, 1)]
    assert multi_index.search(spark.createDataFrame(one, VECTORS), queries).count() == 0
    two = multi_index.search(spark.createDataFrame([*one, (3, [2.0, 4.0], 1, 1, 1.0, 1)], VECTORS), queries).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 3)] and abs(two[0].score - 1) < 1e-15


# blocks of queries beside blocks of rows


def plans_of(monkeypatch):
    """Plans of what the operators give to Python, as they are made."""
    plans = []
    for module in (hard_negatives, multi_index, vector_blocks):
        if hasattr(module, "map_batches"):
            given = module.map_batches
            monkeypatch.setattr(module, "map_batches", lambda df, *a, given=given: plans.append(df._jdf.queryExecution().executedPlan().toString()) or given(df, *a))
    return plans


@pytest.mark.parametrize("operator", [hard_negatives.mine, multi_index.search])
def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch, operator):
    """The planner knows a block's size but not its copies, which are as many as the other side's blocks."""
    plans = plans_of(monkeypatch)
    operator(spark.createDataFrame(vector_rows(), VECTORS), F.col("vec_id") % 50 == 0, per_block=20).collect()
    dealt = [p for p in plans if "explode" in p]
    assert dealt and not any("Broadcast" in p for p in dealt)


@pytest.mark.parametrize("teams, team_blocks, held", [(1, 100, 1 << 30), (3, 4, 1), (2, 7, 500)])
def test_teams_and_sets_give_the_same(spark, monkeypatch, teams, team_blocks, held):
    rows, anchors = vector_rows(4), F.col("vec_id") % 50 == 0
    table = spark.createDataFrame(rows, VECTORS)
    for name, value in (("TEAMS", teams), ("TEAM_BLOCKS", team_blocks), ("HELD_BYTES", held)):
        monkeypatch.setattr(vector_blocks, name, value)
    got = sorted(map(tuple, hard_negatives.mine(table, anchors, per_block=20).collect()))
    assert got == mined(rows) and len(got) > 50
    found, want = {}, true_neighbours(rows)
    for r in multi_index.search(table, anchors, pool=10_000, per_block=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score))
    for i, near in found.items():
        assert np.allclose([s for _, s in sorted(near)], [-t for t, _ in want[i]], atol=1e-12)
    assert found.keys() == {i for i, near in want.items() if near}


def block_of(rng, label, n, dims, scale):
    values = np.floor(scale * rng.normal(size=(n, dims)))
    labels = np.sort(rng.integers(0, label, n))
    whole = lambda x: np.asarray(x, "<i8").tobytes()
    ids = rng.permutation(n)
    row = {"n": n, "dims": dims, "ids": whole(ids), "labels": whole(labels), "alts": whole(ids), "vectors": values.astype("<f8").tobytes()}
    return row, values, labels, ids


@pytest.mark.parametrize("dims, scale", [(64, 30), (64, 1e5), (5, 30), (0, 1)])
def test_scans_of_several_blocks_equal_all_products(dims, scale):
    """Anchors carry their best from block to block, in single precision only where that is exact."""
    rng = np.random.default_rng(dims)
    asked, anchors, own, whose = block_of(rng, 3, 40, dims, scale)
    blocks = [block_of(rng, 3, 300, dims, scale) for _ in range(5)]
    scores = [(anchors.astype(np.int64) @ v.T.astype(np.int64), labels, ids) for _, v, labels, ids in blocks]
    table = [r for b in hard_negatives._positives(4)([asked], iter([b[0] for b in blocks])) for r in b.to_pylist()]
    bars = []
    for i, (a, label) in enumerate(zip(whose, own)):
        found = sorted((-int(s[i, j]), int(ids[j])) for s, labels, ids in scores for j in np.flatnonzero((labels == label) & (ids != a)))[:4]
        assert [(-r["positive_score"], r["positive_id"]) for r in table if r["anchor_id"] == a] == found
        bars.append({"id": int(a), "alt": int(a), "scores": [-s for s, _ in found]})
    table = [r for b in hard_negatives._negatives(3, 50, 95)([{**asked, "bars": bars}], iter([b[0] for b in blocks])) for r in b.to_pylist()]
    for i, (a, label, bar) in enumerate(zip(whose, own, bars)):
        for place, p in enumerate(bar["scores"]):
            found = sorted((-int(s[i, j]), int(ids[j])) for s, labels, ids in scores for j in np.flatnonzero((labels != label) & (50 * p <= 100 * s[i]) & (100 * s[i] <= 95 * p)))[:3]
            assert [(-r["negative_score"], r["negative_id"]) for r in table if r["anchor_id"] == a and r["place"] == place] == found
