import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators import metrics as V
from vigipanel.operators import topk


def scored(n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for model, noise in (("good", 0.3), ("bad", 3.0)):
        y = (rng.random(n) < 0.15).astype(int)
        p = np.round(1 / (1 + np.exp(-(2 * y - 1 + noise * rng.normal(size=n)))), 2)
        rows.append(pd.DataFrame({"model": model, "y": y, "p": p}))
    return pd.concat(rows)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("steps", [None, 4])
def test_auc_counts_ties_half(spark, steps):
    pdf = scored()
    got = V.auc(spark.createDataFrame(pdf), ["model"], steps=steps).toPandas().set_index("model").auc
    for model, rows in pdf.groupby("model"):
        assert got[model] == pytest.approx(brute_auc(rows.y.to_numpy(), rows.p.to_numpy()))


def test_auc_of_the_reversed_score(spark):
    df = spark.createDataFrame(scored())
    a = {r.model: r.auc for r in V.auc(df, ["model"]).collect()}
    b = {r.model: r.auc for r in V.auc(df.withColumn("p", 1 - F.col("p")), ["model"]).collect()}
    assert all(a[m] + b[m] == pytest.approx(1) for m in a)


def test_single_class(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 0, 0.9)], "model string, y int, p double")
    assert V.auc(df, ["model"]).first().auc is None
    sweep = V.threshold_sweep(df, V.GRID_SHORT, ["model"])
    row = sweep.where("threshold = 0.05").first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    best = V.best_threshold(sweep, ["model"], "f1", V.DEFAULT_SHORT).first()
    assert best.threshold == 0.15


def test_sweep_counts_add_up_and_recall_falls(spark):
    df = spark.createDataFrame(scored())
    pdf = V.threshold_sweep(df, V.GRID_RECALL, ["model"]).toPandas()
    assert (pdf[["tp", "fp", "fn", "tn"]].sum(axis=1) == 600).all()
    for _, rows in pdf.groupby("model"):
        assert rows.sort_values("threshold").recall.is_monotonic_decreasing


def test_lowest_threshold_wins_ties(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.01)], "model string, y int, p double")
    sweep = V.threshold_sweep(df, V.GRID_LONG, ["model"])
    assert V.best_threshold(sweep, ["model"]).first().threshold == 0.05
    assert V.best_threshold(sweep, ["model"], "recall", 0.2).first().threshold == 0.05


def test_recall_grid_has_nine_exact_steps():
    assert V.GRID_RECALL == (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)


def test_strict_and_inclusive_thresholds(spark):
    from vigipanel.functions.scalar import classify

    df = spark.createDataFrame([(0.2,), (0.3,), (None,)], "p double")
    strict = [r[0] for r in df.select(classify("p", 0.2, True)).collect()]
    loose = [r[0] for r in df.select(classify("p", 0.2, False)).collect()]
    assert strict == [0, 1, 0] and loose == [1, 1, 0]


def test_roc_reaches_the_corner(spark):
    pdf = V.roc_points(spark.createDataFrame(scored()), ["model"], steps=3).toPandas()
    for _, rows in pdf.groupby("model"):
        rows = rows.sort_values("threshold", ascending=False)
        assert rows.tpr.is_monotonic_increasing and rows.fpr.is_monotonic_increasing
        assert rows.iloc[-1].tpr == 1.0 and rows.iloc[-1].fpr == 1.0


def drawn(rows):
    """The curve by its definition: cumulated counts, equal steps left out, the origin in front."""
    out = []
    for m in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == m]
        p1, n0 = sum(r[1] for r in own), sum(1 - r[1] for r in own)
        points = [(t, sum(r[1] for r in own if r[2] >= t), sum(1 - r[1] for r in own if r[2] >= t)) for t in sorted({r[2] for r in own}, reverse=True)]
        for i, (t, tp, fp) in enumerate(points):
            if 0 < i < len(points) - 1:
                (_, a, b), (_, c, d) = points[i - 1], points[i + 1]
                if a + c == 2 * tp and b + d == 2 * fp:
                    continue
            out.append((m, t, fp / n0 if n0 else None, tp / p1 if p1 else None))
        out.append((m, float("inf"), 0.0 if n0 else None, 0.0 if p1 else None))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("steps", [None, 1, 3])
def test_drawn_curve_equals_its_definition(spark, steps):
    rows = [("a", int(i % 4 == 0), (i // 2) / 40) for i in range(80)] + [("b", 0, i / 10) for i in range(6)] + [("c", 1, 0.5), ("c", 0, 0.5)]
    rows += [(m, int(y), float(p)) for m, y, p in zip(*(scored()[c] for c in ("model", "y", "p")))]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    got = sorted(map(tuple, V.roc_curve(df, ["model"], steps=steps).collect()), key=lambda r: (r[0], r[1]))
    want = drawn(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:]) if None not in w else g[2:] == w[2:]


def test_waterfall_keeps_the_total(spark):
    values = {f"phi_f{i}": float((-1) ** i * i) for i in range(15)}
    wide = spark.createDataFrame([(1, *values.values()), (2, *[None] * 15)], "id int, " + ", ".join(f"{c} double" for c in values))
    both = topk.waterfall(wide, ["id"], 10)
    out = both.where("id = 1").toPandas().sort_values("position")
    assert len(out) == 11 and out.phi.is_monotonic_increasing and list(out.position) == [*range(1, 12)]
    assert out.phi.sum() == pytest.approx(sum(values.values()))
    others = out[out.feature == "Others"].phi.iloc[0]
    assert others == pytest.approx(sum([*values.values()][:5]))
    assert both.where("id = 2 and phi is null").count() == 11
    assert topk.waterfall(wide, ["id"], 15).where("id = 1").count() == 15


def test_explanations_stay_within_the_row(spark):
    wide = spark.createDataFrame([(i, float(i), -1.0 * i, 0.5, 2.0) for i in range(9)], "id int, a double, phi_a double, b double, phi_b double")
    importance = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "feature string, importance double")
    pairs = topk.dependence(wide, importance, ["id"], 1)
    assert sorted(map(tuple, pairs.collect()))[3] == (3, "a", -3.0, 3.0) and pairs.count() == 9
    for df in (pairs, topk.waterfall(wide, ["id"], 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_example_rows_fall_back_to_positions(spark):
    df = spark.createDataFrame([(3, 0, 1), (1, 0, 1), (2, 0, 1)], "id int, y int, yhat int")
    out = {r.example: r.id for r in topk.example_rows(df, ["id"]).collect()}
    assert out == {"true positive": 1, "true negative": 2}


def test_best_by_first_name_wins_ties(spark):
    df = spark.createDataFrame(
        [("b", 0.5, 0.1), ("a", 0.5, 0.3), ("c", 0.2, 0.9)], "model string, recall double, f1 double"
    )
    out = {r.metric: r.model for r in topk.best_by(df, ["recall", "f1"]).collect()}
    assert out == {"recall": "a", "f1": "c"}
