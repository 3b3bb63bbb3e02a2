import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel.operators.ranks import (
    exact_quantiles,
    rank_in_slices,
    running_sums,
    sorted_positions,
)

PROBS = {"q1": 0.25, "q3": 0.75, "p90": 0.9}


def skewed(n=4000, seed=1):
    """Half of the rows in one group, many of them with one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.3, 0.0, rng.lognormal(size=n))
    value[rng.random(n) < 0.02] = np.nan
    return pd.DataFrame({"k": key, "v": value})


@pytest.mark.parametrize("steps", [None, 3, 6])
def test_quantiles_match_pandas(spark, steps):
    pdf = skewed()
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = exact_quantiles(df, ["k"], "v", PROBS, steps=steps).toPandas().set_index("k")
    for name, q in PROBS.items():
        want = pdf.groupby("k").v.quantile(q)
        np.testing.assert_allclose(got[name].sort_index(), want.sort_index(), rtol=1e-12)


@pytest.mark.parametrize("steps", [None, 4])
def test_quantiles_of_the_whole_table(spark, steps):
    pdf = skewed(1500, seed=5).dropna()
    got = exact_quantiles(spark.createDataFrame(pdf), [], "v", {"median": 0.5}, steps=steps)
    assert got.first()["median"] == pytest.approx(pdf.v.median(), rel=1e-12)


def test_quantiles_of_constant_and_single_groups(spark):
    df = spark.createDataFrame([("c", 0.1)] * 7 + [("s", 3.0)], "k string, v double")
    rows = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS).collect()}
    assert (rows["c"].q1, rows["c"].q3, rows["c"].p90) == (0.1, 0.1, 0.1)
    assert rows["s"].p90 == 3.0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("steps", [None, 1, 5])
def test_running_sums_match_pandas(spark, steps, descending):
    counts = skewed(800, seed=9).dropna().groupby(["k", "v"]).size().reset_index(name="n")
    out = running_sums(
        spark.createDataFrame(counts), ["k"], "v", ["n"], descending=descending, steps=steps
    ).toPandas()
    want = counts.sort_values(["k", "v"], ascending=[True, not descending])
    want["n_before"] = want.groupby("k").n.cumsum() - want.n
    merged = out.merge(want, on=["k", "v"], suffixes=("", "_want"))
    assert len(merged) == len(want)
    assert (merged.n_before == merged.n_before_want).all()


def test_rank_in_slices_is_the_global_order(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"w": rng.integers(0, 9, 500), "p": rng.choice(list("abcd"), 500)})
    pdf["id"] = rng.permutation(500)
    ranked = rank_in_slices(
        spark.createDataFrame(pdf),
        slices=[F.col("w"), F.col("p")],
        order=["id"],
    ).toPandas()
    want = ranked.sort_values(["w", "p", "id"])
    assert want["rank"].tolist() == list(range(1, 501))


def test_rank_within_keys(spark):
    pdf = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 3, "t": [5, 3, 1, 2, 4, 9, 7, 8]})
    out = rank_in_slices(
        spark.createDataFrame(pdf), slices=[F.floor(F.col("t") / 2)], order=["t"], keys=["k"]
    ).toPandas()
    want = out.groupby("k").t.rank().astype(int)
    assert (out["rank"] == want).all()


def test_sorted_positions(spark):
    rng = np.random.default_rng(8)
    names = [f"Customer#{i:09d}" for i in rng.permutation(700)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    out = {r.name: r.position for r in sorted_positions(df, ["name"]).collect()}
    assert out == {n: i for i, n in enumerate(sorted(names))}


def test_missing_slices_and_keys_keep_their_rows(spark):
    rows = [(None, "a", 1), (None, None, 2), (3, None, 3), (3, "b", 4), (1, "a", 5)]
    df = spark.createDataFrame(rows, "w int, p string, id int")
    whole = rank_in_slices(df, slices=[F.col("w"), F.col("p")], order=["id"])
    assert {r.id: r["rank"] for r in whole.collect()} == {2: 1, 1: 2, 5: 3, 3: 4, 4: 5}
    within = rank_in_slices(df, slices=[F.col("w")], order=["id"], keys=["p"])
    assert {r.id: r["rank"] for r in within.collect()} == {1: 1, 5: 2, 2: 1, 3: 2, 4: 1}
