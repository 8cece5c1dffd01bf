import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resultlens.functions import vector_blocks
from resultlens.functions.vectors import cosine, l2_squared
from resultlens.operators import vector_index, vectors

SCHEMA = "id long, db_id int, embedding array<float>"


def rows():
    """Copies in several databases, and vectors that are null, hold null, infinite or no numbers, are huge, or have another length."""
    rng = np.random.default_rng(3)
    plain = [(k, k % 3 if k % 10 else None, np.round(rng.normal(size=4), 1).tolist()) for k in range(60)]
    copies = [(100 + k, k % 2, plain[0][2]) for k in range(12)]
    odd = [None, [1.0, None, 0.0, 0.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [0.5, 0.5], [], [0.0] * 4]
    return plain + copies + [(200 + k, k % 3, v) for k, v in enumerate(odd)]


def plain_nearest(rows, k, scope):
    """By the column function, pair by pair; what has no distance is last."""
    a, b = (rows.select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns)) for p in "pm")
    cond = {"other": "p_db_id <> m_db_id", "same": "p_db_id = m_db_id", "any": "true"}[scope]
    pairs = a.crossJoin(b).where(cond).select("p_id", "m_id", l2_squared(F.col("m_embedding"), F.col("p_embedding")).alias("d")).collect()
    found = {}
    for r in pairs:
        found.setdefault(r["p_id"], []).append((2, 0.0, r["m_id"]) if r["d"] is None else (1, 0.0, r["m_id"]) if math.isnan(r["d"]) else (0, r["d"], r["m_id"]))
    return sorted((p, m, str((d, math.nan, None)[kind]), n + 1) for p, all_of in found.items() for n, (kind, d, m) in enumerate(sorted(all_of)[:k]))


def show(df):
    return sorted((r["probe_id"], r["id"], str(r["distance"]), r["place"]) for r in df.select("probe_id", "id", "distance", "place").collect())


@pytest.mark.parametrize("blocks", [(20_000, 25_000), (7, 9)])
@pytest.mark.parametrize("scope", vectors.SCOPES)
def test_blocks_give_what_the_column_function_gives(spark, monkeypatch, scope, blocks):
    monkeypatch.setattr(vectors, "MAX_PROBES", blocks[0])
    monkeypatch.setattr(vectors, "MEMORY_BLOCK", blocks[1])
    df = spark.createDataFrame(rows(), SCHEMA)
    assert show(vectors.nearest(df, df, 5, scope)) == plain_nearest(df, 5, scope)


def test_greatest_cosine_gives_what_the_column_function_gives(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    pairs = df.select(F.col("id").alias("probe_id"), F.col("embedding").alias("p")).crossJoin(df.select("embedding"))
    best = {r["probe_id"]: r["b"] for r in pairs.groupBy("probe_id").agg(F.max(cosine(F.col("embedding"), F.col("p"))).alias("b")).collect()}
    for most in (25_000, 9):
        monkeypatch.setattr(vectors, "MEMORY_BLOCK", most)
        assert {r["probe_id"]: r["similarity"] for r in vectors.greatest_cosine(df, df).collect()} == best
    assert vectors.greatest_cosine(df, df.limit(0)).count() == 0


def test_rows_without_a_vector_come_last(spark):
    memory = spark.createDataFrame([(1, 1, None), (2, 1, [3.0, 0.0]), (3, 1, [1.0, 0.0])], SCHEMA)
    probe = spark.createDataFrame([(7, 1, [1.0, 0.0])], SCHEMA)
    assert [(r["id"], r["distance"]) for r in vectors.nearest(probe, memory, 3).orderBy("place").collect()] == [(3, 0.0), (2, 4.0), (1, None)]


def test_pairs_are_multiplied_in_blocks(spark, tmp_path, capsys):
    """No join makes a row of every pair."""
    df = spark.createDataFrame(rows()[:60], SCHEMA)
    vector_index.build(df, str(tmp_path / "i"), lists=3)
    for found in (vectors.nearest(df, df, 5), vectors.greatest_cosine(df, df), vector_index.search(spark, str(tmp_path / "i"), df, 5, 3)):
        found.explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


@pytest.mark.parametrize("k", [1, 5, 40])
def test_a_bound_of_the_kth_least_lets_few_pairs_through(k):
    """Never under the k-th least value, hardly over it, and no number counts last, as in an ordering of whole rows."""
    rough = np.random.default_rng(2).normal(size=(30, 6_403))
    rough[:, 5::7], rough[:, ::50] = np.inf, np.nan
    rough[7], rough[8, 3:] = np.nan, np.inf
    bound, exact = vector_blocks._at_least_kth(rough, k), np.partition(rough, k - 1, axis=1)[:, k - 1]
    assert np.array_equal(bound, exact, equal_nan=True) if k == 1 else not (bound < exact).any()
    assert (np.isnan(bound) >= np.isnan(exact)).all() and (rough <= bound[:, None])[:7].sum() <= 7 * 2 * k


@pytest.mark.parametrize("scope", vectors.SCOPES)
def test_wide_blocks_give_the_nearest(scope):
    """Blocks of so many vectors that minima of groups decide, with copies and odd vectors among them."""
    rng = np.random.default_rng(4)
    y, x = np.round(rng.normal(size=(3_000, 3)), 1), np.round(rng.normal(size=(20, 3)), 1)
    y[::97], y[5::301] = x[0], np.nan
    kinds, own = rng.integers(-1, 4, 3_000), rng.integers(-1, 4, 20)
    i, j, d, none = vector_blocks.nearest_rows(pa.array(x.tolist()), own, pa.array(y.tolist()), kinds, 5, scope)
    for p in range(20):
        may = np.arange(3_000)
        if scope != "any":
            may = may[(kinds >= 0) & (own[p] >= 0) & ((kinds == own[p]) == (scope == "same"))]
        all_of = ((x[p] - y[may]) ** 2).cumsum(1)[:, -1]
        first = may[np.lexsort((may, all_of))][:5]
        assert j[(i == p) & ~none].tolist() == first.tolist()
