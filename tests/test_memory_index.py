import numpy as np
import pytest
from pyspark.sql import functions as F

from resultlens.operators import vector_index, vectors
from resultlens.streaming import memory

SCHEMA = "arrival long, id string, collection string, embedding array<float>"


def clustered(n, seed, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(k, f"v{rng.integers(0, n):04d}", "ab"[int(rng.integers(0, 2))], (centres[rng.integers(0, 5)] * rng.uniform(0.5, 2) + rng.normal(size=dims) * 0.3).astype(np.float32).tolist()) for k in range(n)]
    return rows + [(n, "null", "a", None), (n + 1, "copy", "a", rows[0][3]), (n + 2, "zero", "b", [0.0] * dims), (n + 3, "zero2", "b", [0.0] * dims)]


def plain_entering(rows, threshold):
    """One row after another: the nearest of the collection that is in decides."""
    kept, seen = [], set()
    for arrival, i, c, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if v is None or (c, i) in seen:
            continue
        v = np.array(v, float)
        near = min(((round(float(((v - w) ** 2).sum()), 9), j, float(v @ w / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-8))) for _, j, d, w in kept if d == c), default=None)
        if near is None or near[2] < threshold:
            kept.append((arrival, i, c, v))
            seen.add((c, i))
    return sorted(a for a, *_ in kept)


@pytest.mark.parametrize("block", [1000, 40, 7])
def test_blocks_enter_as_one_row_after_another(spark, tmp_path, block):
    rows = clustered(150, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = memory.admit(df, df.limit(0), str(tmp_path / "m"), 0.9, block=block)
    assert sorted(r["arrival"] for r in out.collect()) == plain_entering(rows, 0.9)
    assert memory.admit(df.limit(0), df, str(tmp_path / "n")).count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_memory_is_the_same_however_the_stream_is_cut(spark, tmp_path, files):
    rows = clustered(60, 8)
    for k in range(files):
        part = [r for r in rows if r[0] * files // len(rows) == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    memory.grow_memory(stream, str(tmp_path / "mem"), str(tmp_path / "ck")).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "mem"))
    assert sorted(r["arrival"] for r in kept.collect()) == plain_entering(rows, 0.9)


def test_index_finds_what_it_should(spark, tmp_path, monkeypatch):
    """Lists in several chunks; all lists are exact in each scope, some lists nearly so; scarce scopes are searched on."""
    monkeypatch.setattr(vector_index, "LIST_ROWS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(k, k % 7, (centres[rng.integers(0, 12) if k % 3 else 0] + rng.normal(size=16)).tolist()) for k in range(1200)] + [(5000, 99, rows_v) for rows_v in [[0.0] * 16]] + [(5001, 1, None)]
    m = spark.createDataFrame(rows, "id long, db_id int, embedding array<float>")
    p = m.where("id % 100 = 0")
    vector_index.build(m, str(tmp_path / "i"), lists=24, sample=500)
    assert spark.read.parquet(str(tmp_path / "i/vectors")).count() == 1201 and spark.read.parquet(str(tmp_path / "i/lists")).agg(F.max("chunks")).first()[0] > 3
    pick = lambda df: sorted((r["probe_id"], r["id"], r["place"]) for r in df.collect())
    for scope in vectors.SCOPES:
        exact = vectors.nearest(p, m.where("embedding IS NOT NULL"), 5, scope)
        assert pick(vector_index.search(spark, str(tmp_path / "i"), p, 5, 24, scope)) == pick(exact)
        assert vector_index.recall(vector_index.search(spark, str(tmp_path / "i"), p, 5, 8, scope), exact).first()["recall"] >= 0.9
    few = vector_index.lists_for(spark, str(tmp_path / "i"), 5, 0.9)
    assert few < 12 and vector_index.lists_for(spark, str(tmp_path / "i"), 5, 1.0) >= few
    assert vector_index.recall(vector_index.search(spark, str(tmp_path / "i"), p, 5, few), vectors.nearest(p, m.where("embedding IS NOT NULL"), 5)).first()["recall"] >= 0.85
    lone = spark.createDataFrame([(9, 99, [50.0] * 16)], m.schema)
    assert pick(vector_index.search(spark, str(tmp_path / "i"), lone, 1, 1, "same")) == [(9, 5000, 1)]


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, db_id int, embedding array<float>")
    vector_index.build(none, str(tmp_path / "i"))
    assert vector_index.search(spark, str(tmp_path / "i"), none, 5, 3).count() == 0


@pytest.mark.parametrize(("fetch", "block"), [(30, 7), (50, 1000), (4096, 20)])
def test_several_blocks_meet_the_memory_in_one_job(spark, tmp_path, monkeypatch, fetch, block):
    """As one row after another, also where rows of some fetches are in the memory before; the jobs follow the fetches, not the blocks."""
    monkeypatch.setattr(memory, "FETCH", fetch)
    met, real = [], memory._against
    monkeypatch.setattr(memory, "_against", lambda x, *a: met.append(len(x)) or real(x, *a))
    rows = clustered(150, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = memory.admit(df, df.limit(0), str(tmp_path / "m"), 0.9, block=block)
    assert sorted(r["arrival"] for r in out.collect()) == plain_entering(rows, 0.9)
    assert sum(met) == 153 and len(met) <= 153 // max(fetch, block) + 2


def test_a_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(clustered(60, 5), SCHEMA)
    memory.admit(df.mapInArrow(count, SCHEMA), df.limit(0), str(tmp_path / "m"), 0.9, block=20)
    assert seen.value == 64
