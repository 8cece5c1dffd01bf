import pytest
from pyspark.sql import functions as F

from resultlens.operators import etl, metrics, vectors
from resultlens.sources import readers, sinks


def show(df):
    return sorted(map(tuple, df.collect()))


def test_datasets_prefer_a_split(spark, tmp_path):
    for split, rows in (("train", [(1, "a")]), ("test", [(2, "b")])):
        spark.createDataFrame(rows, "id int, v string").write.parquet(str(tmp_path / "one" / split))
    spark.createDataFrame([(3,)], "id int").write.parquet(str(tmp_path / "two"))
    assert show(readers.datasets(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).select("id")) == [(1,), (3,)]


def test_prefixes_and_samples(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    assert show(readers.seeded_sample(df, "id", 5)) == show(readers.seeded_sample(df.repartition(7), "id", 5)) and readers.seeded_sample(df, "id", 500).count() == 100
    assert show(readers.first_rows(df, "id", 2)) == [(0, 0), (1, 1)] and readers.first_rows(df, "id", 3, "g").count() == 6


def test_candidates_and_caches(spark, tmp_path):
    df = spark.createDataFrame([("s", ["a", "b"], ["x", "y"])], "sample_id string, sqls array<string>, completions array<string>")
    assert show(readers.candidate_rows(df, ["sqls", "completions"])) == [("s", 0, "a", "x"), ("s", 1, "b", "y")]
    cache = spark.createDataFrame([("s", [(2, "b"), (1, "a")])], "sample_id string, candidates array<struct<index:int,sql:string>>")
    cache.write.parquet(str(tmp_path / "c"))
    assert [c["sql"] for c in readers.cached_results(spark, str(tmp_path / "c")).first()["candidates"]] == ["a", "b"]


def test_logs_and_json(spark, tmp_path):
    (tmp_path / "log").write_text("noise\nEX accuracy: 67.8\n")
    assert show(readers.scrape(spark, str(tmp_path / "log"), r"accuracy: ([0-9.]+)")) == [("67.8",)]
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert show(readers.json_rows(spark, str(tmp_path / "a.json"))) == [(1,), (2,)]
    assert show(readers.find(spark.range(9), F.col("id") > 3, ["id"], 2, ["id"])) == [(4,), (5,)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 2 == 0, "timeout" if k == 1 else "rows") for k in range(20)], "prompt_id int, ok boolean, status string")
    sinks.train_test(rows, str(tmp_path / "sft"))
    assert spark.read.parquet(str(tmp_path / "sft/test_sft")).count() == 10 and spark.read.parquet(str(tmp_path / "sft/train_sft")).count() == 20
    sinks.write_failed(rows, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 10
    sinks.write_timeouts(rows.withColumns({"dataset": F.lit("d"), "db": F.lit("b"), "sql": F.lit("q"), "error": F.lit(None).cast("string")}), str(tmp_path / "late"))
    assert show(spark.read.text(str(tmp_path / "late"))) == [("d\tb\tq\t",)]
    sinks.write_per_sample(rows, str(tmp_path / "each"), "status")
    assert (tmp_path / "each" / "status=timeout").exists()
    assert sinks.report(rows.orderBy("prompt_id"), ["prompt_id", "ok"], 1).split("\n") == ["prompt_id ok", "0         True"]


def test_ids_in_order_by_ranges(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    got = etl.prompt_ids(df, ["k"], per=9)
    assert show(got.select("k", "prompt_id")) == [(k, f"prompt_{k:06d}") for k in range(50)]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        etl.require(df, "k", "missing")
    with pytest.raises(ValueError):
        etl.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        etl.by_position(df.withColumnRenamed("k", "index"), df.limit(1).withColumnRenamed("k", "index"))


def test_reports(spark):
    df = spark.createDataFrame([("simple", True), (None, False), ("extra", True)], "difficulty string, correct boolean")
    got = [tuple(r) for r in metrics.ex_by_level(df).orderBy(*metrics.preferred_order()).collect()]
    assert got == [("simple", 2, 50.0), ("extra", 1, 100.0), ("overall", 3, 66.6667)]


def test_vectors_at_the_edges(spark, monkeypatch):
    memory = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 2, [0.0, 0.0])], "id int, db_id int, embedding array<float>")
    probes = spark.createDataFrame([(7, 1, [1.0, 0.0]), (8, 9, [0.0, 0.0])], "id int, db_id int, embedding array<float>")
    near = vectors.nearest(probes, memory, 1)
    monkeypatch.setattr(vectors, "MAX_PROBES", 1)
    assert show(vectors.nearest(probes, memory, 1)) == show(near) == [(7, 1, 0.0, 1), (8, 3, 0.0, 1)]
    assert show(vectors.thought_reward(probes, memory.limit(0), 3)) == [(7, 0.0), (8, 0.0)]
    assert vectors.insert_if_absent(memory, probes.union(probes)).count() == 5
