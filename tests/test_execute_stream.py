import pytest
from pyspark.sql import functions as F

from resultlens.operators.execute import Request, execute, kind_of
from resultlens.operators.reward import as_callback
from resultlens.sources import readers, sinks
from resultlens.sources.catalog import Catalog
from resultlens.streaming import memory


@pytest.fixture(scope="module")
def catalog(sf):
    root, name = sf.rsplit("/", 1)
    return Catalog(root.rsplit("/", 1)[0], roots={"set": [root.rsplit("/", 1)[1]]}), name


def run(spark, catalog, sql, **more):
    return execute(spark, catalog[0], Request("set", catalog[1], sql, **more))


def test_envelopes(spark, catalog):
    good = run(spark, catalog, "SELECT r_name FROM region ORDER BY r_name", max_rows=2)
    assert good.ok and good.row_count == 2 and good.statement_type == "SELECT" and "r_name" in good.pandas_result
    assert run(spark, catalog, "SELECT r_name FROM region WHERE 1 = 0").pandas_result == "Empty result set"
    assert "not allowed" in run(spark, catalog, "DROP TABLE region").error
    assert not run(spark, catalog, "SELECT nothing FROM region").ok
    assert not run(spark, catalog, "SHOW TABLES").ok
    note = run(spark, catalog, "DELETE FROM region", mode="sandbox_rollback")
    assert note.ok and note.rows is None and note.notice
    assert kind_of("  ") == "UNKNOWN"


def test_last_of_equal_names_stays(spark, catalog):
    assert run(spark, catalog, "SELECT 1 AS a, 2 AS a").rows == [{"a": 2}]


def test_sqlite_spellings(spark, catalog):
    out = run(spark, catalog, "SELECT [r_name], IFNULL(NULL, 2) AS two, 1 / 0 AS none, strftime('%Y', '2020-05-01') AS y FROM \"region\" ORDER BY 1 LIMIT 1;")
    assert out.rows[0]["two"] == 2 and out.rows[0]["none"] != out.rows[0]["none"] or out.rows[0]["none"] is None
    assert out.rows[0]["y"] == "2020"


def test_timeout(spark, catalog):
    out = run(spark, catalog, "SELECT count(*) FROM lineitem a, lineitem b, nation c, region d WHERE a.l_tax + b.l_tax + length(c.n_name) + length(d.r_name) > 17", timeout_ms=1500)
    assert out.timed_out and not out.ok


def test_names_do_not_leave_the_root():
    with pytest.raises(ValueError):
        Catalog("/data").folders("set", "../x")
    with pytest.raises(ValueError):
        Request("set", "db", "SELECT 1", timeout_ms=0)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("2", "q2", "SELECT\n 2", "b"), ("10", "q10", " ", "a")], "sample_id string, question string, sql string, db_id string")
    assert [tuple(r) for r in sinks.lines_export(rows).collect()] == [(0, 2, "SELECT 2"), (1, 10, "SELECT 1")]
    sinks.write_lines(rows, str(tmp_path / "lines"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "lines/mapping")).count() == 2
    sinks.write_samples(rows.withColumn("log", F.lit("fine")), rows.select("sample_id", "question"), str(tmp_path / "samples"), "sample_id")
    assert (tmp_path / "samples/sql/sample_id=2").exists() and (tmp_path / "samples/result/sample_id=10").exists()
    assert sinks.pairs_export(rows).count() == 2
    (tmp_path / "gold.sql").write_text("SELECT 1\tdb1\nSELECT 2\tdb2\n")
    assert [tuple(r) for r in readers.gold_lines(spark, str(tmp_path / "gold.sql")).orderBy("sample_idx").collect()] == [(0, "SELECT 1", "db1"), (1, "SELECT 2", "db2")]
    (tmp_path / "p.json").write_text('{"0": "SELECT 1\\t----- bird -----\\tdb1", "1": null}')
    assert [tuple(r) for r in readers.predictions(spark, str(tmp_path / "p.json")).orderBy("sample_idx").collect()] == [(0, "SELECT 1", "db1"), (1, " ", "financial")]
    (tmp_path / "csv").mkdir()
    for name in ("x", "x_a", "y_a", "y_b"):
        (tmp_path / "csv" / f"{name}.csv").write_text("v\n1\n")
    found = readers.csv_results(spark, str(tmp_path / "csv"))
    assert sorted((r["instance_id"], r["variant"]) for r in found.collect()) == [("x", None), ("y", "a"), ("y", "b")]
    cache = str(tmp_path / "cache")
    assert sinks.write_cache(rows, cache) and not sinks.write_cache(rows.limit(1), cache)


def test_memory_grows_as_one_batch_or_many(spark, tmp_path):
    rows = [(k, str(k), "c", [float(k % 3 == 0), float(k % 3 == 1), float(k % 3 == 2)]) for k in range(9)]
    schema = "arrival int, id string, collection string, embedding array<float>"
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(*r[:1], *r[1:]) for r in rows[3 * k : 3 * k + 3]], schema).withColumn("db_id", F.lit(1)).write.mode("append").parquet(str(source))
    full = spark.read.parquet(str(source))
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 2).parquet(str(source))
    memory.grow_memory(stream, str(tmp_path / "mem"), str(tmp_path / "ck")).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "mem"))
    once = memory.admit(full, full.limit(0), str(tmp_path / "once"), block=4)
    assert kept.count() == once.count() == 3


def test_cache_takes_what_is_missing(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(k % 4,) for k in range(8)], "k int").write.parquet(str(source))
    stream = spark.readStream.schema("k int").parquet(str(source))
    memory.fill_cache(stream, str(tmp_path / "c"), str(tmp_path / "ck"), ["k"], lambda df: df.withColumn("status", F.lit("rows"))).awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "c")).count() == 4


def test_batches_that_run_again_lose_nothing(spark, tmp_path):
    """A retry of a batch, as after a crash, and of an earlier one."""
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k, str(k), "c", 1, [float(k == 0), float(k == 1), float(k == 2)]), (k + 3, str(k + 3), "c", 1, [1.0, 0.0, 0.0])], "arrival int, id string, collection string, db_id int, embedding array<float>").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    for again in range(2):  # a lost checkpoint makes every batch run again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        memory.grow_memory(stream, str(tmp_path / "mem"), str(tmp_path / f"ck{again}")).awaitTermination()
        assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "mem")).count() == 3
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        memory.fill_cache(stream.select("id"), str(tmp_path / "c"), str(tmp_path / f"cc{again}"), ["id"], lambda df: df.withColumn("status", F.lit("rows"))).awaitTermination()
        assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "c")).count() == 6


def test_reward_callback(spark):
    call = as_callback(spark, lambda df: df.select("row", F.length("completion").cast("double").alias("reward")))
    assert call(["p", "q"], ["abc", "a"], db=["x", "y"]) == [3.0, 1.0]
