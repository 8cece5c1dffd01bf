import os
import random

import pytest
from pyspark.sql import functions as F

from resultlens.operators import etl, metrics
from resultlens.sources import readers
from resultlens.sources.stored import StoredTable

SCHEMA = "k long, s string, v string"


@pytest.fixture()
def table(spark, tmp_path):
    start = spark.createDataFrame([(k, "a", f"old{k}") for k in range(40)], SCHEMA)
    table = StoredTable.create(spark, f"file://{tmp_path}/t", start.schema, ["k", "s"], 8)
    table.merge(start)
    return table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges_against_dictionaries(spark, table):
    rng, held = random.Random(2), {(k, "a"): f"old{k}" for k in range(40)}
    for n in range(6):
        new = {(rng.randint(0, 60), rng.choice("ab")): rng.choice([f"n{n}", None]) for _ in range(15)}
        mode = ("upsert", "insert", "update")[n % 3]
        table.merge(spark.createDataFrame([(*k, v) for k, v in new.items()], SCHEMA), mode)
        for k, v in new.items():
            if mode == "upsert" or (mode == "insert" and k not in held) or (mode == "update" and k in held):
                held[k] = v
        assert rows(table.read()) == sorted(((*k, v) for k, v in held.items()), key=repr)


def test_only_touched_buckets_are_rewritten_and_the_last_row_of_a_key_counts(spark, table):
    before = table._current()["buckets"]
    twice = spark.createDataFrame([(3, "a", "first", 1), (3, "a", "last", 2)], SCHEMA + ", at int")
    touched = table.merge(twice, order="at")
    after = table._current()["buckets"]
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [str(touched[0])]
    assert table.read().where("k = 3").first()["v"] == "last" and table.merge(twice.limit(0)) == []


def test_a_broken_merge_changes_nothing_and_a_rerun_mends_it(spark, table, monkeypatch):
    want, new = rows(table.read()), spark.createDataFrame([(1, "a", "new"), (99, "b", "new")], SCHEMA)
    monkeypatch.setattr(StoredTable, "_publish", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.merge(new)
    monkeypatch.undo()
    assert rows(table.read()) == want
    for _ in range(2):
        table.merge(new)
        assert table.read().count() == 41 and table.read().where("v = 'new'").count() == 2


def test_writers_of_one_version_collide(spark, table):
    with pytest.raises(FileExistsError):
        table._publish(table._current())
    with pytest.raises(ValueError, match="null in the key"):
        table.merge(spark.createDataFrame([(None, "a", "x")], SCHEMA))
    with pytest.raises(ValueError, match="no such mode"):
        table.merge(table.read(), "replace")


def test_a_key_twice_is_found_by_the_pass_that_writes(spark, table):
    now = table._current()
    double = table.read().unionByName(table.read()).withColumn("__bucket", table._bucket(now))
    with pytest.raises(ValueError, match="not unique"):
        table._write(now, double.select("__bucket", "k", "s", "v"), list(range(8)))
    assert table.read().count() == 40


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """Splits of some hundred bytes; several files, one of them empty, lines that are long, empty or not of ASCII."""
    rng, want = random.Random(6), []
    for name in ("a", "b", "c"):
        lines = [rng.choice(["", "é漢", "x" * rng.randint(0, 700), f"SELECT {k}"]) for k in range({"a": 400, "b": 90, "c": 0}[name])]
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += [(name, k, x) for k, x in enumerate(lines)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        assert sorted((r["file"].rsplit("/")[-1][0], r["line"], r["value"]) for r in found.collect()) == sorted(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_predictions_by_entry_and_on_one_line(spark, tmp_path):
    text = '{\n    "0": "SELECT \\"}\\" , 1\\t----- bird -----\\tdb1",\n    "12": null,\n    "3": "SELECT 3\\t----- bird -----\\tdb2"\n}'
    for k, body in enumerate((text, text.replace("\n", " "), text.replace("    ", "").replace("{\n", "{"))):
        (tmp_path / f"{k}.json").write_text(body)
        got = sorted(tuple(r) for r in readers.predictions(spark, str(tmp_path / f"{k}.json")).collect())
        assert got == [(0, 'SELECT "}" , 1', "db1"), (3, "SELECT 3", "db2"), (12, " ", "financial")], k


def test_results_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,"b, c"\n1,"two\nlines"\n,3\n')
    (tmp_path / "x_a.csv").write_text("never,seen\n1,2\n")
    (tmp_path / "y_a.csv").write_text("only\n7\n")
    (tmp_path / "y_b.csv").write_text("k,l,m\n1,2,3\n4,5,6\n")
    (tmp_path / "z.csv").write_text("nothing\n")
    found = [(r["instance_id"], r["variant"], r["pos"], [tuple(c) for c in r["cells"]]) for r in readers.csv_results(spark, str(tmp_path)).collect()]
    assert sorted(found, key=lambda r: (r[0], r[1] or "", r[2])) == [
        ("x", None, 0, [("a", "1"), ("b, c", "two\nlines")]), ("x", None, 1, [("a", None), ("b, c", "3")]), ("y", "a", 0, [("only", "7")]),
        ("y", "b", 0, [("k", "1"), ("l", "2"), ("m", "3")]), ("y", "b", 1, [("k", "4"), ("l", "5"), ("m", "6")]),
    ]


def test_stages_counted_by_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(100)], "k int, v int")
    stages = {"v": F.col("v") > 0, "k": F.col("k") > 50}
    want = rows(etl.filter_summary(df, stages))
    batch = etl.StageCounts(stages)
    batch.filtered(df).write.format("noop").mode("overwrite").save()
    assert rows(batch.summary(spark)) == want
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = etl.StageCounts(stages)
    spark.streams.addListener(stream)
    try:
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.filtered(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # events come after the batches
            if stream._counts[0] >= 100:
                break
            __import__("time").sleep(0.1)
        assert rows(stream.summary(spark)) == want and os.listdir(tmp_path / "out")
    finally:
        spark.streams.removeListener(stream)


def test_quartile_summaries_err_by_no_more_than_stated(spark):
    rng = random.Random(1)
    values = [int(rng.paretovariate(1.1) * 100) for _ in range(20_000)]
    df = spark.createDataFrame([("x", v) for v in values], "level string, v long").repartition(8)
    for accuracy in (50, 1000):
        got = metrics.quartile_sketch(df, "level", "v", accuracy).where("level = 'x'").first()
        for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")):
            low, high = sum(v < got[name] for v in values), sum(v <= got[name] for v in values)
            assert low - len(values) / accuracy - 1 <= q * len(values) <= high + len(values) / accuracy + 1
