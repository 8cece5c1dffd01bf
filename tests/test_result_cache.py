import os

import pytest
from pyspark.sql import functions as F

from resultlens.operators import result_cache, reward
from resultlens.operators.result_cache import ResultCache
from resultlens.plans.executed import ENDLESS
from resultlens.sources.catalog import Catalog
from resultlens.streaming import memory


@pytest.fixture()
def known(spark, sf, tmp_path):
    root, name = sf.rsplit("/", 1)
    return ResultCache(spark, Catalog(root.rsplit("/", 1)[0], roots={"set": [root.rsplit("/", 1)[1]]}), f"file://{tmp_path}/cache", every=2, concurrent=3, max_rows=10), name


def asked(spark, db, *sqls):
    return spark.createDataFrame([("set", db, s) for s in sqls], "dataset string, db string, sql string")


def test_statements_become_rows_and_envelopes(spark, known):
    cache, db = known
    sqls = ["SELECT r_name, r_regionkey FROM region ORDER BY r_name DESC", " SELECT r_name,  r_regionkey FROM region ORDER BY r_name DESC;", "SELECT r_name FROM region WHERE 1 = 0", "SELECT nothing FROM region", "DELETE FROM region", "SELECT n_name FROM nation", None, " ;"]
    assert cache.fill(asked(spark, db, *sqls).union(spark.createDataFrame([("set", None, "SELECT 1"), ("set", "no_such_db", "SELECT 1 AS a FROM region")], "dataset string, db string, sql string"))) == 6
    found = {r["normal_sql"]: r for r in cache.envelopes().collect()}
    good = found["SELECT r_name, r_regionkey FROM region ORDER BY r_name DESC"]
    assert (good["status"], good["row_count"], good["statement_type"]) == ("rows", 5, "SELECT") and good["seconds"] > 0
    assert found["SELECT r_name FROM region WHERE 1 = 0"]["row_count"] == 0 and found["SELECT n_name FROM nation"]["row_count"] == 10  # the cap
    assert {s: found[s]["status"] for s in ("SELECT nothing FROM region", "DELETE FROM region", "SELECT 1 AS a FROM region")} == {"SELECT nothing FROM region": "failed", "DELETE FROM region": "failed", "SELECT 1 AS a FROM region": "failed"}
    rows = cache.rows().where(F.col("key") == good["key"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(5)) and rows[0]["row"] == '{"r_name":"MIDDLE EAST","r_regionkey":4}'


def test_a_rerun_takes_up_what_is_missing(spark, known):
    cache, db = known
    assert cache.fill(asked(spark, db, "SELECT r_name FROM region", "SELECT nothing FROM region")) == 2
    assert cache.fill(asked(spark, db, "SELECT r_name FROM region;", "SELECT nothing FROM region", "SELECT 1 AS a FROM region")) == 2  # the failure again, and the new one
    assert cache.envelopes().count() == 3 and cache.rows().count() == 5 + 5


def test_what_a_broken_run_leaves_is_not_read(spark, known, monkeypatch, tmp_path):
    cache, db = known
    cache.fill(asked(spark, db, "SELECT r_name FROM region"))
    monkeypatch.setattr(ResultCache, "_commit", lambda self, envelopes, at: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        cache.fill(asked(spark, db, "SELECT n_name FROM nation"))
    monkeypatch.undo()
    assert os.listdir(tmp_path / "cache/_staging") and cache.envelopes().count() == 1
    assert cache.fill(asked(spark, db, "SELECT n_name FROM nation", "SELECT r_name FROM region")) == 1 and cache.rows().count() == 15


def test_timeouts_stay_and_are_never_correct(spark, known):
    cache, db = known
    todo = asked(spark, db, ENDLESS).withColumn("timeout_ms", F.lit(1000))
    assert cache.fill(todo) == 1 and cache.fill(todo) == 0
    assert [(r["status"], r["timed_out"], r["error"]) for r in cache.envelopes().collect()] == [("timeout", True, "interrupted")]
    pair = asked(spark, db, ENDLESS).withColumn("truth", F.col("sql"))
    assert [(r["correct"], r["ran"], r["timed_out"]) for r in result_cache.judged(pair, cache).collect()] == [(False, False, True)]


def test_verdicts_by_mode(spark, known):
    cache, db = known
    truth = "SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 9"
    cases = {
        truth: (True, True), "SELECT n_regionkey AS x, CAST(n_nationkey AS DOUBLE) AS y FROM nation WHERE n_nationkey BETWEEN 5 AND 9": (True, False),  # numbers by value, or by text
        "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey BETWEEN 5 AND 9": (False, True), "SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 8": (False, False), "SELECT oops": (False, False), "never cached": (False, False), "": (False, False),
    }
    cache.fill(asked(spark, db, *(c for c in cases if c != "never cached")))
    pairs = asked(spark, db, *cases).withColumn("truth", F.lit(truth))
    for k, mode in enumerate(("positional", "agnostic")):
        assert {r["sql"]: r["correct"] for r in result_cache.judged(pairs, cache, mode=mode).collect()} == {c: v[k] for c, v in cases.items()}
    empty = asked(spark, db, "SELECT r_name FROM region WHERE 1 = 0").withColumn("truth", F.lit("SELECT 1 AS a FROM region WHERE 1 = 0"))
    cache.fill(empty.unionByName(empty.withColumn("sql", F.col("truth"))))
    assert result_cache.judged(empty, cache).first()["correct"]


def test_a_stream_fills_the_cache(spark, known, tmp_path):
    cache, db = known
    for k in range(3):
        asked(spark, db, f"SELECT {k} AS a FROM region", "SELECT r_name FROM region").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for again in range(2):
        stream = spark.readStream.schema("dataset string, db string, sql string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        memory.run_into_cache(stream, cache, f"file://{tmp_path}/state{again}").awaitTermination()
        assert cache.envelopes().count() == 4 and cache.rows().count() == 20


def test_texts_of_a_reward_are_read_once(spark, known):
    cache, db = known
    truth = "SELECT r_name FROM region"
    asked_of = [truth, "SELECT r_regionkey FROM region", "SELECT nothing FROM region"]
    cache.fill(asked(spark, db, *asked_of))
    seen = spark.sparkContext.accumulator(0)
    rows = [(k, "set", db, k % 2, truth, f"<think>{'so ' * 50}</think>{asked_of[k % 3]}", [1.0, float(k)]) for k in range(12)]
    kind = "doc_id long, dataset string, db string, db_id int, truth string, completion string, embedding array<double>"

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    memory_of = spark.createDataFrame([(100, 0, [1.0, 0.0]), (101, 1, [0.0, 1.0])], "id long, db_id int, embedding array<double>")
    out = reward.rewarded(spark.createDataFrame(rows, kind).mapInArrow(count, kind), cache, memory_of).collect()
    assert seen.value == 12 and len(out) == 12
    assert {(r["doc_id"] % 3, r["correct"], r["ran"]) for r in out} == {(0, True, True), (1, False, True), (2, False, False)} and all(r["reward"] == 4 for r in out if r["correct"])
