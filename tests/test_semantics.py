import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resultlens.functions import compare, text
from resultlens.operators import etl, metrics, sqlops, vote
from resultlens.operators.dialect import SETTINGS, to_spark
from resultlens.operators.sqlops import sql_ops


def equal(spark, rows_a, rows_b, mode, schema="a string, b string"):
    one = spark.createDataFrame([(1, *r) for r in rows_a], f"result_id int, {schema}")
    two = spark.createDataFrame([(2, *r) for r in rows_b], f"result_id int, {schema}")
    pairs = spark.createDataFrame([(1, 2)], "pred_id int, gold_id int")
    columns = [c for c in one.columns if c != "result_id"]
    return compare.compare_sets(pairs, one.union(two), columns, mode).first()["equal"]


def test_null_is_empty_but_not_when_raw(spark):
    a, b = [(None, "x")], [("", "x")]
    assert equal(spark, a, b, "positional") and equal(spark, a, b, "agnostic")
    assert not equal(spark, a, b, "raw")


def test_duplicates_and_order_do_not_count(spark):
    a, b = [("1", "2"), ("1", "2"), ("3", "4")], [("3", "4"), ("1", "2")]
    assert all(equal(spark, a, b, m) for m in ("positional", "agnostic", "named", "raw"))


def test_swapped_columns_are_equal_only_agnostically(spark):
    a, b = [("1", "2")], [("2", "1")]
    assert equal(spark, a, b, "agnostic") and not equal(spark, a, b, "positional")


def test_numbers_compare_by_value_and_apart_from_text(spark):
    pairs = spark.createDataFrame([(1, 2)], "pred_id int, gold_id int")
    cells = spark.createDataFrame([(1, 1.0), (2, 1.0)], "result_id int, a double")
    assert compare.compare_sets(pairs, cells, ["a"], "positional").first()["equal"]
    ints, texts = spark.createDataFrame([(1, 1)], "result_id int, a int"), spark.createDataFrame([(2, "1")], "result_id int, a string")
    key = [df.select(compare.row_key(df, ["a"], "positional").alias("k")).first()["k"] for df in (ints, texts)]
    assert key[0] != key[1]


MODES = ("positional", "agnostic", "named", "raw", "graded")


def test_separators_in_values_make_no_rows_equal(spark):
    for mode in MODES:
        assert not equal(spark, [("a|sb", "c")], [("a", "b|sc")], mode)
        assert not equal(spark, [("a|b", "c")], [("a", "b|c")], mode)
        assert not equal(spark, [("1:a", "")], [("", "1:a")], "positional")
        assert equal(spark, [("a|b", "c;d")], [("a|b", "c;d")], mode)


def test_numbers_are_compared_exactly(spark):
    same = lambda a, b, mode="positional", kind="double": equal(spark, [(a,)], [(b,)], mode, f"a {kind}")
    assert not same(1e-7, 0.0) and same(0.0, -0.0) and not same(2**53, 2**53 + 1, kind="long") and not same(0.1, 0.1000001)
    assert same(float("nan"), None) and same(float("nan"), None, "agnostic") and not same(float("nan"), None, "raw")
    assert same(1e300, 1e300) and not same(1e300, 1.1e300)
    whole = spark.createDataFrame([(1, 3)], "result_id int, a int")
    for other, kind, want in ((3.0, "double", True), (3.5, "double", False), (2.0**53, "double", False)):
        cells = [df.select(compare.row_key(df, ["a"], "positional")).first()[0] for df in (whole, spark.createDataFrame([(2, other)], f"result_id int, a {kind}"))]
        assert (cells[0] == cells[1]) == want


def test_tabs_are_stripped_in_graded_mode(spark):
    assert equal(spark, [("\tabc ", "x")], [("abc", "X")], "graded")


def test_any_variant_and_registered_names(spark):
    compare.register_comparator("like_evaluator", "agnostic")
    pairs = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 3), (1, 1, 2, 3)], "sample_id int, idx int, pred_id int, gold_id int")
    cells = spark.createDataFrame([(1, "a", "b"), (2, "x", "y"), (3, "b", "a")], "result_id int, a string, b string")
    got = {r["idx"]: r["equal"] for r in compare.any_variant(pairs, cells, ["a", "b"], "like_evaluator").collect()}
    assert got == {0: True, 1: False}


def test_signatures_need_first_rows_only(spark):
    cells = spark.createDataFrame([(1, f"{k:04d}") for k in range(900)], "result_id int, a string")
    results = spark.createDataFrame([(1, True, None)], "result_id int, ok boolean, error string")
    assert compare.signatures(results, cells, ["a"]).first()["signature"] == "SUCCESS_VALUES:" + ";".join(f"{k:04d}" for k in range(900))[:200]


def test_empty_results(spark):
    pairs = spark.createDataFrame([(1, 2), (1, None)], "pred_id int, gold_id int")
    cells = spark.createDataFrame([], "result_id int, a string")
    found = {r["gold_id"]: r["equal"] for r in compare.compare_sets(pairs, cells, ["a"], "raw").collect()}
    assert found == {2: True, None: False}


def test_signatures_cut_at_200_can_collide(spark):
    cells = spark.createDataFrame([(1, "x" * 200 + "a"), (2, "x" * 200 + "b")], "result_id int, a string")
    results = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, "bad")], "result_id int, ok boolean, error string")
    found = {r["result_id"]: r["signature"] for r in compare.signatures(results, cells, ["a"]).collect()}
    assert found[1] == found[2] and found[3] == "ERROR: bad"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=6))
def test_graded_score_bounds(spark, a, b):
    cells = spark.createDataFrame([(1, k, *r) for k, r in enumerate(a)] + [(2, k, *r) for k, r in enumerate(b)], "result_id int, pos int, x int, y int")
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "pred_id int, gold_id int")
    found = {r["gold_id"]: r for r in compare.graded(pairs, cells, ["x", "y"], "pos").collect()}
    assert 0 <= found[2]["score"] <= 1 and abs(found[1]["score"] - 1) < 1e-9
    assert found[2]["coverage"] == sum(min(a.count(r), b.count(r)) for r in set(a)) / max(len(a), len(b))


def test_all_zero_ignores_other_tokens(spark):
    df = spark.createDataFrame([("0;abc",), ("0.0;0%",), ("0;1",), ("abc",), ("0|0",), ("",)], "v string")
    assert [r[0] for r in df.select(text.all_zero(F.col("v"))).collect()] == [True, True, False, False, False, False]


def test_votes(spark):
    rows = [(1, 0, True, None, "SUCCESS_VALUES:0"), (1, 1, True, None, "SUCCESS_VALUES:0"), (1, 2, True, None, "SUCCESS_VALUES:7"), (2, 0, False, "x", "ERROR: x"), (3, 0, True, None, "SUCCESS_VALUES:a"), (3, 1, True, None, "SUCCESS_VALUES:b")]
    s = spark.createDataFrame(rows, "sample_id int, idx int, ok boolean, error string, signature string").withColumn("sql_text", F.lit("q"))
    vav = {r["sample_id"]: (r["signature"], r["selected_idx"]) for r in vote.vote(s).collect()}
    assert vav == {1: ("SUCCESS_VALUES:7", 2), 2: ("NO_RESULTS", -1), 3: ("SUCCESS_VALUES:b", 1)}
    majority = {r["sample_id"]: r["selected_idx"] for r in vote.vote(s, "majority").collect()}
    assert majority == {1: 0, 2: -1, 3: 0}
    gold = s.where("idx = 0").select("sample_id", F.col("signature").alias("gold_signature"))
    assert all(r["n_grouped"] == r["n_ok"] for r in vote.record(s, gold).collect())


def test_infra_rule_matches_substrings(spark):
    df = spark.createDataFrame([("no such column: capital",), ("syntax error",)], "e string")
    assert [r[0] for r in df.select(text.error_class(F.col("e"))).collect()] == ["infrastructure", "syntax"]


def test_constant_values_trim_to_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, v double")
    assert metrics.trimmed_mean(df, "k", "v").first()["trimmed_mean"] == 0


def test_completions(spark):
    rows = [("<think>" + "x" * 101 + "</think>\n SELECT 1 ; ",), ("a<think>" + "x" * 101 + "</think>SELECT 1",), ("<think>short</think>SELECT 1",), (None,), ("<think> </think> ",)]
    df = spark.createDataFrame(rows, "c string")
    c = F.col("c")
    assert [r[0] for r in df.select(text.format_gate(c)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(text.extract_sql(c)).collect()] == ["SELECT 1 ;", "SELECT 1", "SELECT 1", None, None]
    assert df.select(text.normalize_sql(F.lit("\tselect\n  1 ;; "))).first()[0] == "select 1"


def test_decomposer_on_joins_of_derived_tables():
    """Terms of a conjunction come in the order of their text; arithmetic keeps the statement's own."""
    sql = """SELECT h.city, MAX(q.total) - 1 AS top FROM (SELECT o.hotel, SUM(o.price) AS total FROM orders o WHERE o.price > 0 GROUP BY o.hotel) q
    RIGHT JOIN hotels h ON q.hotel = h.code AND h.stars < 3 WHERE h.city LIKE 'A%' GROUP BY h.city ORDER BY top DESC"""
    assert sql_ops(sql) == [
        "ENTER_SUBQUERY(FROM)", "FROM(orders as T1)", "SELECT_COL(hotel)", "SELECT_AGG(SUM, price)", "ALIAS(COLUMN, SUM(price), total)", "WHERE_PRED(GT, price, VALUE(0))", "GROUP_BY(hotel)", "EXIT_SUBQUERY",
        "FROM(SUBQUERY as T1)", "JOIN(hotels, RIGHT)", "ON_PRED(LT, T2.stars, VALUE(3))", "ON_EQ(T1.hotel, T2.code)", "SELECT_COL(city)", "SELECT_EXPR(MAX(q.total) - 1)", "ALIAS(COLUMN, MAX(q.total) - 1, top)",
        "WHERE_PRED(LIKE, city, VALUE('A%'))", "GROUP_BY(city)", "ORDER_BY(top, DESC)",
    ]


def test_decomposer_on_set_operations_and_windows():
    assert sql_ops("SELECT team FROM wins EXCEPT SELECT team FROM bans WHERE season BETWEEN 3 AND 9") == [
        "FROM(wins as T1)", "SELECT_COL(team)", "EXCEPT", "ENTER_SUBQUERY(SET_RIGHT)", "FROM(bans as T1)", "SELECT_COL(team)", "WHERE_PRED(BETWEEN, season, [VALUE(3), VALUE(9)])", "EXIT_SUBQUERY",
    ]
    assert sql_ops("SELECT player, SUM(score) OVER (ORDER BY played) AS so_far FROM games g CROSS JOIN seasons s LIMIT 2") == [
        "FROM(games as T1)", "JOIN(seasons, CROSS)", "SELECT_COL(player)", "WINDOW(order_by=[played ASC])", "SELECT_WIN(SUM, score)", "ALIAS(COLUMN, SUM(score), so_far)", "LIMIT(2)",
    ]


@pytest.mark.parametrize("mode", ["rankcorr", "footrule"])
def test_results_ranked_by_ranges(spark, monkeypatch, mode):
    """Large results are dealt to ranges and score as in one piece; repeated rows are in all ranges."""
    rng = random.Random(3)
    cells = spark.createDataFrame([(r, k, rng.choice("abc"), float(rng.randint(0, 9 if r < 3 else 1))) for r, n in ((1, 300), (2, 280), (3, 12), (4, 0), (5, 90)) for k in range(n)], "result_id int, pos int, c1 string, c2 double")
    pairs = spark.createDataFrame([(p, g) for p in (1, 2, 3, 4, 5, None) for g in (1, 2, 3, 4)], "pred_id int, gold_id int")
    show = lambda: sorted(map(str, (tuple(r) for r in compare.graded(pairs, cells, ["c1", "c2"], "pos", mode).collect())))
    want = show()
    monkeypatch.setattr(compare, "LARGE_RESULT", 50)
    ranked = compare.ranked_rows(cells.withColumn("key", F.col("c1")), "result_id", "pos")
    assert show() == want and ranked.where("result_id = 1").agg(F.count_distinct("rank"), F.max("rank")).first() == (300, 300)


def test_decomposer_forms():
    assert sql_ops("not sql at all") == [] and sql_ops(None) == []
    assert sql_ops("SELECT a FROM t UNION ALL SELECT b FROM u")[2:4] == ["UNION_ALL", "ENTER_SUBQUERY(SET_RIGHT)"]
    assert "WINDOW(partition_by=[b], order_by=[c DESC])" in sql_ops("SELECT row_number() OVER (PARTITION BY b ORDER BY c DESC) FROM t")
    assert "WHERE_PRED_TREE(a = 1 OR b = 2)" in sql_ops("SELECT a FROM t WHERE a = 1 OR b = 2")
    assert "WHERE_PRED(BETWEEN, a, [VALUE(1), VALUE(2)])" in sql_ops("SELECT a FROM t WHERE a BETWEEN 1 AND 2 AND b IN ('x', 'y')")
    assert "WHERE_PRED(IN_SUBQ, a, SUBQ_LAST)" in sql_ops("SELECT a FROM t WHERE a IN (SELECT b FROM u)")
    assert "WHERE_PRED(GT, a, SUBQ_LAST)" in sql_ops("SELECT a FROM t WHERE a > (SELECT avg(b) FROM u)")


def test_jaccard_is_symmetric(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    found = df.select(sqlops.jaccard(F.col("x"), F.col("y")), sqlops.jaccard(F.col("y"), F.col("x")), sqlops.best_shaped(F.col("x"), F.array("y"))).collect()
    assert all(r[0] == r[1] for r in found) and found[1][0] == 1.0 and found[1][2] == 0.0


def test_dialect():
    assert to_spark("SELECT [a b], \"c\", 'it''s [x]', IFNULL(a, 1) FROM t;") == "SELECT `a b`, `c`, 'it''s [x]', coalesce(a, 1) FROM t"


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(etl.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]
    assert show(etl.insert_ignore(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "w")]
    assert show(etl.update_by_key(a, b, ["k"])) == [(1, "x"), (2, "z")]
    twice = spark.createDataFrame([(2, "p", 1), (2, None, 2), (9, "q", 1), (9, "r", 2)], "k int, v string, at int")
    assert sorted(map(str, map(tuple, etl.update_by_key(a, twice, ["k"], "at").collect()))) == ["(1, 'x')", "(2, None)"]
    assert etl.insert_ignore(a, twice.drop("at"), ["k"]).count() == 3 and etl.upsert(a, twice, ["k"], "at").count() == 3
    judged = spark.createDataFrame([("d", "SELECT  1;", 1), ("d", "SELECT 1", 0), ("d", "SELECT 2", 1)], "db_id string, sql_text string, verdict int")
    chosen = spark.createDataFrame([("d", " SELECT 1"), ("d", "SELECT 2 ;"), ("e", "SELECT 2")], "db_id string, sql_text string")
    assert sorted((r["normal_sql"], r["verdict"]) for r in etl.verdicts_of(chosen, judged).collect()) == [("SELECT 1", 0), ("SELECT 2", 1)]
    assert to_spark("SELECT group_concat(a), strftime('%Y-%m', max(d)) FROM t") == "SELECT listagg(a, ','), date_format(max(d), 'yyyy-MM') FROM t"
    assert to_spark("SELECT 'a\\b' FROM t") == "SELECT 'a\\\\b' FROM t"


def test_pending_knows_every_model(spark):
    models = spark.range(1500).selectExpr("concat('m', id) AS model_name")
    samples = spark.createDataFrame([(1,), (2,)], "sample_id int")
    done = spark.createDataFrame([("m0", 1, True), ("m1499", 2, True), ("m7", 1, False)], "model_name string, sample_id int, ok boolean")
    assert etl.pending(samples, models, done).count() == 2997
    assert etl.pending(samples, models, done, retry_failed=True).count() == 2998


SPELLINGS = (
    "date(d, '+1 month')", "date(d, '-1 year')", "datetime(d, 'start of month', '+1 month', '-1 day')", "date(d, 'weekday 0')", "strftime('%w|%j|%H:%M', d, '+36 hours')", "strftime('%s', d)", "julianday(d, '+1.5 days')",
    "time(d, '-90 seconds')", "datetime(id * 86400, 'unixepoch')", "strftime('%Y-%m-%dT%H:%M:%SZ', d)", "strftime('%Y%%', d)", "printf('%.2f', x)", "printf('%05d|%s|%d%%', id, s, x)", "printf('%d', s)", "format('%-6s|%6.1f', s, s)",
    "printf('%s-%s', id)", "instr(s, 'a')", "s + 0", "0 + id", "s * 1 + id", "'12abc' + id", "id - '2x'", "id * 2 + 0", "s + 0 + s * 1.0", "-id + 0", "id + 0 * 2", "count(*) OVER () + 0", "(id + 1) / 2 + 0", "id || '' + 0", "'a-b' || id",
)


@pytest.mark.parametrize("expression", SPELLINGS)
def test_spellings_against_sqlite(spark, expression):
    import sqlite3

    rows = [(1, "2020-01-31 10:20:30", "12abc", 1.5), (2, "2024-02-29", "x", -2.25), (3, "1999-12-31 23:59:59", "-3.5e1z", 0.125), (4, None, None, None), (5, "2021-08-01", " 7", 1e3)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t(id INT, d TEXT, s TEXT, x REAL)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    session = spark.newSession()
    for name, value in SETTINGS.items():
        session.conf.set(name, value)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.createDataFrame(rows, "id int, d string, s string, x double").createOrReplaceTempView("t")
    sql = f"SELECT {expression} AS r FROM t ORDER BY id"
    want, got = [r for (r,) in con.execute(sql)], [r for (r,) in session.sql(to_spark(sql)).collect()]
    if any(isinstance(r, str) for r in got) and not any(isinstance(r, str) for r in want):
        got = [float(r) for r in got]
    assert got == pytest.approx(want) if not any(isinstance(r, str) for r in want) else got == want


def test_spellings_beyond_the_dialect_stay():
    for sql in ("SELECT date(d, m) FROM t", "SELECT date(d, '+1.5 months') FROM t", "SELECT printf(f, a) FROM t", "SELECT a - b, * FROM t", "SELECT count(*) FROM t"):
        assert to_spark(sql) == sql


def test_tokens_by_a_tokenizer(spark, tmp_path):
    import json

    vocabulary = {"<unk>": 0, "select": 1, "from": 2, "t": 3, "a": 4, "b": 5, "ab": 6}
    model = {"type": "BPE", "vocab": vocabulary, "merges": [["a", "b"]], "unk_token": "<unk>"}
    (tmp_path / "own.json").write_text(json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": model}))
    texts = ["ab ab a", "", None, "abb"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    count = lambda f: [r[0] for r in rows.orderBy("k").select(f(F.col("t"))).collect()]
    assert count(text.token_counter(str(tmp_path / "own.json"))) == [3, 0, None, 2]
    assert count(text.token_counter()) == count(text.word_count)


def test_pending_with_more_models_than_are_broadcast(spark, monkeypatch):
    samples, models = spark.range(20).select(F.col("id").alias("sample_id")), spark.range(7).select(F.col("id").cast("string").alias("model_name"))
    done = spark.createDataFrame([(3, "1", True), (4, "2", False)], "sample_id long, model_name string, ok boolean")
    for most in (2, 100):
        monkeypatch.setattr(etl, "MAX_MODELS", most)
        assert etl.pending(samples, models, done).count() == 138 and etl.pending(samples, models, done, True).count() == 139


def test_rows_are_dealt_before_they_are_told_apart(spark, capsys, monkeypatch):
    """No task gathers the distinct rows of all that it reads: nothing is aggregated before the rows are dealt, to as many tasks as they ask for. Of equal rows in a batch one is dealt."""
    monkeypatch.setattr(compare, "TASK_ROWS", 100)
    cells = spark.range(3_000).select((F.col("id") % 7).alias("result_id"), F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise((F.col("id") % 50).cast("string")).alias("a"))
    digests = compare.result_digests(cells, "result_id", ["a"], "positional")
    digests.explain("formatted")
    steps = [line.strip(" :+-*").split("(")[0].strip() for line in capsys.readouterr().out.split("\n\n")[0].splitlines()]
    read = [x for x in steps if x.startswith(("HashAggregate", "Exchange", "MapInArrow"))][::-1]
    assert read[:2] == ["MapInArrow", "Exchange"]
    text = digests._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in text and ", 30)" in text
    want = {k: len({"x" if i % 2 == 0 else str(i % 50) for i in range(k, 3_000, 7)}) for k in range(7)}
    assert {r["result_id"]: r["n_rows"] for r in digests.collect()} == want
    assert compare.once_a_batch(spark.range(900).select((F.col("id") % 3).alias("a")).coalesce(1)).count() == 3
