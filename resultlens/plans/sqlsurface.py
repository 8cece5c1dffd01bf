"""The SQL surface over the star schema: the same statements on both engines."""

from __future__ import annotations

from ..operators import execute
from ..sources.catalog import Catalog
from .catalogue import query

STATEMENTS = {
    "sql_inner_join": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS nk, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey < 15 GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey > 5 GROUP BY c_nationkey) b ON s_nationkey = c_nationkey",
    "sql_theta_join": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "sql_cross_join": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "sql_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "sql_anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_correlated_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n, round(sum(s), 2) AS total FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "sql_derived_table": "SELECT seg, max(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_union": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "sql_union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation",
    "sql_intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "sql_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM orders",
    "sql_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "sql_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders",
    "sql_like_between_in": "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR NOT p_retailprice < 1900",
    "sql_case_cast": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "sql_group_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_star_join": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name",
}
#: Statements in the spelling of the databases that the engine stands in for, with the same for the independent engine.
SPELLED = {
    "exec_scan_limit": ('SELECT [o_orderkey], "o_totalprice" FROM orders ORDER BY o_orderkey LIMIT 100;', "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"),
    "exec_right_join": ("SELECT n_name, r_name FROM region RIGHT JOIN nation ON n_regionkey = r_regionkey AND r_name LIKE 'A%'", None),
    "exec_integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey * 3 / 2 AS r, (o_orderkey + 1) / (o_custkey - o_custkey) AS none, o_totalprice / 2 AS h, 7 / 2.0 AS f FROM orders",
        "SELECT o_orderkey, CAST(o_orderkey // 7 AS DOUBLE) AS q, CAST(trunc(-o_orderkey * 3 / 2) AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS none, o_totalprice / 2 AS h, CAST(3.5 AS DOUBLE) AS f FROM orders"),
    "exec_cast_prefix": ("SELECT c_custkey, CAST(substr(c_name, 10) || 'abc' AS INTEGER) AS n, CAST(c_mktsegment AS INTEGER) AS zero, CAST(c_acctbal AS INTEGER) AS whole FROM customer",
        "SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS n, CAST(0 AS BIGINT) AS zero, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer"),
    "exec_glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[12]?' AND NOT p_name GLOB '*z*'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].') AND NOT contains(p_name, 'z')"),
    "exec_dates": ("SELECT o_orderkey, date(o_orderdate) AS day, julianday(o_orderdate) - julianday('1992-01-01') AS days, strftime('%Y-%m', o_orderdate) AS month FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate - TIMESTAMP '1992-01-01') / 86400 AS days, strftime(o_orderdate, '%Y-%m') AS month FROM orders"),
    "exec_date_modifiers": ("SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last_day, date(o_orderdate, '+1 month') AS month_on, datetime(o_orderdate, '-90 minutes') AS before, strftime('%w', o_orderdate, '+36 hours') AS weekday, date(o_orderdate, 'weekday 0') AS sunday FROM orders",
        """SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS month_on, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS before,
        CAST(dayofweek(o_orderdate + INTERVAL 36 HOUR) AS VARCHAR) AS weekday, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS sunday FROM orders"""),
    "exec_printf": ("SELECT o_orderkey, printf('%08d|%s', o_orderkey, o_orderstatus) AS code, printf('%d%%', o_totalprice) AS whole, instr(o_orderpriority, '-') AS at FROM orders",
        "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '|' || o_orderstatus AS code, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || '%' AS whole, CAST(instr(o_orderpriority, '-') AS INTEGER) AS at FROM orders"),
    "exec_text_numbers": ("SELECT o_orderkey, o_orderpriority + 0 AS urgency, o_orderstatus * 1 AS none, '12abc' + o_orderkey AS more FROM orders",
        "SELECT o_orderkey, CAST(coalesce(nullif(regexp_extract(o_orderpriority, '^[0-9]+'), ''), '0') AS DOUBLE) AS urgency, CAST(0 AS DOUBLE) AS none, 12 + o_orderkey AS more FROM orders"),
    "exec_group_concat": ("SELECT n_regionkey, count(*) AS n, group_concat(DISTINCT n_regionkey) AS keys, total(n_nationkey) AS t, iif(n_regionkey > 2, 'high', 'low') AS half FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, count(*) AS n, CAST(n_regionkey AS VARCHAR) AS keys, CAST(sum(n_nationkey) AS BIGINT) AS t, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS half FROM nation GROUP BY n_regionkey"),
    "exec_null_order": ("SELECT k FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT NULL) t ORDER BY k LIMIT 2", "SELECT k FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT NULL) t ORDER BY k NULLS FIRST LIMIT 2"),
    "exec_last_of_equal_names": ("SELECT r_regionkey AS k, r_regionkey + 1 AS k FROM region", "SELECT r_regionkey + 1 AS k FROM region"),
}
#: LIKE of sandbox mode ignores case.
SANDBOX = {"exec_sandbox_like": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'BRAND#1%'", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'BRAND#1%'")}
#: Statements and modes whose envelopes are compared, and what they are to hold.
ENVELOPES = (
    ("select", "SELECT r_name FROM region ORDER BY r_name", "read_only", "true, 'SELECT', 5, false, false"),
    ("capped", "SELECT n_name FROM nation ORDER BY n_name", "read_only", "true, 'SELECT', 10, false, false"),
    ("empty", "SELECT n_name FROM nation WHERE 1 = 0", "read_only", "true, 'SELECT', 0, false, false"),
    ("write", " delete from nation", "read_only", "false, 'DELETE', NULL, false, true"),
    ("sandboxed write", "DELETE FROM nation", "sandbox_rollback", "true, 'DELETE', NULL, true, false"),
    ("command", "SHOW TABLES", "read_only", "false, 'SHOW', NULL, false, true"),
    ("no such column", "SELECT nothing FROM nation", "read_only", "false, 'SELECT', NULL, false, true"),
    ("nothing", "  ", "read_only", "false, 'UNKNOWN', NULL, false, true"),
)


def database(d: str) -> tuple[Catalog, str]:
    """The tables below d as a database of a catalogue."""
    root, name = d.rstrip("/").rsplit("/", 1)
    top, folder = root.rsplit("/", 1)
    return Catalog(top, roots={"set": [folder]}), name


def _register(name: str, sql: str, other: str | None = None, sandbox: bool = False) -> None:
    @query(name, other or sql.rstrip(";"))
    def _(spark, d):
        catalog, db = database(d)
        return execute.plan(spark.newSession(), catalog, "set", db, sql, sandbox)


for _name, _sql in STATEMENTS.items():
    _register(_name, _sql)
for _name, (_sql, _other) in SPELLED.items():
    _register(_name, _sql, _other)
for _name, (_sql, _other) in SANDBOX.items():
    _register(_name, _sql, _other, True)


@query("exec_envelopes", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {held})" for name, _, _, held in ENVELOPES) + ") t(name, ok, kind, row_count, has_notice, has_error)")
def _(spark, d):
    catalog, db = database(d)
    found = [(name, execute.execute(spark, catalog, execute.Request("set", db, sql, mode, max_rows=10))) for name, sql, mode, _ in ENVELOPES]
    rows = [(name, e.ok, e.statement_type, e.row_count, e.notice is not None, e.error is not None) for name, e in found]
    return spark.createDataFrame(rows, "name string, ok boolean, kind string, row_count long, has_notice boolean, has_error boolean")
