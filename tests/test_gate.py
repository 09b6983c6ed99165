"""What is refused, and what rewriting makes of foreign spellings."""

import pytest

from millrace.errors import TransformError
from millrace.plans import gate, rewrite
from millrace.plans.transform import run_sql

ROW, BATCH = gate.Grain.ROW, gate.Grain.BATCH

REFUSED = [
    "SELECT a FROM source GROUP BY a", "SELECT a FROM source GROUP BY ALL", "SELECT a, count(*) FROM source GROUP BY a HAVING count(*) > 1", "SELECT DISTINCT a FROM source", "SELECT sum(a) FROM source", "SELECT some(a) FROM source",
    "SELECT std(a) FROM source", "SELECT covar(a, b) FROM source", "SELECT string_agg(a, ',') FROM source", "SELECT rank() OVER (ORDER BY a) FROM source", "SELECT sum(a) OVER () FROM source", "SELECT lead(a) FROM source", "SELECT first(a) FROM source", "SELECT any_value(a) FROM source",
    "SELECT s.a FROM source s JOIN fx ON fx.k = s.k", "SELECT s.a FROM source s FULL JOIN fx ON fx.k = s.k", "SELECT a FROM source NATURAL JOIN fx", "SELECT s.a FROM source s LEFT JOIN fx USING (k)", "SELECT s.a FROM source s LEFT JOIN source t ON s.k = t.k",
    "SELECT s.a FROM source s LEFT JOIN (SELECT * FROM fx) f ON f.k = s.k", "SELECT s.a FROM source s LEFT JOIN fx ON fx.k > s.k", "SELECT s.a FROM source s LEFT JOIN fx ON k = s.k", "SELECT a FROM fx", "SELECT a FROM source WHERE EXISTS (SELECT 1 FROM fx)",
    "SELECT a FROM source WHERE a = (SELECT max(a) FROM source)", "SELECT a FROM source UNION ALL SELECT a FROM other", "WITH t AS (SELECT DISTINCT a FROM source) SELECT a FROM t", "WITH fx AS (SELECT a FROM source) SELECT a FROM fx", "SELECT a FROM (SELECT sum(a) AS a FROM source)",
    "SELECT 1", "VALUES (1)", "INSERT INTO source SELECT 1", "CREATE TABLE t (a INT)", "DROP TABLE source", "SELECT a FROM source; DROP TABLE x", "   ", "SELECT a FROM", "SELECT a FROM source VERSION AS OF 3", "SELECT a FROM a.source", "SELECT a FROM source TABLESAMPLE (5 PERCENT)",
    "SELECT explode_outer(a) FROM source", "SELECT from_unixtime(a, 'UTC') FROM source", "SELECT from_unixtime(a, zone) FROM source", "SELECT DISTINCT ON (a) a FROM source", "SELECT array_sum(a, b) FROM source", "SELECT array_sum(a, 'f(x)') FROM source",
]
ACCEPTED = [
    "SELECT a FROM source", "select a, b as c from source s where s.a in (1, 2) and b like 'x%'", "WITH t AS (SELECT a FROM source), u AS (SELECT a FROM t) SELECT a FROM u", "WITH source AS (SELECT a FROM source) SELECT a FROM source",
    "SELECT s.a, fx.b FROM source s LEFT JOIN fx ON fx.k = s.k", "SELECT s.a FROM source s LEFT JOIN fx f ON lower(f.k) = lower(s.k) AND f.b > 3", "SELECT s.a FROM source s LEFT OUTER JOIN fx ON s.k = fx.k AND s.j = fx.j", "SELECT unnest(a) AS x FROM source",
    "SELECT x FROM source, UNNEST(a) AS t(x)", "SELECT a FROM source -- DISTINCT in a comment", "SELECT 'GROUP BY; unnest(x)' AS a FROM source", "SELECT a FROM source;", "SELECT a FROM source WHERE a > (SELECT 1 FROM source)", "SELECT cast(a AS DECIMAL(18,4)) FROM source",
    "SELECT a FROM source UNION SELECT a FROM source", "SELECT a FROM source ORDER BY a LIMIT 1 OFFSET 2", "SELECT array_max(a, 'x / y') AS m FROM source",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(TransformError):
        gate.check(spark, sql, ROW, ["fx"])


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted_and_idempotent(spark, sql):
    once = gate.check(spark, sql, ROW, ["fx"]).sql
    assert gate.check(spark, once, ROW, ["fx"]).sql == once


def test_batch_grain(spark):
    for sql in ("SELECT a, sum(b) AS s FROM source GROUP BY a HAVING count(*) > 1", "SELECT DISTINCT a FROM source", "SELECT min(a) AS x, max(a) AS y FROM source"):
        gate.check(spark, sql, BATCH)
    for sql in ("SELECT count(DISTINCT a) FROM source", "SELECT avg(a) FROM source", "SELECT approx_percentile(a, 0.5) FROM source", "SELECT sum(a) OVER () FROM source", "SELECT first(a) FROM source"):
        with pytest.raises(TransformError):
            gate.check(spark, sql, BATCH)


def test_warnings_for_per_batch_meaning(spark):
    assert gate.check(spark, "SELECT a FROM source UNION SELECT a FROM source").warnings
    assert gate.check(spark, "SELECT a FROM source LIMIT 3").warnings
    assert not gate.check(spark, "SELECT a FROM source").warnings


def test_rewrites():
    assert rewrite.json_array_casts("SELECT CAST(f(a, 'x)') AS ARRAY(JSON)) FROM t") == "SELECT json_array_elements(f(a, 'x)')) FROM t"
    assert rewrite.json_array_casts("CAST(CAST(a AS ARRAY<JSON>) AS ARRAY ( JSON ))").count("json_array_elements") == 2
    assert "CROSS JOIN LATERAL explode(o.a) AS t(x)" in rewrite.unnests("SELECT x FROM source o CROSS JOIN UNNEST(o.a) AS t(x)")
    assert "LATERAL explode(a) AS t(t)" in rewrite.unnests("SELECT t FROM source, UNNEST(a) AS t")
    assert rewrite.quoted_names('SELECT "a b", \'"c"\' FROM "t"') == "SELECT `a b`, '\"c\"' FROM `t`"
    assert rewrite.statements("SELECT ';' -- ;\n;") == 1


def test_filter_and_columns_reach_the_scan(spark, sf):
    df = run_sql(spark.read.parquet(f"{sf}/orders.parquet"), "SELECT o_orderkey FROM source WHERE o_totalprice > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_custkey" not in plan and "Exchange" not in plan
