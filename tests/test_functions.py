"""Array and JSON functions."""

import json
import math
import random

import pytest

from millrace.errors import TransformError
from millrace.functions import arrays, json_text
from millrace.plans.transform import run_sql

ROWS = [(2, [("C", 3, 2.0)]), (1, [("B", 1, 5.5), ("A", 2, 10.0)]), (3, []), (4, None), (5, [("D", None, 1.0)]), (6, [("E", 0, 4.0), ("F", 2, None)])]
DOC = json.dumps(dict(status="paid", note=None, paid=True, f=1.0, customer=dict(id=42, country="DE"), id=7, lines=[dict(sku=s, qty=q) for s, q in (("A", 2), ("B", 1))]))[:-1] + ', "e": 1e2}'


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(ROWS, "id long, items array<struct<sku: string, qty: long, price: double>>")


def values(df, *columns):
    return {r[0]: tuple(r[c] for c in columns) for r in df.collect()}


def test_array_functions(lines):
    got = values(run_sql(lines, "SELECT id, array_length(items) AS n, array_sum(items, 'price * qty') AS s, array_min(items, 'price') AS a, array_max(items, 'price') AS b, array_avg(items, 'qty') AS m, array_sum(items, 'price / qty') AS d FROM source"), "n", "s", "a", "b", "m", "d")
    assert got[1] == (2, 25.5, 5.5, 10.0, 1.5, 10.5)
    assert got[2] == (1, 6.0, 2.0, 2.0, 3.0, 2 / 3)
    assert got[3] == (0, None, None, None, None, None)
    assert got[4] == (None,) * 6
    assert got[5] == (1, None, 1.0, 1.0, None, None)
    assert got[6] == (2, 0.0, 4.0, 4.0, 1.0, None)  # a division by 0 and a null operand are skipped


def test_nan_is_passed_over(spark):
    df = spark.createDataFrame([(1, [float("nan"), 2.0]), (2, [float("nan")])], "id long, x array<double>")
    got = values(run_sql(df, "SELECT id, array_min(x) AS a, array_max(x) AS b FROM source"), "a", "b")
    assert got == {1: (2.0, 2.0), 2: (math.inf, -math.inf)}


def test_expression_equals_plain_evaluation(spark):
    r = random.Random(1)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["x", "y", "2", "0.5", "t.x"])
        return f"({made(depth - 1)} {r.choice('+-*/')} {made(depth - 1)})"

    elements = [[{"x": r.choice([None, 0.0, 1.0, 2.5]), "y": r.choice([None, 0.0, 3.0])} for _ in range(r.randint(0, 4))] for _ in range(30)]
    df = spark.createDataFrame([(i, [(e["x"], e["y"]) for e in es]) for i, es in enumerate(elements)], "id int, a array<struct<x: double, y: double>>")
    for _ in range(8):
        text = made(3)
        tree = arrays.parse(text)
        got = values(run_sql(df, f"SELECT id, array_sum(a, '{text}') AS s FROM source"), "s")
        for i, es in enumerate(elements):
            want = [v for v in (arrays.evaluate(tree, e) for e in es) if v is not None]
            assert (got[i][0] is None) == (not want)
            assert not want or math.isclose(got[i][0], sum(want), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("text", ["", "f(x)", "x +", "(x", "-x", "x ** 2"])
def test_bad_expressions(text):
    with pytest.raises(TransformError):
        arrays.parse(text)


def test_json_values():
    assert json_text.extract(DOC, "$.customer") == '{"country":"DE","id":42}'
    assert json_text.extract(DOC, "status") == '"paid"' and json_text.extract(DOC, "$.note") is None
    assert json_text.extract(DOC, "$.e") == "100.0"
    assert json_text.scalar(DOC, "$.customer") is None and json_text.scalar(DOC, "$.paid") == "true"
    assert json_text.scalar(DOC, "$['lines'][1][\"sku\"]") == "B" and json_text.scalar(DOC, "$.lines[9].sku") is None
    assert json_text.size(DOC, "$.lines") == 2 and json_text.size(DOC, "$.id") == 0 and json_text.size(DOC, "$.nope") is None
    assert json_text.exists(DOC, "$.note") and not json_text.exists(DOC, "$.nope")
    assert json_text.array_length("[1,2]") == 2 and json_text.array_length("{}") is None
    assert json_text.array_contains('[1,"a"]', "a") and json_text.array_contains("[1]", "1") and not json_text.array_contains('["1"]', "1")
    assert json_text.array_get("[1,null,3]", "-1") == "3" and json_text.array_get("[1,null]", "1") is None and json_text.array_get("[1]", "x") is None
    assert json_text.array_elements('["s",null,1.0,{"b":1,"a":2}]') == ['"s"', None, "1.0", '{"a":2,"b":1}']
    assert json_text.is_scalar("3") and not json_text.is_scalar("[]") and json_text.checked(" [1] ") == " [1] "
    for bad in ("$.*", "$[?(@.a)]", "$..a"):
        with pytest.raises(TransformError):
            json_text.path_steps(bad)
    for bad in ("{bad", "", "NaN", "[1,]"):
        with pytest.raises(TransformError):
            json_text.parse(bad)


def test_json_in_sql(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "{}"), (4, '{"status":"{x"}')], "id long, data string")
    sql = "SELECT id, json_value(data, '$.status') AS a, get_json_object(data, '$.customer') AS b, json_extract(data, '$.lines[0]') AS c, json_array_length(json_extract(data, '$.lines')) AS n FROM source"
    got = values(run_sql(df, sql), "a", "b", "c", "n")
    assert got == {1: ("paid", None, '{"qty":2,"sku":"A"}', 2), 2: (None,) * 4, 3: (None,) * 4, 4: ("{x", None, None, None)}


def test_malformed_json_fails(spark):
    df = spark.createDataFrame([("{bad",)], "data string")
    with pytest.raises(Exception, match="malformed JSON"):
        run_sql(df, "SELECT json_value(data, '$.a') AS a FROM source").collect()


def test_json_columns_equal_single_documents(spark):
    """Repeated keys, bare columns and expressions: one answer."""
    r = random.Random(5)

    def value(depth=0):
        kind = r.randrange(7 if depth < 3 else 5)
        if kind < 5:
            return r.choice(["null", "true", "-1.50", "18446744073709551616", '"x\\u00e9"', "1e3", "7", '""'])
        if kind == 5:
            return "[" + ",".join(value(depth + 1) for _ in range(r.randrange(4))) + "]"
        return "{" + ", ".join(f'"{r.choice("abc")}": {value(depth + 1)}' for _ in range(r.randrange(5))) + "}"

    docs = ['{"a":1,"a":2}', "null", None] + [value() for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, data string").coalesce(1)
    calls = {"json_extract_scalar": "$.a", "json_extract": "$.a", "json_size": "$.a", "json_exists": "$.b", "json_array_get": "0", "json_array_contains": "7", "json_array_length": None, "is_json_scalar": None}
    for document in ("data", "concat(data, '')"):
        sql = ", ".join(f"{n}({document}{'' if a is None else f", '{a}'"}) AS c{k}" for k, (n, a) in enumerate(calls.items()))
        got = {row.id: row[1:] for row in run_sql(df, f"SELECT id, {sql} FROM source").collect()}
        for i, doc in enumerate(docs):
            want = tuple(None if doc is None else f(json_text.parse(doc), *(() if a is None else (a,))) for (f, _), a in zip((json_text.FUNCTIONS[n] for n in calls), calls.values()))
            assert got[i] == want, (doc, got[i], want)
    assert got[0][0] == "2"


def test_unnest_json(spark):
    rows = [(1, json.dumps({"lines": [{"sku": "A"}, {"sku": "B"}]})), (2, json.dumps({"lines": [{"sku": "C"}]})), (3, "{}"), (4, None)]
    df = spark.createDataFrame(rows, "order_id long, data string")
    sql = "SELECT o.order_id, json_value(li, '$.sku') AS sku FROM source o cross join unnest(cast(json_query(o.data, '$[\"lines\"]') as array(json))) as t(li)"
    assert sorted((r.order_id, r.sku) for r in run_sql(df, sql).collect()) == [(1, "A"), (1, "B"), (2, "C")]
