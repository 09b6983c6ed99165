"""Publication, settings, dbt, catalog, metrics and the command line."""

import base64
import http.server
import io
import json
import threading

import pytest
from pyspark.sql import types as T

from millrace.errors import ConfigError, LogError
from millrace.operators import publish as P
from millrace.plans import catalogue, dbt
from millrace.sources import catalog
from millrace.sources.log import Table
from millrace.sources.scan import read_snapshot
from millrace.sources.sink import append
from millrace.streaming import cli, limits, metrics
from millrace.streaming import config as C
from millrace.streaming.pipeline import Pipeline
from millrace.streaming.supervisor import Supervisor, backoff, status, wait_until

FLAT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType())])


@pytest.fixture
def server():
    """A fake service: answer(path, headers, body) -> (status, JSON)."""
    made = []

    def start(answer):
        class Handler(http.server.BaseHTTPRequestHandler):
            def reply(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                code, value = answer(self.path, dict(self.headers), body)
                out = json.dumps(value).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_POST = reply

            def log_message(self, *_):
                pass

        s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        made.append(s)
        return f"http://127.0.0.1:{s.server_port}"

    yield start
    for s in made:
        s.shutdown()


@pytest.fixture
def tables(spark, tmp_path):
    source, target = Table(str(tmp_path / "s")), Table(str(tmp_path / "t"))
    for t in (source, target):
        t.create(FLAT)
    for k in range(2):
        append(source, spark.createDataFrame([(k * 10 + i, "ab"[i % 2]) for i in range(4)], FLAT).coalesce(1))
    return source, target


class Kept:
    def __init__(self, fail=()):
        self.sent, self.fail, self.calls = [], set(fail), 0

    def publish(self, group, body):
        self.calls += 1
        if self.calls in self.fail:
            raise P.PublishError("down")
        self.sent.append(json.loads(body))

    def describe(self):
        return "kept"


# ---- publication ----


def test_messages_of_batches(spark, tables):
    source, target = tables
    sender = Kept(fail=[1])
    own = C.Resolved("p", "mr.p", source.uri, target.uri, max_files_per_batch=1)
    publisher = P.Publisher(sender, "p", "mr.p", "live", "live", "SELECT name, count(*) AS n FROM source GROUP BY name")
    p = Pipeline(spark, own, publisher=publisher)
    assert p.step().published.failed and p.step().published.sent
    (m,) = sender.sent
    assert (m["prev_source_version"], m["source_version"], m["target_version"], m["complete"]) == (1, 2, 2, True)
    assert sorted((r["name"], r["n"]) for r in m["rows"]) == [("a", 2), ("b", 2)]
    assert read_snapshot(spark, target).count() == 8


def test_message_too_large_and_broken_sql(spark, tables):
    df = read_snapshot(spark, tables[0])
    made = P.render(df, 60)
    assert (made.rows, made.count, made.complete) == ([], 8, False)
    publisher = P.Publisher(Kept(), "p", "a", "m", "g", "SELECT nope FROM source")
    assert isinstance(publisher.render(df), Exception)
    assert publisher.send(ValueError(), 1, 1, 1).failed and publisher.previous == 1


def test_breaker():
    now = [0.0]
    b = P.Breaker(2, 10, lambda: now[0])
    b.failed()
    assert not b.open()
    b.failed()
    assert b.open()
    now[0] = 11
    assert not b.open()
    b.succeeded()
    assert b.failures == 0


def test_hub_over_http(server):
    seen = []

    def answer(path, headers, body):
        seen.append((path, headers, body))
        return (202, {}) if "/bad/" not in path else (401, {"no": 1})

    url = server(answer)
    hub = P.WebPubSub.from_connection_string(f"Endpoint={url}/;AccessKey=abc;Version=1.0;", "h", 30)
    hub.publish("g1", b"{}")
    path, headers, _ = seen[0]
    assert path == "/api/hubs/h/groups/g1/:send?api-version=2024-12-01&messageTtlSeconds=30"
    token = headers["Authorization"].split()[1]
    claims = json.loads(base64.urlsafe_b64decode(token.split(".")[1] + "=="))
    assert claims["aud"] == url + path and claims["exp"] - claims["iat"] == P.TOKEN_SECONDS
    assert token == P.bearer("abc", claims["aud"], claims["iat"])
    with pytest.raises(P.PublishError, match="401"):
        hub.publish("bad", b"{}")
    with pytest.raises(ConfigError):
        hub.publish("a/b", b"{}")
    for bad in ("AccessKey=x", "Endpoint=x;AccessKey=;"):
        with pytest.raises(ConfigError):
            P.WebPubSub.from_connection_string(bad, "h")
    assert "abc" not in repr(hub)


# ---- settings ----

TOML = """
[defaults]
max_bytes_per_batch = "64MB"
[[pipeline]]
app_id = "mr.a"
source_uri = "/s"
name = "a"
target_uri = "/t"
transform_sql = "SELECT id FROM source"
"""


def test_settings_are_read():
    (p,) = C.resolve(C.parse(TOML)).pipelines
    assert p.max_bytes_per_batch == 64_000_000 and p.max_files_per_batch == 1000 and p.write_mode == "append"
    for bad in (TOML + "colour = 1\n", "[colours]\n", "[[pipeline]]\nname='x'\n", "a = ", "[runtime]\n[defaults]\n"):
        with pytest.raises(ConfigError):
            C.parse(bad)


def pipe(name, **more):
    return C.PipelineConfig(**({"name": name, "app_id": f"mr.{name}", "source_uri": f"/{name}/s", "target_uri": f"/{name}/t"} | more))


UPSERT = dict(write_mode="upsert", upsert_key="k", dedup_timestamp="ts")


@pytest.mark.parametrize(
    "more",
    [
        dict(app_id=" "), dict(target_uri="/x/s"), dict(write_mode="replace"), dict(change_policy="hope"), dict(upsert_key="k"), dict(write_mode="upsert", upsert_key="k"), dict(write_mode="upsert", dedup_timestamp="ts"), UPSERT | dict(upsert_tiebreak=["ts"]),
        UPSERT | dict(upsert_tiebreak=["a", "a"]), UPSERT | dict(upsert_tiebreak=[" "]), UPSERT | dict(upsert_lookback="-1h"), dict(lookups=[C.LookupConfig("fx", "/fx")]), dict(transform_sql="SELECT 1 FROM source", lookups=[C.LookupConfig("Source", "/fx")]),
        dict(transform_sql="SELECT id FROM source", lookups=[C.LookupConfig("fx", "/x/s")]), dict(max_bytes_per_batch="lots"), dict(transform_sql="SELECT DISTINCT id FROM source"), dict(source_uri="nowhere://x"), dict(upsert_grain_check="maybe"), dict(starting_version=-1), dict(max_files_per_batch=0), dict(dedup_key="k"),
    ],
)
def test_a_bad_pipeline_is_set_aside_and_others_run(spark, more):
    found = C.resolve(C.Config([pipe("x", **more), pipe("good")]), spark)
    assert set(found.rejected) == {"x"} and [p.name for p in found.pipelines] == ["good"]


def test_pipelines_that_get_in_each_others_way():
    found = C.resolve(C.Config([pipe("a"), pipe("b", app_id="mr.a"), pipe("c")]))
    assert set(found.rejected) == {"a", "b"}
    up = pipe("up", **UPSERT)
    for more, ok in ((dict(), False), (dict(change_policy="ignore_changes"), False), (UPSERT | dict(change_policy="ignore_changes"), True)):
        found = C.resolve(C.Config([up, pipe("down", source_uri=up.target_uri, **more)]))
        assert ("down" in found.rejected) != ok
    staged = pipe("st", **(UPSERT | dict(write_mode="staged_upsert")))
    found = C.resolve(C.Config([staged, pipe("spy", source_uri=C.stage_uri(staged.target_uri))]))
    assert set(found.rejected) == {"spy"} and [p.name for p in found.pipelines] == ["st__ingest", "st__apply"]
    assert found.pipelines[0].stage_for == staged.target_uri and found.pipelines[1].upsert_key == "k"
    found = C.resolve(C.Config([pipe("st", write_mode="staged_upsert", upsert_key="k")]))
    assert set(found.rejected) == {"st__ingest", "st__apply"} and not found.pipelines


def test_a_publication_never_stops_its_pipeline(spark):
    section = C.PublishConfig(connection_string="Endpoint=x;AccessKey=y")
    one = lambda name, group="g", sql=None, **more: pipe(name, publish=C.PublishModel("m", group, sql), **more)
    found = C.resolve(C.Config([one("a"), one("b"), one("c", "ok"), one("d", "bad group"), one("e", "g5", "SELECT avg(id) FROM source"), one("f", "g6", **UPSERT)], publish=section), spark)
    assert not found.rejected and set(found.unpublished) == {"a", "b", "d", "e", "f"}
    assert [p.name for p in found.pipelines if p.publish] == ["c"]


def test_limits(tmp_path):
    limits.check_spill(str(tmp_path / "spill"), 10**9)
    for folder, size in ((None, 10), ("/proc/nowhere", None)):
        with pytest.raises(ConfigError):
            limits.check_spill(folder, size)
    with pytest.raises(ConfigError):
        limits.Gate(0)
    gate = limits.Gate(1)
    with gate.entered():
        assert gate.inside == 1
    assert limits.is_capacity(OSError("No space left on device")) and not limits.is_capacity(OSError("gone"))
    config = C.Config([pipe("a"), pipe("b")], C.Defaults(max_memory="4GB"))
    assert [p.memory for p in C.resolve(config).pipelines] == [10**9] * 2


# ---- dbt ----


def manifest(**changes):
    return dbt.parse(json.dumps({"nodes": catalogue.MANIFEST["nodes"] | changes, "sources": catalogue.MANIFEST["sources"]}))


def verdicts(spark, **changes):
    return {v.name: v for v in dbt.analyze_all(manifest(**changes), spark)}


def test_verdicts(spark):
    found = verdicts(spark)
    assert {n: v.kind for n, v in found.items()} == {"lines": "streamable", "totals": "rejected", "priced": "streamable", "live": "publishes", "plain": "rejected"}
    assert "source" in found["lines"].sql and found["priced"].lookups[0][1].name == "fx"


@pytest.mark.parametrize(
    "change",
    [
        dict(compiled_code=None), dict(config={"materialized": "view"}), dict(depends_on={"nodes": []}), dict(depends_on={"nodes": ["source.p.orders", "model.p.totals"]}), dict(depends_on={"nodes": ["gone"]}), dict(compiled_code="SELECT a FROM other.t"),
        dict(meta={"millrace_publish": "webpubsub"}), dict(compiled_code='SELECT o.a FROM "lake"."bronze"."orders" o JOIN "lake"."bronze"."orders" p ON o.a = p.a'),
    ],
)
def test_rejected_models(spark, change):
    base = catalogue.MANIFEST["nodes"]["model.p.lines"]
    found = verdicts(spark, **{"model.p.lines": base | change})
    assert found["lines"].kind == "rejected" and found["live"].kind == "rejected"


def test_two_publications_of_one_host(spark):
    live = catalogue.MANIFEST["nodes"]["model.p.live"]
    found = verdicts(spark, **{"model.p.live2": live | {"name": "live2"}})
    assert found["live"].kind == found["live2"].kind == "rejected"


def test_conversion_reads_back(spark):
    lines = catalogue.MANIFEST["nodes"]["model.p.lines"]
    m = manifest(**{"model.p.lines": lines | {"meta": {"millrace_location": "/data/lines", "millrace_starting_version": 3}}})
    made = dbt.convert(m, C.StorageConfig(uri_template="/lake/{schema}/{name}"), spark)
    by = {p.name: p for p in made}
    assert by["lines"].target_uri == "/data/lines" and by["lines"].source_uri == "/lake/bronze/orders" and by["lines"].app_id == "millrace.lines" and by["lines"].starting_version == 3
    assert by["lines"].publish.group == "live" and by["priced"].lookups[0].uri == "/lake/bronze/rates"
    assert C.parse(dbt.to_toml(made)).pipelines == made
    with pytest.raises(ConfigError):
        dbt.convert(manifest(), C.StorageConfig(), spark)


def test_relations_are_replaced_where_they_are_relations(spark):
    names = {("orders",): "source", ("b", "orders"): "source"}
    sql, unknown = dbt.rewrite_relations(spark, 'WITH x AS (SELECT * FROM b.orders), y AS (SELECT * FROM x) SELECT orders.a, \'from b.orders\' AS t FROM "b"."orders" LEFT JOIN z ON z.k = orders.k', names)
    assert unknown == ["z"] and sql.count("source") == 2 and "'from b.orders'" in sql and "AS `orders`" in sql


# ---- catalog ----


def trino(server, answers):
    base = []

    def answer(path, headers, body):
        if path == "/v1/statement":
            return 200, {"nextUri": f"{base[0]}/next/{body.decode()[:60].replace(' ', '_').replace(chr(34), '')}"}
        for k, v in answers.items():
            if k in path:
                return 200, v
        return 200, {"error": {"message": "no such table"}}

    base.append(server(answer))
    return catalog.Connection(base[0], "me")


def test_locations(server):
    c = trino(server, {"a.b.orders": {"data": [["CREATE TABLE x (\n id bigint\n)\nWITH (\n location = 'abfss://c@x/o''s'\n)"]]}, "system": {"data": [["lake"], ["hub"]]}, "SELECT_catalog_name": {"data": [["lake"], ["hub"]]}})
    assert catalog.location(c, 'a.b."orders"') == "abfss://c@x/o's"
    assert catalog.delta_catalogs(c) == ["hub", "lake"]
    with pytest.raises(LogError):
        catalog.location(c, "a.b.gone")
    with pytest.raises(LogError):
        catalog.query(catalog.Connection("http://127.0.0.1:1", "me", timeout=1), "SELECT 1")


def test_moved_and_silent_catalog():
    places = {"r.s": "/new"}

    def find(relation):
        if relation not in places:
            raise LogError("silent")
        return places[relation]

    own = C.Resolved("p", "a", "/old", "/t", source_relation="r.s")
    located = catalog.Located(find)
    assert located(own).source_uri == "/new"
    places.clear()
    assert located(own).source_uri == "/new" and located(located(own)) == located(own)


def test_profiles(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET", "s3")
    (tmp_path / "profiles.yml").write_text("p:\n  target: dev\n  outputs:\n    dev: {type: trino, host: h, port: 8443, user: u, password: \"{{ env_var('SECRET') }}\", database: lake}\n    other: {type: spark}\n")
    c = catalog.connection(str(tmp_path))
    assert (c.url, c.password, c.catalog) == ("https://h:8443", "s3", "lake")
    for kw in (dict(target="none"), dict(profile="q"), dict(target="other")):
        with pytest.raises(ConfigError):
            catalog.connection(str(tmp_path), **kw)
    with pytest.raises(ConfigError):
        catalog.output({"a": {}, "b": {}})


# ---- running ----


def config_of(tables, **more):
    return C.Config([C.PipelineConfig("p", "mr.p", tables[0].uri, tables[1].uri, allowed_latency_secs=0, **more)])


def test_once_run_and_metrics(spark, tables):
    config = config_of(tables)
    supervisor = Supervisor(spark, config, C.resolve(config, spark))
    assert supervisor.run(once=True) == {} and read_snapshot(spark, tables[1]).count() == 8
    page = supervisor.page()
    assert 'millrace_rows_written_total{pipeline="p"} 8' in page and "millrace_merges_in_flight 0" in page and page.count("# TYPE") == len(metrics.SERIES) + 6
    thread = threading.Thread(target=supervisor.run)
    thread.start()
    append(tables[0], spark.createDataFrame([(99, "z")], FLAT))
    try:
        assert wait_until(lambda: tables[1].last_txn("mr.p") == 3, 60)
    finally:
        supervisor.stop()
        thread.join(60)
    assert status(C.resolve(config, spark)) == [{"name": "p", "source_head": 3, "committed": 3, "lag": 0}]


def test_failure_is_tried_again(spark, tables):
    config = config_of(tables)
    tries = []

    def make(*args, **kw):
        tries.append(1)
        if len(tries) < 2:
            raise LogError("not yet")
        return Pipeline(*args, **kw)

    supervisor = Supervisor(spark, config, C.resolve(config, spark), make=make)
    thread = threading.Thread(target=supervisor.run)
    thread.start()
    try:
        assert wait_until(lambda: tables[1].last_txn("mr.p") == 2, 60)
    finally:
        supervisor.stop()
        thread.join(60)
    read = supervisor.metrics["p"].read()
    assert read["errors"] == read["pipeline_restarts"] == 1 and read["pipeline_up"] == 1
    waits = [backoff(n, "p") for n in range(1, 15)]
    assert 0.75 <= waits[0] <= 1.25 and all(w <= 375 for w in waits) and waits == [backoff(n, "p") for n in range(1, 15)]


def test_command_line(spark, tables, tmp_path):
    path = tmp_path / "p.toml"
    path.write_text(dbt.to_toml(config_of(tables).pipelines) + '\n[[pipeline]]\nname = "bad"\napp_id = ""\nsource_uri = "/a"\ntarget_uri = "/b"\n')
    say = lambda *args: (lambda out: (cli.main([*args], spark, out), out.getvalue()))(io.StringIO())
    code, text = say("validate", "-c", str(path))
    assert code == 1 and "bad: can't run" in text and "p: ok" in text
    code, _ = say("once", "-c", str(path), "--no-publish", "--metrics-addr", "127.0.0.1:0")
    assert code == 1 and read_snapshot(spark, tables[1]).count() == 8
    code, text = say("status", "-c", str(path))
    assert code == 0 and json.loads(text.splitlines()[-1])["lag"] == 0
    (tmp_path / "manifest.json").write_text(json.dumps(catalogue.MANIFEST))
    code, text = say("dbt", "check", str(tmp_path / "manifest.json"))
    assert code == 0 and "streamable  lines" in text and "2 rejected" in text
    code, text = say("dbt", "convert", str(tmp_path / "manifest.json"), "--uri-template", "/l/{schema}/{name}", "-s", "priced")
    assert code == 0 and len(C.parse(text).pipelines) == 1
    assert say("once", "-c", "/nowhere.toml")[0] == 2


def test_spill_series(spark):
    spark.range(300_000).selectExpr("id % 7 AS k", "repeat('x', 50) AS v").repartition(2).sort("v").count()
    page = Supervisor(spark, C.Config(defaults=C.Defaults(max_temp_directory_size="1GB")), C.Resolution()).page()
    values = {line.split()[0]: int(line.split()[1]) for line in page.splitlines() if line.startswith("millrace_spill")}
    assert set(values) == {f"millrace_spill_{x}_bytes" for x in ("memory", "disk", "limit", "free")}
    assert values["millrace_spill_limit_bytes"] == 10**9 and values["millrace_spill_free_bytes"] > 0
