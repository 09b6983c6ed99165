"""Queries by name, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, MillraceError
from ..operators import coerce, dedup, grain, lookup, rank, upsert
from ..operators.publish import render
from ..sources.log import Add, Remove, Table
from ..sources.scan import read_files, read_snapshot
from ..sources.sink import Offset, append, commit, write_files
from ..sources.stats import footer_stats
from ..sources.stream import Cursor, LogStream, Policy
from ..streaming import config as C
from ..streaming.pipeline import Pipeline
from . import dbt, gate
from .transform import run_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, where none is set (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        parsed = urlparse(base)
        return f"{unquote(parsed.path) if parsed.scheme == 'file' else base}/millrace-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, made, True)
    return made


def _over(name: str, sql: str, oracle: str, query_name: str, grain: gate.Grain = gate.Grain.ROW, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query that is one SELECT over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(prepare(table(spark, sf_dir, name)), sql, grain=grain)

    run.__name__ = query_name
    query(oracle)(run)


# ---- projections, filters, shapes ----

FLAGSHIP = "SELECT event_id, CAST(json_extract_scalar(props, '$.k') AS BIGINT) AS k, ts FROM source WHERE event_type <> 'error'"

_over("events", FLAGSHIP, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events WHERE event_type <> 'error'", "json_scalar")
_over(
    "orders", "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price, lower(o_orderpriority) AS priority FROM source",
    "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price, lower(o_orderpriority) AS priority FROM orders", "projection_cast",
)
_over("orders", "SELECT o_orderkey, o_custkey FROM source WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1%')", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1%')", "filter")
_over("customer", "SELECT * FROM source", "SELECT * FROM customer", "identity")
_over(
    "orders", "WITH a AS (SELECT o_orderkey, o_totalprice * 2 AS twice FROM source), source AS (SELECT * FROM a WHERE twice > 50000) SELECT o_orderkey, twice FROM source",
    "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 50000", "cte_chain",
)
_over("part", "SELECT p.k FROM (SELECT p_partkey AS k FROM source) p WHERE p.k IS NOT NULL", "SELECT p_partkey AS k FROM part", "derived_table")
_over("nation", "SELECT n_nationkey AS k FROM source UNION ALL SELECT n_regionkey AS k FROM source", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_regionkey AS k FROM nation", "union_all")
_over("nation", "SELECT n_nationkey AS k FROM source UNION SELECT n_regionkey AS k FROM source", "SELECT n_nationkey AS k FROM nation UNION SELECT n_regionkey AS k FROM nation", "union_distinct")
_over("nation", "SELECT n_nationkey AS k FROM source INTERSECT SELECT n_regionkey AS k FROM source", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT n_regionkey AS k FROM nation", "intersect_batch")
_over("nation", "SELECT n_nationkey AS k FROM source EXCEPT SELECT n_regionkey AS k FROM source", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey AS k FROM nation", "except_batch")
_over("orders", "SELECT o_orderkey, o_totalprice FROM source ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "order_by_limit")
_over(
    "supplier", "SELECT s_suppkey, place.nation AS nation, place.balance AS balance FROM source", "SELECT s_suppkey, s_nationkey AS nation, s_acctbal AS balance FROM supplier", "struct_field",
    prepare=lambda df: df.select("s_suppkey", F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).alias("place")),
)
_over(
    "orders", "SELECT o_orderkey, from_unixtime(secs, 'Europe/Amsterdam') AS wall FROM source", "SELECT o_orderkey, timezone('Europe/Amsterdam', to_timestamp(946684800 + o_orderkey * 3607)) AS wall FROM orders", "from_unixtime_zone",
    prepare=lambda df: df.select("o_orderkey", (F.lit(946684800) + F.col("o_orderkey") * 3607).cast("long").alias("secs")),
)
_over(
    "customer",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side, substring(c_name, 1, 8) AS head, concat(c_name, '/', c_mktsegment) AS label, round(abs(c_acctbal), 1) AS size, greatest(c_nationkey, 7) AS top FROM source",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side, substring(c_name, 1, 8) AS head, concat(c_name, '/', c_mktsegment) AS label, round(abs(c_acctbal), 1) AS size, greatest(c_nationkey, 7) AS top FROM customer",
    "scalar_functions",
)

# ---- JSON ----


def _documents(df: DataFrame) -> DataFrame:
    made = F.to_json(F.struct(F.array("user_id", "event_id").alias("ids"), F.col("event_type").alias("kind"), F.struct("event_id").alias("inner")))
    return df.select("event_id", made.alias("doc"))


_over(
    "events",
    """SELECT event_id, json_extract(doc, '$.ids') AS ids, json_query(doc, '$.kind') AS kind, json_extract(doc, '$.inner') AS inside, json_extract(doc, '$.nothing') AS missing FROM source""",
    """SELECT event_id, '[' || user_id || ',' || event_id || ']' AS ids, '"' || event_type || '"' AS kind, '{"event_id":' || event_id || '}' AS inside, CAST(NULL AS VARCHAR) AS missing FROM events""",
    "json_extract",
    prepare=_documents,
)
_over(
    "events",
    """SELECT event_id, json_value(doc, '$.kind') AS kind, get_json_object(doc, '$.ids') AS container, json_extract_string(doc, '$["inner"]["event_id"]') AS inner_id, json_extract_scalar(doc, '$.ids[0]') AS first_id FROM source""",
    "SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS container, CAST(event_id AS VARCHAR) AS inner_id, CAST(user_id AS VARCHAR) AS first_id FROM events",
    "json_scalars",
    prepare=_documents,
)
_over(
    "events",
    "SELECT event_id, json_size(doc, '$.ids') AS n_ids, json_size(doc, '$.kind') AS n_kind, json_exists(doc, '$.kind') AS has_kind, json_exists(doc, '$.no') AS has_no, is_json_scalar(doc) AS scalar, json_parse(doc) = doc AS same FROM source",
    "SELECT event_id, CAST(2 AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS n_kind, true AS has_kind, false AS has_no, false AS scalar, true AS same FROM events",
    "json_shape",
    prepare=_documents,
)
_over(
    "events",
    """SELECT event_id, json_array_length(json_extract(doc, '$.ids')) AS n, json_array_contains(json_extract(doc, '$.ids'), '7') AS has_7, json_array_get(json_extract(doc, '$.ids'), '-1') AS last, json_array_length(doc) AS none FROM source""",
    "SELECT event_id, CAST(2 AS BIGINT) AS n, user_id = 7 OR event_id = 7 AS has_7, CAST(event_id AS VARCHAR) AS last, CAST(NULL AS BIGINT) AS none FROM events",
    "json_arrays",
    prepare=_documents,
)
_over("events", "SELECT event_id, CAST(id AS BIGINT) AS id FROM source s CROSS JOIN UNNEST(CAST(json_extract(s.doc, '$.ids') AS ARRAY(JSON))) AS t(id)", "SELECT event_id, user_id AS id FROM events UNION ALL SELECT event_id, event_id FROM events", "unnest_json", prepare=_documents)

# ---- arrays ----


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(
    "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity * l_extendedprice), 2) AS total, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice * (1 - l_discount)), 4) AS high, round(avg(l_quantity), 6) AS mean_qty, "
    "round(sum(l_extendedprice / nullif(l_discount, 0)), 3) AS per_discount FROM lineitem GROUP BY l_orderkey"
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        _orders_with_lines(spark, sf_dir),
        "SELECT l_orderkey, array_length(lines) AS n, round(array_sum(lines, 'price * qty'), 2) AS total, round(array_min(lines, 'price'), 2) AS low, round(array_max(lines, 'price * (1 - discount)'), 4) AS high, round(array_avg(lines, 'qty'), 6) AS mean_qty, round(array_sum(lines, 'price / discount'), 3) AS per_discount FROM source",
    )


_over(
    "embeddings", "SELECT vec_id, array_length(embedding) AS n, round(array_sum(embedding), 4) AS total, round(array_min(embedding), 6) AS low, round(array_max(embedding), 6) AS high, round(array_avg(embedding), 5) AS mean, array_sum(slice(embedding, 1, 0)) AS nothing FROM source",
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high, round(list_avg(embedding::DOUBLE[]), 5) AS mean, CAST(NULL AS DOUBLE) AS nothing FROM embeddings", "array_plain",
)
_LINES = "SELECT l_orderkey, l_linenumber AS line, l_quantity AS qty FROM lineitem"


@query(_LINES)
def unnest_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(_orders_with_lines(spark, sf_dir), "SELECT l_orderkey, x.line AS line, x.qty AS qty FROM (SELECT l_orderkey, unnest(lines) AS x FROM source)")


@query(_LINES)
def unnest_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(_orders_with_lines(spark, sf_dir), "SELECT o.l_orderkey, x.line AS line, x.qty AS qty FROM source o CROSS JOIN UNNEST(o.lines) AS t(x)")


@query(_LINES)
def unnest_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(_orders_with_lines(spark, sf_dir), "SELECT o.l_orderkey, x.line AS line, x.qty AS qty FROM source o, UNNEST(o.lines) AS t(x)")


# ---- lookups ----


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT s.s_suppkey, n.n_name AS nation FROM source s LEFT JOIN nations n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey < 3"
    return run_sql(table(spark, sf_dir, "supplier"), sql, {"nations": table(spark, sf_dir, "nation")})


@query("SELECT s_suppkey, upper(n_name) AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def lookup_pinned_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup has three versions with rows; the source's commit comes after the second."""
    folder = workspace(spark)
    nations = Table(f"{folder}/nations")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations.create(names.schema)
    for k, change in enumerate((F.lower, F.upper, F.reverse), 1):
        base = nations.snapshot()
        made = write_files(nations, base, names.select("n_nationkey", change("n_name").alias("n_name")))
        commit(nations, base, None, made.adds, [Remove(p) for p in base.files])
        nations.store.touch(f"_delta_log/{k:020d}.json", (1000 + k) * 1000)
    nations.store.touch(f"_delta_log/{0:020d}.json", 1_000_000)
    pinned = lookup.pin(lookup.Lookup("nations", nations.uri), 1003_000)
    return run_sql(table(spark, sf_dir, "supplier"), "SELECT s.s_suppkey, n.n_name AS nation FROM source s LEFT JOIN nations n ON s.s_nationkey = n.n_nationkey", {"nations": pinned.read(spark)})


# ---- coercion ----

_TARGET = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("amount", T.LongType()), T.StructField("kind", T.StringType(), False), T.StructField("extra", T.StringType())])


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some amounts are no number, and the kind of some is missing."""
    amount = F.when(F.col("event_type") == "error", "n/a").when(F.col("user_id") < 10, None).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", amount.alias("amount"), F.nullif(F.col("event_type"), F.lit("click")).alias("kind"))


_GOOD = "event_type NOT IN ('error', 'click')"


@query("SELECT event_id, CASE WHEN user_id < 10 THEN NULL ELSE user_id END AS amount, event_type AS kind, CAST(NULL AS VARCHAR) AS extra FROM events WHERE " + _GOOD)
def coerce_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce.quarantining(_dirty(spark, sf_dir), _TARGET).good()


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'amount' ELSE 'kind' END AS fault FROM events WHERE NOT (" + _GOOD + ")")
def coerce_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce.quarantining(_dirty(spark, sf_dir), _TARGET).rejects().select("event_id", F.col(coerce.AT).alias("fault"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS BIGINT) AS more FROM events")
def coerce_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("user_id", T.StringType()), T.StructField("more", T.LongType())])
    return coerce.strict(table(spark, sf_dir, "events"), target)


# ---- cut-offs and keys ----

_MIDDLE = "(SELECT quantile_disc(ts, 0.5) FROM events)"


@query("SELECT max(ts) AS mark, CAST(count(*) AS BIGINT) AS keys FROM (SELECT DISTINCT ts, event_id FROM events WHERE ts = (SELECT max(ts) FROM events)) GROUP BY ALL HAVING count(*) > 0")
def watermark_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.cut_off(table(spark, sf_dir, "events"), "ts", "event_id")
    return found.boundary.agg(F.count("*").alias("keys")).select(F.lit(found.mark).cast("timestamp_ntz").alias("mark"), "keys")


@query(f"SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts <= {_MIDDLE})")
def dedup_after_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all events when the target has those up to the middle one."""
    events = table(spark, sf_dir, "events")
    middle = rank.quantile(events, F.unix_micros(F.col("ts").cast("timestamp")), 0.5)
    have = events.filter(F.col("ts") <= F.timestamp_micros(F.lit(middle).cast("long")).cast("timestamp_ntz"))
    return dedup.cut_off(have, "ts", "event_id").apply(events).select("event_id", "ts")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def collapse_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.collapse(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), upsert.Keys("user_id", "ts", ("event_id",)))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def collapse_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.collapse(table(spark, sf_dir, "events").select("user_id", "ts"), upsert.Keys("user_id", "ts"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def grain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grain.duplicates(table(spark, sf_dir, "events").select("user_id"), ["user_id"])


# ---- streams ----


def committed(spark: SparkSession, df: DataFrame, uri: str, key: str, commits: int = 4) -> Table:
    """A table that has df in so many commits, by ranges of key."""
    made = Table(uri)
    made.create(df.schema)
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return made
    step = (high - low) // commits + 1
    for k in range(commits):
        append(made, df.filter((F.col(key) >= low + k * step) & (F.col(key) < low + (k + 1) * step)))
    return made


def settings(source: Table, target: Table, **more) -> C.Resolved:
    return C.Resolved("demo", "mr.demo", source.uri, target.uri, **more)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def append_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits, one a batch, by two runs that follow each other, and a third that finds nothing."""
    folder = workspace(spark)
    source = committed(spark, table(spark, sf_dir, "orders"), f"{folder}/source", "o_orderkey")
    target = Table(f"{folder}/target")
    target.create(T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())]))
    own = settings(source, target, transform_sql="SELECT o_orderkey, o_totalprice FROM source WHERE o_orderstatus = 'O'")
    first = Pipeline(spark, own)
    first.step()
    for _ in range(2):
        Pipeline(spark, own).run_once()
    return read_snapshot(spark, target)


@query("SELECT * FROM nation")
def compaction_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that only rewrites files gives no rows."""
    folder = workspace(spark)
    source = committed(spark, table(spark, sf_dir, "nation"), f"{folder}/source", "n_nationkey", 3)
    base = source.snapshot()
    whole = write_files(source, base, read_snapshot(spark, source, base).coalesce(1))
    commit(source, base, None, [Add(a.path, a.size, False, stats=a.stats) for a in whole.adds], [Remove(p, False) for p in base.files])
    return _all_rows(spark, source, LogStream(source))


def _all_rows(spark: SparkSession, source: Table, stream: LogStream) -> DataFrame:
    """The rows of all batches."""
    out = None
    for batch in iter(stream.next_batch, None):
        df = read_files(spark, source, batch.files, batch.schema, batch.partitions)
        out = df if out is None else out.union(df)
    return out


def _changed(spark: SparkSession, sf_dir: str) -> Table:
    """Regions, of which a later commit rewrites one in upper case, and another adds one."""
    df = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    source = Table(f"{workspace(spark)}/source")
    source.create(df.schema)
    append(source, df.filter("r_regionkey = 0"))
    append(source, df.filter("r_regionkey between 1 and 3"))
    base = source.snapshot()
    old = [a for a in base.files.values() if '"r_regionkey": 0' in (a.stats or "")]
    made = write_files(source, base, df.filter("r_regionkey = 0").select("r_regionkey", F.upper("r_name").alias("r_name")))
    commit(source, base, None, made.adds, [Remove(old[0].path)])
    append(source, df.filter("r_regionkey > 3"))
    return source


@query("SELECT r_regionkey, r_name FROM region")
def policy_skip_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _changed(spark, sf_dir)
    return _all_rows(spark, source, LogStream(source, policy=Policy.SKIP))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, upper(r_name) FROM region WHERE r_regionkey = 0")
def policy_ignore_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _changed(spark, sf_dir)
    return _all_rows(spark, source, LogStream(source, policy=Policy.IGNORE))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <= 12")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of four commits."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    source = Table(f"{workspace(spark)}/source")
    source.create(df.schema)
    for low in (0, 7, 13, 20):
        append(source, df.filter(f"n_nationkey >= {low} and n_nationkey < {({0: 7, 7: 13, 13: 20}).get(low, 1000)}"))
    return read_snapshot(spark, source, source.snapshot(2))


@query("SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition values live in the log and come back typed."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    made = Table(f"{workspace(spark)}/table")
    made.create(df.schema, ["c_mktsegment", "c_nationkey"])
    append(made, df)
    return read_snapshot(spark, made)


_NEWEST = "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _upserted(spark: SparkSession, sf_dir: str, mode: str) -> Table:
    folder = workspace(spark)
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    source = committed(spark, df, f"{folder}/source", "event_id")
    target = Table(f"{folder}/target")
    target.create(df.schema)
    one = C.PipelineConfig("demo", "mr.demo", source.uri, target.uri, write_mode=mode, upsert_key="user_id", dedup_timestamp="ts", upsert_tiebreak=["event_id"])
    for r in C.resolve(C.Config([one]), spark).pipelines:
        Pipeline(spark, r).run_once()
    return target


@query(_NEWEST)
def upsert_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_snapshot(spark, _upserted(spark, sf_dir, "upsert"))


@query(_NEWEST)
def staged_upsert_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_snapshot(spark, _upserted(spark, sf_dir, "staged_upsert"))


@query("SELECT CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS removed")
def upsert_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are all there already change nothing, but the position is recorded."""
    target = _upserted(spark, sf_dir, "upsert")
    df = read_snapshot(spark, target)
    keys = upsert.Keys("user_id", "ts", ("event_id",))
    before = target.snapshot()
    made = upsert.merge(spark, target, df, keys, df.columns, Offset("mr.again", 3))
    after = target.snapshot()
    assert after.txns["mr.again"] == 3
    return spark.createDataFrame([(made.updated, made.inserted, len(set(before.files) - set(after.files)))], "updated long, inserted long, removed long")


# ---- publications ----

_over(
    "lineitem", "SELECT l_returnflag, sum(l_linenumber) AS lines, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM source GROUP BY l_returnflag HAVING count(*) > 0",
    "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag", "publish_group_by", gate.Grain.BATCH,
)
_over("lineitem", "SELECT count(*) AS n, max(l_linenumber) AS most FROM source", "SELECT CAST(count(*) AS BIGINT) AS n, max(l_linenumber) AS most FROM lineitem", "publish_global", gate.Grain.BATCH)
_over("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM source", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "publish_distinct", gate.Grain.BATCH)
_over(
    "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM source GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "publish_rollup", gate.Grain.BATCH,
)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def publish_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a message, as they were rendered."""
    made = render(run_sql(table(spark, sf_dir, "events"), "SELECT event_type, count(*) AS n FROM source GROUP BY event_type", grain=gate.Grain.BATCH))
    return spark.createDataFrame([(r["event_type"], r["n"]) for r in made.rows], "event_type string, n long")


# ---- verdicts ----

#: Statements by where they are accepted: at the grain of rows and of batches, of batches only, or nowhere.
STATEMENTS = {
    "both": (
        'SELECT a FROM source',
        'SELECT a FROM source WHERE a > 1',
        'SELECT s.a, n.b FROM source s LEFT JOIN nations n ON n.k = s.k',
        'SELECT a FROM source UNION ALL SELECT a FROM source',
        'SELECT a FROM source UNION SELECT a FROM source',
        'SELECT a FROM source ORDER BY a LIMIT 3',
        'SELECT unnest(x) AS y FROM source',
        'SELECT y FROM source s CROSS JOIN UNNEST(s.x) AS t(y)',
        "SELECT from_unixtime(a, 'Europe/Amsterdam') AS t FROM source",
        'WITH source AS (SELECT a FROM source) SELECT a FROM source',
    ),
    "batch": (
        'SELECT a FROM source GROUP BY a',
        'SELECT DISTINCT a FROM source',
        'SELECT sum(a) FROM source',
    ),
    "none": (
        'SELECT a FROM other',
        'SELECT mean(a) FROM source',
        'SELECT row_number() OVER (ORDER BY a) FROM source',
        'SELECT rank() FROM source',
        'SELECT a FROM source QUALIFY row_number() OVER (ORDER BY a) = 1',
        'SELECT s.a FROM source s JOIN source t ON s.a = t.a',
        'SELECT a FROM source, nations',
        'SELECT a FROM source CROSS JOIN nations',
        'SELECT s.a, n.b FROM source s LEFT JOIN nations n ON true',
        'SELECT s.a FROM source s LEFT JOIN nations n ON n.k = coalesce(n.k, s.k)',
        'SELECT s.a FROM source s RIGHT JOIN nations n ON n.k = s.k',
        'SELECT s.a FROM source s FULL JOIN nations n ON n.k = s.k',
        'SELECT s.a FROM source s LEFT SEMI JOIN nations n ON n.k = s.k',
        'SELECT s.a FROM source s LEFT ANTI JOIN nations n ON n.k = s.k',
        'SELECT a FROM source WHERE k IN (SELECT k FROM nations)',
        'SELECT a FROM source WHERE EXISTS (SELECT 1 FROM nations n WHERE n.k = source.k)',
        'SELECT count(DISTINCT a) FROM source HAVING median(a) > 1',
        'SELECT y FROM source LATERAL VIEW explode(x) t AS y',
        'SELECT * FROM range(3)',
        'VALUES (1)',
        'DELETE FROM source',
        'SELECT a FROM source; SELECT a FROM source',
        'SELECT a FROM source TABLESAMPLE (10 ROWS)',
        'SELECT from_unixtime(a) FROM source',
        'WITH nations AS (SELECT a FROM source) SELECT a FROM nations',
        'SELECT a FROM db.source',
        'SELECT approx_distinct(a) FROM source',
        '',
    ),
}


def _verdicts_sql() -> str:
    """The same table as literal rows."""
    told = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(sql, g.value, kind == "both" or kind == "batch" and g is gate.Grain.BATCH) for kind, statements in STATEMENTS.items() for sql in statements for g in gate.Grain]
    return "SELECT * FROM (VALUES " + ", ".join(f"({told(s)}, '{g}', {str(ok).lower()})" for s, g, ok in rows) + ") AS t(statement, grain, accepted)"


@query(_verdicts_sql())
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says to each statement, at both grains, with `nations` a declared lookup."""
    rows = []
    for sql in (x for statements in STATEMENTS.values() for x in statements):
        for g in gate.Grain:
            try:
                gate.check(spark, sql, g, ["nations"])
                rows.append((sql, g.value, True))
            except MillraceError:
                rows.append((sql, g.value, False))
    return spark.createDataFrame(rows, "statement string, grain string, accepted boolean")


MANIFEST = {
    "nodes": {
        "model.p.lines": {"name": "lines", "resource_type": "model", "database": "lake", "schema": "silver", "compiled_code": 'SELECT order_id, unnest(items) AS item FROM "lake"."bronze"."orders"', "depends_on": {"nodes": ["source.p.orders"]}, "config": {"materialized": "table"}},
        "model.p.totals": {"name": "totals", "resource_type": "model", "database": "lake", "schema": "silver", "compiled_code": 'SELECT sum(price) AS price FROM "lake"."bronze"."orders"', "depends_on": {"nodes": ["source.p.orders"]}, "config": {"materialized": "table"}},
        "model.p.priced": {"name": "priced", "resource_type": "model", "database": "lake", "schema": "silver", "compiled_code": 'SELECT o.order_id, fx.rate FROM "lake"."bronze"."orders" o LEFT JOIN "lake"."bronze"."rates" fx ON fx.currency = o.currency', "depends_on": {"nodes": ["source.p.orders", "source.p.rates"]}, "config": {"materialized": "incremental"}},
        "model.p.live": {"name": "live", "resource_type": "model", "compiled_code": 'SELECT count(*) AS n FROM "lake"."silver"."lines"', "depends_on": {"nodes": ["model.p.lines"]}, "config": {"materialized": "view", "meta": {"millrace_publish": "webpubsub"}}},
        "model.p.plain": {"name": "plain", "resource_type": "model", "compiled_code": "SELECT 1", "config": {"materialized": "view"}},
    },
    "sources": {
        "source.p.orders": {"name": "orders", "resource_type": "source", "database": "lake", "schema": "bronze"},
        "source.p.rates": {"name": "rates", "resource_type": "source", "database": "lake", "schema": "bronze", "meta": {"millrace_lookup": "fx"}},
    },
}


@query("SELECT * FROM (VALUES ('live', 'publishes'), ('lines', 'streamable'), ('plain', 'rejected'), ('priced', 'streamable'), ('totals', 'rejected')) AS t(model, verdict)")
def dbt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be streamed of a small manifest."""
    found = dbt.analyze_all(dbt.parse(json.dumps(MANIFEST)), spark)
    return spark.createDataFrame([(v.name, v.kind.lower()) for v in found], "model string, verdict string")


@query(
    "SELECT CAST(1 + (o_orderkey - low) // step AS BIGINT) AS version, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_totalprice) AS cheapest "
    "FROM orders, (SELECT min(o_orderkey) AS low, (max(o_orderkey) - min(o_orderkey)) // 4 + 1 AS step FROM orders) GROUP BY ALL"
)
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bounds of the files of each commit, as the commit records them."""
    made = committed(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), f"{workspace(spark)}/orders", "o_orderkey")
    rows = []
    for v in range(1, made.head() + 1):
        for a in made.commit(v).adds:
            s = json.loads(a.stats)
            assert s == json.loads(footer_stats(made.store.path(a.path)))
            rows.append((v, s["numRecords"], s["minValues"]["o_orderkey"], s["maxValues"]["o_orderkey"], s["minValues"]["o_totalprice"]))
    files = spark.createDataFrame(rows, "version long, n long, low long, high long, cheapest double")
    return files.groupBy("version").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("cheapest").alias("cheapest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(table(spark, sf_dir, "events"), FLAGSHIP)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
