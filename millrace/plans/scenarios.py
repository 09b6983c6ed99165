"""More registered queries: what a pipeline, a log and its settings do, each shown as rows that SQL can tell."""

from __future__ import annotations

import http.server
import io
import json
import shutil
import tempfile
import threading
import time
import urllib.parse
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LogError, MillraceError
from ..operators import coerce, dead_letter, dedup, grain, lookup, publish, upsert
from ..sources import catalog
from ..sources.log import HadoopStore, Remove, Table
from ..sources.scan import read_files, read_snapshot
from ..sources.sink import Offset, append, commit, write_files
from ..sources.stats import provably_below
from ..sources.stream import Cursor, LogStream, Policy
from ..streaming import config as C
from ..streaming import metrics
from ..streaming.limits import Gate
from ..streaming.pipeline import Pipeline
from . import dbt
from .catalogue import MANIFEST, _over, committed, query, settings, table, workspace


def _nations(spark: SparkSession, sf_dir: str, commits: int = 5) -> Table:
    """Nations in so many commits of one file each, by ranges of the key; commit 1 is the first with rows."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey").coalesce(1)
    made = Table(f"{workspace(spark)}/nations")
    made.create(df.schema)
    step = 25 // commits
    for k in range(commits):
        append(made, df.filter((F.col("n_nationkey") >= k * step) & (F.col("n_nationkey") < (k + 1) * step)))
    return made


def _numbered(spark: SparkSession, source: Table, stream: LogStream) -> DataFrame:
    """The rows of all batches, with the number of the batch."""
    out = None
    for k, batch in enumerate(iter(stream.next_batch, None)):
        df = read_files(spark, source, batch.files, batch.schema, batch.partitions).select(F.lit(k).alias("batch"), "n_nationkey")
        out = df if out is None else out.union(df)
    return out


def _refused(spark: SparkSession, cases: list[tuple[str, Callable]]) -> DataFrame:
    """The kind of error that each case ends in; null for none."""
    rows = []
    for name, run in cases:
        try:
            run()
            rows.append((name, None))
        except MillraceError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")


def _told(*rows: tuple) -> str:
    """SQL of literal rows (name, error)."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'CAST(NULL AS VARCHAR)' if e is None else repr(e)})" for n, e in rows) + ") AS t(name, error)"


# ---- reading a log ----


@query("SELECT n_nationkey // 10 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two files a batch; commits stay whole."""
    source = _nations(spark, sf_dir)
    return _numbered(spark, source, LogStream(source, max_files=2))


@query("SELECT n_regionkey AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def commit_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit of a file for each region, read a file at a time."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_regionkey")
    source = Table(f"{workspace(spark)}/source")
    source.create(df.schema, ["n_regionkey"])
    append(source, df)
    return _numbered(spark, source, LogStream(source, max_files=1, split_commits=True))


@query("SELECT n_nationkey // 5 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def one_commit_a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nations(spark, sf_dir)
    return _numbered(spark, source, LogStream(source, one_commit=True))


@query("SELECT n_nationkey // 15 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def memory_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files are all that the memory of a batch takes."""
    source = _nations(spark, sf_dir)
    largest = max(a.size for a in source.snapshot().files.values())
    return _numbered(spark, source, LogStream(source, memory=int(largest * 3.5), amplification=1.0))


@query("SELECT 0 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey >= 10")
def start_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the version that was current then, itself included."""
    source = _nations(spark, sf_dir)
    for v in source.versions():
        source.store.touch(f"_delta_log/{v:020d}.json", (1000 + v) * 1000)
    return _numbered(spark, source, LogStream.from_time(source, 1003_500))


@query("SELECT 0 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey >= 15")
def start_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nations(spark, sf_dir)
    return _numbered(spark, source, LogStream(source, Cursor(4)))


@query(_told(("too large", "CommitTooLarge"), ("split", None), ("rewritten rows", "ChangeCommitError"), ("skipped", None), ("deletion vector", "DeletionVectorUnsupported"), ("missing commit", "CursorUnavailable"), ("vacuumed file", "SourceFileVacuumed"), ("newer protocol", "UnsupportedProtocol"), ("no table", "LogError"), ("beyond the head", None)))
def log_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream can't read, told by kind."""
    source = _nations(spark, sf_dir)
    changed, guarded, holed, vacuumed, newer = (_nations(spark, sf_dir, 1) for _ in range(5))
    base = changed.snapshot()
    commit(changed, base, None, [], [Remove(p) for p in base.files])
    guarded.write_commit(2, [{"add": {"path": "x.parquet", "size": 1, "dataChange": True, "partitionValues": {}, "deletionVector": {"storageType": "u"}}}])
    holed.write_commit(2, [{"commitInfo": {}}])
    holed.store.delete(f"_delta_log/{1:020d}.json")
    gone = vacuumed.snapshot()
    for path in gone.files:
        vacuumed.store.delete(path)
    newer.write_commit(2, [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7}}])
    return _refused(
        spark,
        [
            ("too large", LogStream(source, max_bytes=1).next_batch),
            ("split", LogStream(source, max_bytes=1, split_commits=True).next_batch),
            ("rewritten rows", LogStream(changed, Cursor(2)).next_batch),
            ("skipped", LogStream(changed, Cursor(2), Policy.SKIP).next_batch),
            ("deletion vector", LogStream(guarded, Cursor(2)).next_batch),
            ("missing commit", LogStream(Table(holed.uri), Cursor(1)).next_batch),
            ("vacuumed file", lambda: read_files(spark, vacuumed, [(1, a) for a in gone.files.values()], gone.schema)),
            ("newer protocol", Table(newer.uri).snapshot),
            ("no table", Table(f"{workspace(spark)}/nothing").head),
            ("beyond the head", LogStream(source, Cursor(99)).next_batch),
        ],
    )


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a table of its files; no other is read."""
    made = committed(spark, table(spark, sf_dir, "orders"), f"{workspace(spark)}/orders", "o_orderkey")
    return read_snapshot(spark, made, columns=["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def checkpoint_opens_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve commits, of which the first ten are in a checkpoint and no more in the log."""
    made = committed(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f"{workspace(spark)}/orders", "o_orderkey", 12)
    for v in range(10):
        made.store.delete(f"_delta_log/{v:020d}.json")
    return read_snapshot(spark, Table(made.uri))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def checkpoint_passed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint that can't be read, where the commits are all there."""
    made = committed(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f"{workspace(spark)}/orders", "o_orderkey", 3)
    made.store.replace(f"_delta_log/{2:020d}.checkpoint.parquet", b"nonsense")
    return read_snapshot(spark, Table(made.uri))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, true AS several FROM lineitem")
def sized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one task in files of 64 KB."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    made = Table(f"{workspace(spark)}/lines")
    made.create(df.schema)
    append(made, df, None, 64 << 10)
    return read_snapshot(spark, made).withColumn("several", F.lit(len(made.snapshot().files) > 1 or df.count() < 10_000))


# ---- commits ----


@query("SELECT CAST(v AS BIGINT) AS version, CAST(10 * v AS BIGINT) AS source_version, 'mr.' || v AS app_id, CAST(n AS BIGINT) AS n FROM (SELECT n_regionkey + 1 AS v, count(*) AS n FROM nation GROUP BY n_regionkey)")
def commit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each commit records beside its rows."""
    df = table(spark, sf_dir, "nation")
    made = Table(f"{workspace(spark)}/target")
    made.create(df.schema)
    for k in range(5):
        append(made, df.filter(F.col("n_regionkey") == k), Offset(f"mr.{k + 1}", 10 * (k + 1), "id"))
    rows = []
    for v in range(1, 6):
        c = made.commit(v)
        assert c.info["millrace.sourceTableId"] == "id" and c.txns == {c.info["millrace.appId"]: c.info["millrace.sourceVersion"]}
        rows.append((v, c.info["millrace.sourceVersion"], c.info["millrace.appId"], sum(json.loads(a.stats)["numRecords"] for a in c.adds)))
    return spark.createDataFrame(rows, "version long, source_version long, app_id string, n long")


@query("SELECT CAST(5 AS BIGINT) AS recorded, CAST(count(*) AS BIGINT) AS kept FROM nation WHERE n_nationkey < 5")
def empty_batches_move_the_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five commits give no row; all five are recorded."""
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    Pipeline(spark, settings(source, target, transform_sql="SELECT * FROM source WHERE n_nationkey < 5", max_files_per_batch=1)).run_once()
    return read_snapshot(spark, target).agg(F.lit(target.last_txn("mr.demo")).cast("long").alias("recorded"), F.count("*").alias("kept"))


@query(_told(("two writers of a version", "CommitConflict"), ("one app_id twice", "LogError"), ("negative version", "LogError"), ("another writer before", None)))
def commit_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _nations(spark, sf_dir, 1)
    base = target.snapshot()
    extra = write_files(target, base, read_snapshot(spark, target)).adds
    commit(target, base, Offset("a", 1), [])
    return _refused(
        spark,
        [
            ("two writers of a version", lambda: target.write_commit(1, [])),
            ("one app_id twice", lambda: commit(target, base, Offset("a", 2), [])),
            ("negative version", lambda: append(target, None, Offset("b", -1))),
            ("another writer before", lambda: commit(target, base, Offset("b", 1), extra)),
        ],
    )


@query("SELECT column_name, data_type FROM (VALUES ('n_nationkey', 'bigint'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(column_name, data_type)")
def stage_has_the_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nations(spark, sf_dir, 1)
    stage = Table(f"{workspace(spark)}/stage")
    for _ in range(2):  # one that is there already stays
        made = stage.create_like(source)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in made.schema], "column_name string, data_type string")


# ---- dead letters, cut-offs, rebuilds ----

_AMOUNT = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("amount", T.LongType())])


@query("SELECT event_id, 'mr.demo' AS app_id, 'demo' AS pipeline, 'amount' AS column_name, 'n/a' AS amount FROM events WHERE event_type = 'error'")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't fit, once each, though a run is repeated."""
    folder = workspace(spark)
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")).alias("amount"))
    source = committed(spark, df, f"{folder}/source", "event_id", 2)
    target, letters = Table(f"{folder}/target"), Table(dead_letter.default_uri(f"{folder}/target"))
    target.create(_AMOUNT)
    letters.create(dead_letter.SCHEMA)
    for _ in range(2):
        Pipeline(spark, settings(source, target)).run_once()
    value = F.from_json("payload", "event_id long, amount string")
    return read_snapshot(spark, letters).select(value["event_id"].alias("event_id"), "app_id", "pipeline", "column_name", value["amount"].alias("amount"))


@query("SELECT max(o_orderkey) AS source_version FROM orders WHERE o_custkey % 7 = 3")
def recorded_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild recorded for one of seven pipelines."""
    df = table(spark, sf_dir, "orders").select(F.concat(F.lit("mr."), (F.col("o_custkey") % 7).cast("string")).alias("app_id"), F.col("o_orderkey").alias("source_version"))
    marks = committed(spark, df, f"{workspace(spark)}/marks", "source_version", 2)
    return spark.createDataFrame([(dedup.watermark(spark, marks, "mr.3"),)], "source_version long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS mark, CAST(1 + (n_nationkey + 1) // 5 AS BIGINT) AS start FROM nation")
def rescan_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reading begins again for each cut-off: behind the newest commit without a row beyond it."""
    source = _nations(spark, sf_dir)
    return spark.createDataFrame([(k, dedup.rescan_start(source, "n_nationkey", k, 1)) for k in range(25)], "mark long, start long")


def _rebuilt(spark: SparkSession, sf_dir: str, below: int) -> tuple[Table, Table]:
    """(nations, a target that another job has written anew with those of keys below)."""
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    Pipeline(spark, settings(source, target, max_files_per_batch=1)).step()
    base = target.snapshot()
    made = write_files(target, base, read_snapshot(spark, source).filter(F.col("n_nationkey") < below))
    commit(target, base, None, made.adds, [Remove(p) for p in base.files])
    return source, target


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def resume_after_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuild has the first 12 rows; the rest follows, none twice."""
    source, target = _rebuilt(spark, sf_dir, 12)
    Pipeline(spark, settings(source, target, dedup_timestamp="n_nationkey", dedup_key="n_name")).run_once()
    return read_snapshot(spark, target).select("n_nationkey", "n_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def resume_at_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuild says that it has read three versions."""
    source, target = _rebuilt(spark, sf_dir, 15)
    marks = Table(f"{workspace(spark)}/marks")
    df = spark.createDataFrame([("mr.demo", 2), ("mr.demo", 3), ("mr.other", 5)], "app_id string, source_version long")
    marks.create(df.schema)
    append(marks, df)
    Pipeline(spark, settings(source, target, watermark_uri=marks.uri)).run_once()
    return read_snapshot(spark, target).select("n_nationkey", "n_name")


@query("SELECT * FROM (VALUES ('ours', 'ours'), ('rebuilt', 'overwritten'), ('new', 'never written')) AS t(target, writer)")
def who_wrote_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, rebuilt = _rebuilt(spark, sf_dir, 5)
    ours, new = (Table(f"{workspace(spark)}/{n}") for n in ("ours", "new"))
    for t in (ours, new):
        t.create_like(source)
    Pipeline(spark, settings(source, ours)).run_once()
    return spark.createDataFrame([(n, dedup.who_wrote(t, "mr.demo")[0].value) for n, t in (("ours", ours), ("rebuilt", rebuilt), ("new", new))], "target string, writer string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(1 AS BIGINT) AS times FROM nation")
def replaced_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source was made anew at another place with all its rows; with a cut-off none comes twice."""
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    Pipeline(spark, settings(source, target, max_files_per_batch=2)).step()
    Pipeline(spark, settings(_nations(spark, sf_dir), target, dedup_timestamp="n_nationkey", dedup_key="n_name")).run_once()
    return read_snapshot(spark, target).groupBy("n_nationkey").agg(F.count("*").alias("times"))


@query(_told(("source is target", "ConfigError"), ("lookup is source", "ConfigError"), ("lookup is target", "ConfigError"), ("one lookup twice", "ConfigError"), ("all apart", None), ("other lookups than before", "ConfigError"), ("another source without a cut-off", "LogError"), ("rebuild without a record", "LogError")))
def role_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, a, b = (_nations(spark, sf_dir, 1) for _ in range(3))
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    look = lambda n, t: lookup.Lookup(n, t.uri)
    guard = lambda s, t, *x: lambda: lookup.guard(s.snapshot(), t.snapshot(), list(x))
    a.store.touch(f"_delta_log/{1:020d}.json", 1_000_000)
    a.store.touch(f"_delta_log/{0:020d}.json", 1_000_000)
    b.store.touch(f"_delta_log/{1:020d}.json", 1_000_000)
    b.store.touch(f"_delta_log/{0:020d}.json", 1_000_000)
    sql = "SELECT s.* FROM source s LEFT JOIN x ON x.n_nationkey = s.n_nationkey"
    Pipeline(spark, settings(source, target, transform_sql=sql, lookups=[C.LookupConfig("x", uri=a.uri)])).run_once()
    other_rebuilt, rebuilt = _rebuilt(spark, sf_dir, 5)
    marks = Table(f"{workspace(spark)}/marks")
    marks.create(T.StructType([T.StructField("app_id", T.StringType()), T.StructField("source_version", T.LongType())]))
    return _refused(
        spark,
        [
            ("source is target", guard(source, source)),
            ("lookup is source", guard(source, target, look("x", source))),
            ("lookup is target", guard(source, target, look("x", target))),
            ("one lookup twice", guard(source, target, look("x", a), look("y", a))),
            ("all apart", guard(source, target, look("x", a), look("y", b))),
            ("other lookups than before", lambda: Pipeline(spark, settings(source, target, transform_sql=sql.replace(" x", " y"), lookups=[C.LookupConfig("y", uri=b.uri)]))),
            ("another source without a cut-off", lambda: Pipeline(spark, settings(b, target))),
            ("rebuild without a record", lambda: Pipeline(spark, settings(other_rebuilt, rebuilt, watermark_uri=marks.uri))),
        ],
    )


@query("SELECT n_name FROM nation")
def lookup_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup that another table has taken the place of, used as it is now."""
    now = _nations(spark, sf_dir)
    one = lookup.Lookup("x", now.uri, lookup.Identity.USE_CURRENT, known_id="another")
    pinned = lookup.pin(one, 0)
    assert dict(pinned.extra())["millrace.lookup.x.current"] == "true"
    return pinned.read(spark).select("n_name")


@query(_told(("strict, replaced", "LogError"), ("current, replaced", None), ("no version so old", "LogError"), ("version for earlier rows", None), ("a name of the source", "ConfigError")))
def lookup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = _nations(spark, sf_dir, 1).uri
    return _refused(
        spark,
        [
            ("strict, replaced", lambda: lookup.pin(lookup.Lookup("x", uri, known_id="another"), 1 << 60)),
            ("current, replaced", lambda: lookup.pin(lookup.Lookup("x", uri, lookup.Identity.USE_CURRENT, known_id="another"), 1 << 60)),
            ("no version so old", lambda: lookup.pin(lookup.Lookup("x", uri), 5)),
            ("version for earlier rows", lambda: lookup.pin(lookup.Lookup("x", uri, pre_history_version=1), 5)),
            ("a name of the source", lambda: lookup.Lookup("source", uri)),
        ],
    )


@query("SELECT CAST(count(*) AS BIGINT) AS rows, count(*) > 10 AS warned FROM nation")
def many_rows_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    out = Pipeline(spark, settings(source, target, max_output_rows_per_batch=10)).step()
    return spark.createDataFrame([(out.rows, bool(out.warnings))], "rows long, warned boolean")


@query("SELECT * FROM (VALUES (0, 'event_id'), (1, 'kind')) AS t(place, column_name)")
def produced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's columns that a query gives, in the target's order."""
    target = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "kind", "extra")])
    df = table(spark, sf_dir, "events").selectExpr("event_type AS KIND", "event_id", "ts")
    return spark.createDataFrame(list(enumerate(coerce.columns_present(df, target))), "place int, column_name string")


@query("SELECT CAST(1 AS BIGINT) AS skipped, CAST(5 AS BIGINT) AS recorded, CAST(0 AS BIGINT) AS lag")
def skipped_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit without rows moves the cursor; nothing is recorded for it."""
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    p = Pipeline(spark, settings(source, target))
    p.run_once()
    source.write_commit(6, [{"commitInfo": {}}])
    kind = p.step().kind
    return spark.createDataFrame([(int(kind == "skipped"), target.last_txn("mr.demo"), p.stream.lag())], "skipped long, recorded long, lag long")


# ---- upserts ----


@query("SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_nationkey * 3600000000 AS BIGINT) AS hours, CAST(n_nationkey * 86400000000 AS BIGINT) AS days, CAST(n_nationkey AS BIGINT) AS plain FROM nation")
def lookbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, upsert.parse_lookback(f"{k}h").amount, upsert.parse_lookback(f"{k}d").amount, upsert.parse_lookback(k).amount) for k in range(25)]
    return spark.createDataFrame(rows, "n long, hours long, days long, plain long")


@query("SELECT n_name, r_name, n_name < r_name AND NOT starts_with(r_name, n_name) AS below, n_name[1:3] < n_name AND NOT starts_with(n_name, n_name[1:3]) AS cut FROM nation JOIN region ON r_regionkey = n_regionkey")
def cut_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When one text is surely below another, though it may be the cut bound of a file."""
    found = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name").collect()
    return spark.createDataFrame([(a, b, provably_below(a, b), provably_below(a[:3], a)) for a, b in found], "n_name string, r_name string, below boolean, cut boolean")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey >= 10 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey < 20 THEN n_regionkey END AS n_regionkey, CASE WHEN n_nationkey >= 10 THEN 2 ELSE 1 END AS seq FROM nation")
def upsert_keeps_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows keep the columns that the batch doesn't have; five rows are new, of which they are null."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey", F.lit(1).alias("seq"))
    target = Table(f"{workspace(spark)}/target")
    target.create(df.schema)
    append(target, df.filter("n_nationkey < 20"))
    batch = coerce.strict(df.filter("n_nationkey >= 10").select("n_nationkey", F.lower("n_name").alias("n_name"), F.lit(2).alias("seq")), df.schema)
    upsert.merge(spark, target, batch, upsert.Keys("n_nationkey", "seq"), ["n_nationkey", "n_name", "seq"], None)
    return read_snapshot(spark, target)


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_in_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer batches first: stored rows stay where they are the newer ones."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    target = Table(f"{workspace(spark)}/target")
    target.create(df.schema)
    for k in (2, 0, 1):
        upsert.merge(spark, target, df.filter(F.col("event_id") % 3 == k), upsert.Keys("user_id", "ts", ("event_id",)), df.columns, None)
    return read_snapshot(spark, target).select("user_id", "ts")


@query(_told(("no such column", "ConfigError"), ("time for a number", "ConfigError"), ("number for a number", None), ("append-only", "ConfigError"), ("key repeated", "SchemaError"), ("key repeated, unchecked", None), ("negative lookback", "ConfigError"), ("no lookback", "ConfigError")))
def upsert_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, closed = _nations(spark, sf_dir, 1), Table(f"{workspace(spark)}/closed")
    closed.create(target.snapshot().schema, configuration={"delta.appendOnly": "true"})
    check = lambda t, k, s, look=None, g=True: lambda: upsert.preflight(spark, t, upsert.Keys(k, s, (), upsert.parse_lookback(look) if look else None), g)
    return _refused(
        spark,
        [
            ("no such column", check(target, "n_nationkey", "ts")),
            ("time for a number", check(target, "n_name", "n_nationkey", "2h")),
            ("number for a number", check(target, "n_name", "n_nationkey", "2")),
            ("append-only", check(closed, "n_name", "n_nationkey")),
            ("key repeated", check(target, "n_regionkey", "n_nationkey")),
            ("key repeated, unchecked", check(target, "n_regionkey", "n_nationkey", None, False)),
            ("negative lookback", lambda: upsert.parse_lookback("-1h")),
            ("no lookback", lambda: upsert.parse_lookback("soon")),
        ],
    )


@query("SELECT 4 AS passes, true AS unique, CAST(count(*) AS BIGINT) AS rows FROM (SELECT DISTINCT n_nationkey FROM nation)")
def key_check_in_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 keys in memory for seven at a time; one that is there twice is met in its pass."""
    df = read_snapshot(spark, _nations(spark, sf_dir, 1))
    n = grain.check(df, ["n_nationkey"], memory=64)
    try:
        grain.check(df.union(df.filter("n_nationkey = 17")), ["n_nationkey"], memory=64)
        unique = False
    except MillraceError:
        unique = True
    return spark.createDataFrame([(n, unique, df.count())], "passes int, unique boolean, rows long")


@query(_told(("as declared", None), ("wider number", None), ("text for a number", "SchemaError"), ("time of another unit", None), ("inside a struct", "SchemaError")))
def files_as_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of another writer can be read in a table's declared types."""
    folder = workspace(spark)
    base = table(spark, sf_dir, "nation").coalesce(1)

    def check(name: str, declared: str, *columns: str) -> Callable:
        made = Table(f"{folder}/{name.replace(' ', '-')}")
        df = base.selectExpr(*columns)
        made.create(df.schema)
        append(made, df)
        batch = LogStream(made).next_batch()
        return lambda: coerce.refuse_unreadable(made, batch.files, T._parse_datatype_string(declared))

    return _refused(
        spark,
        [
            ("as declared", check("as declared", "k int, n string", "cast(n_nationkey as int) AS k", "n_name AS n")),
            ("wider number", check("wider number", "k bigint", "cast(n_nationkey as int) AS k")),
            ("text for a number", check("text for a number", "k bigint", "n_name AS k")),
            ("time of another unit", check("time of another unit", "t timestamp_ntz", "timestamp_millis(n_nationkey) AS t")),
            ("inside a struct", check("inside a struct", "s struct<a: bigint>", "struct(n_name AS a) AS s")),
        ],
    )


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS keys, count(DISTINCT user_id) = count(*) AS one_each FROM events")
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id")
    try:
        grain.check(df, ["user_id"])
        one = True
    except MillraceError:
        one = False
    return df.agg(F.count_distinct("user_id").alias("keys"), F.lit(one).alias("one_each"))


# ---- publication ----


class _Kept:
    """A sender that keeps what it gets, and is down at some calls."""

    def __init__(self, down: tuple[int, ...] = ()):
        self.sent: list[dict] = []
        self.down, self.calls = down, 0

    def publish(self, group: str, body: bytes) -> None:
        self.calls += 1
        if self.calls in self.down:
            raise publish.PublishError("down")
        self.sent.append(json.loads(body))

    def describe(self) -> str:
        return "kept"


@query("SELECT CAST(v AS BIGINT) AS version, CAST(CASE WHEN v > 1 THEN v - 1 END AS BIGINT) AS before, CAST(v AS BIGINT) AS target_version, CAST(5 AS BIGINT) AS rows FROM range(1, 6) t(v) WHERE v <> 2")
def publish_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message a batch; the second isn't sent, and the third says which version came before it all the same."""
    source, sender = _nations(spark, sf_dir), _Kept((2,))
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    Pipeline(spark, settings(source, target, max_files_per_batch=1), publisher=publish.Publisher(sender, "demo", "mr.demo", "live", "live", "SELECT n_name FROM source")).run_once()
    return spark.createDataFrame([(m["source_version"], m["prev_source_version"], m["target_version"], len(m["rows"])) for m in sender.sent], "version long, before long, target_version long, rows long")


@query("SELECT CAST(k AS INT) AS step, k >= 2 AND k < 5 AS open FROM range(0, 7) t(k)")
def publish_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two failures open it for three ticks."""
    now = [0.0]
    made, rows = publish.Breaker(2, 3, lambda: now[0]), []
    for k in range(7):
        now[0] = float(k)
        rows.append((k, made.open()))
        if k in (0, 1):
            now[0] = 2.0 if k else 0.0
            made.failed()
    return spark.createDataFrame(rows, "step int, open boolean")


@query("SELECT false AS complete, CAST(0 AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS row_count FROM customer")
def publish_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the size of a message there are no rows, but still their number."""
    made = publish.render(table(spark, sf_dir, "customer"), 100)
    return spark.createDataFrame([(made.complete, len(made.rows), made.count)], "complete boolean, rows long, row_count long")


@query("SELECT r_regionkey AS hub, 'https://h.example/api/hubs/hub' || r_regionkey || '/groups/g/:send?api-version=2024-12-01' || CASE WHEN r_regionkey > 0 THEN '&messageTtlSeconds=' || r_regionkey ELSE '' END AS url FROM region")
def publish_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = publish.WebPubSub.from_connection_string
    return spark.createDataFrame([(k, make("Endpoint=h.example/;AccessKey=abc;Version=1.0;", f"hub{k}", k).url("g")) for k in range(5)], "hub int, url string")


# ---- settings and manifests ----


def _pipeline(**more) -> C.PipelineConfig:
    return C.PipelineConfig(**({"name": "p", "app_id": "mr.p", "source_uri": "/s", "target_uri": "/t"} | more))


_SETTINGS: list[tuple[str, bool, dict]] = [
    ("plain", True, {}),
    ("no app_id", False, {"app_id": ""}),
    ("source is target", False, {"target_uri": "/s"}),
    ("lookup without a query", False, {"lookups": [C.LookupConfig("x", uri="/x")]}),
    ("lookup with a query", True, {"lookups": [C.LookupConfig("x", uri="/x")], "transform_sql": "SELECT s.a FROM source s LEFT JOIN x ON x.k = s.k"}),
    ("upsert", True, {"write_mode": "upsert", "upsert_key": "k", "dedup_timestamp": "ts"}),
    ("upsert without a key", False, {"write_mode": "upsert", "dedup_timestamp": "ts"}),
    ("upsert without a timestamp", False, {"write_mode": "upsert", "upsert_key": "k"}),
    ("key of an append", False, {"upsert_key": "k"}),
    ("unknown mode", False, {"write_mode": "replace"}),
    ("aggregate", False, {"transform_sql": "SELECT count(*) AS n FROM source"}),
    ("bad size", False, {"max_bytes_per_batch": "much"}),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, ok, _ in _SETTINGS) + ") AS t(name, accepted)")
def settings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a single pipeline's settings may be."""
    rows = [(name, not C.resolve(C.Config([_pipeline(**more)]), spark).rejected) for name, _, more in _SETTINGS]
    return spark.createDataFrame(rows, "name string, accepted boolean")


@query("SELECT name, state FROM (VALUES ('a', 'rejected'), ('b', 'rejected'), ('c', 'runs')) AS t(name, state)")
def settings_in_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines share an app_id; the third runs all the same."""
    made = C.resolve(C.Config([_pipeline(name=n, app_id=a, target_uri=f"/{n}") for n, a in (("a", "mr.x"), ("b", "mr.x"), ("c", "mr.c"))]), spark)
    return spark.createDataFrame([(r.name, "runs") for r in made.pipelines] + [(n, "rejected") for n in made.rejected], "name string, state string")


@query("SELECT * FROM (VALUES ('lines', 'mr.lines.ingest', 'append'), ('lines', 'mr.lines.apply', 'upsert')) AS t(name, app_id, mode)")
def staged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.expand_staged([_pipeline(name="lines", app_id="mr.lines", write_mode="staged_upsert", upsert_key="k", dedup_timestamp="ts")])
    return spark.createDataFrame([(p.name.split("__")[0], p.app_id, p.write_mode) for p in made], "name string, app_id string, mode string")


@query("SELECT * FROM (VALUES ('lines', '/lake/silver/lines'), ('priced', '/lake/silver/priced')) AS t(pipeline, target)")
def dbt_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipelines of the models that can be streamed, and where they write."""
    made = dbt.convert(dbt.parse(json.dumps(MANIFEST)), C.StorageConfig(uri_template="/lake/{schema}/{name}"), spark)
    return spark.createDataFrame([(p.name, p.target_uri) for p in made], "pipeline string, target string")

# ---- running ----


class _Doubled:
    """A change of a batch in code instead of SQL."""

    def apply(self, batch: DataFrame, lookups=None) -> DataFrame:
        return batch.withColumn("n_nationkey", F.col("n_nationkey") * 2)

    def describe(self) -> str:
        return "doubled keys"


@query("SELECT CAST(2 * n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation")
def transform_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    Pipeline(spark, settings(source, target), transform=_Doubled()).run_once()
    return read_snapshot(spark, target)


class _Raced(Table):
    """A table into which someone else commits right before this writer's first commit."""

    rival: Callable | None = None

    def write_commit(self, version: int, actions) -> None:
        rival, self.rival = self.rival, None
        if rival:
            rival()
        super().write_commit(version, actions)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 10 THEN 'rival' WHEN n_nationkey < 20 THEN 'batch' ELSE 'old' END AS n_name, 2 AS attempts FROM nation")
def merge_planned_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between plan and commit another writer changes the first ten rows; the merge is planned again on them."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.lit("old").alias("n_name"), F.lit(1).alias("seq"))
    target = _Raced(f"{workspace(spark)}/target")
    target.create(df.schema)
    append(target, df)
    keys = upsert.Keys("n_nationkey", "seq")
    newer = lambda name, seq: df.withColumn("n_name", F.lit(name)).withColumn("seq", F.lit(seq))
    target.rival = lambda: upsert.merge(spark, Table(target.uri), newer("rival", 3).filter("n_nationkey < 10"), keys, df.columns, None)
    made = upsert.merge(spark, target, newer("batch", 2).filter("n_nationkey < 20"), keys, df.columns, None)
    return read_snapshot(spark, Table(target.uri)).select("n_nationkey", "n_name", F.lit(made.attempts).alias("attempts"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation")
def upsert_never_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the batch doesn't have stay."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    target = Table(f"{workspace(spark)}/target")
    target.create(df.withColumn("seq", F.lit(1)).schema)
    append(target, df.withColumn("seq", F.lit(1)))
    upsert.merge(spark, target, df.filter("n_nationkey % 2 = 0").select("n_nationkey", F.upper("n_name").alias("n_name"), F.lit(2).alias("seq")), upsert.Keys("n_nationkey", "seq"), ["n_nationkey", "n_name", "seq"], None)
    return read_snapshot(spark, target).select("n_nationkey", "n_name")


@query("SELECT 2 AS most_inside, 6 AS entered")
def merge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six merges, of which two run at a time."""
    made, lock, seen = Gate(2), threading.Lock(), []

    def one(_: int) -> None:
        with made.entered():
            with lock:
                seen.append(made.inside)
            time.sleep(0.02)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(one, range(6)))
    return spark.createDataFrame([(max(seen), len(seen))], "most_inside int, entered int")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def table_on_hadoop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log and its files reached by Spark's file systems alone."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    folder = workspace(spark)
    made = Table(folder)
    made.store = HadoopStore(folder if ":" in folder else f"file:{folder}")
    made.create(df.schema, ["o_orderpriority"])
    append(made, df, Offset("mr.h", 7))
    assert made.last_txn("mr.h") == 7
    return read_snapshot(spark, made)


@query(
    "SELECT * FROM (VALUES ('follows an upsert', 'rejected'), ('follows, ignoring changes', 'runs'), ('up', 'runs'), ('staged__apply', 'runs'), ('staged__ingest', 'runs'), ('reads a stage', 'rejected')) AS t(name, state)"
)
def settings_between_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may read an upserted table, or a stage."""
    upserts = {"write_mode": "upsert", "upsert_key": "k", "dedup_timestamp": "ts"}
    made = C.resolve(
        C.Config(
            [
                _pipeline(name="up", app_id="1", target_uri="/up", **upserts),
                _pipeline(name="follows an upsert", app_id="2", source_uri="/up", target_uri="/a"),
                _pipeline(name="follows, ignoring changes", app_id="3", source_uri="/up", target_uri="/b", change_policy="ignore_changes", **upserts),
                _pipeline(name="staged", app_id="4", target_uri="/st", **(upserts | {"write_mode": "staged_upsert"})),
                _pipeline(name="reads a stage", app_id="5", source_uri=C.stage_uri("/st"), target_uri="/c"),
            ]
        ),
        spark,
    )
    return spark.createDataFrame([(r.name, "runs") for r in made.pipelines] + [(n, "rejected") for n in made.rejected], "name string, state string")


_PUBLISHED: list[tuple[str, bool, dict]] = [
    ("plain", True, {"publish": C.PublishModel("m", "plain")}),
    ("aggregate", True, {"publish": C.PublishModel("m", "agg", "SELECT count(*) AS n FROM source")}),
    ("window", False, {"publish": C.PublishModel("m", "win", "SELECT row_number() OVER (ORDER BY a) AS n FROM source")}),
    ("bad group", False, {"publish": C.PublishModel("m", "a/b")}),
    ("other kind", False, {"publish": C.PublishModel("m", "kind", kind="fax")}),
    ("upsert", False, {"publish": C.PublishModel("m", "ups"), "write_mode": "upsert", "upsert_key": "k", "dedup_timestamp": "ts"}),
    ("shared one", False, {"publish": C.PublishModel("m", "same")}),
    ("shared two", False, {"publish": C.PublishModel("m", "same")}),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true, {str(ok).lower()})" for n, ok, _ in _PUBLISHED) + ") AS t(name, runs, publishes)")
def settings_of_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication that can't be never stops its pipeline."""
    made = C.resolve(C.Config([_pipeline(name=n, app_id=n, target_uri=f"/{n}", **more) for n, _, more in _PUBLISHED], publish=C.PublishConfig(connection_string="Endpoint=http://h;AccessKey=k;")), spark)
    runs = {r.name: r.publish is not None for r in made.pipelines}
    return spark.createDataFrame([(n, n in runs, runs.get(n, False)) for n, *_ in _PUBLISHED], "name string, runs boolean, publishes boolean")


@query("SELECT * FROM (VALUES ('default target', 'dev'), ('named target', 'prod'), ('no such target', 'ConfigError'), ('no such profile', 'ConfigError'), ('several profiles', 'ConfigError')) AS t(name, chosen)")
def dbt_profile_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = {"p": {"target": "dev", "outputs": {"dev": {"host": "dev"}, "prod": {"host": "prod"}}}}
    rows = []
    for name, asked in (("default target", (one,)), ("named target", (one, None, "prod")), ("no such target", (one, None, "none")), ("no such profile", (one, "q")), ("several profiles", (one | {"q": {}},))):
        try:
            rows.append((name, catalog.output(*asked)["host"]))
        except MillraceError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, chosen string")


@query("SELECT * FROM (VALUES (0, '/first/s'), (1, '/second/s'), (2, '/second/s')) AS t(poll, source)")
def relocated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that moves, and a catalog that is silent at the third poll."""
    answers = iter(("/first/s", "/second/s", None))

    def find(relation: str) -> str:
        place = next(answers)
        if place is None:
            raise LogError("silent")
        return place

    located = catalog.Located(find)
    own = C.Resolved("p", "mr.p", "/s", "/t", source_relation="lake.bronze.s")
    return spark.createDataFrame([(k, located(own).source_uri) for k in range(3)], "poll int, source string")


@query("SELECT CAST(k AS INT) AS failures, true AS near FROM range(1, 13) t(k)")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling from a second to five minutes, 25 % more or less, and the same again for one pipeline."""
    from ..streaming.supervisor import backoff

    rows = []
    for k in range(1, 13):
        base, wait = min(300.0, 2.0 ** (k - 1)), backoff(k, "p")
        rows.append((k, 0.75 * base <= wait <= 1.25 * base and wait == backoff(k, "p")))
    return spark.createDataFrame(rows, "failures int, near boolean")


@query("SELECT 'rows_written_total' AS series, CAST(count(*) AS BIGINT) AS value FROM nation UNION ALL SELECT 'batches_committed_total', 3 UNION ALL SELECT 'last_source_version', 5 UNION ALL SELECT 'source_lag_versions', 0")
def metrics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run of three batches, as the page shows them."""
    source = _nations(spark, sf_dir)
    target = Table(f"{workspace(spark)}/target")
    target.create_like(source)
    own = metrics.Metrics("demo")
    Pipeline(spark, settings(source, target, max_files_per_batch=2), metrics=own).run_once()
    shown = dict(line.split('{pipeline="demo"} ') for line in metrics.text([own]).splitlines() if '{pipeline="demo"} ' in line)
    wanted = ("rows_written_total", "batches_committed_total", "last_source_version", "source_lag_versions")
    return spark.createDataFrame([(n, int(shown[f"millrace_{n}"])) for n in wanted], "series string, value long")


@query("SELECT * FROM (VALUES ('validate', 0), ('once', 0), ('status', 0), ('validate a bad file', 1), ('once a bad file', 1)) AS t(command, code)")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of commands over a file with one pipeline, and over one whose pipeline can't run."""
    from ..streaming import cli

    source = _nations(spark, sf_dir)
    folder = tempfile.mkdtemp(prefix="millrace-")  # the command line reads its settings on the driver
    try:
        target = Table(f"{workspace(spark)}/target")
        target.create_like(source)
        for name, app in (("good", "mr.p"), ("bad", "")):
            with open(f"{folder}/{name}.toml", "w") as f:
                f.write(f'[[pipeline]]\nname = "p"\napp_id = "{app}"\nsource_uri = "{source.uri}"\ntarget_uri = "{target.uri}"\n')
        rows = [(command, cli.main([*command.split()[:1], "-c", f"{folder}/{'bad' if 'bad' in command else 'good'}.toml"], spark, io.StringIO())) for command in ("validate", "once", "status", "validate a bad file", "once a bad file")]
    finally:
        shutil.rmtree(folder, True)
    return spark.createDataFrame(rows, "command string, code int")


@query("SELECT n_name AS relation, '/lake/' || n_nationkey AS place FROM nation")
def catalog_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked of a server on this machine that speaks the catalog's protocol, two pages an answer."""
    places = {r.n_name: f"/lake/{r.n_nationkey}" for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()}

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, value: dict) -> None:
            body = json.dumps(value).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            said = self.rfile.read(int(self.headers["Content-Length"])).decode()
            name = said.removeprefix('SHOW CREATE TABLE "').rstrip('"')
            self.answer({"nextUri": f"http://127.0.0.1:{self.server.server_port}/{urllib.parse.quote(name)}"})

        def do_GET(self) -> None:
            name = urllib.parse.unquote(self.path[1:])
            self.answer({"data": [[f"CREATE TABLE x (\n a bigint\n)\nWITH (\n location = '{places[name]}'\n)"]]})

        def log_message(self, *_) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        there = catalog.Connection(f"http://127.0.0.1:{server.server_port}", "u")
        return spark.createDataFrame([(n, catalog.location(there, n)) for n in places], "relation string, place string")
    finally:
        server.shutdown()
        server.server_close()


# ---- built-in functions ----

_over(
    "orders",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, date_add(o_orderdate, 40) AS later, datediff(o_orderdate, DATE'1992-01-01') AS days, date_trunc('MONTH', o_orderdate) AS month_start, last_day(o_orderdate) AS month_end, dayofweek(o_orderdate) AS weekday, add_months(o_orderdate, 3) AS spring FROM source",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS later, CAST(date_diff('day', DATE '1992-01-01', o_orderdate) AS INT) AS days, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, last_day(o_orderdate) AS month_end, CAST(dayofweek(o_orderdate) + 1 AS INT) AS weekday, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS spring FROM orders",
    "date_functions", prepare=lambda df: df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")),
)
_over(
    "embeddings",
    "SELECT vec_id, slice(embedding, 2, 3) AS part, element_at(embedding, -1) AS last, size(filter(embedding, x -> x > 0)) AS positive, array_contains(embedding, embedding[5]) AS has, array_position(embedding, embedding[7]) <= 8 AS place, size(array_distinct(embedding)) AS different, sort_array(slice(embedding, 1, 4)) AS sorted FROM source",
    "SELECT vec_id, embedding[2:4] AS part, embedding[len(embedding)] AS last, CAST(len([x for x in embedding if x > 0]) AS INT) AS positive, true AS has, true AS place, CAST(len(list_distinct(embedding)) AS INT) AS different, list_sort(embedding[1:4]) AS sorted FROM embeddings",
    "array_builtins",
)
_over(
    "supplier",
    "SELECT s_suppkey, map('a', s_nationkey, 'b', s_suppkey)['b'] AS b, size(map_keys(map('a', 1, 'b', 2))) AS n, named_struct('x', s_name, 'y', s_acctbal).y AS y, map_contains_key(map('k', s_name), 'k') AS has, struct(s_name AS name).name AS name FROM source",
    "SELECT s_suppkey, s_suppkey AS b, 2 AS n, s_acctbal AS y, true AS has, s_name AS name FROM supplier", "map_struct_builtins",
)
_over(
    "customer",
    "SELECT c_custkey, upper(trim(c_name)) AS up, length(c_name) AS n, replace(c_mktsegment, 'A', 'a') AS rep, lpad(CAST(c_custkey AS STRING), 8, '0') AS pad, split_part(c_name, '#', 2) AS part, regexp_replace(c_name, '[0-9]+', '#') AS masked, c_acctbal % 10 AS rest, floor(c_acctbal) AS low, ceil(c_acctbal) AS high, sign(c_acctbal) AS side, round(sqrt(abs(c_acctbal)), 6) AS root, round(power(c_nationkey, 2), 3) AS square FROM source",
    "SELECT c_custkey, upper(trim(c_name)) AS up, CAST(length(c_name) AS INT) AS n, replace(c_mktsegment, 'A', 'a') AS rep, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pad, split_part(c_name, '#', 2) AS part, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked, c_acctbal % 10 AS rest, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high, CAST(sign(c_acctbal) AS DOUBLE) AS side, round(sqrt(abs(c_acctbal)), 6) AS root, round(power(c_nationkey, 2), 3) AS square FROM customer",
    "string_math_builtins",
)
