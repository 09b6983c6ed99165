"""Coercion, dead letters, cut-offs, lookups, upserts and uniqueness."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CommitConflict, ConfigError, LogError, SchemaError
from millrace.operators import coerce, dead_letter, dedup, grain, lookup, rank, upsert
from millrace.sources.log import Remove, Table
from millrace.sources.scan import read_snapshot
from millrace.sources.sink import Offset, append, commit, write_files
from millrace.sources.stats import provably_below, touches_any
from millrace.streaming import config as C
from millrace.streaming.pipeline import Pipeline

T0 = dt.datetime(2024, 1, 1)
ORDER = T.StructType([T.StructField("order_id", T.LongType(), False), T.StructField("amount", T.LongType()), T.StructField("_timestamp", T.TimestampNTZType(), False)])


def table(tmp_path, name, schema, partitions=()):
    made = Table(str(tmp_path / name))
    made.create(schema, partitions)
    return made


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- coercion ----


def test_strict(spark):
    df = spark.createDataFrame([("1", "x")], "n string, more string")
    target = T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("absent", T.DateType())])
    assert tuples(coerce.strict(df, target)) == [(1, None)]
    for bad in ("n/a", None):
        with pytest.raises(Exception):
            coerce.strict(spark.createDataFrame([(bad,)], "n string"), target).collect()
    with pytest.raises(SchemaError):
        coerce.strict(df, T.StructType([T.StructField("must", T.LongType(), False)]))


def test_quarantine_names_the_first_fault(spark):
    df = spark.createDataFrame([(1, "5", "2024-01-01"), (2, "n/a", "nope"), (None, "7", None), (4, None, "bad")], "order_id long, amount string, day string")
    target = T.StructType([T.StructField("order_id", T.LongType(), False), T.StructField("amount", T.LongType()), T.StructField("day", T.DateType())])
    parted = coerce.quarantining(df, target)
    assert tuples(parted.good()) == [(1, 5, dt.date(2024, 1, 1))]
    assert sorted((str(r.order_id), r[coerce.AT]) for r in parted.rejects().collect()) == [("2", "amount"), ("4", "day"), ("None", "order_id")]


def test_nested_values_stay_strict(spark):
    df = spark.createDataFrame([(["1", "oops"],)], "a array<string>")
    with pytest.raises(Exception):
        coerce.quarantining(df, T.StructType([T.StructField("a", T.ArrayType(T.LongType()))])).good().collect()


def test_pipeline_sets_bad_rows_aside_once(spark, tmp_path):
    raw = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("amount", T.StringType()), T.StructField("_timestamp", T.TimestampNTZType(), False)])
    source, target = table(tmp_path, "s", raw), table(tmp_path, "t", ORDER)
    letters = table(tmp_path, "t__mr_dq", dead_letter.SCHEMA)
    append(source, spark.createDataFrame([(1, "10", T0), (2, "n/a", T0), (3, None, T0)], raw))
    own = C.Resolved("p", "mr.p", source.uri, target.uri)
    (out, _) = Pipeline(spark, own).run_once()
    assert (out.rows, out.rejected) == (2, 1)
    (r,) = read_snapshot(spark, letters).collect()
    assert (r.app_id, r.source_version, r.column_name) == ("mr.p", 1, "amount") and r.payload.startswith('{"order_id":2,"amount":"n/a"')
    assert dead_letter.write(letters, coerce.quarantining(read_snapshot(spark, source), ORDER).rejects(), "mr.p", "p", 1) == 0
    assert read_snapshot(spark, target).count() == 2


# ---- cut-offs and rebuilds ----


def orders(spark, first, n):
    return spark.createDataFrame([(i, i * 100, T0 + dt.timedelta(minutes=i)) for i in range(first, first + n)], ORDER)


def rebuild(table_, df):
    base = table_.snapshot()
    made = write_files(table_, base, df)
    return commit(table_, base, None, made.adds, [Remove(p) for p in base.files])


def unique(spark, table_, n):
    got = [r.order_id for r in read_snapshot(spark, table_).collect()]
    assert sorted(got) == list(range(n))


def streams(spark, tmp_path, **more):
    source, target = table(tmp_path, "s", ORDER), table(tmp_path, "t", ORDER)
    for k in range(4):
        append(source, orders(spark, 10 * k, 10))
    return source, target, C.Resolved("p", "mr.p", source.uri, target.uri, max_files_per_batch=64, **more)


def test_rebuild_then_resume_without_gap_or_repeat(spark, tmp_path):
    source, target, own = streams(spark, tmp_path, dedup_timestamp="_timestamp", dedup_key="order_id")
    Pipeline(spark, own).run_once()
    rebuild(target, orders(spark, 0, 25))  # the rebuild saw less than was streamed
    append(source, orders(spark, 40, 5))
    Pipeline(spark, own).run_once()
    unique(spark, target, 45)


def test_first_run_on_a_filled_target(spark, tmp_path):
    source, target, own = streams(spark, tmp_path, dedup_timestamp="_timestamp", dedup_key="order_id")
    rebuild(target, orders(spark, 0, 3))
    rebuild(target, orders(spark, 0, 17))
    Pipeline(spark, own).run_once()
    unique(spark, target, 40)


def test_rebuild_by_watermark_table(spark, tmp_path):
    marks = table(tmp_path, "w", T.StructType([T.StructField("app_id", T.StringType(), False), T.StructField("source_version", T.LongType(), False)]))
    source, target, own = streams(spark, tmp_path, watermark_uri=marks.uri)
    Pipeline(spark, own).run_once()
    rebuild(target, orders(spark, 0, 30))
    with pytest.raises(LogError):
        Pipeline(spark, own)
    append(marks, spark.createDataFrame([("mr.p", 2), ("mr.p", 3), ("other", 9)], marks.snapshot().schema))
    Pipeline(spark, own).run_once()
    unique(spark, target, 40)


def test_replaced_source(spark, tmp_path):
    source, target, own = streams(spark, tmp_path)
    Pipeline(spark, own).run_once()
    os.rename(source.uri, source.uri + "-old")
    other = table(tmp_path, "s", ORDER)
    append(other, orders(spark, 0, 50))
    with pytest.raises(LogError):
        Pipeline(spark, own)
    import dataclasses

    Pipeline(spark, dataclasses.replace(own, dedup_timestamp="_timestamp", dedup_key="order_id")).run_once()
    unique(spark, target, 50)


def test_cut_off_rules(spark):
    have = spark.createDataFrame([(1, T0), (2, T0), (None, T0)], "k long, ts timestamp_ntz")
    later = T0 + dt.timedelta(seconds=1)
    batch = spark.createDataFrame([(1, T0), (3, T0), (None, T0), (4, later), (5, T0 - dt.timedelta(1))], "k long, ts timestamp_ntz")
    assert tuples(dedup.cut_off(have, "ts", "k").apply(batch).select("k")) == [(3,), (4,), (None,)]
    assert tuples(dedup.cut_off(have, "ts", None).apply(batch).select("k")) == [(4,)]
    assert dedup.cut_off(have.limit(0), "ts", "k").apply(batch).count() == 5
    with pytest.raises(Exception, match="null"):
        dedup.cut_off(have, "ts", "k").apply(batch.select("k", F.lit(None).cast("timestamp_ntz").alias("ts"))).collect()


def test_quantile_is_exact(spark, monkeypatch):
    r = random.Random(4)
    cases = [[], [None], [7], [5, 5, None], [-3, 7, 9, 1, None], [-(2**60), 0, 2**60], [r.randint(-50, 50) for _ in range(301)], [r.randint(0, 10**14) for _ in range(500)]]
    for parts in (2, 3, rank.PARTS):
        monkeypatch.setattr(rank, "PARTS", parts)
        for values in cases if parts > 3 else cases[3:7]:
            df = spark.createDataFrame([(v,) for v in values], "v long")
            kept = sorted(v for v in values if v is not None)
            for share in (0.5, 0.0, 1.0) if parts == 3 else (0.5,):
                want = next((v for k, v in enumerate(kept, 1) if k >= len(kept) * share), None)
                assert rank.quantile(df, F.col("v"), share) == want


def test_middle_event_is_not_searched_in_one_task(spark, sf):
    from millrace.plans import catalogue

    plan = catalogue.dedup_after_rebuild(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "percentile"))  # all timestamps in one task, and again in each task of the product


def test_rescan_start(spark, tmp_path):
    source, _, _ = streams(spark, tmp_path)
    mark = lambda i: T0 + dt.timedelta(minutes=i)
    assert dedup.rescan_start(source, "_timestamp", mark(19), 0) == 3
    assert dedup.rescan_start(source, "_timestamp", mark(15), 0) == 2
    assert dedup.rescan_start(source, "_timestamp", mark(-5), 0) == 0
    assert dedup.rescan_start(source, "_timestamp", mark(100), 0) == 5
    assert dedup.rescan_start(source, "_timestamp", None, 1) == 1
    assert dedup.rescan_start(source, "_timestamp", mark(15), 0, max_commits=1) == 0


# ---- lookups ----


def lookup_tables(spark, tmp_path):
    rates = T.StructType([T.StructField("currency", T.StringType()), T.StructField("rate", T.DoubleType())])
    raw = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("currency", T.StringType())])
    out = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("rate", T.DoubleType())])
    source, fx, target = table(tmp_path, "s", raw), table(tmp_path, "fx", rates), table(tmp_path, "t", out)
    for k in (1, 2):
        rebuild(fx, spark.createDataFrame([("EUR", float(k))], rates))
    for v, at in ((0, 10), (1, 20), (2, 40)):
        os.utime(fx.store.path(f"_delta_log/{v:020d}.json"), (at, at))
    for n in range(2):
        append(source, spark.createDataFrame([(n, "EUR")], raw))
    for v, at in ((0, 5), (1, 30), (2, 50)):
        os.utime(source.store.path(f"_delta_log/{v:020d}.json"), (at, at))
    own = C.Resolved("p", "mr.p", source.uri, target.uri, [C.LookupConfig("fx", fx.uri)], transform_sql="SELECT s.order_id, fx.rate FROM source s LEFT JOIN fx ON fx.currency = s.currency")
    return source, fx, target, own


def test_each_commit_sees_the_lookup_of_its_time(spark, tmp_path):
    source, fx, target, own = lookup_tables(spark, tmp_path)
    Pipeline(spark, own).run_once()
    assert tuples(read_snapshot(spark, target)) == [(0, 1.0), (1, 2.0)]
    info = target.commit(target.head()).info
    assert info["millrace.lookup.fx.version"] == "2" and info["millrace.lookup.fx.tableId"] == fx.snapshot().metadata.id


def test_strictly_before_and_pre_history(spark, tmp_path):
    _, fx, _, _ = lookup_tables(spark, tmp_path)
    assert lookup.version_before(fx, 40_000)[0] == 1 and lookup.version_before(fx, 40_001)[0] == 2
    with pytest.raises(LogError):
        lookup.version_before(fx, 10_000)
    assert lookup.version_before(fx, 10_000, 0) == (0, True)


def test_replaced_lookup(spark, tmp_path):
    _, fx, _, _ = lookup_tables(spark, tmp_path)
    strict = lookup.Lookup("fx", fx.uri, known_id="another")
    with pytest.raises(LogError):
        lookup.pin(strict, 60_000)
    made = lookup.pin(lookup.Lookup("fx", fx.uri, lookup.Identity.USE_CURRENT, known_id="another"), 15_000)
    assert made.current and made.snapshot.version == 2 and ("millrace.lookup.fx.current", "true") in made.extra()


def test_roles_and_changed_sets(spark, tmp_path):
    import dataclasses

    source, fx, target, own = lookup_tables(spark, tmp_path)
    with pytest.raises(ConfigError):
        Pipeline(spark, dataclasses.replace(own, lookups=[C.LookupConfig("fx", source.uri)]))
    Pipeline(spark, own).run_once()
    with pytest.raises(ConfigError):
        Pipeline(spark, dataclasses.replace(own, lookups=[C.LookupConfig("rates", fx.uri)], transform_sql="SELECT s.order_id, rates.rate FROM source s LEFT JOIN rates ON rates.currency = s.currency"))


# ---- upserts ----

STATE = T.StructType([T.StructField("k", T.LongType()), T.StructField("status", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("region", T.StringType())])
KEYS = upsert.Keys("k", "ts")


def states(spark, rows):
    return spark.createDataFrame([(k, s, t, None) for k, s, t in rows], STATE)


def test_update_insert_and_untouched_files(spark, tmp_path):
    t = table(tmp_path, "t", STATE)
    append(t, spark.createDataFrame([(1, "a", 1, "eu"), (2, "a", 1, "us")], STATE).coalesce(1))
    append(t, spark.createDataFrame([(50, "a", 1, "eu")], STATE).coalesce(1))
    far = [p for p, a in t.snapshot().files.items() if '"k": 50' in a.stats]
    made = upsert.merge(spark, t, states(spark, [(1, "b", 2), (1, "c", 3), (2, "old", 0), (3, "new", 1)]), KEYS, ["k", "status", "ts"], Offset("mr.u", 7))
    assert (made.updated, made.inserted, made.files_scanned) == (1, 1, 1)
    assert tuples(read_snapshot(spark, t)) == [(1, "c", 3, "eu"), (2, "a", 1, "us"), (3, "new", 1, None), (50, "a", 1, "eu")]
    assert far[0] in t.snapshot().files and t.last_txn("mr.u") == 7
    head = upsert.merge(spark, t, states(spark, [(1, "c", 3)]), KEYS, ["k", "status", "ts"], Offset("mr.u", 8))
    assert head.updated == head.inserted == 0 and t.last_txn("mr.u") == 8 and not t.commit(head.version).adds


def test_stored_null_sequence_is_left_alone(spark, tmp_path):
    t = table(tmp_path, "t", STATE)
    append(t, spark.createDataFrame([(1, "kept", None, None)], STATE))
    made = upsert.merge(spark, t, states(spark, [(1, "x", 5)]), KEYS, STATE.names, None)
    assert made.updated == made.inserted == 0


def test_nulls_in_a_batch_fail(spark, tmp_path):
    t = table(tmp_path, "t", STATE)
    for row in ((None, "x", 1), (1, "x", None)):
        with pytest.raises(Exception, match="is null"):
            upsert.merge(spark, t, states(spark, [row]), KEYS, STATE.names, None)
    assert t.head() == 0


def test_lookback_clamps(spark, tmp_path):
    t = table(tmp_path, "t", STATE)
    append(t, states(spark, [(1, "ancient", 0)]))
    keys = upsert.Keys("k", "ts", (), upsert.parse_lookback(10))
    made = upsert.merge(spark, t, states(spark, [(1, "now", 100)]), keys, STATE.names, None)
    assert made.clamped and made.inserted == 1 and made.files_scanned == 0
    assert tuples(read_snapshot(spark, t).select("k", "ts")) == [(1, 0), (1, 100)]
    with pytest.raises(SchemaError, match="several rows"):
        upsert.preflight(spark, t, KEYS)


def test_random_merges_keep_the_newest_row(spark, tmp_path):
    r = random.Random(3)
    t = table(tmp_path, "t", STATE)
    model = {}
    for step in range(5):
        batch = [(r.randint(0, 40), f"{step}-{i}", r.randint(0, 30)) for i in range(r.randint(0, 25))]
        upsert.merge(spark, t, states(spark, batch).coalesce(1), KEYS, STATE.names, Offset("mr.u", step))
        best = {}
        for k, s, ts in batch:  # the later row wins a tie within the batch
            if k not in best or ts >= best[k][1]:
                best[k] = (s, ts)
        for k, (s, ts) in best.items():
            if k not in model or ts > model[k][1]:
                model[k] = (s, ts)
        assert {x.k: (x.status, x.ts) for x in read_snapshot(spark, t).collect()} == model


def test_conflict_is_planned_again(spark, tmp_path, monkeypatch):
    t = table(tmp_path, "t", STATE)
    append(t, states(spark, [(1, "a", 1)]))
    real, calls = upsert._merge_once, []

    def once(*args):
        if not calls:
            calls.append(1)
            raise CommitConflict(t.uri, 2)
        return real(*args)

    monkeypatch.setattr(upsert, "_merge_once", once)
    made = upsert.merge(spark, t, states(spark, [(1, "b", 2)]), KEYS, STATE.names, None)
    assert made.attempts == 2 and made.updated == 1


def test_staged_equals_direct(spark, tmp_path):
    source = table(tmp_path, "s", STATE)
    r = random.Random(9)
    for step in range(3):
        append(source, states(spark, [(r.randint(0, 9), f"{step}", 100 * step + i) for i in range(15)]))
    finals = []
    for mode in ("upsert", "staged_upsert"):
        target = table(tmp_path, mode, STATE)
        p = C.PipelineConfig("u", f"mr.{mode}", source.uri, target.uri, write_mode=mode, upsert_key="k", dedup_timestamp="ts")
        found = C.resolve(C.Config([p]), spark)
        assert not found.rejected and len(found.pipelines) == 1 + (mode != "upsert")
        for one in found.pipelines:
            Pipeline(spark, one).run_once()
        finals.append(tuples(read_snapshot(spark, target)))
    assert finals[0] == finals[1] and len(finals[0]) == 10


def test_stage_commits_may_be_larger_than_a_batch(spark, tmp_path):
    """An ingested batch can become more bytes than it was read from; its commit is applied alone."""
    source, target = table(tmp_path, "s", STATE), table(tmp_path, "t", STATE)
    p = C.PipelineConfig("u", "mr.large", source.uri, target.uri, write_mode="staged_upsert", upsert_key="k", dedup_timestamp="ts", apply_max_bytes="1KB")
    first, second = C.resolve(C.Config([p]), spark).pipelines
    for step in range(2):
        append(source, states(spark, [(k, f"{step}", 10 * step) for k in range(5)]))
        assert [o.kind for o in Pipeline(spark, first).run_once()] == ["progressed", "caught_up"]
    assert all(sum(a.size for a in Table(first.target_uri).commit(v).adds) > 1000 for v in (1, 2))
    assert [o.kind for o in Pipeline(spark, second).run_once()] == ["progressed"] * 2 + ["caught_up"]
    assert tuples(read_snapshot(spark, target)) == tuples(states(spark, [(k, "1", 10) for k in range(5)]))
    with pytest.raises(ConfigError):
        C.parse("[[pipeline]]\nname = 'n'\napp_id = 'a'\nsource_uri = '/s'\ntarget_uri = '/t'\nfrom_stage = true\n")


def test_collapse_sorts_partitions_of_the_advised_size(spark):
    """One file's rows, most of one key, aren't sorted in one task; of full ties the later row stays."""
    n = 20_000
    rows = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") / 4).cast("long").alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("v"), "id")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        made = upsert.collapse(rows, upsert.Keys("k", "ts"))
        got = {r["k"]: r["id"] for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {-1: n - 1} | {k: k for k in range(0, n, 10)}
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "skewed" in plan


def test_preflight_and_lookback_rules(spark, tmp_path):
    t = table(tmp_path, "t", STATE)
    with pytest.raises(ConfigError):
        upsert.preflight(spark, t, upsert.Keys("nope", "ts"))
    with pytest.raises(ConfigError):
        upsert.preflight(spark, t, upsert.Keys("k", "ts", (), upsert.parse_lookback("48h")))
    only = Table(str(tmp_path / "only"))
    only.create(STATE, (), {"delta.appendOnly": "true"})
    with pytest.raises(ConfigError):
        upsert.preflight(spark, only, KEYS)
    assert upsert.parse_lookback("2d") == upsert.Lookback(2 * 86400 * 10**6, True)
    for bad in ("-1h", "soon", "3 y"):
        with pytest.raises(ConfigError):
            upsert.parse_lookback(bad)


def test_uniqueness(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,)], "k string")
    with pytest.raises(SchemaError, match="2 rows"):
        grain.check(df, ["k"])
    assert {r.k for r in grain.duplicates(df, ["k"]).collect()} == {"a", None}
    grain.check(df.filter("k = 'b'"), ["k"])
    assert [grain.passes(n, 256_000_000) for n in (6_000_000, 500_000_000)] == [1, 18] and grain.passes(1, 10**6) == 1


# ---- statistics ----


def test_cut_text_bounds():
    assert provably_below("abc", "abd") and not provably_below("abc", "abcd") and not provably_below("b", "a") and not provably_below("1", 2)


def test_touching_never_loses_a_match():
    r = random.Random(2)
    for _ in range(3000):
        text = r.random() < 0.5
        value = (lambda: "".join(r.choice("ab") for _ in range(r.randint(0, 4)))) if text else (lambda: r.randint(0, 30))
        keys = sorted(value() for _ in range(r.randint(0, 6)))
        inside = sorted(value() for _ in range(r.randint(1, 5)))
        low, high = inside[0], inside[-1]
        if text and r.random() < 0.5:
            low, high = low[:2], high[:2]
        got = touches_any(low, high, keys)
        assert got or not set(keys) & set(inside)  # never loses a match
        assert not got or any(not provably_below(k, low) and not provably_below(high, k) for k in keys)
    assert touches_any(None, 3, [1]) and not touches_any(None, None, [])
