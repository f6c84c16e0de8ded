from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cupboard import schemas
from cupboard.operators import quality, state
from cupboard.operators.load import ConstraintError, append_batch, read_table
from cupboard.operators.normalize import registry_importer
from cupboard import registry
from cupboard.streaming import events as streamed
from cupboard.streaming.landing import watch_landing
from test_analytics import logged, owned
from test_import import SHOP, write


def now():
    return F.lit("2026-03-10 09:00:00").cast("timestamp")


def test_register_fills_and_refuses(spark):
    rows = spark.createDataFrame([
        ("Soap", "bathroom", None, None, None, "hand_soap"), ("Lamp", "electronics", "new", None, None, None),
        ("Bad", "gadget", None, None, None, None), (None, "food", None, None, None, None), ("Odd", None, "broken", None, None, None),
    ], "name string, category string, condition string, is_consumable boolean, estimated_lifespan_days int, kind string")
    got = {r.name: (r.is_consumable, r.estimated_lifespan_days, r.condition) for r in state.register(rows, now())[0].collect()}
    assert got == {"Soap": (True, 20, "good"), "Lamp": (False, None, "new")}
    accepted, refused = state.register(rows, now())
    assert {(r.name, r.reason) for r in refused.collect()} == {("Bad", "enum:category"), (None, "not_null:name"), ("Odd", "enum:condition")}
    snapshot = state.append_possessions(owned(spark, [{"id": 5, "name": "x"}]), accepted)
    assert sorted(r.id for r in snapshot.collect()) == [5, 6, 7]


def test_update_and_delete(spark):
    rows = owned(spark, [{"id": 1, "name": "a", "location": "x"}, {"id": 2, "name": "b", "location": "y"}])
    changes = spark.createDataFrame([
        (1, "location", "old", 1), (1, "location", None, 2), (1, "estimated_lifespan_days", "12", 1), (2, "estimated_lifespan_days", "oops", 1),
        (2, "name", None, 5), (2, "condition", "broken", 5), (2, "colour", "red", 5), (9, "name", "z", 5), (2, "location", "later", 4), (2, None, "x", 1),
    ], "id long, column_name string, value string, seq long")
    got = {r.id: (r.name, r.location, r.estimated_lifespan_days) for r in state.update(rows, changes)[0].collect()}
    assert got == {1: ("a", None, 12), 2: ("b", "later", None)}
    refused = {(r.id, r.column_name, r.reason) for r in state.update(rows, changes)[1].collect()}
    assert refused == {(2, "estimated_lifespan_days", "unreadable"), (2, "name", "not_null"), (2, "condition", "enum"),
                       (2, "colour", "unknown_column"), (9, "name", "unknown_id"), (2, None, "unknown_column")}
    assert [r.id for r in state.delete(rows, spark.createDataFrame([(1,), (1,)], "id long")).collect()] == [2]


def test_events_change_state(spark):
    rows = owned(spark, [{"id": 1, "name": "a", "last_replenished": date(2020, 1, 1)}, {"id": 2, "name": "b", "last_replenished": date(2020, 1, 1)}])
    log = logged(spark, [
        (1, "opened", datetime(2026, 3, 1, 23)), (1, "empty", datetime(2026, 3, 5)), (2, "low", datetime(2026, 3, 5)), (1, "low", datetime(2026, 3, 5)),
    ])
    days = {r.id: r.last_replenished for r in state.apply_events(rows, log).collect()}
    assert days == {1: date(2026, 3, 1), 2: date(2020, 1, 1)}
    assert {r.possession_id: r.event_type for r in state.latest_status(log).collect()} == {1: "low", 2: "low"}


def test_log_defaults_and_refuses(spark):
    events = spark.createDataFrame([(1, "opened", None), (1, "eaten", None), (None, "low", None), (8, "low", None)], "possession_id long, event_type string, logged_at timestamp")
    accepted, refused = state.log_events(events, owned(spark, [{"id": 1, "name": "a"}]), now())
    assert accepted.first().logged_at == datetime(2026, 3, 10, 9) and accepted.count() == 1
    assert {(r.possession_id, r.reason) for r in refused.collect()} == {
        (1, "enum:event_type"), (None, "not_null:possession_id"), (8, "foreign_key:possession_id")}


def test_checks(spark):
    rows = owned(spark, [{"id": 1, "name": "a", "category": None}, {"id": 2, "name": "b", "category": "gadget"}])
    log = logged(spark, [(1, "opened", datetime(2026, 1, 1)), (7, "eaten", datetime(2026, 1, 1))])
    found = {(r.table_name, r.rule, r.key) for r in quality.check_all({"possessions": rows, "consumption_log": log}).collect()}
    assert found == {
        ("possessions", "enum:category", "2"), ("consumption_log", "enum:event_type", "1"),
        ("consumption_log", "foreign_key:possession_id", "1"),
    }
    twice = quality.check_all({"possessions": owned(spark, [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}])}).collect()
    assert [(r.rule, r.key) for r in twice] == [("unique:id", "1")]
    missing = quality.check_not_null(spark.createDataFrame([(1, None)], "id long, item_name string"), "receipt_items", ["item_name"])
    assert missing.first().rule == "not_null:item_name"
    assert quality.check_unique(spark.createDataFrame([(1,), (1,), (2,)], "id long"), "t").first().key == "1"


def test_defaults(spark):
    rows = spark.createDataFrame([("s", None), ("t", "USD")], "source string, currency string")
    got = {r.source: (r.currency, r.created_at) for r in quality.fill_defaults(rows, "purchase_history", now()).collect()}
    assert got == {"s": ("JPY", datetime(2026, 3, 10, 9)), "t": ("USD", datetime(2026, 3, 10, 9))}
    assert quality.fill_defaults(spark.range(1), "receipt_items", now()).first().quantity == 1


def test_tables():
    assert sorted(schemas.TABLES) == [
        "consumption_log", "possessions", "purchase_history", "receipt_items", "receipt_scans", "schema_version", "video_sessions"]


def test_migrations_run_twice(spark):
    old = spark.createDataFrame([("custom_store", 1.0)], "source string, price double")
    once = quality.backfill(old, old.limit(0))
    assert quality.backfill(old, once).count() == 1
    versions = spark.createDataFrame([], schemas.SCHEMA_VERSION)
    applied = spark.range(2).select(F.lit("1.0.0").alias("version"), now().alias("applied_at"))
    once = quality.record_versions(versions, applied)
    assert once.count() == 1 and quality.record_versions(once, applied).count() == 1
    evolved = quality.evolve(spark.range(1).toDF("id"), spark.range(1).withColumn("image_hash", F.lit("h")))
    assert sorted(map(str, [r.image_hash for r in evolved.collect()])) == ["None", "h"]


def test_landing_streams(spark, tmp_path):
    """Two streams feed one table in turn; each continues where it stopped."""
    table, importer = str(tmp_path / "table"), registry_importer(registry.FORMATS, registry.SYMBOLS)

    def run(name):
        watch_landing(spark, str(tmp_path / name), table, str(tmp_path / f"ck-{name}"), importer, name, now=now).awaitTermination()
        return sorted(r.order_id for r in read_table(spark, table, schemas.PURCHASE_HISTORY).collect())

    write(tmp_path / "one" / "a.csv", SHOP, [["2026/01/15", "1", "A", "500"]])
    assert run("one") == ["1"]
    write(tmp_path / "two" / "a.csv", SHOP, [["2026/01/15", "1", "A", "500"], ["2026/01/17", "3", "C", "5"]])
    assert run("two") == ["1", "3"]
    write(tmp_path / "one" / "b.csv", SHOP, [["2026/01/15", "1", "A", "500"], ["2026/01/16", "2", "B", "5"]])
    assert run("one") == ["1", "2", "3"] and run("two") == ["1", "2", "3"]
    ids = [r.id for r in read_table(spark, table, schemas.PURCHASE_HISTORY).collect()]
    assert sorted(ids) == [1, 2, 3]


def purchases(spark, *rows):
    return spark.createDataFrame(rows, "source string, item_name string, currency string, purchase_date date")


def test_rerun_replaces_the_whole_batch(spark, tmp_path):
    table, day = str(tmp_path / "t"), date(2026, 1, 1)

    def append(batch, *rows):
        append_batch(purchases(spark, *rows), table, schemas.PURCHASE_HISTORY, batch, now(), partition="source")
        return sorted((r.batch_id, r.source, r.item_name) for r in read_table(spark, table, schemas.PURCHASE_HISTORY).collect())

    assert read_table(spark, table, schemas.PURCHASE_HISTORY) is None
    assert append("b0") == []
    append("b1", ("a", "x", "JPY", day), ("b", "old", "JPY", day))
    append("b2", ("a", "y", "JPY", day))
    assert append("b1", ("a", "z", "JPY", day)) == [("b1", "a", "z"), ("b2", "a", "y")]
    assert append("b2") == [("b1", "a", "z")]


def test_a_run_that_ends_before_its_record_is_never_seen(spark, tmp_path, monkeypatch):
    table, day = str(tmp_path / "t"), date(2026, 1, 1)

    def append(batch, *rows):
        append_batch(purchases(spark, *rows), table, schemas.PURCHASE_HISTORY, batch, now(), partition="source")

    def seen():
        return sorted((r.batch_id, r.source, r.item_name, r.id) for r in read_table(spark, table, schemas.PURCHASE_HISTORY).collect())

    append("b1", ("a", "x", "JPY", day))
    with monkeypatch.context() as patch:
        patch.setattr(spark, "range", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")), raising=False)
        for item in ("half", "done"):
            with pytest.raises(RuntimeError):
                append("b2", ("a", item, "JPY", day), ("b", item, "JPY", day))
    assert seen() == [("b1", "a", "x", 1)]
    append("b2", ("a", "y", "JPY", day))
    assert seen() == [("b1", "a", "x", 1), ("b2", "a", "y", 2)]


@pytest.mark.parametrize("row", [("", "x", "JPY", None), (None, "x", "JPY", None), ("a", "x", None, None)])
def test_append_refuses_blank_sources_and_nulls(spark, tmp_path, row):
    table = str(tmp_path / "t")
    with pytest.raises(ConstraintError):
        append_batch(purchases(spark, row), table, schemas.PURCHASE_HISTORY, "1", now(), partition="source")
    assert read_table(spark, table, schemas.PURCHASE_HISTORY) is None


def test_empty_event_stream(spark, tmp_path):
    (tmp_path / "events").mkdir()
    log = streamed.event_stream(spark, str(tmp_path / "events"), schemas.CONSUMPTION_LOG)
    assert streamed.run_to_table(log, state.latest_status, str(tmp_path / "out")).count() == 0


def test_event_stream_in_several_triggers(spark, tmp_path):
    for part, (possession, event, hour) in enumerate([(1, "opened", 1), (2, "low", 2), (1, "empty", 3)]):
        logged(spark, [(possession, event, datetime(2026, 1, 1, hour))]).write.parquet(str(tmp_path / "events" / f"p{part}"))
        log = streamed.event_stream(spark, str(tmp_path / "events"), schemas.CONSUMPTION_LOG, recursiveFileLookup="true", maxFilesPerTrigger="1")
        table = streamed.run_to_table(log, state.latest_status, str(tmp_path / "out"))
    assert {r.possession_id: r.event_type for r in table.collect()} == {1: "empty", 2: "low"}


def test_old_changes_are_merged_and_not_read_again(spark, tmp_path, monkeypatch):
    """Every run equals the batch result, whether it merges or reads a base; a run lost before its record changes nothing."""
    rows = [(1, "opened", 1), (2, "low", 2), (1, "empty", 3), (3, "opened", 4), (2, "empty", 5), (1, "low", 6)]
    out = str(tmp_path / "out")

    def run(n, every):
        logged(spark, [(p, e, datetime(2026, 1, 1, h)) for p, e, h in rows[n - 1:n]]).write.mode("overwrite").parquet(str(tmp_path / "events" / f"p{n}"))
        log = streamed.event_stream(spark, str(tmp_path / "events"), schemas.CONSUMPTION_LOG, recursiveFileLookup="true", maxFilesPerTrigger="1")
        table = streamed.run_to_table(log, state.latest_status, out, merge_every=every)
        whole = logged(spark, [(p, e, datetime(2026, 1, 1, h)) for p, e, h in rows[:n]])
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, state.latest_status(whole).collect()))
        return table

    run(1, 2), run(2, 2)
    merged = run(3, 2)
    assert "merged-" in merged.inputFiles()[0] and len({f.rsplit("/", 2)[-2] for f in merged.inputFiles()}) == 1
    spark.range(5).write.parquet(f"{out}/merged-99")  # left by a run that ended before its record
    later = run(4, 2)
    assert "PartitionFilters: [isnotnull(batch" in later._jdf.queryExecution().toString()
    run(5, 2), run(6, 2)
    assert spark.read.parquet(f"{out}/merges").count() == 2
