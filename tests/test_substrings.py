"""Searches by trigram lists equal full scans."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.functions.text import like
from cupboard.operators import substrings
from cupboard.operators.load import ConstraintError, append_batch, read_table

COLUMNS = "id long, name string, notes string"
PATTERNS = ["%ring%", "Ring", "%aba%ba_", "%\\ab%", "%", "%ab%", "", "%ΟΣΑ%", "%日本語%", "%abab%", "%never there%", "aba", "%100\\%%", "%ßab%"]


def NOW():
    return F.lit("2026-04-01 00:00:00").cast("timestamp")


def rows_of(rng, ids):
    pool = ["String ring", "RING", "ring", "a\\abc", "ΟΔΟΣΑ οσα", "日本語の本", "100\\% cotton", "STRAẞAB ßab", "", None, "ab", "İstanbul ring"]
    def text():
        return rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choice("abAB") for _ in range(rng.randrange(0, 9)))
    return [(i, text(), text()) for i in ids]


def schema_of(spark):
    return spark.createDataFrame([], COLUMNS).schema


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three batches with lists (ids in far and negative blocks), one of them replaced, one batch without lists."""
    rng, path, schema = random.Random(5), str(tmp_path_factory.mktemp("s") / "t"), schema_of(spark)
    kept = {}
    for name, ids in (("a", range(0, 90)), ("b", range(65_500, 65_600)), ("a", range(0, 60)), ("c", range(-70_000, -69_950))):
        kept[name] = rows_of(rng, ids)
        substrings.append_with_trigrams(spark.createDataFrame(kept[name], COLUMNS), path, schema, name, NOW(), ("name", "notes"), keep_ids=True)
    kept["bare"] = rows_of(rng, range(1_000_000, 1_000_030))
    append_batch(spark.createDataFrame(kept["bare"], COLUMNS), path, schema, "bare", NOW(), keep_ids=True)
    return path, [r for part in kept.values() for r in part]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_a_full_scan(spark, table, pattern):
    path, rows = table
    whole = spark.createDataFrame(rows, COLUMNS)
    want = sorted(r.id for r in whole.where(like("name", pattern) | like("notes", pattern)).collect())
    found = substrings.search(spark, path, schema_of(spark), ("name", "notes"), pattern)
    assert sorted(r.id for r in found.collect()) == want
    one = substrings.search(spark, path, schema_of(spark), ("notes",), pattern, max_ids=3)
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in whole.where(like("notes", pattern)).collect())


def test_candidates_hold_every_trigram_and_few_files_are_opened(spark, table):
    path, rows = table
    listed = [r for r in rows if r[0] < 1_000_000]
    left = substrings.candidates(spark, path, ("name",), "%abab%")
    want = sorted(i for i, name, _ in listed if name and all(g in name.lower() for g in ("aba", "bab")))
    assert want and sorted(r.id for r in left.collect()) == want
    plan = substrings.search(spark, path, schema_of(spark), ("name",), "%never there%")
    assert {r.batch_id for r in plan.collect()} <= {"bare"}
    assert "file_path" in plan._jdf.queryExecution().toString()


def test_lists_are_bounded_by_blocks(spark):
    rows = spark.range(200_000).select(F.lit("f").alias("file_name"), "id", F.lit("same text").alias("name"))
    lists = substrings._lists(rows, ("name",))
    assert lists.agg(F.max(F.size("places"))).first()[0] == substrings.BLOCK
    assert lists.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).where("n <> 200000").count() == 0


def test_empty_tables_and_missing_ids(spark, tmp_path):
    path, schema = str(tmp_path / "t"), schema_of(spark)
    assert substrings.search(spark, path, schema, ("name",), "%ring%") is None
    with pytest.raises(ConstraintError):
        substrings.append_with_trigrams(spark.createDataFrame([(None, "ring", None)], COLUMNS), path, schema, "x", NOW(), ("name",), keep_ids=True)
    substrings.append_with_trigrams(spark.createDataFrame([], COLUMNS), path, schema, "x", NOW(), ("name",), keep_ids=True)
    assert substrings.search(spark, path, schema, ("name",), "%ring%").count() == 0
    substrings.append_with_trigrams(spark.createDataFrame([(1, "a", "ring")], COLUMNS), path, schema, "y", NOW(), ("name",), keep_ids=True)
    assert substrings.search(spark, path, schema, ("name",), "%a%").count() == 1
    assert substrings.search(spark, path, schema, ("name",), "%ring%").count() == 0


def test_new_ids_are_given_without_keep_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    for batch, names in (("x", ["a ring", "b"]), ("y", ["string", "c"])):
        substrings.append_with_trigrams(spark.createDataFrame([(n,) for n in names], "name string"), path, schema, batch, NOW(), ("name",))
    assert sorted(r.name for r in substrings.search(spark, path, schema, ("name",), "%RING").collect()) == ["a ring", "string"]
    assert sorted(r.id for r in read_table(spark, path, schema).collect()) == [1, 2, 3, 4]


def test_lists_without_their_record_do_not_count(spark, tmp_path, monkeypatch):
    """A run that ends while lists are written leaves some of them; the batch is then searched whole."""
    path, schema = str(tmp_path / "t"), schema_of(spark)
    rows = spark.createDataFrame([(1, "a ring", None), (2, "string", None)], COLUMNS)
    substrings.append_with_trigrams(rows, path, schema, "x", NOW(), ("name",), keep_ids=True)
    with monkeypatch.context() as patch:
        patch.setattr(substrings, "record_beside", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        patch.setattr(substrings, "_lists", lambda rows, fields, whole=substrings._lists: whole(rows.where("id = 3"), fields))
        more = spark.createDataFrame([(3, "ringing", None), (4, "rings", None)], COLUMNS)
        with pytest.raises(RuntimeError):
            substrings.append_with_trigrams(more, path, schema, "y", NOW(), ("name",), keep_ids=True)
    assert sorted(r.id for r in substrings.search(spark, path, schema, ("name",), "%ring%").collect()) == [1, 2, 3, 4]
