"""Folders of export files: the rows are put in order once, and each layout's files hold them in that order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cupboard.plans import exports
from cupboard.plans.views import ROW_KEY, Views


def tables(spark, folder, n=400):
    draw = random.Random(3)
    lines = [(draw.randrange(60), draw.randrange(30), draw.randrange(20), 1 + n % 7, 5.0, draw.randrange(9000) * 10.0, 0.0, 0.0, draw.choice("RAN"), "O",
              datetime(2001, 1, 1) + timedelta(days=draw.randrange(300))) for n in range(n)]
    spark.createDataFrame(lines, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k, k % 7, "O", 10.0, datetime(2001, 1, 1) + timedelta(days=k), "LOW") for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
                          ).write.parquet(f"{folder}/orders.parquet")
    parts = [(k, f"part {k}", f"Brand#{k % 5}", "STANDARD", k, 9.0) for k in range(30)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return Views(spark, str(folder))


def test_rows_are_put_in_order_once_for_all_layouts(spark, tmp_path, monkeypatch):
    views = tables(spark, tmp_path)
    frame, ordered = type(spark.range(1)), []
    by_range = frame.repartitionByRange
    # Several files, as of larger tables.
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *keys: (ordered.append(keys), by_range(self, 3, *keys))[1])
    rows = views.view("export_rows").orderBy(*ROW_KEY).collect()
    for write, layouts in ((exports.landing_folder, range(5)), (exports.mixed_folder, [*range(5), 7]), (exports.other_shop_folder, range(7)),
                           (exports.short_row_folder, range(5))):
        ordered.clear()
        folder = write(views).removesuffix("/*")
        assert ordered == [ROW_KEY]
        for layout in layouts:
            name, encoding, columns = exports.LAYOUTS[layout]
            read = spark.read.options(header=True, encoding=encoding, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False,
                                      ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")
            item = columns["item_text"]
            got = sorted(read.select(F.col(item).alias("item"), "_metadata.file_path", F.monotonically_increasing_id().alias("n")).collect(),
                         key=lambda r: (r.file_path, r.n))
            mine = [r.item_text for r in rows if (r.layout == layout if layout < 5 else layout == 7 or r.l_orderkey % 2 + 5 == layout)]
            assert [r.item or "" for r in got] == mine
            assert len({r.file_path for r in got}) > 1
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_purchases_of_several_batches_are_joined_once(spark, tmp_path, monkeypatch):
    from cupboard.operators import load
    from cupboard.plans import catalog

    views, plans = tables(spark, tmp_path), []
    append = load.append_batch
    monkeypatch.setattr(load, "append_batch", lambda rows, *rest, **named: (
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), append(rows, *rest, **named))[1])
    assert sum(r.n for r in catalog.appended_purchases(views).collect()) == views.purchases.count()
    assert len(plans) == 3 and not any("Join" in plan for plan in plans)


def test_folders_are_compressed_and_purchases_not_written_apart(spark, tmp_path):
    from pathlib import Path

    views = tables(spark, tmp_path / "in")
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir())
    for write in (exports.landing_folder, exports.mixed_folder, exports.other_shop_folder, exports.short_row_folder):
        folder = write(views).removesuffix("/*")
        files = [f for f in Path(folder).glob("*/part-*") if f.parent.name != "j-empty"]
        assert files and all(f.name.endswith(".csv.gz") for f in files)
        new = set(scratch.iterdir()) - before
        assert new == {Path(folder)}
        before |= new
