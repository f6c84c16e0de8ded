import csv
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from cupboard import registry
from cupboard.operators.load import append_batch, import_exports, read_table
from cupboard.operators.normalize import registry_importer, shop_a_importer, shop_b_importer, statement_importer
from cupboard.schemas import PURCHASE_HISTORY

SHOP = ["注文日", "注文番号", "商品名", "価格"]


def write(path, header, rows, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


def plugin(**options):
    return registry_importer(registry.FORMATS, registry.SYMBOLS, **options)


def load(spark, folder, importer=None, target=None):
    done = import_exports(spark, str(folder), target, importer or plugin())
    rows = [r.asDict() for r in done.accepted.orderBy("file_no", "file_block_start", "row_id").collect()]
    counts = {r.file_path.rsplit("/", 1)[-1]: (r.imported, r.skipped, r.errors) for r in done.statistics.collect()}
    reasons = sorted((r.file_path.rsplit("/", 1)[-1], r.reason) for r in done.rejected.collect())
    return rows, counts, reasons


def test_many_layouts_in_one_folder(spark, tmp_path):
    write(tmp_path / "a.csv", SHOP, [["2026/01/15", "1-1", "テスト 🎉", "¥1,500"], ["2026/02/20", "1-2", "Item", "￥3,000"]], "utf-8-sig")
    write(tmp_path / "b.csv", SHOP, [["2026年3月1日", "2-1", "せっけん", "1500円"]], "shift_jis")
    write(tmp_path / "c.csv", SHOP, [["2026/03/02", "3-1", "①番", "10"]], "cp932")
    write(tmp_path / "d.csv", ["Item title", "Sale price", "Sale date", "Order number"], [["Vintage Lamp", "$45.00", "Mar-10-26", "E-1"]])
    write(tmp_path / "e.csv", ["利用日", "利用先", "金額", "カテゴリ"], [["2026/01/10", "Store", "580", "food"], ["2026/01/10", "Store", "580", "food"]])
    (tmp_path / "f.csv").write_bytes(b"")
    write(tmp_path / "g.csv", SHOP, [])
    (tmp_path / "h.csv").write_bytes(bytes(range(128, 256)) * 10)
    rows, counts, reasons = load(spark, tmp_path)
    assert counts == {
        "a.csv": (2, 0, 0), "b.csv": (1, 0, 0), "c.csv": (1, 0, 0), "d.csv": (1, 0, 0), "e.csv": (1, 1, 0),
        "f.csv": (0, 0, 1), "g.csv": (0, 0, 0), "h.csv": (0, 0, 1),
    }
    assert reasons == [("f.csv", "empty_file"), ("h.csv", "undecodable")]
    assert [r["item_name"] for r in rows] == ["テスト 🎉", "Item", "せっけん", "①番", "Vintage Lamp", "Store"]
    assert [r["source"] for r in rows] == ["amazon"] * 4 + ["ebay", "credit_card"]
    assert [r["price"] for r in rows] == [1500, 3000, 1500, 10, 45, 580]
    assert [r["currency"] for r in rows] == ["JPY", "JPY", "JPY", "USD", "USD", "USD"]
    assert [r["purchase_date"] for r in rows][4] == date(2026, 3, 10)
    assert rows[5]["order_id"] is None and rows[5]["category"] == "food"


def test_tied_detection_takes_the_earlier_format(spark, tmp_path):
    header = ["Order Date", "Order ID", "Title", "Purchase Price Per Unit", "Quantity", "Category"]
    write(tmp_path / "us.csv", header, [["01/15/2026", "112-1", "Cable", "$12.99", "1", "Electronics"]])
    rows, _, _ = load(spark, tmp_path)
    assert (rows[0]["format_key"], rows[0]["purchase_date"], rows[0]["price"]) == ("amazon_jp", None, 12.99)
    rows, _, _ = load(spark, tmp_path, plugin(format_key="amazon_us", source="mine"))
    assert (rows[0]["source"], rows[0]["purchase_date"]) == ("mine", date(2026, 1, 15))
    rows, _, _ = load(spark, tmp_path, plugin(format_key="no_such_format"))
    assert rows[0]["format_key"] == "amazon_jp"


def test_odd_file_names(spark, tmp_path):
    write(tmp_path / "sub dir" / "日本 a%20+[b]{c}.csv", SHOP, [["2026/01/15", "1", "A", "5"]])
    write(tmp_path / "sub dir" / "日本 a%20+b.csv", SHOP, [["2026/01/15", "2", "B", "6"]])
    rows, _, _ = load(spark, tmp_path / "sub dir")
    assert sorted(r["item_name"] for r in rows) == ["A", "B"]


def test_unrecognised_blank_row_counts_nowhere(spark, tmp_path):
    write(tmp_path / "x.csv", ["col1", "col2"], [["", ""]])
    assert load(spark, tmp_path)[1] == {"x.csv": (0, 0, 0)}


def test_quotes_newlines_short_and_long_rows(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(
        '注文日,注文番号,商品名,価格\n2026/01/01,1,"a ""b""\nc, d",100\n\n2026/01/02,2\n2026/01/03,3,x\n2026/01/04,4,y,5,extra\n',
        encoding="utf-8")
    rows, counts, reasons = load(spark, tmp_path)
    assert [(r["item_name"], r["price"]) for r in rows] == [('a "b"\nc, d', 100), ("x", None), ("y", 5)]
    assert counts == {"q.csv": (3, 0, 1)} and reasons == [("q.csv", "short_row")]
    assert json.loads(rows[0]["raw_data"])["商品名"] == 'a "b"\nc, d'
    assert json.loads(rows[1]["raw_data"])["価格"] is None
    assert "extra" in json.loads(rows[2]["raw_data"])["null"]


def test_embedded_newline_in_shift_jis(spark, tmp_path):
    write(tmp_path / "s.csv", SHOP, [["2026/01/01", "1", '表ソ"能"\n二行', "100"], ["2026/01/01", "2", "ソ", "5"]], "shift_jis")
    rows, counts, _ = load(spark, tmp_path)
    assert [r["item_name"] for r in rows] == ['表ソ"能"\n二行', "ソ"] and counts == {"s.csv": (2, 0, 0)}


def test_headers_are_trimmed_and_matched_in_any_case(spark, tmp_path):
    write(tmp_path / "t.csv", [" item TITLE ", "sale PRICE", "sale date", "ORDER number"], [["Lamp", "$4", "Mar-10-26", "1"]])
    rows, _, _ = load(spark, tmp_path)
    assert (rows[0]["format_key"], rows[0]["item_name"], rows[0]["price"]) == ("ebay", "Lamp", 4)
    assert " item TITLE " in json.loads(rows[0]["raw_data"])


def test_second_run_skips_what_is_stored(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    write(landing / "a.csv", SHOP, [["2026/01/15", "1", "A", "500"], ["2026/01/15", "", "B", "5"], ["", "", "C", "5"]])
    now = F.lit("2026-04-01 00:00:00").cast("timestamp")
    first = import_exports(spark, str(landing), None, plugin())
    append_batch(first.accepted, table, PURCHASE_HISTORY, "1", now, partition="source")
    stored = read_table(spark, table, PURCHASE_HISTORY)
    assert stored.count() == 3 and stored.select("id").distinct().count() == 3
    rows, counts, _ = load(spark, landing, target=stored)
    assert counts == {"a.csv": (1, 2, 0)}  # without a date nothing compares equal
    assert rows[0]["item_name"] == "C"
    append_batch(first.accepted, table, PURCHASE_HISTORY, "1", now, partition="source")
    assert read_table(spark, table, PURCHASE_HISTORY).count() == 3


def test_large_file_keeps_file_order(spark, tmp_path):
    """Cut into many splits, the first of two equal orders must still be the earlier line."""
    write(tmp_path / "big.csv", SHOP, [["2026/01/01", str(i % 5000), f"item {i}", str(i)] for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows, counts, _ = load(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == {"big.csv": (5000, 15_000, 0)}
    assert [r["item_name"] for r in rows] == [f"item {i}" for i in range(5000)]


def test_shop_a(spark, tmp_path):
    write(tmp_path / "jp" / "a.csv", SHOP + ["不明"], [["2026/01/15", "X", "", "", "foo"], ["2026/01/15", "X", "second", "1", ""], ["", "", "", "", ""]])
    rows, counts, _ = load(spark, tmp_path / "jp", shop_a_importer())
    assert counts == {"a.csv": (2, 1, 0)} and [r["currency"] for r in rows] == ["JPY", "JPY"]
    write(tmp_path / "us" / "a.csv", ["Order Date", "Order ID", "Title", "Item Total"], [["01/15/2026", "U", "Cable", "$9.99"]])
    rows, _, _ = load(spark, tmp_path / "us", shop_a_importer())
    assert (rows[0]["currency"], rows[0]["price"], rows[0]["purchase_date"]) == ("USD", None, date(2026, 1, 15))
    write(tmp_path / "no" / "a.csv", ["col1"], [["x"]])
    assert load(spark, tmp_path / "no", shop_a_importer())[1:] == ({"a.csv": (0, 0, 1)}, [("a.csv", "unknown_header")])


def test_shop_b_and_statement(spark, tmp_path):
    write(tmp_path / "b" / "b.csv", ["注文日", "受注番号", "商品名称", "金額"], [["2026/01/15 9:05:00", "R", "茶", "1,200円"]])
    rows, _, _ = load(spark, tmp_path / "b", shop_b_importer())
    assert (rows[0]["source"], rows[0]["price"], rows[0]["currency"]) == ("rakuten", 1200, "JPY")
    assert rows[0]["purchase_date"] == date(2026, 1, 15)
    write(tmp_path / "c" / "c.csv", ["DATE", "Merchant", "amount", "Reference"], [["2026/03/01", "Refund", "-1000", ""], ["2026/03/01", "US", "$29.99", "9"]])
    rows, _, _ = load(spark, tmp_path / "c", statement_importer("manual"))
    assert [(r["source"], r["price"], r["order_id"]) for r in rows] == [("manual", -1000, None), ("manual", 29.99, "9")]


def test_registry_from_a_file(spark, tmp_path):
    config = {"formats": {"my_store": {
        "name": "Mine", "source_key": "my_store", "columns": {"item_name": ["Thing"], "price": ["Cost"]}, "date_formats": ["%Y-%m-%d"]}}}
    path = tmp_path / "formats.json"
    path.write_text(json.dumps(config))
    formats, symbols = registry.load_formats(spark, str(path))
    assert formats == config["formats"] and symbols == registry.SYMBOLS
    with pytest.raises(FileNotFoundError):
        registry.load_formats(spark, str(tmp_path / "absent.json"))


def test_registry_without_a_statement_format(spark, tmp_path):
    formats = {"mine": {"name": "Mine", "source_key": "mine", "columns": {"item_name": ["Thing"], "price": ["Cost"]}, "date_formats": ["%Y-%m-%d"]}}
    write(tmp_path / "in" / "a.csv", ["Thing", "Cost"], [["Cup", "5"]])
    write(tmp_path / "in" / "b.csv", ["x", "y"], [["1", "2"]])
    rows, counts, _ = load(spark, tmp_path / "in", registry_importer(formats, registry.SYMBOLS))
    assert [(r["item_name"], r["source"]) for r in rows] == [("Cup", "mine")] and counts["b.csv"] == (0, 0, 0)


def test_header_with_a_line_break(spark, tmp_path):
    for name, charset in (("u", "utf-8"), ("s", "shift_jis")):
        path = tmp_path / "in" / f"{name}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text('注文日,注文番号,"商品\n名 ""x""",商品名,価格\n2026/01/01,1%s,"a\nb",茶,100\n' % name, encoding=charset)
    rows, counts, reasons = load(spark, tmp_path / "in")
    assert [(r["item_name"], r["price"]) for r in rows] == [("茶", 100), ("茶", 100)] and reasons == []
    assert counts == {"u.csv": (1, 0, 0), "s.csv": (1, 0, 0)}
    assert json.loads(rows[0]["raw_data"])['商品\n名 "x"'] == "a\nb"


def test_encoding_order_from_a_file(spark, tmp_path):
    path = tmp_path / "formats.json"
    path.write_text(json.dumps({"formats": {}, "encoding_order": ["utf-8", "utf-8-sig", "cp1252"]}))
    charsets = registry.load_charsets(spark, str(path))
    assert charsets == ("UTF-8", "windows-1252") and registry.load_charsets(spark) == registry.CHARSETS
    write(tmp_path / "in" / "a.csv", ["Item title", "Sale price", "Sale date", "Order number"], [["Café", "$4", "Mar-10-26", "1"]], "cp1252")
    rows, _, _ = load(spark, tmp_path / "in", registry_importer(registry.FORMATS, registry.SYMBOLS, charsets=charsets))
    assert rows[0]["item_name"] == "Café"


def test_registered_imports_and_changes_are_whole(spark, monkeypatch):
    """The operators get every layout and every change, not the part that the results show."""
    from cupboard.operators import load as loading
    from cupboard.operators import state
    from cupboard.plans import catalog
    from cupboard.plans.views import Views

    views, seen = Views(spark, "/root/testdata/sf0.001"), []
    imported, updated = loading.import_exports, state.update
    monkeypatch.setattr(loading, "import_exports", lambda s, path, *rest: (seen.append(path), imported(s, path, *rest))[1])
    monkeypatch.setattr(state, "update", lambda rows, changes: (seen.append(changes.count()), updated(rows, changes))[1])

    def rows_of(query):
        seen.clear()
        query(views)
        lines = spark.read.csv(seen[0], header=False, multiLine=True, escape='"').select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("f"))
        return {r.f for r in lines.distinct().collect()}

    shops = {"a-shop-utf8", "b-shop-sjis", "c-auction", "d-store", "e-statement"}
    assert rows_of(catalog.import_statement) == shops
    assert rows_of(catalog.import_short_rows) == shops
    assert rows_of(catalog.import_shop_b) == shops | {"f-other-shop-utf8", "g-other-shop-sjis"}
    seen.clear()
    catalog.refused_changes(views)
    assert seen == [catalog._changes(views).count()]
