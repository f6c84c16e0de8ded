import hashlib
import random
from datetime import date

from pyspark.sql import functions as F

from cupboard.functions import receipt_text as R
from cupboard.operators.receipts import accept_scans, extract, fan_out, load_receipts, read_receipts
from cupboard.sources.scans import parse_detections, read_images, read_item_lines, read_ocr_results
from cupboard.operators.detections import consolidate
from cupboard.operators.normalize import lifespan_of_kind, parse_item_lines

TEXT = "\n".join([
    "RECEIPT", "ABC Mart", "TEL 03-1234-5678", "2026/03/10 12:30", "Rice ball  ¥150", "Water 500ml ¥1,110",
    "Box x2 $12.50", "Gum ¥5", "Box 2 ¥300", "Subtotal ¥1,560", "TOTAL ¥1,572",
])


def fields(spark, *texts, confidences=("90",)):
    rows = spark.createDataFrame([(i, t, list(confidences)) for i, t in enumerate(texts)], "i int, ocr_text string, confidences array<string>")
    return extract(rows).orderBy("i").collect()


def test_receipt(spark):
    row = fields(spark, TEXT)[0]
    assert (row.store_name, row.receipt_date_text, row.receipt_date, row.currency) == (
        "ABC Mart", "2026-03-10", date(2026, 3, 10), "JPY")
    assert row.total_amount == 1560
    assert [(i.name, i.price) for i in row["items"]] == [("Rice ball", 150), ("Water 500ml", 1110), ("Box", 12.5), ("Bo", 300)]


def test_dates_are_taken_as_printed(spark):
    rows = fields(spark, "a 26/03/10 b", "3-10-2026", "2026年3月1日", "２０２６/３/１", "none", "1/2/345")
    assert [r.receipt_date_text for r in rows] == ["2010-26-03", "2026-03-10", "2026-03-01", "２０２６-03-01", None, None]
    assert rows[0].receipt_date is None


def test_blank_text_and_confidence(spark):
    assert fields(spark, "  \n　", None)[0].status == "empty_text"
    low = fields(spark, "Tea ¥100", confidences=["-1", "0", "40", " 41 ", "x", "96.5", ""])[0]
    assert (low.status, low.ocr_confidence) == ("review", 40.5)
    assert fields(spark, "Tea ¥100", confidences=[])[0].ocr_confidence == 0.0


def test_wide_digits_total_words_and_currencies(spark):
    rows = fields(spark, "お茶 ￥１２０\n合計 120円", "Tea $1.50\nAmount  due 9.99", "x €5", "y £5", "z")
    assert [(i.name, i.price) for i in rows[0]["items"]] == [("お茶", 120)]
    assert [r.total_amount for r in rows] == [120, 9.99, None, None, None]
    assert [r.currency for r in rows] == ["JPY", "USD", "EUR", "GBP", "JPY"]


def sequential(scans, stored):
    hashes, paths, kept = {s[1] for s in stored}, {s[0] for s in stored}, []
    for i, path, digest, n in scans:
        if n and digest not in hashes and path not in paths:
            kept.append(i)
            hashes.add(digest)
            paths.add(path)
    return kept


def test_scans_against_a_sequential_load(spark):
    rng = random.Random(3)
    for repeat_paths in (False, True, True):
        scans = [
            (i, f"p{rng.randint(0, 8) if repeat_paths else i}", f"h{rng.randint(0, 8)}", rng.choice([0, 1, 1, 2])) for i in range(30)
        ]
        stored = [("p1", "h90"), ("p77", "h2")]
        rows = spark.createDataFrame(scans, "i int, image_path string, image_hash string, n int").withColumn(
            "items", F.array_repeat(F.lit("x"), F.col("n")))
        got = accept_scans(rows, spark.createDataFrame(stored, "image_path string, image_hash string"), "i")
        assert sorted(r.i for r in got.collect()) == sequential(scans, stored)


def test_chain_of_scans(spark, monkeypatch):
    """Each scan shares its hash with one neighbour and its path with the other: rounds grow with the logarithm."""
    from cupboard.operators import components

    scans = [(i, f"p{(i + 1) // 2}", f"h{i // 2}", 1) for i in range(60)]
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    rows = spark.createDataFrame(scans, "i int, image_path string, image_hash string, n int").withColumn("items", F.array(F.lit("x")))
    got = accept_scans(rows, spark.createDataFrame([], "image_path string, image_hash string"), "i")
    assert sorted(r.i for r in got.collect()) == sequential(scans, []) and len(rounds) <= 8


def test_fan_out(spark):
    rows = spark.createDataFrame([(7, "p", "h", TEXT, ["80"])], "receipt_id long, image_path string, image_hash string, ocr_text string, confidences array<string>")
    receipts, items, purchases = fan_out(extract(rows), F.lit("2026-03-11 00:00:00").cast("timestamp"))
    assert (receipts.count(), items.count(), purchases.count()) == (1, 4, 4)
    row = purchases.filter("item_name = 'Rice ball'").first()
    assert (row.source, row.raw_data, row.purchase_date) == ("receipt", "receipt_id=7,store=ABC Mart", date(2026, 3, 10))
    assert {r.purchase_history_id for r in items.collect()} == {r.id for r in purchases.collect()} == {1, 2, 3, 4}


def test_load_receipts(spark, tmp_path):
    now = F.lit("2026-03-11 00:00:00").cast("timestamp")

    def load(batch, *names):
        rows = spark.createDataFrame([(n, n, TEXT, ["80"]) for n in names], "image_path string, image_hash string, ocr_text string, confidences array<string>")
        load_receipts(extract(rows), str(tmp_path), batch, now)
        return read_receipts(spark, str(tmp_path))

    load("1", "a", "b")
    load("2", "c")
    tables = load("1", "a")
    scans = {r.id: r.image_path for r in tables["receipt_scans"].collect()}
    bought = {r.id: (r.item_name, r.price) for r in tables["purchase_history"].collect()}
    items = tables["receipt_items"].collect()
    assert sorted(scans.values()) == ["a", "c"] and len(items) == len(bought) == 8
    assert all(bought[i.purchase_history_id] == (i.item_name, i.price) and i.receipt_id in scans for i in items)


def test_image_and_ocr_scans(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"\x00\xffimage")
    row = read_images(spark, str(tmp_path / "img"), "*.png").first()
    assert row.image_hash == hashlib.sha256(b"\x00\xffimage").hexdigest()
    (tmp_path / "ocr.json").write_text('{"image_path": "a", "ocr_text": "t", "words": [{"text": "t", "conf": "91"}]}\n')
    row = extract(read_ocr_results(spark, str(tmp_path / "ocr.json"))).first()
    assert (row.image_path, row.ocr_confidence, row.status) == ("a", 91.0, "ok")


def test_item_lines(spark, tmp_path):
    (tmp_path / "lines.txt").write_text(
        "kitchen:Rice cooker\n Supplement : Protein / SAVAS / x \ngarage:Drill\nno colon\nfood:   \n\nfood:a:b\n", encoding="utf-8")
    lines = parse_item_lines(read_item_lines(spark, str(tmp_path)), F.lit(date(2026, 3, 10)))
    got = [(r.status, r.category, r.name, r.brand, r.is_consumable, r.estimated_lifespan_days, r.last_replenished)
           for r in lines.orderBy("row_id").collect()]
    assert got[0] == ("accepted", "kitchen", "Rice cooker", None, False, None, None)
    assert got[1] == ("accepted", "supplement", "Protein", "SAVAS / x", True, 60, date(2026, 3, 10))
    assert [g[0] for g in got] == ["accepted", "accepted", "unknown_category", "no_category", "empty", "empty", "accepted"]
    assert got[6][2] == "a:b"


def test_lifespan_of_kind(values):
    assert values(lifespan_of_kind, ["shampoo", "lamp", None]) == [45, 30, 30]


def test_detections(spark):
    frames = spark.createDataFrame([
        (1, 1, '[{"name": "Sony WH", "category": "electronics", "condition": "good", "location": "desk"}]'),
        (1, 2, '[{"name": " sony  wh", "category": "electronics", "condition": "fair", "location": "Desk"}]'),
        (1, 3, '[{"name": "sony-wh", "category": "electronics", "condition": "fair", "location": "shelf"}]'),
        (1, 4, "no json"), (1, 5, "[]"),
    ], "session_id int, frame int, detections string")
    items, rejected = parse_detections(frames)
    assert (items.count(), rejected.count()) == (3, 1)
    sessions = spark.createDataFrame([(1, "this is my  sony  wh here")], "session_id int, audio_transcript string")
    rows = {r.location: r for r in consolidate(items, sessions).collect()}
    assert rows["Desk"].name == " sony  wh" and rows["Desk"].frames == 2 and rows["Desk"].condition == "good"
    assert rows["shelf"].frames == 1 and not rows["shelf"].from_audio


def test_stored_scans_come_from_the_extracted_ones(spark, monkeypatch):
    """The texts are made and hashed once: the scans stored before are rows of the written table."""
    from cupboard.plans import catalog

    rows = [(1, "a", "x\nRice ¥120\nno day printed\nBALANCE", ["50"], "h1"), (2, "b", "x\nTea ¥300", ["50"], "h2"), (3, "c", "x\nTea ¥300\nno day printed", ["50"], "h3")]
    calls = []

    def scans(_):
        calls.append(1)
        return spark.createDataFrame(rows, "row_id long, image_path string, ocr_text string, confidences array<string>, image_hash string")

    monkeypatch.setattr(catalog, "_scans", scans)
    assert [tuple(r) for r in catalog.new_receipts(None).collect()] == [("b", "h2")]
    assert len(calls) == 1


def test_every_pattern_is_searched_once(spark):
    """A value that is named twice inside array functions is computed twice; nothing costly is."""
    rows = spark.createDataFrame([("Tea 1.20 円", ["5", "x", "0", "7"])], "line string, confidences array<string>")

    def searches(column, name):
        return rows.select(column.alias("v"))._jdf.queryExecution().analyzed().toString().lower().count(name)

    line = F.col("line")
    assert searches(R.line_price(line), "regexp_extract_all(") == len(R.PRICES)
    assert searches(R.priced_lines(F.array(line)), "regexp_extract_all(") == len(R.PRICES)
    assert searches(R.mean_confidence(F.col("confidences")), "rlike") == 1
    assert searches(R.date_text(line), "rlike") == 7  # of digits alone, none of a date pattern
    assert rows.select(R.mean_confidence(F.col("confidences"))).first()[0] == 6.0


def test_prices_dates_and_total_words_as_before(values):
    lines = {"￥1,200 円": 1200.0, "1,200 円 ¥3": 1200.0, "$ 4.50": 4.5, "5": None, "9.99 9.98": 9.99, "１２円": 12.0, "¥5": None, "12円 .": 12.0, "$7": None}
    assert values(R.line_price, list(lines)) == list(lines.values())
    dates = {"on 2024/1/2 or 3/4/2025": "2024-01-02", "3-4-2025": "2025-03-04", "3/4/25x 5/6/27": "2027-05-06", "１２/３１/２４": "2024-12-31",
             "12345/6/7": "2345-06-07", "no day": None, "": None}
    assert values(R.date_text, list(dates)) == list(dates.values())
    words = {"Subtotal 3": True, "GRAND  TOTAL": True, "Tax Incl.": True, "taxincl": True, "Amount due": True, "amountdue": True, "balance": True,
             "合計": True, "小計": True, "総計": True, "お支払い": True, "お買上": True, "お預り": False, "tax": False, "計": False, "amount": False, "totaI": False}
    assert values(R.is_total_line, list(words)) == list(words.values())
