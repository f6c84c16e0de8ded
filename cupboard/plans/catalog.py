"""Every registered query by name, over the derived tables of ``views``."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard import registry, schemas
from cupboard.functions.dates import date_text, parse_clean_date
from cupboard.functions.money import amount_of, currency_of, shop_a_amount, shop_b_amount
from cupboard.functions.text import row_json
from cupboard.operators import dedupe, detections, headers, load, normalize, pruning, quality, receipts, rollups, state, substrings
from cupboard.plans import analytics as Q
from cupboard.plans import exports, reports
from cupboard.plans.views import ROW_KEY, VIEWS, Views
from cupboard.session import scratch_dir, write_and_reload
from cupboard.sources.scans import content_hash, parse_detections, read_item_lines, read_ocr_results
from cupboard.streaming import events as streamed
from cupboard.streaming import cycles, stateful

AS_OF = datetime(2001, 7, 20, 12)
LOG_AS_OF = datetime(2024, 1, 20, 12)
ALERTS_AS_OF = datetime(2024, 2, 20, 12)
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, so that results read the same in any client."""
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"
    })


# --- normalisation ----------------------------------------------------------------------------

def _price_query(amount, currency=None):
    def query(v: Views) -> DataFrame:
        text = F.col("price_text")
        columns = [amount(text).alias("amount")]
        if currency is not None:
            columns.append(currency(F.coalesce(text, F.lit(""))).alias("currency"))
        return v.view("dirty").select(*LINE_KEY, "price_text", *columns)

    return query


def _clean_dates(v: Views) -> DataFrame:
    return v.view("dirty").select(*LINE_KEY, "date_text", date_text(F.col("date_text")).alias("clean"))


def _date_query(formats: list[str], iso_fallback: bool):
    def query(v: Views) -> DataFrame:
        day = parse_clean_date(F.col("clean"), formats, iso_fallback)
        return _clean_dates(v).select(*LINE_KEY, "date_text", day.alias("day"))

    return query


def dates_by_format(v: Views) -> DataFrame:
    return _clean_dates(v).select(*LINE_KEY, "date_text", *[
        parse_clean_date(F.col("clean"), f["date_formats"]).alias(f"day_{key}") for key, f in registry.FORMATS.items()
    ])


def raw_rows(v: Views) -> DataFrame:
    names = ["item_text", "price_text", "date_text", "order_id"]
    return v.view("dirty").select(
        *LINE_KEY, row_json(F.array(*map(F.lit, names)), F.array(*names)).alias("raw_data")
    )


def _item_lines(v: Views) -> DataFrame:
    return normalize.parse_item_lines(v.view("item_lines"), F.lit(AS_OF.date()))


def item_lines(v: Views) -> DataFrame:
    return _item_lines(v).select(
        "row_id", "status", "category", "name", "brand", "is_consumable", "estimated_lifespan_days", "last_replenished"
    )


def item_line_rejects(v: Views) -> DataFrame:
    return _item_lines(v).filter(F.col("status").isin("no_category", "unknown_category")).select("row_id", "status")


def item_line_statistics(v: Views) -> DataFrame:
    return _item_lines(v).filter("status = 'accepted'").groupBy("category").agg(F.count("*").alias("items"))


def scanned_item_lines(v: Views) -> DataFrame:
    """Item lines written as text files and scanned from there, with the totals of the load."""
    folder = scratch_dir(v.spark)
    v.view("item_lines").select("value").write.text(folder)
    lines = normalize.parse_item_lines(read_item_lines(v.spark, folder), F.lit(AS_OF.date()))
    return lines.rollup("status", "category").agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"), F.count("brand").alias("n_brands"),
    ).filter("status IS NOT NULL OR category IS NULL")


def new_possessions(v: Views) -> DataFrame:
    lines = _item_lines(v).filter("status = 'accepted'")
    registered_early = F.col("created_at") < F.lit("2001-02-01").cast("timestamp")
    owned = v.possessions.filter(registered_early).select(F.substring("name", 1, 8).alias("name"), "category")
    return dedupe.accept_possessions(lines, owned, ["row_id"]).select("row_id", "name", "category", "brand")


def consumable_defaults(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, [*schemas.KIND_LIFESPANS, "lamp"]))
    kind = F.get(kinds, (F.col("p_partkey") % F.size(kinds)).cast("int"))
    return v.table("part").select("p_partkey", kind.alias("kind")).withColumn(
        "days", normalize.lifespan_of_kind(F.col("kind"))
    )


# --- headers ----------------------------------------------------------------------------------

def _header_files(v: Views) -> DataFrame:
    return v.view("header_lines").withColumn("header", headers.split_header(F.col("line")))


def format_scores(v: Views) -> DataFrame:
    files = headers.score_formats(_header_files(v), registry.FORMATS)
    return files.select(
        "file_id", F.get("matches.key", F.col("detected")).alias("detected"),
        *[F.get("matches.score", F.lit(i)).alias(f"score_{key}") for i, key in enumerate(registry.FORMATS)],
    )


POSITIONS = [f"{m}_at" for m in headers.MEANINGS]


def header_mapping(v: Views) -> DataFrame:
    return headers.map_by_registry(_header_files(v), registry.FORMATS).select("file_id", "format_key", "source", *POSITIONS)


def header_mapping_forced(v: Views) -> DataFrame:
    files = headers.map_by_registry(_header_files(v), registry.FORMATS, format_key="walmart", source="my_store")
    return files.select("file_id", "format_key", "source", *POSITIONS)


def shop_a_mapping(v: Views) -> DataFrame:
    return headers.map_shop_a(_header_files(v)).select("file_id", "variant", *POSITIONS[:-1])


def shop_b_mapping(v: Views) -> DataFrame:
    return headers.map_shop_b(_header_files(v)).select("file_id", "variant", *POSITIONS[:-1])


def statement_mapping(v: Views) -> DataFrame:
    return headers.map_statement(_header_files(v)).select("file_id", *POSITIONS[:-1])


# --- duplicates and import --------------------------------------------------------------------

HISTORY_END = "1999-01-01"


def _batch(v: Views) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Staged rows cut by ship date into a batch and the history it is compared with."""
    staged = v.view("staged")
    is_history = F.col("l_shipdate") < F.lit(HISTORY_END).cast("timestamp_ntz")
    batch = dedupe.drop_empty(staged.filter(~is_history))
    return batch, staged.filter(is_history), ROW_KEY


STAGED = [*LINE_KEY, "source", "item_name", "price", "purchase_date", "order_id"]


def empty_rows_dropped(v: Views) -> DataFrame:
    return dedupe.drop_empty(v.view("staged")).select(*STAGED)


def new_by_order_id(v: Views) -> DataFrame:
    return dedupe.accept_by_order(*_batch(v)).select(*STAGED)


def new_purchases(v: Views) -> DataFrame:
    return dedupe.accept_new(*_batch(v)).select(*STAGED)


def pruned_new_purchases(v: Views) -> DataFrame:
    """As ``new_purchases``, with the history appended in batches by ship year and compared only where its files' key filters
    meet the new rows."""
    batch, history, order = _batch(v)
    path = f"{scratch_dir(v.spark)}/purchase_history"
    schema = history.select(*dedupe.COMPOSITE_KEY, "order_id").schema
    staged = write_and_reload(history)
    year = F.year("l_shipdate")
    for first, last in ((0, 1994), (1995, 1996), (1997, 1997), (1998, 9999)):
        part = staged.filter(year.between(first, last))
        pruning.append_with_filters(part, path, schema, f"to {last}", Q.at(AS_OF), keep_ids=True)
    batch = write_and_reload(batch)
    return dedupe.accept_new(batch, pruning.read_matching(v.spark, path, schema, batch), order).select(*STAGED)


def new_purchase_counts(v: Views) -> DataFrame:
    batch, history, order = _batch(v)
    accepted = dedupe.accept_new(batch, history, order).groupBy("source").agg(F.count("*").alias("imported"))
    return batch.groupBy("source").agg(F.count("*").alias("n")).join(accepted, "source", "left").select(
        "source", F.coalesce("imported", F.lit(0)).alias("imported"),
        (F.col("n") - F.coalesce("imported", F.lit(0))).alias("skipped"),
    )


SEARCHED = ("name", "brand", "notes", "location")
SEARCHES = (
    (("name", "brand", "notes"), "%ring%"), (("location",), "%KITCHEN%"), (("name",), "%re%green%"), (("notes",), "spare%steel piece"),
    (("name", "notes"), "%no such text%"), (("brand",), "%#_4%"),
)


def _with_trigrams(v: Views) -> str:
    """Folder of the possessions, appended in three batches with their trigram lists; one batch is first published wrong."""
    path = f"{scratch_dir(v.spark)}/possessions"
    rows = write_and_reload(v.possessions)
    wrong = rows.withColumns({"name": F.lit("string ring"), "location": F.lit("kitchen")})
    for batch_id, part in (("new", wrong.filter("condition = 'new'")), ("good", rows.filter("condition = 'good'")),
                           ("worn", rows.filter("condition IN ('fair', 'poor')")), ("new", rows.filter("condition = 'new'"))):
        substrings.append_with_trigrams(part, path, schemas.POSSESSIONS, batch_id, F.col("created_at"), SEARCHED, keep_ids=True)
    return path


def indexed_search(v: Views) -> DataFrame:
    """As ``search_free_text``, by trigram lists."""
    found = substrings.search(v.spark, _with_trigrams(v), schemas.POSSESSIONS, *SEARCHES[0])
    return _plain_times(found.drop("batch_id"))


def search_shares(v: Views) -> DataFrame:
    """For each search the rows of the table, those its trigrams leave to look at, and those found."""
    path = _with_trigrams(v)
    n = F.count("*").alias("n")

    def one(fields: tuple[str, ...], pattern: str) -> DataFrame:
        left = substrings.candidates(v.spark, path, fields, pattern)
        found = substrings.search(v.spark, path, schemas.POSSESSIONS, fields, pattern)
        everything = load.read_table(v.spark, path, schemas.POSSESSIONS)
        counts = [(everything, "rows"), (everything if left is None else left, "candidates"), (found, "found")]
        return reduce(DataFrame.unionByName, [
            df.agg(n).select(F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind"), "n") for df, kind in counts])

    return reduce(DataFrame.unionByName, [one(fields, pattern) for fields, pattern in SEARCHES])


IMPORTED = ["source", "item_name", "price", "currency", "purchase_date", "order_id", "category"]


def import_folder(v: Views) -> DataFrame:
    importer = normalize.registry_importer(registry.FORMATS, registry.SYMBOLS)
    return load.import_exports(v.spark, exports.landing_folder(v), None, importer).accepted.select(*IMPORTED, "raw_data")


def import_folder_statistics(v: Views) -> DataFrame:
    importer = normalize.registry_importer(registry.FORMATS, registry.SYMBOLS)
    done = load.import_exports(v.spark, exports.landing_folder(v), None, importer)
    return done.statistics.groupBy("format_key").agg(
        F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"), F.sum("errors").alias("errors")
    )


def import_shop_a(v: Views) -> DataFrame:
    done = load.import_exports(v.spark, exports.landing_folder(v), None, normalize.shop_a_importer())
    return done.accepted.select(*IMPORTED[:-1])


def import_shop_a_rejects(v: Views) -> DataFrame:
    """Folders whose files the importer of one shop sets aside, with the reason."""
    done = load.import_exports(v.spark, exports.landing_folder(v), None, normalize.shop_a_importer())
    folder = F.element_at(F.split("file_path", "/"), -2)
    return done.rejected.select(folder.alias("folder"), "reason").distinct()


def import_short_rows(v: Views) -> DataFrame:
    """The whole folder is imported; shown are the store's counts, whose files have short rows."""
    importer = normalize.registry_importer(registry.FORMATS, registry.SYMBOLS)
    done = load.import_exports(v.spark, exports.short_row_folder(v), None, importer)
    return done.statistics.filter("format_key = 'shopify'").groupBy("format_key").agg(
        F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"), F.sum("errors").alias("errors")
    )


def _of_folders(rows: DataFrame, *names: str) -> DataFrame:
    return rows.filter(F.element_at(F.split("file_path", "/"), -2).isin(*names))


def import_shop_b(v: Views) -> DataFrame:
    """Every purchase in the shop's own files; foreign files are imported too as far as their headers allow, shown are
    those of the two folders that share headers with the shop's."""
    done = load.import_exports(v.spark, exports.other_shop_folder(v), None, normalize.shop_b_importer())
    return _of_folders(done.accepted, *[exports.LAYOUTS[i][0] for i in (0, 1, 5, 6)]).select(*IMPORTED[:-1])


def import_shop_a_english(v: Views) -> DataFrame:
    """Japanese and English files of one shop beside foreign, undecodable and empty ones."""
    done = load.import_exports(v.spark, exports.mixed_folder(v), None, normalize.shop_a_importer())
    return done.accepted.select(*IMPORTED[:-1])


def import_mixed_rejects(v: Views) -> DataFrame:
    """Folders whose files are set aside, with the reason."""
    done = load.import_exports(v.spark, exports.mixed_folder(v), None, normalize.shop_a_importer())
    folder = F.element_at(F.split("file_path", "/"), -2)
    return done.rejected.select(folder.alias("folder"), "reason").distinct()


def import_format_names(v: Views) -> DataFrame:
    """Rows imported per format, by the name the registry shows."""
    importer = normalize.registry_importer(registry.FORMATS, registry.SYMBOLS)
    done = load.import_exports(v.spark, exports.landing_folder(v), None, importer)
    return done.statistics.groupBy("format_name").agg(F.sum("imported").alias("imported"))


def import_statement(v: Views) -> DataFrame:
    """Foreign files are imported too as far as their headers allow; shown are the rows of the statement's folder."""
    done = load.import_exports(v.spark, exports.landing_folder(v), None, normalize.statement_importer())
    return _of_folders(done.accepted, exports.LAYOUTS[4][0]).select(*IMPORTED[:-1])


def _bought(v: Views) -> DataFrame:
    """The purchases, written once for several batches: each would join the three tables again."""
    return write_and_reload(v.purchases.select(*[f.name for f in schemas.PURCHASE_HISTORY.fields if f.name in v.purchases.columns]))


def appended_purchases(v: Views) -> DataFrame:
    """Two batches appended to a table, the second one twice: a rerun replaces its own rows."""
    path = f"{scratch_dir(v.spark)}/purchase_history"
    rows, now = _bought(v), Q.at(AS_OF)
    early = F.col("purchase_date") < F.lit("1998-01-01").cast("date")
    for batch_id, part in (("b1", rows.filter(early)), ("b2", rows.filter(~early)), ("b2", rows.filter(~early))):
        load.append_batch(part, path, schemas.PURCHASE_HISTORY, batch_id, now, partition="source")
    table = load.read_table(v.spark, path, schemas.PURCHASE_HISTORY)
    return table.groupBy("batch_id", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("id").isNotNull()).alias("n_ids"), F.round(F.sum("price"), 2).alias("total")
    )


def spending_kept_up(v: Views) -> DataFrame:
    """Spending from the sums kept with each batch; the second batch is first published wrong, then replaced."""
    path = f"{scratch_dir(v.spark)}/purchase_history"
    rows, now = _bought(v), Q.at(AS_OF)
    early = F.col("purchase_date") < F.lit("2001-06-01").cast("date")
    wrong = rows.filter(~early).withColumn("price", F.col("price") * 2)
    for batch_id, part in (("b1", rows.filter(early)), ("b2", wrong), ("b2", rows.filter(~early))):
        rollups.append_with_sums(part, path, batch_id, now)
    sums = rollups.read_sums(v.spark, path)
    none = F.lit(None).cast("string")

    def section(rows: DataFrame, name: str, label: Column, unit: Column, items: str = "items", total: str = "total") -> DataFrame:
        return rows.select(F.lit(name).alias("section"), label.alias("label"), unit.alias("unit"), F.col(items).alias("items"), F.col(total).alias("total"))

    trend = Q.month_over_month(sums, AS_OF)
    return reduce(DataFrame.unionByName, [
        section(Q.spend_by_source_month(sums, AS_OF), "source", F.col("source"), F.col("currency")),
        section(Q.spend_by_category_month(sums, v.possessions, AS_OF), "category", F.col("category"), none),
        section(Q.spend_monthly_trend(sums, AS_OF), "month", F.col("month"), none),
        section(Q.health_spend_month(sums, AS_OF), "health", none, F.col("currency")),
        section(Q.weekly_spend_report(sums, AS_OF), "week", F.col("source"), F.col("currency")),
        section(trend, "previous month", none, F.col("currency"), "previous_items", "previous_total"),
        section(trend, "current month", none, F.col("currency"), "current_items", "current_total"),
    ])


# --- receipts ---------------------------------------------------------------------------------

def _scans(v: Views) -> DataFrame:
    words = F.split("ocr_text", " ")
    confidence = F.transform(words, lambda w: F.when(F.length(w) % 7 == 0, F.lit("x")).otherwise(
        (F.length(w) * 13 % 101 - 1).cast("string")))
    return v.view("ocr").withColumns({
        "confidences": confidence, "image_hash": content_hash(F.col("ocr_text").cast("binary")),
    })


def receipt_fields(v: Views) -> DataFrame:
    return receipts.extract(_scans(v)).select(
        "image_path", "store_name", "receipt_date_text", "receipt_date", "total_amount", "currency",
        F.size("items").alias("n_items"),
    )


def receipt_items(v: Views) -> DataFrame:
    # The outer form: for the inner one Spark adds a filter that would extract the items once more.
    rows = receipts.extract(_scans(v)).select("image_path", F.inline_outer("items")).filter("name IS NOT NULL")
    return rows.groupBy("image_path", "name", "price").agg(F.count("*").alias("n"))


def receipt_confidence(v: Views) -> DataFrame:
    return receipts.extract(_scans(v)).select(
        "image_path", F.round("ocr_confidence", 6).alias("ocr_confidence"), "status"
    )


def image_hashes(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", content_hash(F.col("text").cast("binary")).alias("image_hash"))


def _new_scans(v: Views) -> DataFrame:
    scans = write_and_reload(receipts.extract(_scans(v)))
    # Stored before: receipts without a printed day, some under an older path, the others with another content.
    moved = F.contains("ocr_text", F.lit("BALANCE"))
    stored = scans.filter(F.contains("ocr_text", F.lit("no day printed"))).select(
        F.when(moved, F.concat(F.lit("old/"), "image_path")).otherwise(F.col("image_path")).alias("image_path"),
        F.when(moved, F.col("image_hash")).otherwise(F.lit("changed")).alias("image_hash"),
    )
    return receipts.accept_scans(scans, write_and_reload(stored), "row_id")


def new_receipts(v: Views) -> DataFrame:
    return _new_scans(v).select("image_path", "image_hash")


def receipt_purchases(v: Views) -> DataFrame:
    accepted = _new_scans(v).withColumn("receipt_id", F.col("row_id"))
    stored, items, purchases = receipts.fan_out(accepted, Q.at(AS_OF))
    return purchases.groupBy("raw_data", "item_name", "price", "currency", "purchase_date", "source").agg(F.count("*").alias("n"))


def receipt_tables(v: Views) -> DataFrame:
    accepted = _new_scans(v).withColumn("receipt_id", F.col("row_id"))
    tables = receipts.fan_out(accepted, Q.at(AS_OF))
    counted = [
        t.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, t in zip(("receipt_scans", "receipt_items", "purchase_history"), tables)
    ]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


def _loaded(v: Views) -> dict[str, DataFrame]:
    """Two batches of new scans loaded into the three tables, the first one twice."""
    accepted, folder = write_and_reload(_new_scans(v)), scratch_dir(v.spark)
    even = F.col("row_id") % 2 == 0
    for batch_id, part in (("b1", accepted.filter(even)), ("b2", accepted.filter(~even)), ("b1", accepted.filter(even))):
        receipts.load_receipts(part, folder, batch_id, Q.at(AS_OF))
    return receipts.read_receipts(v.spark, folder)


def loaded_receipts(v: Views) -> DataFrame:
    """Items with the receipt and the purchase that their keys name."""
    tables = _loaded(v)
    items = tables["receipt_items"].select("receipt_id", "purchase_history_id", "item_name", "price")
    scans = tables["receipt_scans"].select(F.col("id").alias("receipt_id"), "image_path")
    bought = tables["purchase_history"].select(
        F.col("id").alias("purchase_history_id"), F.col("item_name").alias("bought"), F.col("price").alias("paid"))
    return items.join(scans, "receipt_id").join(bought, "purchase_history_id").filter("item_name = bought").groupBy("image_path").agg(
        F.count("*").alias("n"), F.countDistinct("purchase_history_id").alias("n_purchases"), F.round(F.sum("paid"), 2).alias("total"))


def receipt_key_violations(v: Views) -> DataFrame:
    """Both keys of the items, some of them broken."""
    tables = _loaded(v)
    whole = F.col("price") % 2 == 0
    tables["receipt_items"] = tables["receipt_items"].withColumns({
        "receipt_id": F.when(whole, -F.col("receipt_id")).otherwise(F.col("receipt_id")),
        "purchase_history_id": F.when(~whole, -F.col("purchase_history_id")).otherwise(F.col("purchase_history_id")),
    })
    return quality.check_all(tables).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


def scanned_receipts(v: Views) -> DataFrame:
    """OCR results written as JSON lines and scanned from there."""
    folder = scratch_dir(v.spark)
    scans = _scans(v)
    words = F.transform("confidences", lambda c: F.struct(F.lit("w").alias("text"), c.alias("conf")))
    scans.select("image_path", "image_hash", "ocr_text", words.alias("words")).write.json(folder, compression="gzip")
    return receipts.extract(read_ocr_results(v.spark, folder)).select(
        "image_path", "image_hash", "store_name", "receipt_date", "total_amount", "currency", F.size("items").alias("n_items"),
        F.round("ocr_confidence", 6).alias("ocr_confidence"), "status")


# --- detections -------------------------------------------------------------------------------

def detected_items(v: Views) -> DataFrame:
    return parse_detections(v.view("frames"))[0].groupBy("session_id", "name", "category", "condition", "location").agg(
        F.count("*").alias("n")
    )


def unreadable_detections(v: Views) -> DataFrame:
    return parse_detections(v.view("frames"))[1].groupBy("session_id").agg(F.count("*").alias("n"))


def consolidated_items(v: Views) -> DataFrame:
    items, _ = parse_detections(v.view("frames"))
    return detections.consolidate(items, v.view("sessions"))


def _misread_items(v: Views) -> DataFrame:
    return parse_detections(v.view("misread_frames"))[0]


def similar_items(v: Views) -> DataFrame:
    return detections.consolidate_similar(_misread_items(v), v.view("talking_sessions"))


def spoken_items(v: Views) -> DataFrame:
    names = _misread_items(v).select("session_id", detections.normal_form(F.col("name")).alias("name_key"))
    return detections.spoken_names(names, v.view("talking_sessions"))


def video_sessions(v: Views) -> DataFrame:
    return _plain_times(detections.session_records(v.view("sessions"), Q.at(AS_OF)))


# --- state ------------------------------------------------------------------------------------

def _registered(v: Views) -> tuple[DataFrame, DataFrame]:
    new = v.table("part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("gadget")).when(F.col("p_partkey") % 9 == 1, F.lit("supplement"))
        .when(F.col("p_partkey") % 9 == 2, F.lit("food")).when(F.col("p_partkey") % 9 == 3, F.lit("consumable"))
        .otherwise("kitchen").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("purchase_price"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("new")).when(F.col("p_partkey") % 40 == 1, F.lit("broken")).alias("condition"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(True)).cast("boolean").alias("is_consumable"),
        F.when(F.col("p_partkey") % 11 == 0, F.col("p_size")).alias("estimated_lifespan_days"),
        F.when(F.col("p_partkey") % 9 == 3, F.lit("shampoo")).alias("kind"),
    )
    return state.register(new, Q.at(AS_OF))


def registered_possessions(v: Views) -> DataFrame:
    return _registered(v)[0].select(
        "p_partkey", "name", "category", "purchase_price", "condition", "is_consumable", "estimated_lifespan_days")


def refused_possessions(v: Views) -> DataFrame:
    return _registered(v)[1].select("p_partkey", "reason")


def appended_possessions(v: Views) -> DataFrame:
    """A snapshot with the registered rows added: the old ids stay, the new ones follow without gaps."""
    both = state.append_possessions(v.possessions, _registered(v)[0])
    added = both.join(v.possessions.select("id"), "id", "left_anti")
    return added.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids")).unionByName(
        added.agg(F.lit("all").alias("category"), F.count("*").alias("n"), (F.max("id") - F.min("id") + 1).alias("n_ids")))


def _changes(v: Views) -> DataFrame:
    # Each order changes the possession its total points at; later orders win.
    line = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey")
    return line.select(
        F.col("l_partkey").alias("id"),
        F.when(F.col("l_linenumber") % 3 == 0, "location").when(F.col("l_linenumber") % 3 == 1, "purchase_price")
        .otherwise("estimated_lifespan_days").alias("column_name"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("o_orderpriority"))
        .when(F.col("l_linenumber") % 3 == 1, F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") * 2).cast("string")))
        .otherwise((F.col("o_custkey") % 100).cast("string")).alias("value"),
        seq.alias("seq"),
    )


def updated_possessions(v: Views) -> DataFrame:
    snapshot, _ = state.update(v.possessions, _changes(v))
    return snapshot.select("id", "name", "location", "purchase_price", "estimated_lifespan_days")


def refused_changes(v: Views) -> DataFrame:
    """Every seventh order names a column that does not exist or sends a value its column must not hold."""
    order = F.floor(F.col("seq") / 100_000_000)
    fault = F.when(order % 7 == 0, order % 5)  # NULL for the changes sent as they are
    sent = _changes(v).withColumns({
        "id": F.when((order % 7 == 0) & (order % 2 == 1), -F.col("id")).otherwise(F.col("id")),
        "column_name": F.when(fault == 0, "colour").when(fault == 1, "condition").when(fault == 2, "name")
        .otherwise(F.col("column_name")),
        "value": F.when(fault == 1, "broken").when(fault == 2, F.lit(None)).when(fault == 3, "a few").otherwise(F.col("value")),
    })
    return state.update(v.possessions, sent)[1].select("id", "column_name", "value", "seq", "reason")


def remaining_possessions(v: Views) -> DataFrame:
    gone = v.table("lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return state.delete(v.possessions, gone).select("id", "name", "category")


def _raw_events(v: Views) -> DataFrame:
    return v.table("events").select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 13 != 0, F.col("user_id")).alias("possession_id"),
        F.when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "purchase", "empty")
        .otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("logged_at"),
    )


def _owned_by_some(v: Views) -> DataFrame:
    return v.possessions.filter("id % 10 <> 3")


def logged_events(v: Views) -> DataFrame:
    accepted, _ = state.log_events(_raw_events(v), _owned_by_some(v), Q.at(LOG_AS_OF))
    return _plain_times(accepted.select("id", "possession_id", "event_type", "logged_at"))


def refused_events(v: Views) -> DataFrame:
    return state.log_events(_raw_events(v), _owned_by_some(v), Q.at(LOG_AS_OF))[1].select("id", "possession_id", "event_type", "reason")


def replenished_possessions(v: Views) -> DataFrame:
    return state.apply_events(v.possessions, v.log).select("id", "name", "last_replenished")


def latest_status(v: Views) -> DataFrame:
    return _plain_times(state.latest_status(v.log))


def _as_log(events: DataFrame) -> DataFrame:
    """Raw events as a consumption log, by the same SQL as the batch view."""
    return events.sparkSession.sql(VIEWS["consumption_log"], events=events)


def streamed_latest_status(v: Views) -> DataFrame:
    log = streamed.event_stream(v.spark, v.folder, v.table("events").schema, pathGlobFilter="events.parquet")
    return _plain_times(streamed.run_to_table(_as_log(log), state.latest_status))


def streamed_replenishment(v: Views) -> DataFrame:
    log = streamed.event_stream(v.spark, v.folder, v.table("events").schema, pathGlobFilter="events.parquet")
    return streamed.run_to_table(_as_log(log), state.replenished_days)


def streamed_new_by_order_id(v: Views) -> DataFrame:
    """The order-id rule with the orders seen as state of a stream, which starts from the history's."""
    batch, history, order = _batch(v)
    folder = scratch_dir(v.spark)
    batch.write.parquet(f"{folder}/in")
    rows = v.spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
    firsts = stateful.first_orders(rows, list(order), write_and_reload(history))
    return stateful.run_to_end(firsts, f"{folder}/out").select(*STAGED)


def streamed_lifespan_alerts(v: Views) -> DataFrame:
    """Timers set by replacements in the log and lifespans of the possessions, up to ALERTS_AS_OF."""
    folder = scratch_dir(v.spark)
    now = Q.at(ALERTS_AS_OF)
    owned = v.possessions.filter("is_consumable AND estimated_lifespan_days IS NOT NULL").select(
        F.col("id").alias("possession_id"), F.col("estimated_lifespan_days").alias("lifespan_days"),
        F.lit(None).cast("timestamp").alias("replenished_at"), F.lit("2000-01-01").cast("timestamp").alias("seen_at"))
    replaced = v.log.filter((F.col("event_type") == "replaced") & (F.col("logged_at") <= now)).select(
        "possession_id", F.lit(None).cast("int").alias("lifespan_days"), F.col("logged_at").alias("replenished_at"), F.col("logged_at").alias("seen_at"))
    clock = v.spark.range(1).select(
        F.lit(-1).cast("long").alias("possession_id"), F.lit(None).cast("int").alias("lifespan_days"),
        F.lit(None).cast("timestamp").alias("replenished_at"), now.alias("seen_at"))
    owned.unionByName(replaced).unionByName(clock).write.parquet(f"{folder}/in")
    changes = v.spark.readStream.schema(owned.schema).parquet(f"{folder}/in").withWatermark("seen_at", "0 seconds")
    return stateful.run_to_end(stateful.lifespan_alerts(changes), f"{folder}/out")


def _marked(v: Views, marks: tuple[cycles.Mark, ...], learned: bool) -> DataFrame:
    """Marks that stand at ALERTS_AS_OF by the consumables and the whole log, replayed as a stream."""
    folder = scratch_dir(v.spark)
    now = Q.at(ALERTS_AS_OF)
    owned = v.possessions.filter("is_consumable").select(
        F.col("id").alias("possession_id"), F.lit(cycles.POSSESSION).alias("change"),
        F.col("estimated_lifespan_days").cast("int").alias("lifespan_days"), F.lit("2000-01-01").cast("timestamp").alias("at"))
    logged = v.log.filter(F.col("logged_at") <= now).select(
        "possession_id", F.col("event_type").alias("change"), F.lit(None).cast("int").alias("lifespan_days"), F.col("logged_at").alias("at"))
    clock = v.spark.range(1).select(
        F.lit(-1).cast("long").alias("possession_id"), F.lit("time").alias("change"), F.lit(None).cast("int").alias("lifespan_days"), now.alias("at"))
    owned.unionByName(logged).unionByName(clock).write.parquet(f"{folder}/in")
    changes = v.spark.readStream.schema(owned.schema).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
    return cycles.standing(stateful.run_to_end(cycles.mark_changes(changes, marks, learned), f"{folder}/out"))


def streamed_learned_alerts(v: Views) -> DataFrame:
    """Alerts by learned cycles, from keyed state and timers."""
    found = _marked(v, (cycles.REPLENISH,), True)
    return found.select("possession_id", "last_replenished", F.round("cycle_days", 6).alias("cycle_days"), "is_learned")


def streamed_due_items(v: Views) -> DataFrame:
    """What is to be replenished, runs out within a week or has run out, by default lifespans."""
    found = _marked(v, (cycles.REPLENISH, cycles.DUE_WEEK, cycles.EMPTY), False)
    return found.select("possession_id", "last_replenished", "marks")


# --- quality ----------------------------------------------------------------------------------

def _checked(v: Views) -> dict[str, DataFrame]:
    """Tables with faults: unmapped categories and events, missing names, references without parents."""
    order = F.col("l_orderkey")
    part = F.col("id") % 9 == 0
    owned = v.possessions.withColumns({
        "category": F.when(part, F.lit("gadget")).otherwise(F.col("category")),
        "name": F.when(F.col("id") % 25 != 0, F.col("name")),
    })
    log = v.table("events").select(
        F.col("event_id").alias("id"), (F.col("user_id") * F.when(F.col("event_id") % 23 == 0, -1).otherwise(1)).alias("possession_id"),
        F.when(F.col("event_type") == "view", "opened").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 40 != 0, F.col("ts").cast("timestamp")).alias("logged_at"),
    )
    bought = v.purchases.select(
        (order * 100 + F.col("l_linenumber")).alias("id"), "source",
        (F.col("possession_id") * F.when(order % 17 == 0, -1).otherwise(1)).alias("possession_id"),
        F.when(F.col("l_orderkey") % 30 != 0, F.col("currency")).alias("currency"),
    )
    return {"possessions": owned, "consumption_log": log, "purchase_history": bought}


def enum_violations(v: Views) -> DataFrame:
    tables = _checked(v)
    found = [quality.check_enum(tables[t], t, c, members) for t, c, members in schemas.ENUMS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def null_violations(v: Views) -> DataFrame:
    tables = _checked(v)
    found = quality.check_not_null(tables["possessions"], "possessions", ["name", "condition"])
    found = found.unionByName(quality.check_not_null(tables["consumption_log"], "consumption_log", ["logged_at", "event_type"]))
    return found.unionByName(quality.check_not_null(tables["purchase_history"], "purchase_history", ["source", "currency"]))


def foreign_key_violations(v: Views) -> DataFrame:
    tables = _checked(v)
    found = quality.check_foreign_key(tables["purchase_history"], "purchase_history", "possession_id", tables["possessions"])
    return found.unionByName(
        quality.check_foreign_key(tables["consumption_log"], "consumption_log", "possession_id", tables["possessions"])
    )


def key_violations(v: Views) -> DataFrame:
    return quality.check_unique(_checked(v)["purchase_history"], "purchase_history")


def violation_counts(v: Views) -> DataFrame:
    return quality.check_all(_checked(v)).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


def filled_defaults(v: Views) -> DataFrame:
    rows = _checked(v)["purchase_history"].select("id", "source", "currency")
    return _plain_times(quality.fill_defaults(rows, "purchase_history", Q.at(AS_OF))).groupBy(
        "source", "currency", "created_at"
    ).agg(F.count("*").alias("n"))


def custom_sources(v: Views) -> DataFrame:
    """A source name that no table knows goes through the import and into the table."""
    importer = normalize.registry_importer(registry.FORMATS, registry.SYMBOLS, source="corner shop")
    done = load.import_exports(v.spark, exports.landing_folder(v), None, importer)
    path = f"{scratch_dir(v.spark)}/purchase_history"
    load.append_batch(done.accepted, path, schemas.PURCHASE_HISTORY, "b1", Q.at(AS_OF), partition="source")
    return load.read_table(v.spark, path, schemas.PURCHASE_HISTORY).select(*IMPORTED)


def backfilled_purchases(v: Views) -> DataFrame:
    """A migration run twice: the second run finds rows and copies nothing."""
    old = v.purchases.select("source", "item_name", "price")
    once = quality.backfill(old, old.limit(0))
    twice = quality.backfill(old, once)
    return twice.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


def recorded_versions(v: Views) -> DataFrame:
    """A version for each ship year; years before 1997 were recorded before, at their first day of shipping."""
    shipped = v.table("lineitem").select(
        F.concat(F.lit("v"), F.year("l_shipdate").cast("string")).alias("version"), F.col("l_shipdate").cast("timestamp_ntz").alias("applied_at"))
    old = shipped.filter(F.col("version") < "v1997").groupBy("version").agg(F.min("applied_at").alias("applied_at"))
    once = quality.record_versions(old, shipped.withColumn("applied_at", F.col("applied_at") + F.expr("INTERVAL 1 DAY")))
    return quality.record_versions(once, shipped)


def evolved_scans(v: Views) -> DataFrame:
    old = v.view("ocr").filter("row_id >= 0").select("row_id", "image_path")
    new = _scans(v).filter("row_id < 0").select("row_id", "image_path", "image_hash")
    return quality.evolve(old, new)


QUERIES = {
    # spending
    "spend_by_source_month": lambda v: Q.spend_by_source_month(v.purchases, AS_OF),
    "spend_by_category_month": lambda v: Q.spend_by_category_month(v.purchases, v.possessions, AS_OF),
    "spend_monthly_trend": lambda v: Q.spend_monthly_trend(v.purchases, AS_OF),
    "health_spend_month": lambda v: Q.health_spend_month(v.purchases, AS_OF),
    "weekly_spend_report": lambda v: Q.weekly_spend_report(v.purchases, AS_OF),
    "month_over_month": lambda v: Q.month_over_month(v.purchases, AS_OF),
    "recurring_purchases": lambda v: Q.recurring_purchases(v.purchases, AS_OF),
    "wasteful_purchases": lambda v: Q.wasteful_purchases(v.purchases, AS_OF),
    # consumables
    "consumables_alert": lambda v: Q.consumables_alert(v.possessions, AS_OF),
    "consumables_due_week": lambda v: Q.consumables_due_week(v.possessions, AS_OF),
    "consumable_status_daily": lambda v: reports.daily_consumable_check(v.possessions, AS_OF),
    "consumption_cycle": lambda v: Q.consumption_cycle(v.log, v.possessions),
    "replenish_forecast_learned": lambda v: Q.replenish_forecast_learned(v.possessions, v.log, AS_OF),
    "shopping_list": lambda v: reports.weekly_purchase_suggestion(v.purchases, v.possessions, AS_OF),
    "stock_vs_activity": lambda v: Q.stock_vs_activity(v.possessions, v.view("activity"), LOG_AS_OF),
    # possessions
    "possessions_by_category": lambda v: Q.possessions_by_category(v.possessions),
    "possessions_by_location": lambda v: Q.possessions_by_location(v.possessions),
    "latest_possessions": lambda v: _plain_times(Q.latest_possessions(v.possessions)),
    "search_by_category": lambda v: _plain_times(Q.search_by_category(v.possessions, "kitchen")),
    "search_by_location": lambda v: _plain_times(Q.search_by_location(v.possessions, "%KITCHEN%")),
    "indexed_search": indexed_search,
    "search_shares": search_shares,
    "search_free_text": lambda v: _plain_times(Q.search_free_text(v.possessions, "%ring%")),
    "weekly_new_items": lambda v: Q.weekly_new_items(v.possessions, datetime(2001, 7, 18, 12)),
    "weekly_consumed": lambda v: Q.weekly_consumed(v.log, v.possessions, LOG_AS_OF),
    "weekly_life_report": lambda v: reports.weekly_life_report(v.purchases, v.possessions, v.log, AS_OF, LOG_AS_OF),
    # normalisation
    "price_and_currency": _price_query(
        lambda c: amount_of(c, registry.SYMBOLS), lambda c: currency_of(c, registry.SYMBOLS)),
    "price_basic_symbols": _price_query(amount_of, currency_of),
    "shop_a_price": _price_query(shop_a_amount),
    "shop_b_price": _price_query(shop_b_amount),
    "dates_by_format": dates_by_format,
    "shop_a_dates": _date_query(registry.SHOP_A_DATES, False),
    "shop_b_dates": _date_query(registry.SHOP_B_DATES, False),
    "statement_dates": _date_query(registry.STATEMENT_DATES, True),
    "raw_rows": raw_rows,
    "item_lines": item_lines,
    "item_line_rejects": item_line_rejects,
    "item_line_statistics": item_line_statistics,
    "scanned_item_lines": scanned_item_lines,
    "new_possessions": new_possessions,
    "consumable_defaults": consumable_defaults,
    # headers
    "format_scores": format_scores,
    "header_mapping": header_mapping,
    "header_mapping_forced": header_mapping_forced,
    "shop_a_mapping": shop_a_mapping,
    "shop_b_mapping": shop_b_mapping,
    "statement_mapping": statement_mapping,
    # duplicates and import
    "empty_rows_dropped": empty_rows_dropped,
    "new_by_order_id": new_by_order_id,
    "new_purchases": new_purchases,
    "pruned_new_purchases": pruned_new_purchases,
    "new_purchase_counts": new_purchase_counts,
    "import_folder": import_folder,
    "import_folder_statistics": import_folder_statistics,
    "import_shop_a": import_shop_a,
    "import_shop_a_rejects": import_shop_a_rejects,
    "import_shop_a_english": import_shop_a_english,
    "import_mixed_rejects": import_mixed_rejects,
    "import_format_names": import_format_names,
    "import_shop_b": import_shop_b,
    "import_short_rows": import_short_rows,
    "import_statement": import_statement,
    "appended_purchases": appended_purchases,
    "spending_kept_up": spending_kept_up,
    # receipts
    "receipt_fields": receipt_fields,
    "receipt_items": receipt_items,
    "receipt_confidence": receipt_confidence,
    "image_hashes": image_hashes,
    "new_receipts": new_receipts,
    "receipt_purchases": receipt_purchases,
    "receipt_tables": receipt_tables,
    "loaded_receipts": loaded_receipts,
    "receipt_key_violations": receipt_key_violations,
    "scanned_receipts": scanned_receipts,
    # detections
    "detected_items": detected_items,
    "unreadable_detections": unreadable_detections,
    "consolidated_items": consolidated_items,
    "similar_items": similar_items,
    "spoken_items": spoken_items,
    "video_sessions": video_sessions,
    # state
    "registered_possessions": registered_possessions,
    "refused_possessions": refused_possessions,
    "appended_possessions": appended_possessions,
    "refused_changes": refused_changes,
    "updated_possessions": updated_possessions,
    "remaining_possessions": remaining_possessions,
    "logged_events": logged_events,
    "refused_events": refused_events,
    "replenished_possessions": replenished_possessions,
    "latest_status": latest_status,
    "streamed_latest_status": streamed_latest_status,
    "streamed_replenishment": streamed_replenishment,
    "streamed_new_by_order_id": streamed_new_by_order_id,
    "streamed_lifespan_alerts": streamed_lifespan_alerts,
    "streamed_learned_alerts": streamed_learned_alerts,
    "streamed_due_items": streamed_due_items,
    # quality
    "enum_violations": enum_violations,
    "null_violations": null_violations,
    "foreign_key_violations": foreign_key_violations,
    "key_violations": key_violations,
    "violation_counts": violation_counts,
    "filled_defaults": filled_defaults,
    "custom_sources": custom_sources,
    "backfilled_purchases": backfilled_purchases,
    "recorded_versions": recorded_versions,
    "evolved_scans": evolved_scans,
}
