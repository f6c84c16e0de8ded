"""Cells of export rows to typed purchase rows."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard import registry
from cupboard.functions.dates import date_text, parse_clean_date
from cupboard.functions.money import amount_of, currency_of, shop_a_amount, shop_b_amount
from cupboard.functions.text import row_json, strip
from cupboard.operators import headers
from cupboard.schemas import DEFAULT_LIFESPAN, KIND_LIFESPANS, LINE_CATEGORIES, LINE_LIFESPANS


@dataclass(frozen=True)
class Importer:
    """What sets one importer apart: header mapping, value parsing and duplicate rules."""

    map_headers: Callable[..., DataFrame]
    amount: Callable[[Column], Column]
    currency: Callable[[Column], Column]
    date: Callable[[Column], Column]
    drops_empty_rows: bool
    compares_composite: bool
    needs_known_header: bool
    charsets: tuple[str, ...] = registry.CHARSETS


def _by_format(formats: dict) -> Callable[[Column], Column]:
    def date(raw: Column) -> Column:
        branches = F
        for key, definition in formats.items():
            parsed = parse_clean_date(raw, definition.get("date_formats", registry.DEFAULT_DATE_FORMATS))
            branches = branches.when(F.col("format_key") == key, parsed)
        return branches.otherwise(F.lit(None).cast("date"))

    return date


def registry_importer(
    formats: dict, symbols: dict, format_key: str | None = None, source: str | None = None,
    charsets: tuple[str, ...] = registry.CHARSETS,
) -> Importer:
    return Importer(
        charsets=charsets,
        map_headers=lambda files: headers.map_by_registry(files, formats, format_key, source),
        amount=lambda raw: amount_of(raw, symbols),
        currency=lambda raw: currency_of(raw, symbols),
        date=_by_format(formats),
        drops_empty_rows=True,
        compares_composite=True,
        needs_known_header=False,
    )


def shop_a_importer() -> Importer:
    return Importer(
        map_headers=lambda files: headers.map_shop_a(files).withColumn("format_key", F.lit("shop_a")),
        amount=shop_a_amount,
        currency=lambda raw: F.when(F.col("variant") == 1, "JPY").otherwise("USD"),
        date=lambda raw: parse_clean_date(raw, registry.SHOP_A_DATES, iso_fallback=False),
        drops_empty_rows=False,
        compares_composite=False,
        needs_known_header=True,
    )


def shop_b_importer() -> Importer:
    return Importer(
        map_headers=lambda files: headers.map_shop_b(files).withColumn("format_key", F.lit("shop_b")),
        amount=shop_b_amount,
        currency=lambda raw: F.lit("JPY"),
        date=lambda raw: parse_clean_date(raw, registry.SHOP_B_DATES, iso_fallback=False),
        drops_empty_rows=False,
        compares_composite=False,
        needs_known_header=True,
    )


def statement_importer(source: str = "credit_card") -> Importer:
    return Importer(
        map_headers=lambda files: headers.map_statement(files, source).withColumn("format_key", F.lit("statement")),
        amount=amount_of,
        currency=currency_of,
        date=lambda raw: parse_clean_date(raw, registry.STATEMENT_DATES),
        drops_empty_rows=True,
        compares_composite=True,
        needs_known_header=False,
    )


def to_purchases(rows: DataFrame, importer: Importer) -> DataFrame:
    """Typed purchase rows from ``cells`` and the position columns of a header mapping.

    A text column that a short row does not reach makes the row an error; a blank cell does not.
    """
    def cell(meaning: str) -> Column:
        at = F.col(f"{meaning}_at")
        # Blank cells come as NULL from the scan and count as empty text; cells past the row's end stay NULL.
        return F.when(at <= F.col("n_cells"), F.coalesce(F.get(F.col("cells"), at - 1), F.lit("")))

    def cut_off(meaning: str) -> Column:
        return F.coalesce(F.col(f"{meaning}_at") > F.col("n_cells"), F.lit(False))

    # First the texts, each read by several expressions below, then their values.
    texts = rows.select(
        *[c for c in rows.columns if not c.endswith("_at") and c not in ("cells", "overlong")],
        F.coalesce(strip(cell("item_name")), F.lit("")).alias("item_name"),
        F.coalesce(cell("price"), F.lit("")).alias("price_text"),
        date_text(cell("purchase_date")).alias("date_text"),
        F.nullif(strip(cell("order_id")), F.lit("")).alias("order_id"),
        F.nullif(strip(cell("category")), F.lit("")).alias("category"),
        _raw_row().alias("raw_data"),
        (cut_off("item_name") | cut_off("order_id") | cut_off("category")).alias("is_error"),
    )
    price = F.col("price_text")
    return texts.select(
        "file_path", "file_no", "file_block_start", "row_id", "format_key", "source", "item_name",
        importer.amount(price).alias("price"),
        importer.currency(price).alias("currency"),
        importer.date(F.col("date_text")).alias("purchase_date"),
        "order_id", "category", "raw_data", "is_error",
    )


def _raw_row() -> Column:
    """The row as JSON. Cells a short row lacks are null; the cells of an overlong row come along whole."""
    def held(at: Column) -> Column:
        return F.when(at <= F.col("n_cells"), F.coalesce(F.get(F.col("cells"), at - 1), F.lit("")))

    regular = F.col("repeated_at").isNull() & (F.col("n_cells") == F.size("cells"))
    at_all = F.coalesce("repeated_at", F.sequence(F.lit(1), F.size("header")))
    general = row_json(
        F.concat(
            F.transform(at_all, lambda at: F.get(F.col("header"), at - 1)),
            F.when(F.col("overlong").isNotNull(), F.array(F.lit("null"))).otherwise(F.array().cast("array<string>")),
        ),
        F.concat(
            F.transform(at_all, held),
            F.when(F.col("overlong").isNotNull(), F.array("overlong")).otherwise(F.array().cast("array<string>")),
        ),
    )
    return F.when(
        regular, row_json(F.col("header"), F.transform("cells", lambda cell: F.coalesce(cell, F.lit(""))))
    ).otherwise(general)


def parse_item_lines(lines: DataFrame, as_of_date: Column, column: str = "value") -> DataFrame:
    """``category:name[ / brand]`` lines to possessions, with a ``status``.

    Status is ``accepted``, ``no_category``, ``unknown_category`` or ``empty``.
    """
    line = strip(F.col(column))
    parts = F.split(line, ":", 2)
    category = F.lower(strip(parts[0]))
    body = strip(F.get(parts, 1))
    pieces = F.split(body, " / ", 2)
    has_brand = F.size(pieces) > 1
    name = F.when(has_brand, strip(pieces[0])).otherwise(body)
    status = (
        F.when(F.coalesce(line, F.lit("")) == "", "empty")
        .when(F.size(parts) < 2, "no_category")
        .when(~category.isin(*LINE_CATEGORIES), "unknown_category")
        .when(name == "", "empty")
        .otherwise("accepted")
    )
    parsed = lines.withColumns({"name": name, "category": category, "brand": F.when(has_brand, strip(F.get(pieces, 1))),
                                "status": status})
    return with_line_lifespan(parsed, as_of_date)


def _lookup(key: Column, values: dict[str, int]) -> Column:
    branches = F
    for name, number in values.items():
        branches = branches.when(key == name, F.lit(number))
    return branches.otherwise(F.lit(None).cast("int"))


def with_line_lifespan(items: DataFrame, as_of_date: Column) -> DataFrame:
    """Consumable flag and lifespan by category; a consumable counts as replenished on the load date."""
    lifespan = _lookup(F.col("category"), LINE_LIFESPANS)
    return items.withColumns({
        "is_consumable": F.coalesce(lifespan.isNotNull(), F.lit(False)),
        "estimated_lifespan_days": lifespan,
        "last_replenished": F.when(lifespan.isNotNull(), as_of_date),
    })


def lifespan_of_kind(kind: Column) -> Column:
    """Default lifespan in days by kind of consumable, 30 for any other kind."""
    return F.coalesce(_lookup(kind, KIND_LIFESPANS), F.lit(DEFAULT_LIFESPAN))
