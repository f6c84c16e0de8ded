"""Export formats: which header names carry which meaning, and how dates are written.

A format is ``{"name", "source_key", "columns": {meaning: [header, ...]}, "date_formats": [...]}``.
New formats are added as data, through ``load_formats``.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Header names, date formats and source names per export format.
FORMATS = {
    "amazon_jp": {
        "name": "Amazon.co.jp",
        "source_key": "amazon",
        "columns": {
            "item_name": ["商品名", "Title"],
            "price": ["価格", "合計", "Item Total", "Purchase Price Per Unit"],
            "purchase_date": ["注文日", "Order Date"],
            "order_id": ["注文番号", "Order ID"],
            "quantity": ["数量", "Quantity"],
            "category": ["カテゴリ", "Category"],
        },
        "date_formats": ["%Y/%m/%d", "%Y-%m-%d", "%Y年%m月%d日"],
    },
    "amazon_us": {
        "name": "Amazon.com",
        "source_key": "amazon",
        "columns": {
            "item_name": ["Title", "Product Name"],
            "price": ["Item Total", "Purchase Price Per Unit", "Total Owed"],
            "purchase_date": ["Order Date", "Ship Date"],
            "order_id": ["Order ID"],
            "quantity": ["Quantity"],
            "category": ["Category"],
        },
        "date_formats": ["%m/%d/%Y", "%Y-%m-%d", "%m/%d/%y"],
    },
    "rakuten": {
        "name": "Rakuten",
        "source_key": "rakuten",
        "columns": {
            "item_name": ["商品名", "商品名称"],
            "price": ["商品価格", "金額"],
            "purchase_date": ["注文日時", "注文日"],
            "order_id": ["注文番号", "受注番号"],
            "quantity": ["個数", "数量"],
            "category": [],
        },
        "date_formats": ["%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d"],
    },
    "ebay": {
        "name": "eBay",
        "source_key": "ebay",
        "columns": {
            "item_name": ["Item title", "Item Title", "Title"],
            "price": ["Total price", "Item price", "Sale price", "Total Price"],
            "purchase_date": ["Sale date", "Date", "Order date"],
            "order_id": ["Order number", "Order Number", "Transaction ID"],
            "quantity": ["Quantity"],
            "category": ["Category"],
        },
        "date_formats": ["%b-%d-%y", "%b %d, %Y", "%m/%d/%Y", "%Y-%m-%d"],
    },
    "walmart": {
        "name": "Walmart",
        "source_key": "walmart",
        "columns": {
            "item_name": ["Product", "Item Description", "Product Name"],
            "price": ["Price", "Amount", "Item Total"],
            "purchase_date": ["Date", "Order Date", "Purchase Date"],
            "order_id": ["Order #", "Order Number", "Order ID"],
            "quantity": ["Qty", "Quantity"],
            "category": ["Category", "Department"],
        },
        "date_formats": ["%m/%d/%Y", "%m/%d/%y", "%Y-%m-%d"],
    },
    "shopify": {
        "name": "Shopify Order Export",
        "source_key": "shopify",
        "columns": {
            "item_name": ["Lineitem name", "Name"],
            "price": ["Lineitem price", "Total", "Subtotal"],
            "purchase_date": ["Created at", "Paid at"],
            "order_id": ["Order", "Order Number"],
            "quantity": ["Lineitem quantity"],
            "category": [],
        },
        "date_formats": ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"],
    },
    "generic_credit_card": {
        "name": "Generic Credit Card Statement",
        "source_key": "credit_card",
        "columns": {
            "item_name": ["商品名", "利用先", "摘要", "内容", "明細", "店名", "Description", "Merchant", "Payee"],
            "price": ["金額", "利用金額", "支払金額", "請求金額", "Amount", "Price", "Debit"],
            "purchase_date": ["日付", "利用日", "利用年月日", "取引日", "Date", "Transaction Date", "Post Date"],
            "order_id": ["管理番号", "Reference", "Reference Number"],
            "quantity": [],
            "category": ["カテゴリ", "Category", "Type"],
        },
        "date_formats": ["%Y/%m/%d", "%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%Y年%m月%d日"],
    },
}
FALLBACK_FORMAT = "generic_credit_card"
DEFAULT_SOURCE = "manual"
DEFAULT_DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y"]

# Currency symbols known to the registry.
SYMBOLS = {
    "¥": "JPY",
    "￥": "JPY",
    "$": "USD",
    "€": "EUR",
    "£": "GBP",
    "₩": "KRW",
    "A$": "AUD",
    "C$": "CAD",
}

# Currency symbols used where no registry is given.
BASIC_SYMBOLS = {"¥": "JPY", "￥": "JPY", "$": "USD", "€": "EUR", "£": "GBP"}

# Headers of the two dedicated shop importers, primary set before alternate set.
SHOP_A_HEADERS = (
    {
        "注文日": "purchase_date",
        "注文番号": "order_id",
        "商品名": "item_name",
        "価格": "price",
        "数量": "quantity",
        "合計": "total",
    },
    {
        "Order Date": "purchase_date",
        "Order ID": "order_id",
        "Title": "item_name",
        "Item Total": "price",
        "Purchase Price Per Unit": "unit_price",
        "Quantity": "quantity",
    },
)
SHOP_B_HEADERS = (
    {
        "注文日時": "purchase_date",
        "注文番号": "order_id",
        "商品名": "item_name",
        "商品価格": "price",
        "個数": "quantity",
        "送料": "shipping",
        "ショップ名": "shop",
    },
    {
        "注文日": "purchase_date",
        "受注番号": "order_id",
        "商品名称": "item_name",
        "金額": "price",
        "数量": "quantity",
    },
)

# Headers of the statement importer.
STATEMENT_HEADERS = {
    "item_name": ["商品名", "利用先", "摘要", "内容", "明細", "店名", "description", "merchant"],
    "price": ["金額", "利用金額", "支払金額", "請求金額", "price", "amount"],
    "purchase_date": ["日付", "利用日", "利用年月日", "取引日", "date", "transaction_date"],
    "order_id": ["注文番号", "管理番号", "order_id", "reference"],
}

# Date formats of the dedicated importers.
SHOP_A_DATES = ["%Y/%m/%d", "%Y-%m-%d", "%Y年%m月%d日", "%m/%d/%Y"]
SHOP_B_DATES = [
    "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y年%m月%d日",
]
STATEMENT_DATES = [
    "%Y/%m/%d", "%Y-%m-%d", "%Y年%m月%d日", "%m/%d/%Y", "%Y/%m/%d %H:%M", "%Y-%m-%d %H:%M:%S",
]


# Charsets tried in this order; the first that decodes the whole file is used.
CHARSETS = ("UTF-8", "Shift_JIS", "windows-31j")
# Names that a registry file may use, as Spark knows them.
_CHARSET_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf8": "UTF-8", "shift_jis": "Shift_JIS", "sjis": "Shift_JIS",
                  "cp932": "windows-31j", "euc_jp": "EUC-JP", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}


def load_charsets(spark: SparkSession, path: str | None = None) -> tuple[str, ...]:
    """The ``encoding_order`` of a registry file, without repetitions; CHARSETS if it has none."""
    order = _config(spark, path).get("encoding_order") if path else None
    return tuple(dict.fromkeys(_CHARSET_NAMES.get(name.lower(), name) for name in order)) if order else CHARSETS


def load_formats(spark: SparkSession, path: str | None = None) -> tuple[dict, dict]:
    """Formats and currency symbols, from a JSON file of ``{"formats", "currency_symbols"}`` if given."""
    if path is None:
        return FORMATS, SYMBOLS
    config = _config(spark, path)
    return config["formats"], config.get("currency_symbols") or SYMBOLS


def _config(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as error:
        raise FileNotFoundError(f"no format registry at {path}") from error
