"""Table schemas, enumerations and column defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed members of the enumerated columns.
CATEGORIES = (
    "electronics", "clothing", "consumable", "food", "supplement",
    "furniture", "kitchen", "bathroom", "office", "other",
)
CONDITIONS = ("new", "good", "fair", "poor")
EVENT_TYPES = ("opened", "half_used", "low", "empty", "replaced", "disposed")

# Categories accepted by the prefixed line loader.
LINE_CATEGORIES = (
    "kitchen", "bathroom", "electronics", "clothing", "supplement", "food", "office", "other",
)

# Lifespan in days set by the line loader, by consumable category.
LINE_LIFESPANS = {"bathroom": 90, "supplement": 60, "food": 14}

# Lifespan in days by kind of consumable.
KIND_LIFESPANS = {
    "supplement": 60,
    "shampoo": 45,
    "conditioner": 45,
    "body_soap": 40,
    "toothpaste": 30,
    "detergent": 30,
    "dish_soap": 25,
    "hand_soap": 20,
    "tissue": 14,
    "toilet_paper": 14,
    "trash_bag": 21,
    "wrap": 30,
    "coffee": 14,
    "rice": 21,
    "cooking_oil": 60,
    "soy_sauce": 60,
}
DEFAULT_LIFESPAN = 30

ALERT_THRESHOLD = 0.8
MIN_OCR_CONFIDENCE = 50.0

POSSESSIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType(), False),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("purchase_date", T.DateType()),
    T.StructField("purchase_price", T.DoubleType()),
    T.StructField("purchase_source", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("condition", T.StringType(), False),
    T.StructField("is_consumable", T.BooleanType(), False),
    T.StructField("estimated_lifespan_days", T.IntegerType()),
    T.StructField("last_replenished", T.DateType()),
    T.StructField("notes", T.StringType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
])

PURCHASE_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType(), False),
    T.StructField("item_name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("currency", T.StringType(), False),
    T.StructField("purchase_date", T.DateType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("possession_id", T.LongType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
])

CONSUMPTION_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("possession_id", T.LongType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("logged_at", T.TimestampType(), False),
    T.StructField("notes", T.StringType()),
])

RECEIPT_SCANS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("image_path", T.StringType(), False),
    T.StructField("store_name", T.StringType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("currency", T.StringType(), False),
    T.StructField("receipt_date", T.DateType()),
    T.StructField("receipt_date_text", T.StringType()),
    T.StructField("ocr_raw_text", T.StringType()),
    T.StructField("ocr_confidence", T.DoubleType()),
    T.StructField("language", T.StringType()),
    T.StructField("image_hash", T.StringType()),
    T.StructField("processed_at", T.TimestampType(), False),
])

RECEIPT_ITEMS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("receipt_id", T.LongType(), False),
    T.StructField("item_name", T.StringType(), False),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("purchase_history_id", T.LongType()),
])

VIDEO_SESSIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("video_path", T.StringType(), False),
    T.StructField("frame_count", T.IntegerType()),
    T.StructField("has_audio", T.BooleanType()),
    T.StructField("audio_transcript", T.StringType()),
    T.StructField("items_detected", T.IntegerType()),
    T.StructField("items_confirmed", T.IntegerType()),
    T.StructField("processed_at", T.TimestampType(), False),
])

SCHEMA_VERSION = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("applied_at", T.TimestampType(), False),
])

TABLES = {
    "possessions": POSSESSIONS,
    "purchase_history": PURCHASE_HISTORY,
    "consumption_log": CONSUMPTION_LOG,
    "receipt_scans": RECEIPT_SCANS,
    "receipt_items": RECEIPT_ITEMS,
    "video_sessions": VIDEO_SESSIONS,
    "schema_version": SCHEMA_VERSION,
}

# Column defaults; "now" stands for the run's as_of timestamp.
DEFAULTS = {
    "possessions": {"condition": "good", "is_consumable": False, "created_at": "now"},
    "purchase_history": {"currency": "JPY", "created_at": "now"},
    "consumption_log": {"logged_at": "now"},
    "receipt_scans": {"currency": "JPY", "language": "ja", "processed_at": "now"},
    "receipt_items": {"quantity": 1},
    "video_sessions": {"has_audio": False, "items_detected": 0, "items_confirmed": 0, "processed_at": "now"},
    "schema_version": {"applied_at": "now"},
}

# (child table, child column, parent table); parents are keyed by id.
FOREIGN_KEYS = (
    ("purchase_history", "possession_id", "possessions"),
    ("consumption_log", "possession_id", "possessions"),
    ("receipt_items", "receipt_id", "receipt_scans"),
    ("receipt_items", "purchase_history_id", "purchase_history"),
)

ENUMS = (
    ("possessions", "category", CATEGORIES),
    ("possessions", "condition", CONDITIONS),
    ("consumption_log", "event_type", EVENT_TYPES),
)
