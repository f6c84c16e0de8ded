"""Domain tables derived from an order/part/event star schema, as SQL that any ANSI engine runs.

Every view reads its base tables whole. Placeholders such as ``{lineitem}`` name the tables;
``sql_for`` leaves plain names and ``Views`` binds DataFrames.
"""

from __future__ import annotations

import string
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cupboard.session import prepare

_CATEGORY = """CASE p_type WHEN 'STANDARD' THEN 'supplement' WHEN 'SMALL' THEN 'food' WHEN 'LARGE' THEN 'furniture'
    WHEN 'ECONOMY' THEN 'kitchen' WHEN 'MEDIUM' THEN 'electronics' ELSE 'clothing' END"""

# Unique order of the line items; (order, line) alone repeats.
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
_ROW_KEY = ", ".join(ROW_KEY)


def _thousands(number: str) -> str:
    """An integer below a million with a thousands comma."""
    return (
        f"CASE WHEN {number} >= 1000 THEN CAST(CAST(floor({number} / 1000) AS BIGINT) AS STRING) || ',' || "
        f"lpad(CAST({number} % 1000 AS STRING), 3, '0') ELSE CAST({number} AS STRING) END"
    )


def _cents(number: str) -> str:
    """An integer number of cents as units with two decimals."""
    return f"CAST(CAST(floor({number} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({number} % 100 AS STRING), 2, '0')"


def _two(number: str) -> str:
    return f"lpad(CAST({number} AS STRING), 2, '0')"


_Y, _M, _D = (f"{part}(purchase_date)" for part in ("year", "month", "day"))
_MONTH_NAME = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(purchase_date) * 3 - 2 AS INT), 3)"
_YEAR2 = f"substring(CAST({_Y} AS STRING), 3, 2)"

VIEWS = {
    "purchases": f"""
        SELECT {_ROW_KEY}, o_orderpriority AS source, p_name || ' ' || p_brand AS item_name, l_extendedprice AS price,
            CASE o_custkey % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
            CAST(o_orderdate AS DATE) AS purchase_date,
            CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS order_id,
            CASE WHEN l_returnflag = 'R' THEN NULL ELSE {_CATEGORY} END AS category,
            CASE WHEN l_linenumber = 1 THEN l_partkey END AS possession_id
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
    "possessions": f"""
        SELECT p_partkey AS id, p_name AS name, {_CATEGORY} AS category, p_brand AS brand,
            CAST(NULL AS DATE) AS purchase_date, p_retailprice AS purchase_price, CAST(NULL AS STRING) AS purchase_source,
            CASE p_partkey % 4 WHEN 0 THEN 'Kitchen shelf' WHEN 1 THEN 'desk' WHEN 2 THEN 'bathroom' END AS location,
            CASE p_partkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'fair' WHEN 2 THEN 'poor' ELSE 'good' END AS condition,
            p_size % 2 = 0 AS is_consumable,
            CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS estimated_lifespan_days,
            CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE DATE '2001-05-01' + CAST(p_partkey % 90 AS INT) END
                AS last_replenished,
            CASE WHEN p_partkey % 6 = 0 THEN 'Spare ' || p_type || ' piece' END AS notes,
            CAST(NULL AS STRING) AS image_path,
            CAST(DATE '2001-01-01' + CAST(p_partkey % 200 AS INT) AS TIMESTAMP) AS created_at
        FROM {{part}}""",
    "consumption_log": """
        SELECT event_id AS id, user_id AS possession_id,
            CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'half_used' WHEN 'error' THEN 'low'
                WHEN 'purchase' THEN 'empty' ELSE 'replaced' END AS event_type,
            CAST(ts AS TIMESTAMP) AS logged_at, CAST(NULL AS STRING) AS notes
        FROM {events}""",
    "activity": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'supplement' WHEN 1 THEN 'food' ELSE 'office' END AS category,
            CAST(ts AS TIMESTAMP) AS logged_at, value AS amount
        FROM {events}""",
    # Prices and dates as exports write them; every ninth item name is blank.
    "dirty": f"""
        SELECT {_ROW_KEY}, source, order_id, category,
            CASE WHEN l_partkey % 9 = 0 THEN '  ' ELSE ' ' || item_name || ' ' END AS item_text,
            CASE l_linenumber
                WHEN 1 THEN '¥' || {_thousands('units')}
                WHEN 2 THEN CASE l_partkey % 4 WHEN 0 THEN '$' WHEN 1 THEN 'A$' WHEN 2 THEN '€' ELSE '£ ' END || {_cents('cents')}
                WHEN 3 THEN {_thousands('units')} || '円'
                WHEN 4 THEN '-' || CASE WHEN l_partkey % 2 = 0 THEN '$' ELSE '' END || {_cents('cents')}
                WHEN 5 THEN CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE NULL END
                WHEN 6 THEN '(' || CAST(units AS STRING) || ')'
                ELSE '￥' || translate({_thousands('units')}, '0123456789', '０１２３４５６７８９') END AS price_text,
            CASE l_orderkey % 9
                WHEN 0 THEN {_Y} || '/' || {_two(_M)} || '/' || {_two(_D)}
                WHEN 1 THEN {_Y} || '-' || {_two(_M)} || '-' || {_two(_D)}
                WHEN 2 THEN {_Y} || '年' || {_M} || '月' || {_D} || '日'
                WHEN 3 THEN {_two(_M)} || '/' || {_two(_D)} || '/' || {_Y}
                WHEN 4 THEN {_MONTH_NAME} || '-' || {_two(_D)} || '-' || {_YEAR2}
                WHEN 5 THEN upper({_MONTH_NAME}) || ' ' || {_D} || ', ' || {_Y}
                WHEN 6 THEN {_Y} || '/' || {_M} || '/' || {_D} || ' 9:05:00'
                WHEN 7 THEN {_Y} || '-' || {_two(_M)} || '-' || {_two(_D)} || 'T23:30:00-08:00'
                ELSE CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN {_Y} || '/02/30' ELSE {_M} || '/' || {_D} || '/75' END
            END AS date_text
        FROM (SELECT *, CAST(floor(price / 100) AS BIGINT) AS units, CAST(floor(price / 10) AS BIGINT) AS cents
              FROM {{purchases}}) AS p""",
    # Purchases with coarse prices, so that equal (source, item, date, price) rows occur.
    "staged": f"""
        SELECT {_ROW_KEY}, 'shop' || CAST(l_suppkey % 3 AS STRING) AS source,
            CASE WHEN l_partkey % 50 = 0 THEN '' ELSE substring(item_name, 1, 6) END AS item_name,
            CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(floor(price / 20000) AS DOUBLE) END AS price,
            CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE DATE '2001-01-01' + CAST(l_orderkey % 250 AS INT) END AS purchase_date,
            CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN ''
                ELSE CAST(l_orderkey AS STRING) END AS order_id
        FROM {{purchases}}""",
    # Rows of five kinds of exports (``layout``), as the exporters write them.
    "export_rows": f"""
        SELECT {_ROW_KEY}, layout, units, quoted_name, purchase_date,
            CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'N' || CAST(l_orderkey AS STRING) END AS order_text,
            CASE WHEN layout = 4 AND l_partkey % 13 = 0 THEN '' ELSE quoted_name END AS item_text,
            CASE WHEN layout = 4 AND l_partkey % 13 = 0 THEN ''
                WHEN layout = 0 THEN '¥' || {_thousands('units')}
                WHEN layout = 1 THEN '￥' || {_thousands('units')}
                WHEN layout = 2 THEN '$' || {_cents('units')}
                ELSE CAST(units AS STRING) END AS price_text,
            CASE WHEN layout < 2 THEN {_Y} || '/' || {_two(_M)} || '/' || {_two(_D)}
                WHEN layout = 2 THEN {_MONTH_NAME} || '-' || {_two(_D)} || '-' || {_YEAR2}
                WHEN layout = 3 THEN {_Y} || '-' || {_two(_M)} || '-' || {_two(_D)} || 'T23:30:00-0800'
                WHEN l_partkey % 17 = 0 THEN 'unknown'
                ELSE {_Y} || '/' || {_M} || '/' || {_D} END AS date_text,
            coalesce(category, '') AS category_text
        FROM (SELECT *, l_suppkey % 5 AS layout, CAST(floor(price / 20000) + 10 AS BIGINT) AS units,
                CASE l_suppkey % 5 WHEN 4 THEN substring(item_name, 1, 6)
                    WHEN 0 THEN CASE WHEN l_partkey % 40 = 0 THEN '2"' || chr(10) || item_name ELSE item_name END
                    WHEN 1 THEN '品 ' || item_name ELSE item_name END AS quoted_name
              FROM {{purchases}}) AS p""",
    # OCR results: one generated receipt per order, and every document as a scanned text.
    "ocr": f"""
        SELECT o_orderkey AS row_id, 'orders/' || CAST(o_orderkey AS STRING) AS image_path,
            'RECEIPT' || chr(10) || '  ' || chr(10) ||
            CASE o_orderkey % 3 WHEN 0 THEN '-----' ELSE 'TEL 03-' || CAST(o_custkey AS STRING) END || chr(10) ||
            CASE WHEN o_orderkey % 7 = 0 THEN '12,500' ELSE ' ' || o_orderpriority || ' Mart' END || chr(10) ||
            CASE o_orderkey % 5 WHEN 0 THEN {_Y} || '/' || {_two(_M)} || '/' || {_two(_D)} || ' 12:30'
                WHEN 1 THEN {_M} || '-' || {_D} || '-' || {_Y} WHEN 2 THEN {_two(_M)} || '/' || {_two(_D)} || '/' || {_YEAR2}
                WHEN 3 THEN {_Y} || '年' || {_M} || '月' || {_D} || '日' ELSE 'no day printed' END || chr(10) ||
            'Rice ball  ¥' || CAST(o_custkey % 900 + 1 AS STRING) || chr(10) ||
            'Water   500ml ' || {_thousands('units')} || ' 円' || chr(10) ||
            CASE WHEN o_orderkey % 4 = 0 THEN 'Box x2 $' || {_cents('units')} ELSE 'Box 2 ¥300' END || chr(10) ||
            'Tea ' || {_cents('units')} || chr(10) || 'Gum ¥5' || chr(10) ||
            CASE WHEN o_orderkey % 2 = 0 THEN 'Subtotal ¥' || {_thousands('units + 10')} || chr(10) ELSE '' END ||
            CASE o_orderkey % 3 WHEN 0 THEN '合計 ¥' || {_thousands('units + 20')}
                WHEN 1 THEN 'Amount  Due: ' || {_cents('units')} ELSE 'BALANCE' END AS ocr_text
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS purchase_date, CAST(floor(o_totalprice / 10) AS BIGINT) AS units
              FROM {{orders}}) AS o
        UNION ALL
        SELECT -1 - doc_id, 'documents/' || CAST(doc_id AS STRING), text FROM {{documents}}""",
    # Prefixed item lines, some of them faulty.
    "item_lines": f"""
        SELECT p_partkey AS row_id,
            CASE p_partkey % 11 WHEN 0 THEN 'no category here' WHEN 1 THEN 'garage:' || p_name WHEN 2 THEN '  '
                WHEN 3 THEN 'food:   ' WHEN 4 THEN '　Food : ' || p_name || ' '
                ELSE ' ' || {_CATEGORY} || ':' || substring(p_name, 1, 8) ||
                    CASE WHEN p_size % 3 = 0 THEN ' / ' || p_brand || ' / x' ELSE '' END END AS value
        FROM {{part}}""",
    # Header lines of exports, one per order: eight layouts in changing case, order and with extra columns.
    "header_lines": """
        SELECT o_orderkey AS file_id,
            CASE o_orderkey % 8
                WHEN 0 THEN '注文日,注文番号,商品名,価格,数量,カテゴリ'
                WHEN 1 THEN 'Order Date,Order ID,Title,Purchase Price Per Unit,Quantity,Category'
                WHEN 2 THEN '利用日,利用先,金額,カテゴリ'
                WHEN 3 THEN 'Item title,Sale price,Sale date,Order number'
                WHEN 4 THEN ' ORDER DATE ,order id,product name,TOTAL OWED'
                WHEN 5 THEN 'Created at,"Lineitem name",Lineitem price,Order'
                WHEN 6 THEN '注文日時,受注番号,商品名称,商品価格,個数'
                ELSE 'col1,col2' END
            || CASE o_custkey % 3 WHEN 0 THEN ',' || o_orderpriority WHEN 1 THEN ',Date,date' ELSE '' END AS line
        FROM {orders}""",
    # Frames of video sessions (one session per supplier): JSON arrays of items, some unreadable.
    "frames": f"""
        SELECT l_suppkey AS session_id, l_orderkey * 10 + l_linenumber AS frame,
            CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 'no items seen' ELSE
            '[{{{{"name": "' || CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE '  ' || replace(p_name, ' ', '-') END
            || '", "category": "' || {_CATEGORY} || '", "condition": "good", "location": "'
            || CASE l_partkey % 2 WHEN 0 THEN 'desk' ELSE 'Desk ' END || '"}}}}, {{{{"name": "' || p_brand
            || '", "category": "other", "condition": "' || CASE WHEN l_partkey % 2 = 0 THEN 'fair' ELSE 'poor' END
            || '", "location": "shelf"}}}}]' END AS detections
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    # The same frames as misread now and then: a letter lost, doubled or changed in the first name, a word added.
    "misread_frames": """
        SELECT session_id, frame, CASE frame % 7
                WHEN 0 THEN replace(detections, 'ring', 'rng') WHEN 1 THEN replace(detections, 'widget', 'widgett')
                WHEN 2 THEN replace(detections, 'gizmo', 'gizno') WHEN 3 THEN replace(detections, 'small', 'smal')
                WHEN 4 THEN replace(detections, 'Brand', 'Brnad') WHEN 5 THEN replace(detections, 'bolt', 'bolts')
                ELSE detections END AS detections
        FROM {frames}""",
    # Transcripts that say names whole, in another case, and inside longer words.
    "talking_sessions": """
        SELECT s_suppkey AS session_id, CASE s_suppkey % 4
                WHEN 0 THEN 'Here is the ' || upper(p_name) || ', next to it a ' || p_brand || '.'
                WHEN 1 THEN 'nothing but ' || p_name || 's and a sub' || p_name
                WHEN 2 THEN 'on the desk: ' || replace(p_name, ' ', '-') || '; two of them' ELSE NULL END AS audio_transcript
        FROM {supplier} JOIN {part} ON s_suppkey = p_partkey""",
    "sessions": """
        SELECT s_suppkey AS session_id, 'videos/' || s_name || '.mp4' AS video_path,
            CAST(s_suppkey % 100 AS INT) AS frame_count, s_suppkey % 2 = 0 AS has_audio,
            CASE WHEN s_suppkey % 2 = 0 THEN 'on the desk you see ' || p_name || ' and ' || p_brand ELSE '' END AS audio_transcript
        FROM {supplier} JOIN {part} ON s_suppkey = p_partkey""",
}


# Views whose rows go into costly expressions, and the large tables below them.
COSTLY_VIEWS = ("dirty", "ocr", "frames", "misread_frames", "export_rows")
LARGE_TABLES = ("lineitem", "orders", "documents")


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(field for _, field, _, _ in string.Formatter().parse(VIEWS[name]) if field))


def sql_for(*names: str) -> str:
    """``name AS (...)`` clauses of the views and the views they read, for a WITH list."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for base in _needs(name):
            if base in VIEWS:
                add(base)
        done.setdefault(name, VIEWS[name].format(**{base: base for base in _needs(name)}))

    for name in names:
        add(name)
    return ", ".join(f"{name} AS ({text})" for name, text in done.items())


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: making and parsing their texts costs far more than this exchange of a few columns."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Views:
    """The derived tables over a folder of Parquet files, built lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, dealt_out: bool = False) -> DataFrame:
        dealt_out = dealt_out or name in COSTLY_VIEWS

        def base(name: str) -> DataFrame:
            if name in VIEWS:
                return self.view(name, dealt_out)
            return dealt(self.table(name)) if dealt_out and name in LARGE_TABLES else self.table(name)

        return self.spark.sql(VIEWS[name], **{needed: base(needed) for needed in _needs(name)})

    @cached_property
    def purchases(self) -> DataFrame:
        return self.view("purchases")

    @cached_property
    def possessions(self) -> DataFrame:
        return self.view("possessions")

    @cached_property
    def log(self) -> DataFrame:
        return self.view("consumption_log")
