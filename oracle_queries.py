"""Plain SQL for each registered query, written for DuckDB and independent of the Spark plans.

Only the derived views and the fixed value tables are shared with the package.
"""

from __future__ import annotations

from cupboard import registry, schemas
from cupboard.functions.text import WHITESPACE
from cupboard.plans.views import ROW_KEY, sql_for

NOW = "TIMESTAMP '2001-07-20 12:00:00'"
LOG_NOW = "TIMESTAMP '2024-01-20 12:00:00'"
TODAY = "DATE '2001-07-20'"
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEY = ", ".join(ROW_KEY)
MEANINGS = ("item_name", "price", "purchase_date", "order_id", "category")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_views(*names: str, extra: str = "") -> str:
    return "WITH " + sql_for(*names) + (", " + extra if extra else "") + " "


def months_back(months: int) -> str:
    return f"(date_trunc('month', {TODAY}) - INTERVAL {months} MONTH + to_days(CAST(day({TODAY}) - 1 AS INT)))::DATE"


def days_until(day: str, now: str = NOW) -> str:
    return f"date_diff('microsecond', {now}, CAST({day} AS TIMESTAMP)) / 86400000000.0"


SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE if ord(c) >= 9)


def strip(value: str) -> str:
    return f"trim({value}, {SPACES})"


def narrow(value: str) -> str:
    return f"translate({value}, '０１２３４５６７８９', '0123456789')"


O: dict[str, str] = {}
PURCHASES = with_views("purchases")
BOTH = with_views("purchases", "possessions")

# --- spending ---------------------------------------------------------------------------------
O["spend_by_source_month"] = PURCHASES + """
SELECT source, count(*) AS items, round(sum(price), 2) AS total, currency
FROM purchases WHERE purchase_date >= DATE '2001-07-01' GROUP BY source, currency"""

O["spend_by_category_month"] = BOTH + """
SELECT c AS category, count(*) AS items, round(sum(price), 2) AS total FROM (
    SELECT coalesce(ph.category, p.category, 'uncategorized') AS c, ph.price
    FROM purchases ph LEFT JOIN possessions p ON ph.possession_id = p.id
    WHERE ph.purchase_date >= DATE '2001-07-01') GROUP BY c"""

O["spend_monthly_trend"] = PURCHASES + f"""
SELECT strftime(purchase_date, '%Y-%m') AS month, count(*) AS items, round(sum(price), 2) AS total
FROM purchases WHERE purchase_date >= {months_back(6)} GROUP BY 1"""

O["health_spend_month"] = PURCHASES + """
SELECT currency, count(*) AS items, round(sum(price), 2) AS total
FROM purchases WHERE purchase_date >= DATE '2001-07-01' AND category IN ('supplement', 'food') GROUP BY currency"""

WEEK = "BETWEEN DATE '2001-07-16' AND DATE '2001-07-22'"
O["weekly_spend_report"] = PURCHASES + f"""
SELECT source, currency, count(*) AS items, round(sum(price), 2) AS total, grouping(source) = 1 AS is_total
FROM purchases WHERE purchase_date {WEEK} GROUP BY GROUPING SETS ((currency, source), (currency))"""

O["month_over_month"] = PURCHASES + f"""
SELECT currency, round(sum(price) FILTER (purchase_date < DATE '2001-07-01'), 2) AS previous_total,
    count(*) FILTER (purchase_date < DATE '2001-07-01') AS previous_items,
    round(sum(price) FILTER (purchase_date >= DATE '2001-07-01'), 2) AS current_total,
    count(*) FILTER (purchase_date >= DATE '2001-07-01') AS current_items
FROM purchases WHERE purchase_date BETWEEN DATE '2001-06-01' AND {TODAY} GROUP BY currency"""

RECURRING = f"""SELECT item_name, count(*) AS purchase_count, round(avg(price), 6) AS avg_price,
    max(purchase_date) AS last_purchased,
    CAST(trunc(date_diff('microsecond', CAST(max(purchase_date) AS TIMESTAMP), {NOW}) / 86400000000.0) AS INT) AS days_since_last
FROM purchases WHERE purchase_date >= {months_back(12)} GROUP BY item_name HAVING count(*) >= 2"""
O["recurring_purchases"] = PURCHASES + RECURRING

O["wasteful_purchases"] = with_views("purchases", extra=f"""
year AS (SELECT * FROM purchases WHERE purchase_date >= {months_back(12)} AND price IS NOT NULL),
ranked AS (SELECT currency, price, row_number() OVER (PARTITION BY currency ORDER BY price) AS rn,
    count(*) OVER (PARTITION BY currency) AS n FROM year),
bound AS (SELECT currency, price AS price_bound FROM ranked WHERE rn = CAST(ceil(n * 9 / 10.0) AS BIGINT)),
item AS (SELECT currency, item_name, count(*) AS purchase_count, max(price) AS price, max(purchase_date) AS last_purchased
    FROM year GROUP BY ALL)""") + """
SELECT item_name, currency, price, purchase_count, last_purchased FROM item JOIN bound USING (currency)
WHERE purchase_count = 1 AND price >= price_bound"""

# --- consumables ------------------------------------------------------------------------------
POSSESSIONS = with_views("possessions")
ALERT = "(last_replenished + CAST(trunc(estimated_lifespan_days * 0.8) AS INT))"
EMPTY = "(last_replenished + estimated_lifespan_days)"
O["consumables_alert"] = POSSESSIONS + f"""
SELECT id, name, brand, last_replenished, estimated_lifespan_days, CAST({EMPTY} AS DATE) AS estimated_empty_date,
    round({days_until(ALERT)}, 6) AS days_until_alert
FROM possessions WHERE is_consumable AND last_replenished IS NOT NULL AND CAST({ALERT} AS TIMESTAMP) <= {NOW}"""

DUE = f"""SELECT name, brand, last_replenished, estimated_lifespan_days, CAST({EMPTY} AS DATE) AS estimated_empty,
    CAST(trunc({days_until(EMPTY)}) AS INT) AS days_remaining
FROM possessions WHERE is_consumable AND last_replenished IS NOT NULL AND {days_until(EMPTY)} <= 7"""
O["consumables_due_week"] = POSSESSIONS + DUE

O["consumable_status_daily"] = POSSESSIONS + f"""
SELECT id, name, CASE WHEN CAST({ALERT} AS TIMESTAMP) <= {NOW} THEN 'replenish' ELSE 'fine' END AS status,
    CAST(trunc({days_until(EMPTY)}) AS INT) AS days_remaining
FROM possessions WHERE is_consumable AND last_replenished IS NOT NULL AND estimated_lifespan_days IS NOT NULL"""

CYCLES = """cycles AS (
    SELECT a.possession_id, avg(date_diff('microsecond', a.logged_at, b.logged_at) / 86400000000.0) AS cycle_days
    FROM consumption_log a JOIN consumption_log b ON a.possession_id = b.possession_id
    WHERE a.event_type = 'opened' AND b.event_type IN ('empty', 'replaced') AND b.logged_at > a.logged_at
    GROUP BY a.possession_id)"""
O["consumption_cycle"] = with_views("possessions", "consumption_log", extra=CYCLES) + """
SELECT p.id, p.name, round(cycle_days, 6) AS avg_cycle_days FROM cycles JOIN possessions p ON p.id = possession_id"""

O["replenish_forecast_learned"] = with_views("possessions", "consumption_log", extra=CYCLES + """,
planned AS (SELECT p.*, cycle_days, coalesce(round(cycle_days, 6), CAST(estimated_lifespan_days AS DOUBLE)) AS days
    FROM possessions p LEFT JOIN cycles ON p.id = possession_id
    WHERE is_consumable AND last_replenished IS NOT NULL),
alerts AS (SELECT *, last_replenished + CAST(floor(round(days * CAST(0.8 AS DOUBLE), 6)) AS INT) AS alert_date FROM planned)""") + f"""
SELECT id, name, round(days, 6) AS cycle_days, cycle_days IS NOT NULL AS is_learned, CAST(alert_date AS DATE) AS alert_date,
    round({days_until('alert_date')}, 6) AS days_until_alert
FROM alerts WHERE CAST(alert_date AS TIMESTAMP) <= {NOW}"""

O["shopping_list"] = with_views("purchases", "possessions", extra=f"""
due AS ({DUE}), regular AS ({RECURRING}),
wanted AS (SELECT name AS item_name, 'running_out' AS reason, min(days_remaining) AS days FROM due GROUP BY name
    UNION ALL SELECT item_name, 'regular', NULL FROM regular
    WHERE item_name IS NOT NULL AND item_name NOT IN (SELECT name FROM due)),
prices AS (SELECT item_name, round(avg(price), 6) AS estimated_price FROM purchases
    WHERE purchase_date >= {months_back(12)} GROUP BY item_name)""") + """
SELECT w.item_name, reason, days AS days_remaining, estimated_price FROM wanted w LEFT JOIN prices USING (item_name)"""

O["stock_vs_activity"] = with_views("possessions", "activity", extra=f"""
recent AS (SELECT category, count(*) AS sessions, round(sum(amount), 2) AS amount FROM activity
    WHERE logged_at > {LOG_NOW} - INTERVAL 30 DAY AND logged_at <= {LOG_NOW} GROUP BY category),
stock AS (SELECT category, CAST(trunc({days_until(EMPTY, LOG_NOW)}) AS INT) AS days FROM possessions
    WHERE is_consumable AND last_replenished IS NOT NULL AND estimated_lifespan_days IS NOT NULL)""") + """
SELECT r.category, any_value(sessions) AS sessions, any_value(r.amount) AS amount, count(days) AS items,
    min(days) AS least_days_left, count(*) FILTER (days <= 7) AS running_out
FROM recent r LEFT JOIN stock s USING (category) GROUP BY r.category"""

# --- possessions ------------------------------------------------------------------------------
O["possessions_by_category"] = POSSESSIONS + 'SELECT category, count(*) AS "count" FROM possessions GROUP BY category'
O["possessions_by_location"] = POSSESSIONS + (
    'SELECT location, count(*) AS "count" FROM possessions WHERE location IS NOT NULL GROUP BY location')
O["latest_possessions"] = POSSESSIONS + (
    "SELECT name, brand, category, created_at FROM possessions ORDER BY created_at DESC, id DESC LIMIT 10")
O["search_by_category"] = POSSESSIONS + "SELECT * FROM possessions WHERE category = 'kitchen'"
O["search_by_location"] = POSSESSIONS + "SELECT * FROM possessions WHERE location ILIKE '%KITCHEN%'"
O["search_free_text"] = POSSESSIONS + (
    "SELECT * FROM possessions WHERE name ILIKE '%ring%' OR brand ILIKE '%ring%' OR notes ILIKE '%ring%'")
O["indexed_search"] = O["search_free_text"]


def search_share(fields: tuple[str, ...], pattern: str) -> str:
    runs = pattern.lower().replace("_", "%").split("%")
    grams = {run[i:i + 3] for run in runs for i in range(len(run) - 2)}
    held = " OR ".join("(" + " AND ".join(f"contains(lower({f}), '{g}')" for g in sorted(grams)) + ")" for f in fields) if grams else "TRUE"
    found = " OR ".join(f"{f} ILIKE '{pattern}'" for f in fields)
    counts = (("rows", "TRUE"), ("candidates", held), ("found", found))
    return " UNION ALL ".join(
        f"SELECT '{pattern}' AS pattern, '{kind}' AS kind, count(*) AS n FROM possessions WHERE {test}" for kind, test in counts)


SEARCHES = (
    (("name", "brand", "notes"), "%ring%"), (("location",), "%KITCHEN%"), (("name",), "%re%green%"), (("notes",), "spare%steel piece"),
    (("name", "notes"), "%no such text%"), (("brand",), "%#_4%"),
)
O["search_shares"] = POSSESSIONS + " UNION ALL ".join(search_share(*s) for s in SEARCHES)
O["weekly_new_items"] = POSSESSIONS + f"SELECT id, name, category FROM possessions WHERE CAST(created_at AS DATE) {WEEK}"

CONSUMED = """SELECT possession_id, name, event_type, CAST(logged_at AS DATE) AS logged_on
FROM consumption_log JOIN possessions p ON p.id = possession_id
WHERE event_type = 'empty' AND CAST(logged_at AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"""
O["weekly_consumed"] = with_views("possessions", "consumption_log") + CONSUMED

O["weekly_life_report"] = with_views("purchases", "possessions", "consumption_log", extra=f"""
week AS (SELECT * FROM purchases WHERE purchase_date {WEEK}),
due AS ({DUE}), consumed AS ({CONSUMED}), trend AS (
    SELECT currency, round(sum(price) FILTER (purchase_date < DATE '2001-07-01'), 2) AS pt,
        count(*) FILTER (purchase_date < DATE '2001-07-01') AS pn,
        round(sum(price) FILTER (purchase_date >= DATE '2001-07-01'), 2) AS ct,
        count(*) FILTER (purchase_date >= DATE '2001-07-01') AS cn
    FROM purchases WHERE purchase_date BETWEEN DATE '2001-06-01' AND {TODAY} GROUP BY currency)""") + f"""
SELECT 'spend' AS section, source AS label, round(sum(price), 2) AS number, currency AS unit, CAST(count(*) AS VARCHAR) AS detail
    FROM week GROUP BY source, currency
UNION ALL SELECT 'spend', 'total', round(sum(price), 2), currency, CAST(count(*) AS VARCHAR) FROM week GROUP BY currency
UNION ALL SELECT 'category', c, round(sum(price), 2), NULL, CAST(count(*) AS VARCHAR) FROM (
    SELECT coalesce(w.category, p.category, 'uncategorized') AS c, price FROM week w LEFT JOIN possessions p ON w.possession_id = p.id) GROUP BY c
UNION ALL SELECT 'new_item', name, CAST(id AS DOUBLE), NULL, category FROM possessions WHERE CAST(created_at AS DATE) {WEEK}
UNION ALL SELECT 'consumed', name, CAST(possession_id AS DOUBLE), event_type, CAST(logged_on AS VARCHAR) FROM consumed
UNION ALL SELECT 'due', name, CAST(days_remaining AS DOUBLE), 'days', CAST(estimated_empty AS VARCHAR) FROM due
UNION ALL SELECT 'previous_month', currency, pt, currency, CAST(pn AS VARCHAR) FROM trend
UNION ALL SELECT 'current_month', currency, ct, currency, CAST(cn AS VARCHAR) FROM trend"""

# --- normalisation ----------------------------------------------------------------------------
DIRTY = with_views("dirty")


def generic_amount(column: str) -> str:
    return f"TRY_CAST(regexp_replace({narrow(column)}, '[^0-9.-]', '', 'g') AS DOUBLE)"


def currency(column: str, symbols: dict[str, str]) -> str:
    found = "".join(
        f" WHEN contains({column}, {text(s)}) THEN {text(c)}" for s, c in sorted(symbols.items(), key=lambda i: -len(i[0])))
    return f"CASE WHEN {column} IS NULL THEN 'USD' WHEN contains({column}, '円') THEN 'JPY'{found} ELSE 'USD' END"


for name, symbols in (("price_and_currency", registry.SYMBOLS), ("price_basic_symbols", registry.BASIC_SYMBOLS)):
    O[name] = DIRTY + f"""SELECT {LINE}, price_text, {generic_amount('price_text')} AS amount,
    {currency('price_text', symbols)} AS currency FROM dirty"""

for name, removed in (("shop_a_price", "¥￥,"), ("shop_b_price", "¥￥,円")):
    cleaned = f"{narrow(f'''translate(price_text, {text(removed)}, '')''')}"
    O[name] = DIRTY + f"""SELECT {LINE}, price_text, CASE WHEN regexp_full_match({strip(cleaned)}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')
    THEN TRY_CAST({strip(cleaned)} AS DOUBLE) END AS amount FROM dirty"""


def a_date(column: str, formats: list[str], iso: bool) -> str:
    tries = []
    for f in formats:
        # A four-digit year must be written with four digits.
        years = f"regexp_matches({column}, '(^|[^0-9])[0-9]{{4}}([^0-9]|$)')" if "%Y" in f else "TRUE"
        tries.append(f"CASE WHEN {years} THEN CAST(try_strptime({column}, {text(f)}) AS DATE) END")
    if iso:
        tries.append(
            f"TRY_CAST(nullif(regexp_extract({column}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(T[0-9:]+([+-][0-9]{{2}}:?[0-9]{{2}}|Z)?)?$', 1), '') AS DATE)")
    return f"coalesce({', '.join(tries)})"


# strptime of the oracle shifts by %z; those formats are read by their date part instead.
O["dates_by_format"] = DIRTY + f"SELECT {LINE}, date_text, " + ", ".join(
    a_date("date_text", [x for x in f["date_formats"] if "%z" not in x], True) + f" AS day_{k}"
    for k, f in registry.FORMATS.items()) + " FROM dirty"
O["shop_a_dates"] = DIRTY + f"SELECT {LINE}, date_text, {a_date('date_text', registry.SHOP_A_DATES, False)} AS day FROM dirty"
O["shop_b_dates"] = DIRTY + f"SELECT {LINE}, date_text, {a_date('date_text', registry.SHOP_B_DATES, False)} AS day FROM dirty"
O["statement_dates"] = DIRTY + f"SELECT {LINE}, date_text, {a_date('date_text', registry.STATEMENT_DATES, True)} AS day FROM dirty"
O["raw_rows"] = DIRTY + f"""SELECT {LINE}, CAST(json_object('item_text', item_text, 'price_text', price_text,
    'date_text', date_text, 'order_id', order_id) AS VARCHAR) AS raw_data FROM dirty"""

LIFESPAN = "CASE category " + " ".join(f"WHEN {text(k)} THEN {d}" for k, d in schemas.LINE_LIFESPANS.items()) + " END"
LINES = with_views("item_lines", extra=f"""
cut AS (SELECT row_id, {strip('value')} AS line FROM item_lines),
halves AS (SELECT row_id, line, strpos(line, ':') AS colon,
    CASE WHEN strpos(line, ':') > 0 THEN lower({strip("substring(line, 1, strpos(line, ':') - 1)")}) ELSE lower(line) END AS category,
    CASE WHEN strpos(line, ':') > 0 THEN {strip("substring(line, strpos(line, ':') + 1)")} END AS body FROM cut),
named AS (SELECT *, CASE WHEN strpos(body, ' / ') > 0 THEN {strip("substring(body, 1, strpos(body, ' / ') - 1)")} ELSE body END AS name,
    CASE WHEN strpos(body, ' / ') > 0 THEN {strip("substring(body, strpos(body, ' / ') + 3)")} END AS brand FROM halves),
parsed AS (SELECT *, CASE WHEN line = '' THEN 'empty' WHEN colon = 0 THEN 'no_category'
    WHEN category NOT IN ({', '.join(map(text, schemas.LINE_CATEGORIES))}) THEN 'unknown_category'
    WHEN name = '' THEN 'empty' ELSE 'accepted' END AS status, CAST({LIFESPAN} AS INT) AS days FROM named)""")
O["item_lines"] = LINES + f"""SELECT row_id, status, category, name, brand, days IS NOT NULL AS is_consumable,
    days AS estimated_lifespan_days, CASE WHEN days IS NOT NULL THEN {TODAY} END AS last_replenished FROM parsed"""
O["item_line_rejects"] = LINES + "SELECT row_id, status FROM parsed WHERE status IN ('no_category', 'unknown_category')"
O["item_line_statistics"] = LINES + "SELECT category, count(*) AS items FROM parsed WHERE status = 'accepted' GROUP BY category"
O["scanned_item_lines"] = LINES + """
SELECT status, category, count(*) AS n, count(*) AS n_rows, count(brand) AS n_brands FROM parsed GROUP BY ROLLUP (status, category)"""
O["new_possessions"] = LINES.replace("WITH ", "WITH " + sql_for("possessions") + ", ", 1) + """
SELECT row_id, name, category, brand FROM (
    SELECT *, row_number() OVER (PARTITION BY name, category ORDER BY row_id) AS nth FROM parsed WHERE status = 'accepted') x
WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM possessions p WHERE p.created_at < TIMESTAMP '2001-02-01' AND substring(p.name, 1, 8) = x.name AND p.category = x.category)"""
KINDS = [*schemas.KIND_LIFESPANS, "lamp"]
O["consumable_defaults"] = f"""
WITH kinds AS (SELECT * FROM (VALUES {', '.join(f"({i}, {text(k)}, {schemas.KIND_LIFESPANS.get(k, 'NULL')})" for i, k in enumerate(KINDS))}) AS v(i, kind, days))
SELECT p_partkey, kind, CAST(coalesce(days, 30) AS INT) AS days FROM part JOIN kinds ON i = p_partkey % {len(KINDS)}"""

# --- headers ----------------------------------------------------------------------------------
REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {text(k)}, {text(f['source_key'])}, {text(m)}, {text(c)}, {j})"
    for i, (k, f) in enumerate(registry.FORMATS.items())
    for m, cs in f["columns"].items() for j, c in enumerate(cs)
) + ") AS r(format_ord, format_key, source, meaning, candidate, cand_ord))"
HEADERS = f"""
cells AS (SELECT file_id, {strip("trim(name, '\"')")} AS name, pos FROM (
    SELECT file_id, unnest(string_split(line, ',')) AS name, generate_subscripts(string_split(line, ','), 1) AS pos FROM header_lines)),
hits AS (SELECT file_id, format_ord, format_key, source, meaning, pos, row_number() OVER (
        PARTITION BY file_id, format_key, meaning
        ORDER BY CASE WHEN name = candidate THEN 0 ELSE 1 END, cand_ord, pos DESC) AS nth
    FROM cells JOIN registry ON lower(name) = lower(candidate)),
matched AS (SELECT * FROM hits WHERE nth = 1),
scores AS (SELECT file_id, format_ord, format_key, source, count(*) AS score FROM matched GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, format_ord) AS nth FROM scores)
    WHERE nth = 1 AND score >= 2)"""
HEADER_VIEWS = with_views("header_lines", extra=REGISTRY + "," + HEADERS)
O["format_scores"] = HEADER_VIEWS + "SELECT h.file_id, any_value(b.format_key) AS detected, " + ", ".join(
    f"CAST(coalesce(max(s.score) FILTER (s.format_key = {text(k)}), 0) AS INT) AS score_{k}" for k in registry.FORMATS
) + " FROM header_lines h LEFT JOIN scores s USING (file_id) LEFT JOIN best b ON b.file_id = h.file_id GROUP BY h.file_id"
POSITIONS = ", ".join(f"CAST(max(m.pos) FILTER (m.meaning = {text(x)}) AS INT) AS {x}_at" for x in MEANINGS)
O["header_mapping"] = HEADER_VIEWS + f"""
SELECT c.file_id, c.format_key, any_value(c.source) AS source, {POSITIONS} FROM (
    SELECT h.file_id, coalesce(b.format_key, 'generic_credit_card') AS format_key, coalesce(b.source, 'credit_card') AS source
    FROM header_lines h LEFT JOIN best b USING (file_id)) c
LEFT JOIN matched m ON m.file_id = c.file_id AND m.format_key = c.format_key GROUP BY c.file_id, c.format_key"""
O["header_mapping_forced"] = HEADER_VIEWS + f"""
SELECT h.file_id, 'walmart' AS format_key, 'my_store' AS source, {POSITIONS} FROM header_lines h
LEFT JOIN matched m ON m.file_id = h.file_id AND m.format_key = 'walmart' GROUP BY h.file_id"""


def header_sets(sets) -> str:
    rows = ", ".join(
        f"({v}, {text(h)}, {text('price' if m == 'unit_price' else m)}, {1 if m == 'unit_price' else 0})"
        for v, s in enumerate(sets, 1) for h, m in s.items())
    return with_views("header_lines", extra=f"""
        known AS (SELECT * FROM (VALUES {rows}) AS k(variant, header, meaning, late)),""" + HEADERS.split("hits AS")[0].rstrip().rstrip(",") + """,
        found AS (SELECT file_id, variant, meaning, pos, late FROM cells JOIN known ON name = header),
        used AS (SELECT file_id, min(variant) AS variant FROM found GROUP BY file_id)""") + (
        "SELECT h.file_id, any_value(u.variant) AS variant, " + ", ".join(
            f"CAST(arg_min(f.pos, f.late * 1000 - f.pos) FILTER (f.meaning = {text(x)}) AS INT) AS {x}_at" for x in MEANINGS[:-1])
        + """ FROM header_lines h LEFT JOIN used u USING (file_id)
        LEFT JOIN found f ON f.file_id = h.file_id AND f.variant = u.variant GROUP BY h.file_id""")


O["shop_a_mapping"] = header_sets(registry.SHOP_A_HEADERS)
O["shop_b_mapping"] = header_sets(registry.SHOP_B_HEADERS)
STATEMENT = ", ".join(f"({text(m)}, {text(h.lower())})" for m, hs in registry.STATEMENT_HEADERS.items() for h in hs)
O["statement_mapping"] = with_views("header_lines", extra=f"""
    known AS (SELECT * FROM (VALUES {STATEMENT}) AS k(meaning, header)),""" + HEADERS.split("hits AS")[0].rstrip().rstrip(",") + """,
    first AS (SELECT file_id, meaning, arg_min(name, pos) AS name FROM cells JOIN known ON lower(name) = header GROUP BY ALL),
    placed AS (SELECT f.file_id, f.meaning, max(c.pos) AS pos FROM first f JOIN cells c ON c.file_id = f.file_id AND c.name = f.name GROUP BY ALL)""") + (
    "SELECT h.file_id, " + ", ".join(f"CAST(max(p.pos) FILTER (p.meaning = {text(x)}) AS INT) AS {x}_at" for x in MEANINGS[:-1])
    + " FROM header_lines h LEFT JOIN placed p USING (file_id) GROUP BY h.file_id")

# --- duplicates and import --------------------------------------------------------------------


def first_wins(columns: str) -> str:
    """Clauses that accept rows of ``batch`` (with rn, unique) against ``history``."""
    return f"""
by_order AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, order_id ORDER BY rn) AS nth
        FROM batch WHERE coalesce(order_id, '') <> '') x
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.source = x.source AND h.order_id = x.order_id)),
no_id AS (SELECT * FROM batch WHERE coalesce(order_id, '') = ''),
pool AS (SELECT source, item_name, purchase_date, price, rn FROM by_order
    UNION ALL SELECT source, item_name, purchase_date, price, rn FROM no_id
    UNION ALL SELECT source, item_name, purchase_date, price, -1 FROM history),
firsts AS (SELECT source, item_name, purchase_date, price, min(rn) AS first_rn FROM pool GROUP BY ALL),
by_composite AS (SELECT n.* FROM no_id n LEFT JOIN firsts f ON f.source = n.source AND f.item_name = n.item_name
        AND f.purchase_date = n.purchase_date AND f.price = n.price
    WHERE coalesce(n.item_name, '') = '' OR n.purchase_date IS NULL OR n.price IS NULL OR f.first_rn = n.rn),
accepted AS (SELECT {columns} FROM by_order UNION ALL SELECT {columns} FROM by_composite)"""


STAGED_COLUMNS = f"{LINE}, source, item_name, price, purchase_date, order_id"
NOT_EMPTY = "NOT (coalesce(item_name, '') = '' AND price IS NULL)"
BATCH = f"""
batch AS (SELECT *, row_number() OVER (ORDER BY {KEY}) AS rn FROM staged
    WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND {NOT_EMPTY}),
history AS (SELECT * FROM staged WHERE l_shipdate < TIMESTAMP '1999-01-01'),"""
STAGED = with_views("staged", extra=BATCH + first_wins(STAGED_COLUMNS))
O["empty_rows_dropped"] = with_views("staged") + f"SELECT {STAGED_COLUMNS} FROM staged WHERE {NOT_EMPTY}"
O["new_by_order_id"] = STAGED + f"SELECT {STAGED_COLUMNS} FROM by_order UNION ALL SELECT {STAGED_COLUMNS} FROM no_id"
O["new_purchases"] = STAGED + f"SELECT {STAGED_COLUMNS} FROM accepted"
O["pruned_new_purchases"] = O["new_purchases"]
O["streamed_new_by_order_id"] = O["new_by_order_id"]
O["new_purchase_counts"] = STAGED + """
SELECT b.source, coalesce(a.n, 0) AS imported, b.n - coalesce(a.n, 0) AS skipped
FROM (SELECT source, count(*) AS n FROM batch GROUP BY source) b
LEFT JOIN (SELECT source, count(*) AS n FROM accepted GROUP BY source) a USING (source)"""


def exported(layouts: str, columns: str, where: str = "TRUE") -> str:
    """The batch that importing the written layouts must see, computed without any text parsing."""
    return with_views("export_rows", extra=f"""
batch AS (SELECT {columns}, format_key, raw_data, row_number() OVER (ORDER BY layout, {KEY}) AS rn FROM (
    SELECT *, CASE layout WHEN 0 THEN 'amazon' WHEN 1 THEN 'amazon' WHEN 2 THEN 'ebay' WHEN 3 THEN 'shopify' ELSE 'credit_card' END AS src,
        CASE layout WHEN 0 THEN 'amazon_jp' WHEN 1 THEN 'amazon_jp' WHEN 2 THEN 'ebay' WHEN 3 THEN 'shopify' ELSE 'generic_credit_card' END AS format_key,
        CASE WHEN layout = 4 AND l_partkey % 13 = 0 THEN '' ELSE trim(quoted_name) END AS item,
        CASE WHEN layout = 4 AND l_partkey % 13 = 0 THEN NULL WHEN layout = 2 THEN units / 100.0 ELSE units END AS amount,
        CASE WHEN layout = 4 AND l_partkey % 17 = 0 THEN NULL ELSE purchase_date END AS day,
        CASE WHEN layout < 4 THEN nullif(order_text, '') END AS ord,
        CASE WHEN layout IN (0, 1, 4) THEN nullif(category_text, '') END AS cat,
        CAST(CASE WHEN layout < 2 THEN json_object('注文日', date_text, '注文番号', order_text, '商品名', item_text, '価格', price_text, 'カテゴリ', category_text)
            WHEN layout = 2 THEN json_object('Item title', item_text, 'Sale price', price_text, 'Sale date', date_text, 'Order number', order_text)
            WHEN layout = 3 THEN json_object('Created at', date_text, 'Lineitem name', item_text, 'Lineitem price', price_text, 'Order', order_text)
            ELSE json_object('利用日', date_text, '利用先', item_text, '金額', price_text, 'カテゴリ', category_text) END AS VARCHAR) AS raw_data
    FROM export_rows WHERE layout IN ({layouts})) e WHERE {where}),
history AS (SELECT * FROM batch WHERE FALSE),""" + first_wins("*"))


GENERAL = """src AS source, item AS item_name, CAST(amount AS DOUBLE) AS price,
    CASE WHEN layout < 2 THEN 'JPY' ELSE 'USD' END AS currency, day AS purchase_date, ord AS order_id, cat AS category"""
FULL = exported("0, 1, 2, 3, 4", GENERAL, "NOT (item = '' AND amount IS NULL)")
IMPORTED = "source, item_name, price, currency, purchase_date, order_id"
O["import_folder"] = FULL.replace("(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", f"""(
    SELECT {IMPORTED}, category, raw_data FROM by_order UNION ALL SELECT {IMPORTED}, category, raw_data FROM by_composite)""") + f"""
SELECT {IMPORTED}, category, raw_data FROM accepted"""
O["import_folder_statistics"] = FULL.replace("(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", """(
    SELECT format_key FROM by_order UNION ALL SELECT format_key FROM by_composite)""") + """
SELECT format_key, imported, n - imported AS skipped, 0::BIGINT AS errors
FROM (SELECT format_key, count(*) AS n FROM batch GROUP BY format_key)
JOIN (SELECT format_key, count(*) AS imported FROM accepted GROUP BY format_key) USING (format_key)"""
NAMES = " ".join(f"WHEN {text(k)} THEN {text(f['name'])}" for k, f in registry.FORMATS.items())
O["import_format_names"] = f"""
SELECT CASE format_key {NAMES} END AS format_name, imported FROM ({O["import_folder_statistics"]})"""
O["import_shop_a"] = exported("0, 1", GENERAL.replace(", cat AS category", "")).replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", "(SELECT 1)") + f"""
SELECT {IMPORTED} FROM by_order UNION ALL SELECT {IMPORTED} FROM no_id"""
O["import_shop_a_rejects"] = with_views("export_rows") + """
SELECT DISTINCT CASE layout WHEN 2 THEN 'c-auction' WHEN 3 THEN 'd-store' ELSE 'e-statement' END AS folder, 'unknown_header' AS reason
FROM export_rows WHERE layout > 1"""
# The importer's own layouts are copies of every row with order ids of their own; layouts 0 and 1 have neither its price nor its date.
O["import_shop_b"] = exported("0, 1", """'rakuten' AS source, item AS item_name, CASE WHEN layout > 1 THEN CAST(amount AS DOUBLE) END AS price,
    'JPY' AS currency, CASE WHEN layout > 1 THEN day END AS purchase_date, ord AS order_id""").replace(
    "FROM export_rows WHERE layout IN (0, 1)", """FROM (SELECT * FROM export_rows WHERE layout < 2 UNION ALL
        SELECT * REPLACE (CAST(5 + l_orderkey % 2 AS INT) AS layout, CASE WHEN order_text = '' THEN '' ELSE 'B' || order_text END AS order_text,
            item_text AS quoted_name) FROM export_rows)""").replace("layout < 4 THEN nullif(order_text", "TRUE THEN nullif(order_text").replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", "(SELECT 1)") + f"""
SELECT {IMPORTED} FROM by_order UNION ALL SELECT {IMPORTED} FROM no_id"""
O["import_shop_a_english"] = exported("0, 1", """'amazon' AS source, item AS item_name,
    CASE WHEN layout < 2 THEN amount WHEN l_partkey % 3 > 0 THEN units / 100.0 END AS price,
    CASE WHEN layout < 2 THEN 'JPY' ELSE 'USD' END AS currency, day AS purchase_date, ord AS order_id""").replace(
    "FROM export_rows WHERE layout IN (0, 1)", """FROM (SELECT * FROM export_rows WHERE layout < 2 UNION ALL
        SELECT * REPLACE (7 AS layout, item_text AS quoted_name) FROM export_rows)""").replace("layout < 4 THEN nullif(order_text", "TRUE THEN nullif(order_text").replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", "(SELECT 1)") + f"""
SELECT source, item_name, CAST(price AS DOUBLE) AS price, currency, purchase_date, order_id
FROM (SELECT {IMPORTED} FROM by_order UNION ALL SELECT {IMPORTED} FROM no_id)"""
O["import_mixed_rejects"] = with_views("export_rows") + """
SELECT DISTINCT CASE layout WHEN 2 THEN 'c-auction' WHEN 3 THEN 'd-store' ELSE 'e-statement' END AS folder, 'unknown_header' AS reason
FROM export_rows WHERE layout > 1
UNION ALL SELECT 'i-undecodable', 'undecodable' WHERE EXISTS (SELECT 1 FROM export_rows) UNION ALL SELECT 'j-empty', 'empty_file'"""
SHORT = "l_partkey % 5 = 0"
O["import_short_rows"] = exported("3", GENERAL, f"NOT ({SHORT}) AND NOT (item = '' AND amount IS NULL)").replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", """(
    SELECT format_key FROM by_order UNION ALL SELECT format_key FROM by_composite)""") + f"""
SELECT 'shopify' AS format_key, (SELECT count(*) FROM accepted) AS imported,
    (SELECT count(*) FROM batch) - (SELECT count(*) FROM accepted) AS skipped,
    (SELECT count(*) FROM export_rows WHERE layout = 3 AND {SHORT}) AS errors"""
O["import_statement"] = exported("4", """'credit_card' AS source, item AS item_name, CAST(amount AS DOUBLE) AS price, 'USD' AS currency,
    day AS purchase_date, CAST(NULL AS VARCHAR) AS order_id""", "NOT (item = '' AND amount IS NULL)").replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", f"(SELECT {IMPORTED} FROM by_order UNION ALL SELECT {IMPORTED} FROM by_composite)") + f"""
SELECT {IMPORTED} FROM accepted"""
O["appended_purchases"] = PURCHASES + """
SELECT CASE WHEN purchase_date < DATE '1998-01-01' THEN 'b1' ELSE 'b2' END AS batch_id, source, count(*) AS n, count(*) AS n_ids,
    round(sum(price), 2) AS total FROM purchases GROUP BY 1, 2"""

O["spending_kept_up"] = f"""
SELECT 'source' AS section, source AS label, currency AS unit, items, total FROM ({O["spend_by_source_month"]})
UNION ALL SELECT 'category', category, NULL, items, total FROM ({O["spend_by_category_month"]})
UNION ALL SELECT 'month', month, NULL, items, total FROM ({O["spend_monthly_trend"]})
UNION ALL SELECT 'health', NULL, currency, items, total FROM ({O["health_spend_month"]})
UNION ALL SELECT 'week', source, currency, items, total FROM ({O["weekly_spend_report"]})
UNION ALL SELECT 'previous month', NULL, currency, previous_items, previous_total FROM ({O["month_over_month"]})
UNION ALL SELECT 'current month', NULL, currency, current_items, current_total FROM ({O["month_over_month"]})"""

# --- receipts ---------------------------------------------------------------------------------
PRICES = ["[¥￥][ \\t]*([0-9][0-9,]+)", "([0-9][0-9,]+)[ \\t]*円", "\\$[ \\t]*([0-9][0-9,]*\\.[0-9]{2})", "([0-9][0-9,]*\\.[0-9]{2})"]
TOTALS = "合計|小計|総計|お支払い|お買上|tax[ \\t]*incl|total|amount[ \\t]*due|balance"


def line_price(line: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({line}, '{p}', 1), '')" for p in PRICES)
    return f"CAST(replace(coalesce({found}), ',', '') AS DOUBLE)"


def line_name(line: str) -> str:
    name = line
    for p in [*PRICES, "[¥￥$×x*][ \\t]*[0-9]+"]:
        name = f"regexp_replace({name}, '{p}', '', 'g')"
    return f"rtrim(trim(regexp_replace({name}, '[ \\t]{{2,}}', ' ', 'g')), '.-_= ')"


RECEIPT = f"""
raw_lines AS (SELECT row_id, image_path, trim(unnest(string_split(ocr_text, chr(10)))) AS line,
    generate_subscripts(string_split(ocr_text, chr(10)), 1) AS line_no FROM ocr),
lines AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY line_no) AS pos,
    regexp_matches(line, '{TOTALS}', 'i') AS is_total, {line_price('line')} AS price FROM raw_lines WHERE line <> ''),
line_items AS (SELECT row_id, image_path, pos, name, price FROM (
    SELECT *, {line_name('line')} AS name FROM lines WHERE length(line) >= 3 AND NOT is_total AND price > 0) WHERE length(name) >= 2),
stores AS (SELECT row_id, arg_min(line, pos) AS store_name FROM lines WHERE pos <= 5 AND length(line) >= 2
    AND NOT regexp_matches(line, '^([0-9]+$|[-=*]+$|tel|fax|phone|電話|レジ|担当|レシート|receipt|no\\.|#)', 'i')
    AND NOT regexp_full_match(line, '[0-9¥￥$,. \\t]+') GROUP BY row_id),
totals AS (SELECT row_id, arg_min(price, pos) AS total_amount FROM lines WHERE is_total AND price IS NOT NULL GROUP BY row_id),
counts AS (SELECT row_id, count(*) AS n_items FROM line_items GROUP BY row_id),
day_parts AS (SELECT row_id,
    regexp_extract(ocr_text, '([0-9]{{4}})[/\\-年]([0-9]{{1,2}})[/\\-月]([0-9]{{1,2}})', ['a', 'b', 'c']) AS ymd,
    regexp_extract(ocr_text, '([0-9]{{1,2}})[/\\-]([0-9]{{1,2}})[/\\-]([0-9]{{4}})', ['a', 'b', 'c']) AS mdy,
    regexp_extract(ocr_text, '([0-9]{{1,2}})[/\\-]([0-9]{{1,2}})[/\\-]([0-9]{{2}})\\b', ['a', 'b', 'c']) AS short FROM ocr),
days AS (SELECT row_id, CASE
    WHEN ymd.a <> '' THEN ymd.a || '-' || lpad(ymd.b, 2, '0') || '-' || lpad(ymd.c, 2, '0')
    WHEN mdy.a <> '' THEN mdy.c || '-' || lpad(mdy.a, 2, '0') || '-' || lpad(mdy.b, 2, '0')
    WHEN short.a <> '' THEN '20' || short.c || '-' || lpad(short.a, 2, '0') || '-' || lpad(short.b, 2, '0') END AS day_text FROM day_parts),
money AS (SELECT row_id, CASE WHEN regexp_matches(ocr_text, '[¥￥円]') THEN 'JPY' WHEN contains(ocr_text, '$') THEN 'USD'
    WHEN contains(ocr_text, '€') THEN 'EUR' WHEN contains(ocr_text, '£') THEN 'GBP' ELSE 'JPY' END AS currency FROM ocr),
scored AS (SELECT row_id, coalesce(avg(conf) FILTER (conf > 0), 0.0) AS confidence FROM (
    SELECT row_id, CASE WHEN length(w) % 7 = 0 THEN NULL ELSE length(w) * 13 % 101 - 1 END AS conf
    FROM (SELECT row_id, unnest(string_split(ocr_text, ' ')) AS w FROM ocr)) GROUP BY row_id)"""
SCANS = with_views("ocr", extra=RECEIPT)
O["receipt_fields"] = SCANS + """
SELECT image_path, store_name, day_text AS receipt_date_text, TRY_CAST(day_text AS DATE) AS receipt_date, total_amount, currency,
    CAST(coalesce(n_items, 0) AS INT) AS n_items
FROM ocr LEFT JOIN stores USING (row_id) LEFT JOIN totals USING (row_id) LEFT JOIN counts USING (row_id)
LEFT JOIN days USING (row_id) LEFT JOIN money USING (row_id)"""
O["receipt_items"] = SCANS + "SELECT image_path, name, price, count(*) AS n FROM line_items GROUP BY ALL"
O["receipt_confidence"] = SCANS + """
SELECT image_path, round(confidence, 6) AS ocr_confidence, CASE WHEN trim(ocr_text) = '' THEN 'empty_text' WHEN confidence < 50 THEN 'review' ELSE 'ok' END AS status
FROM ocr LEFT JOIN scored USING (row_id)"""
O["image_hashes"] = "SELECT doc_id, sha256(text) AS image_hash FROM documents"
NEW_SCANS = with_views("ocr", extra=RECEIPT + """,
hashed AS (SELECT row_id, image_path, ocr_text, sha256(ocr_text) AS image_hash FROM ocr),
stored AS (SELECT CASE WHEN contains(ocr_text, 'BALANCE') THEN 'old/' || image_path ELSE image_path END AS image_path,
    CASE WHEN contains(ocr_text, 'BALANCE') THEN image_hash ELSE 'changed' END AS image_hash
    FROM hashed WHERE contains(ocr_text, 'no day printed')),
new_scans AS (SELECT row_id, image_path, image_hash FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.image_hash ORDER BY h.row_id) AS nth FROM hashed h JOIN counts USING (row_id)
    WHERE h.image_path NOT IN (SELECT image_path FROM stored)) f
    WHERE nth = 1 AND image_hash NOT IN (SELECT image_hash FROM stored))""")
O["new_receipts"] = NEW_SCANS + "SELECT image_path, image_hash FROM new_scans"
O["receipt_purchases"] = NEW_SCANS + """
SELECT 'receipt_id=' || CAST(row_id AS VARCHAR) || ',store=' || coalesce(store_name, 'None') AS raw_data, name AS item_name, price, currency,
    TRY_CAST(day_text AS DATE) AS purchase_date, 'receipt' AS source, count(*) AS n
FROM new_scans JOIN line_items USING (row_id) LEFT JOIN stores USING (row_id) LEFT JOIN days USING (row_id) LEFT JOIN money USING (row_id)
GROUP BY ALL"""
O["receipt_tables"] = NEW_SCANS + """
SELECT 'receipt_scans' AS table_name, count(*) AS n FROM new_scans
UNION ALL SELECT 'receipt_items', count(*) FROM new_scans JOIN line_items USING (row_id)
UNION ALL SELECT 'purchase_history', count(*) FROM new_scans JOIN line_items USING (row_id)"""

O["loaded_receipts"] = NEW_SCANS + """
SELECT image_path, count(*) AS n, count(*) AS n_purchases, round(sum(price), 2) AS total
FROM new_scans JOIN (SELECT row_id, name, price FROM line_items) USING (row_id) GROUP BY image_path"""
O["receipt_key_violations"] = NEW_SCANS + """
SELECT 'receipt_items' AS table_name, CASE WHEN price % 2 = 0 THEN 'foreign_key:receipt_id' ELSE 'foreign_key:purchase_history_id' END AS rule,
    count(*) AS n FROM new_scans JOIN line_items USING (row_id) GROUP BY ALL"""
O["scanned_receipts"] = SCANS + """
SELECT image_path, sha256(ocr_text) AS image_hash, store_name, TRY_CAST(day_text AS DATE) AS receipt_date, total_amount, currency,
    CAST(coalesce(n_items, 0) AS INT) AS n_items, round(confidence, 6) AS ocr_confidence,
    CASE WHEN trim(ocr_text) = '' THEN 'empty_text' WHEN confidence < 50 THEN 'review' ELSE 'ok' END AS status
FROM ocr LEFT JOIN stores USING (row_id) LEFT JOIN totals USING (row_id) LEFT JOIN counts USING (row_id)
LEFT JOIN days USING (row_id) LEFT JOIN money USING (row_id) LEFT JOIN scored USING (row_id)"""

# --- detections -------------------------------------------------------------------------------
SEEN = """
seen AS (SELECT session_id, frame, i->>'name' AS name, i->>'category' AS category, i->>'condition' AS condition, i->>'location' AS location
    FROM (SELECT session_id, frame, unnest(from_json(detections, '["JSON"]')) AS i FROM frames WHERE json_valid(detections)))"""
FRAMES = with_views("frames", "sessions", extra=SEEN)
O["detected_items"] = FRAMES + "SELECT session_id, name, category, condition, location, count(*) AS n FROM seen GROUP BY ALL"
O["unreadable_detections"] = with_views("frames") + (
    "SELECT session_id, count(*) AS n FROM frames WHERE NOT json_valid(detections) GROUP BY session_id")
PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~ ]+"""
O["consolidated_items"] = with_views("frames", "sessions", extra=SEEN + f""",
keyed AS (SELECT *, trim(regexp_replace(lower(name), '{PUNCT}', ' ', 'g')) AS name_key,
    trim(regexp_replace(lower(location), '{PUNCT}', ' ', 'g')) AS location_key FROM seen),
spelled AS (SELECT session_id, name_key, category, location_key, name, count(*) AS n,
    contains(any_value(audio_transcript), name) AS said FROM keyed JOIN sessions USING (session_id)
    GROUP BY session_id, name_key, category, location_key, name),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, name_key, category, location_key
    ORDER BY said DESC, n DESC, name DESC) AS nth FROM spelled) WHERE nth = 1),
facts AS (SELECT session_id, name_key, category, location_key, min(location) AS location, count(*) AS frames FROM keyed GROUP BY ALL),
conditions AS (SELECT * FROM (SELECT session_id, name_key, category, location_key, condition, row_number() OVER (
    PARTITION BY session_id, name_key, category, location_key ORDER BY frame, condition) AS nth FROM keyed) WHERE nth = 1)""") + """
SELECT session_id, name_key, category, c.name, f.location, d.condition, f.frames, c.said AS from_audio
FROM chosen c JOIN facts f USING (session_id, name_key, category, location_key)
JOIN conditions d USING (session_id, name_key, category, location_key)"""
MISREAD = with_views("misread_frames", "talking_sessions", extra=SEEN.replace("FROM frames", "FROM misread_frames") + f""",
keyed AS (SELECT *, trim(regexp_replace(lower(name), '{PUNCT}', ' ', 'g')) AS name_key,
    trim(regexp_replace(lower(location), '{PUNCT}', ' ', 'g')) AS location_key FROM seen),
heard AS (SELECT session_id, ' ' || trim(regexp_replace(lower(coalesce(audio_transcript, '')), '{PUNCT}', ' ', 'g')) || ' ' AS words
    FROM talking_sessions),
named AS (SELECT DISTINCT session_id, name_key FROM keyed),
spoken AS (SELECT session_id, name_key FROM named JOIN heard USING (session_id) WHERE contains(words, ' ' || name_key || ' '))""")
O["spoken_items"] = MISREAD + "SELECT session_id, name_key FROM spoken"
O["similar_items"] = MISREAD.replace("WITH ", "WITH RECURSIVE ", 1) + """,
places AS (SELECT session_id, category, location_key, name_key, row_number() OVER () AS id
    FROM (SELECT DISTINCT session_id, category, location_key, name_key FROM keyed)),
near AS (SELECT a.id AS a, b.id AS b FROM places a JOIN places b USING (session_id, category, location_key)
    WHERE regexp_replace(a.name_key, '[^0-9]', '', 'g') = regexp_replace(b.name_key, '[^0-9]', '', 'g')
    AND 10 * levenshtein(a.name_key, b.name_key) <= 2 * greatest(length(a.name_key), length(b.name_key))),
reach AS (SELECT id, id AS far FROM places UNION SELECT r.id, n.b FROM reach r JOIN near n ON r.far = n.a),
roots AS (SELECT id, min(far) AS root FROM reach GROUP BY id),
placed AS (SELECT k.*, root, s.name_key IS NOT NULL AS said FROM keyed k
    JOIN places p USING (session_id, category, location_key, name_key) JOIN roots USING (id)
    LEFT JOIN spoken s ON s.session_id = k.session_id AND s.name_key = k.name_key),
chosen AS (SELECT root, name FROM (SELECT root, name, row_number() OVER (PARTITION BY root ORDER BY said DESC, n DESC, name DESC) AS nth
    FROM (SELECT root, name, said, count(*) AS n FROM placed GROUP BY root, name, said)) WHERE nth = 1),
conditions AS (SELECT root, condition FROM (SELECT root, condition, row_number() OVER (PARTITION BY root ORDER BY frame, condition) AS nth
    FROM placed) WHERE nth = 1)
SELECT session_id, c.name, category, min(location) AS location, d.condition, count(*) AS frames, bool_or(said) AS from_audio,
    count(DISTINCT name_key) AS n_names
FROM placed p JOIN chosen c USING (root) JOIN conditions d USING (root) GROUP BY session_id, root, c.name, category, d.condition"""
O["video_sessions"] = with_views("sessions") + f"""
SELECT video_path, frame_count, has_audio, audio_transcript, 0 AS items_detected, 0 AS items_confirmed, {NOW} AS processed_at FROM sessions"""

# --- state ------------------------------------------------------------------------------------
KIND_DAYS = "CASE kind " + " ".join(f"WHEN {text(k)} THEN {d}" for k, d in schemas.KIND_LIFESPANS.items()) + " ELSE 30 END"
NEW = f"""
WITH new AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 0 THEN p_name END AS name,
    CASE p_partkey % 9 WHEN 0 THEN 'gadget' WHEN 1 THEN 'supplement' WHEN 2 THEN 'food' WHEN 3 THEN 'consumable' ELSE 'kitchen' END AS category,
    p_retailprice, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 40 = 1 THEN 'broken' END, 'good') AS condition,
    p_partkey % 7 = 0 OR p_partkey % 9 IN (1, 2, 3) AS is_consumable,
    CASE WHEN p_partkey % 11 = 0 THEN p_size END AS given, CASE p_partkey % 9 WHEN 3 THEN 'shampoo' WHEN 1 THEN 'supplement' WHEN 2 THEN 'food' ELSE 'kitchen' END AS kind FROM part)
"""
VALID = "name IS NOT NULL AND category <> 'gadget' AND condition <> 'broken'"
O["registered_possessions"] = NEW + f"""
SELECT p_partkey, name, category, p_retailprice AS purchase_price, condition, is_consumable,
    CAST(coalesce(given, CASE WHEN is_consumable THEN {KIND_DAYS} END) AS INT) AS estimated_lifespan_days
FROM new WHERE {VALID}"""
O["refused_possessions"] = NEW + f"""
SELECT p_partkey, CASE WHEN name IS NULL THEN 'not_null:name' WHEN category = 'gadget' THEN 'enum:category' ELSE 'enum:condition' END AS reason
FROM new WHERE NOT ({VALID})"""
O["appended_possessions"] = NEW + f"""
SELECT category, count(*) AS n, count(*) AS n_ids FROM new WHERE {VALID} GROUP BY category
UNION ALL SELECT 'all', count(*), count(*) FROM new WHERE {VALID}"""
O["updated_possessions"] = with_views("possessions", extra="""
changes AS (SELECT l_partkey AS id, l_linenumber % 3 AS col, CASE l_linenumber % 3 WHEN 0 THEN o_orderpriority
        WHEN 1 THEN CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey * 2 AS VARCHAR) END ELSE CAST(o_custkey % 100 AS VARCHAR) END AS value,
    l_orderkey * 100000000 + l_partkey AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
last AS (SELECT id, col, value FROM (SELECT *, row_number() OVER (PARTITION BY id, col ORDER BY seq DESC, value DESC NULLS LAST) AS nth FROM changes) WHERE nth = 1)""") + """
SELECT p.id, p.name, CASE WHEN a.id IS NULL THEN p.location ELSE a.value END AS location,
    CASE WHEN b.id IS NULL THEN p.purchase_price ELSE CAST(b.value AS DOUBLE) END AS purchase_price,
    CASE WHEN c.id IS NULL THEN p.estimated_lifespan_days ELSE CAST(c.value AS INT) END AS estimated_lifespan_days
FROM possessions p LEFT JOIN last a ON a.id = p.id AND a.col = 0 LEFT JOIN last b ON b.id = p.id AND b.col = 1
LEFT JOIN last c ON c.id = p.id AND c.col = 2"""
O["refused_changes"] = """
WITH sent AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_partkey ELSE -l_partkey END AS id,
        CASE l_orderkey % 5 WHEN 0 THEN 'colour' WHEN 1 THEN 'condition' WHEN 2 THEN 'name' ELSE
            CASE l_linenumber % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'purchase_price' ELSE 'estimated_lifespan_days' END END AS column_name,
        CASE l_orderkey % 5 WHEN 1 THEN 'broken' WHEN 2 THEN NULL WHEN 3 THEN 'a few' ELSE CASE l_linenumber % 3 WHEN 0 THEN o_orderpriority
            WHEN 1 THEN CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey * 2 AS VARCHAR) END ELSE CAST(o_custkey % 100 AS VARCHAR) END END AS value,
        l_orderkey * 100000000 + l_partkey AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 7 = 0),
judged AS (SELECT *, CASE WHEN column_name = 'colour' THEN 'unknown_column' WHEN id NOT IN (SELECT p_partkey FROM part) THEN 'unknown_id'
    WHEN column_name = 'name' THEN 'not_null' WHEN column_name = 'condition' THEN 'enum'
    WHEN value = 'a few' AND column_name <> 'location' THEN 'unreadable' END AS reason FROM sent)
SELECT * FROM judged WHERE reason IS NOT NULL"""
O["remaining_possessions"] = POSSESSIONS + """
SELECT id, name, category FROM possessions WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"""
RAW_EVENTS = f"""WITH raw AS (SELECT event_id AS id, CASE WHEN user_id % 13 <> 0 THEN user_id END AS possession_id,
    CASE event_type WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'empty' ELSE event_type END AS event_type,
    CASE WHEN event_id % 5 <> 0 THEN ts ELSE {LOG_NOW} END AS logged_at FROM events) """
RAW_EVENTS += """, judged AS (SELECT *, CASE WHEN possession_id IS NULL THEN 'not_null:possession_id'
    WHEN event_type NOT IN ('opened', 'empty') THEN 'enum:event_type'
    WHEN possession_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) THEN 'foreign_key:possession_id' END AS reason FROM raw) """
O["logged_events"] = RAW_EVENTS + "SELECT id, possession_id, event_type, logged_at FROM judged WHERE reason IS NULL"
O["refused_events"] = RAW_EVENTS + "SELECT id, possession_id, event_type, reason FROM judged WHERE reason IS NOT NULL"
REPLENISHED = """SELECT possession_id, CAST(max(logged_at) AS DATE) AS replenished_on FROM consumption_log
    WHERE event_type IN ('opened', 'replaced') GROUP BY possession_id"""
O["replenished_possessions"] = with_views("possessions", "consumption_log", extra=f"days AS ({REPLENISHED})") + """
SELECT id, name, coalesce(replenished_on, last_replenished) AS last_replenished FROM possessions LEFT JOIN days ON possession_id = id"""
O["latest_status"] = with_views("consumption_log") + """
SELECT possession_id, event_type, logged_at FROM (SELECT *, row_number() OVER (
    PARTITION BY possession_id ORDER BY logged_at DESC, id DESC) AS nth FROM consumption_log) WHERE nth = 1"""
O["streamed_latest_status"] = O["latest_status"]
O["streamed_replenishment"] = with_views("consumption_log") + REPLENISHED

# --- quality ----------------------------------------------------------------------------------
O["streamed_lifespan_alerts"] = with_views("possessions", "consumption_log") + """
SELECT possession_id, day AS last_replenished, day + CAST(trunc(estimated_lifespan_days * 0.8) AS INT) AS alert_on
FROM (SELECT possession_id, CAST(max(logged_at) AS DATE) AS day FROM consumption_log
    WHERE event_type = 'replaced' AND logged_at <= TIMESTAMP '2024-02-20 12:00:00' GROUP BY possession_id) r JOIN possessions p ON p.id = r.possession_id
WHERE is_consumable AND estimated_lifespan_days IS NOT NULL
    AND CAST(day + CAST(trunc(estimated_lifespan_days * 0.8) AS INT) AS TIMESTAMP) < TIMESTAMP '2024-02-20 12:00:00'"""
STREAMED = """
replenished AS (SELECT p.*, CAST(day AS DATE) AS day FROM possessions p JOIN (
    SELECT possession_id, max(logged_at) AS day FROM consumption_log
    WHERE event_type = 'replaced' AND logged_at <= TIMESTAMP '2024-02-20 12:00:00' GROUP BY possession_id) r ON p.id = r.possession_id
    WHERE is_consumable)"""
O["streamed_learned_alerts"] = with_views("possessions", "consumption_log", extra=CYCLES.replace(
    "GROUP BY", "AND a.logged_at <= TIMESTAMP '2024-02-20 12:00:00' AND b.logged_at <= TIMESTAMP '2024-02-20 12:00:00' GROUP BY") + "," + STREAMED) + """
SELECT id AS possession_id, day AS last_replenished, coalesce(round(cycle_days, 6), CAST(estimated_lifespan_days AS DOUBLE)) AS cycle_days,
    cycle_days IS NOT NULL AS is_learned
FROM replenished LEFT JOIN cycles ON id = possession_id
WHERE CAST(day + CAST(floor(round(coalesce(round(cycle_days, 6), CAST(estimated_lifespan_days AS DOUBLE)) * CAST(0.8 AS DOUBLE), 6)) AS INT) AS TIMESTAMP)
    <= TIMESTAMP '2024-02-20 12:00:00'"""
O["streamed_due_items"] = with_views("possessions", "consumption_log", extra=STREAMED + """,
marked AS (SELECT id, day, concat_ws(',',
    CASE WHEN CAST(day + CAST(trunc(estimated_lifespan_days * 0.8) AS INT) AS TIMESTAMP) <= TIMESTAMP '2024-02-20 12:00:00' THEN 'replenish' END,
    CASE WHEN CAST(day + CAST(estimated_lifespan_days AS INT) AS TIMESTAMP) <= TIMESTAMP '2024-02-27 12:00:00' THEN 'due_week' END,
    CASE WHEN CAST(day + CAST(estimated_lifespan_days AS INT) AS TIMESTAMP) <= TIMESTAMP '2024-02-20 12:00:00' THEN 'empty' END) AS marks
    FROM replenished)""") + """
SELECT id AS possession_id, day AS last_replenished, marks FROM marked WHERE marks <> ''"""
CHECKED = with_views("possessions", "purchases", extra="""
owned AS (SELECT id, CASE WHEN id % 25 <> 0 THEN name END AS name, CASE WHEN id % 9 = 0 THEN 'gadget' ELSE category END AS category, condition
    FROM possessions),
logged AS (SELECT event_id AS id, CASE WHEN event_id % 23 = 0 THEN -user_id ELSE user_id END AS possession_id, CASE WHEN event_type = 'view' THEN 'opened' ELSE event_type END AS event_type,
    CASE WHEN event_id % 40 <> 0 THEN ts END AS logged_at FROM events),
bought AS (SELECT l_orderkey * 100 + l_linenumber AS id, source,
    CASE WHEN l_orderkey % 17 = 0 THEN -possession_id ELSE possession_id END AS possession_id, CASE WHEN l_orderkey % 30 <> 0 THEN currency END AS currency FROM purchases)""")
ENUM = f"""
SELECT 'possessions' AS table_name, 'enum:category' AS rule, CAST(id AS VARCHAR) AS key, category AS value FROM owned
    WHERE category NOT IN ({', '.join(map(text, schemas.CATEGORIES))})
UNION ALL SELECT 'possessions', 'enum:condition', CAST(id AS VARCHAR), condition FROM owned
    WHERE condition NOT IN ({', '.join(map(text, schemas.CONDITIONS))})
UNION ALL SELECT 'consumption_log', 'enum:event_type', CAST(id AS VARCHAR), event_type FROM logged
    WHERE event_type NOT IN ({', '.join(map(text, schemas.EVENT_TYPES))})"""
NULLS = """
SELECT 'possessions' AS table_name, 'not_null:name' AS rule, CAST(id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS value FROM owned WHERE name IS NULL
UNION ALL SELECT 'consumption_log', 'not_null:logged_at', CAST(id AS VARCHAR), NULL FROM logged WHERE logged_at IS NULL
UNION ALL SELECT 'purchase_history', 'not_null:currency', CAST(id AS VARCHAR), NULL FROM bought WHERE currency IS NULL"""
FOREIGN = """
SELECT 'purchase_history' AS table_name, 'foreign_key:possession_id' AS rule, CAST(id AS VARCHAR) AS key, CAST(possession_id AS VARCHAR) AS value
    FROM bought WHERE possession_id NOT IN (SELECT id FROM owned)
UNION ALL SELECT 'consumption_log', 'foreign_key:possession_id', CAST(id AS VARCHAR), CAST(possession_id AS VARCHAR)
    FROM logged WHERE possession_id NOT IN (SELECT id FROM owned)"""
O["enum_violations"] = CHECKED + ENUM
O["null_violations"] = CHECKED + NULLS
O["foreign_key_violations"] = CHECKED + FOREIGN
UNIQUE = """
SELECT 'purchase_history' AS table_name, 'unique:id' AS rule, CAST(id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value
FROM bought GROUP BY id HAVING count(*) > 1"""
O["key_violations"] = CHECKED + UNIQUE
O["violation_counts"] = CHECKED + f"""
SELECT table_name, rule, count(*) AS n FROM (({ENUM}) UNION ALL ({NULLS}) UNION ALL ({UNIQUE}) UNION ALL ({FOREIGN})) GROUP BY ALL"""
O["filled_defaults"] = CHECKED + f"""
SELECT source, coalesce(currency, 'JPY') AS currency, {NOW} AS created_at, count(*) AS n FROM bought GROUP BY ALL"""
O["custom_sources"] = exported("0, 1, 2, 3, 4", GENERAL.replace("src AS source", "'corner shop' AS source"), "NOT (item = '' AND amount IS NULL)").replace(
    "(SELECT * FROM by_order UNION ALL SELECT * FROM by_composite)", f"""(
    SELECT {IMPORTED}, category FROM by_order UNION ALL SELECT {IMPORTED}, category FROM by_composite)""") + f"""
SELECT {IMPORTED}, category FROM accepted"""
O["backfilled_purchases"] = PURCHASES + "SELECT source, count(*) AS n, round(sum(price), 2) AS total FROM purchases GROUP BY source"
O["recorded_versions"] = """
SELECT 'v' || CAST(year(l_shipdate) AS VARCHAR) AS version,
    CAST(min(l_shipdate) + CASE WHEN year(l_shipdate) < 1997 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS TIMESTAMP) AS applied_at
FROM lineitem GROUP BY year(l_shipdate)"""
O["evolved_scans"] = with_views("ocr") + """
SELECT row_id, image_path, CASE WHEN row_id < 0 THEN sha256(ocr_text) END AS image_hash FROM ocr"""

ORACLES = O
