"""Header names to column positions, and format detection: one row per file in, one out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.functions.text import strip
from cupboard.registry import DEFAULT_SOURCE, FALLBACK_FORMAT, SHOP_A_HEADERS, SHOP_B_HEADERS, STATEMENT_HEADERS

MEANINGS = ("item_name", "price", "purchase_date", "order_id", "category")
MIN_SCORE = 2


def split_header(line: Column) -> Column:
    """Cells of a header line, with quotes resolved."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda cell: F.when(
        cell.startswith('"'), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(cell))


def _last_position(names: Column, name: Column) -> Column:
    """Position of the last cell with a name, NULL if absent: of equal headers the last one holds the value."""
    from_end = F.array_position(F.reverse(names), name)
    return F.when(from_end > 0, F.size(names) - from_end + 1)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def match_column(names: Column, lowered: Column, candidates: Column, lowered_candidates: Column) -> Column:
    """Position of the first candidate found exactly, else of the first found in any case."""
    return F.coalesce(
        _first(F.transform(candidates, lambda c: _last_position(names, c))),
        _first(F.transform(lowered_candidates, lambda c: _last_position(lowered, c))),
    )


def _registry(formats: dict) -> Column:
    """The formats as one array literal in registry order; ``meanings`` follow MEANINGS, then the rest."""
    rows = []
    for key, definition in formats.items():
        columns = definition["columns"]
        meanings = [*MEANINGS, *[m for m in columns if m not in MEANINGS]]
        rows.append({
            "key": key,
            "name": definition.get("name", key),
            "source": definition.get("source_key", DEFAULT_SOURCE),
            "meanings": [
                {"names": columns.get(m, []), "lowered": [c.lower() for c in columns.get(m, [])]} for m in meanings
            ],
        })
    schema = "array<struct<key: string, name: string, source: string, meanings: array<struct<names: array<string>, lowered: array<string>>>>>"
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


def match_formats(names: Column, lowered: Column, formats: dict) -> Column:
    """Per format in registry order: key, source, the position of each meaning and the number found."""
    def matched(f: Column) -> Column:
        positions = F.transform(f["meanings"], lambda m: match_column(names, lowered, m["names"], m["lowered"]))
        return F.struct(
            f["key"].alias("key"), f["name"].alias("name"), f["source"].alias("source"), positions.alias("positions"),
            F.size(F.filter(positions, lambda p: p.isNotNull())).alias("score"),
        )

    return F.transform(_registry(formats), matched)


def detect_format(matches: Column) -> Column:
    """Index of the best score, ties to the earlier format; NULL below two matches."""
    best = F.array_max(F.transform(matches, lambda m, i: F.struct(m["score"].alias("score"), (-i).alias("later"))))
    return F.when(best["score"] >= MIN_SCORE, -best["later"])


def _repeated_at() -> Column:
    """Where a name occurs more than once, the position of the last cell of each name; NULL elsewhere."""
    header, at_all = F.col("header"), F.sequence(F.lit(1), F.size("header"))
    last = F.filter(at_all, lambda at: _last_position(header, F.get(header, at - 1)) == at)
    return F.when(F.size(F.array_distinct(header)) < F.size(header), last)


def _per_header(files: DataFrame, mapping: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Map each distinct header once and join the result back: files share few headers."""
    distinct = files.select("header").distinct()
    names = distinct.withColumn("names", F.transform("header", strip)).withColumn("repeated_at", _repeated_at())
    mapped = mapping(names.withColumn("lowered", F.transform("names", F.lower))).drop("lowered")
    return files.join(mapped, "header", "left")


def score_formats(files: DataFrame, formats: dict) -> DataFrame:
    """Add the matches of every format, and the index of the one detected."""
    def scored(headers: DataFrame) -> DataFrame:
        matches = headers.withColumn("matches", match_formats(F.col("names"), F.col("lowered"), formats))
        return matches.withColumn("detected", detect_format(F.col("matches")))

    return _per_header(files, scored)


def map_by_registry(
    files: DataFrame, formats: dict, format_key: str | None = None, source: str | None = None
) -> DataFrame:
    """Add format, source and the position of each meaning to files with a ``header`` array.

    A known ``format_key`` wins; an unknown one falls back to detection, and no detection to the
    statement format. Without a statement format the file has no mapping and the default source.
    """
    if FALLBACK_FORMAT not in formats:
        formats = {**formats, FALLBACK_FORMAT: {"source_key": DEFAULT_SOURCE, "columns": {}}}
    keys = list(formats)
    files = score_formats(files, formats)
    if format_key in formats:
        index = F.lit(keys.index(format_key))
    else:
        index = F.coalesce("detected", F.lit(keys.index(FALLBACK_FORMAT)))
    chosen = files.withColumn("chosen", F.get("matches", index))
    return chosen.withColumns({
        "format_key": F.col("chosen.key"),
        "format_name": F.col("chosen.name"),
        "source": F.lit(source) if source else F.col("chosen.source"),
        **{f"{m}_at": F.get("chosen.positions", F.lit(i)).cast("int") for i, m in enumerate(MEANINGS)},
    }).drop("matches", "detected", "chosen")


def map_by_header_sets(files: DataFrame, header_sets, source: str) -> DataFrame:
    """Exact header names; the alternate set counts only if no header is in the primary set.

    ``variant`` is 1 or 2 for the set used, NULL if neither matches.
    """
    hits = [F.arrays_overlap("names", F.array(*map(F.lit, s))) for s in header_sets]
    variant = F.when(hits[0], 1).when(hits[1], 2)

    def position(meaning: str) -> Column:
        branches = F
        for number, header_set in enumerate(header_sets, 1):
            wanted = [h for h, m in header_set.items() if m == meaning]
            if meaning == "price":  # a unit price stands in for a missing line price
                wanted += [h for h, m in header_set.items() if m == "unit_price"]
            found = [_last_position(F.col("names"), F.lit(h)) for h in wanted]
            branches = branches.when(F.col("variant") == number, F.coalesce(*found, F.lit(None).cast("long")))
        return branches.otherwise(F.lit(None)).cast("int")

    mapped = _per_header(files, lambda headers: headers.withColumn("variant", variant).withColumns(
        {f"{m}_at": position(m) for m in MEANINGS[:-1]}
    ))
    return mapped.withColumns({"category_at": F.lit(None).cast("int"), "source": F.lit(source)})


def map_shop_a(files: DataFrame) -> DataFrame:
    return map_by_header_sets(files, SHOP_A_HEADERS, "amazon")


def map_shop_b(files: DataFrame) -> DataFrame:
    return map_by_header_sets(files, SHOP_B_HEADERS, "rakuten")


def map_statement(files: DataFrame, source: str = "credit_card") -> DataFrame:
    """Statement importer: for each meaning the first header, in header order, that is a candidate in any case."""
    def position(meaning: str) -> Column:
        wanted = F.array(*[F.lit(c.lower()) for c in STATEMENT_HEADERS[meaning]])
        first = F.get(F.filter("lowered", lambda h: F.array_contains(wanted, h)), 0)
        name = F.get(F.col("names"), F.array_position(F.col("lowered"), first).cast("int") - 1)
        return F.when(first.isNotNull(), _last_position(F.col("names"), name)).cast("int")

    mapped = _per_header(files, lambda headers: headers.withColumns({f"{m}_at": position(m) for m in MEANINGS[:-1]}))
    return mapped.withColumns({"category_at": F.lit(None).cast("int"), "source": F.lit(source)})
