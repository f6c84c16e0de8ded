"""Quality rules with thresholds that follow each language and source, in built-in functions only.

Every metric is summarised per (lang, source) by a quantile sketch: counts of documents in buckets whose edges grow by a
constant factor, so any quantile is known to that factor. Sketches merge by adding counts, whatever the order, so those
of a language and of the whole table come from the small ones, and two runs agree. A threshold is a fence
beyond an upper (or lower) quantile of the group, as far away as the group's own spread says, plus a gap; a corpus of
clean documents therefore loses nothing, while documents far from their own group fail. Groups below ``min_group``
documents use their language's sketch, and languages below it the table's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from .common import BLANK_CLASS, words

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8


@dataclass(frozen=True)
class Rule:
    """A metric fails above ``q75 + ranges * (q75 - q25) + gap + tail * q(tail_at)``, its group's quantiles; a lower rule fails
    below ``q25 - ranges * (q75 - q25) - gap``.

    Where most documents have none of something, the quartiles are zero, and the bound follows a quantile further out: a
    group in which one document in ten repeats a few lines has a wider bound than a spotless one.
    """

    name: str
    metric: str
    ranges: float
    gap: float
    tail: float = 0.0
    tail_at: float = 0.95
    lower: bool = False


RULES = (
    Rule("symbol_share", "symbol_share", 8.0, 0.02, tail=0.25),
    Rule("repeat_share", "repeat_share", 8.0, 0.20, tail=1.0, tail_at=0.90),
    Rule("dup_line_share", "dup_line_share", 8.0, 0.35, tail=0.5),
    Rule("word_length", "word_length", 8.0, 4.0),
    Rule("short_words", "word_length", 8.0, 0.5, lower=True),
    Rule("brevity", "brevity", 8.0, 0.02),
)
# Edges of the sketches' buckets grow by this factor; bucket 0 holds zeros only.
GROWTH = 1.01
_ZERO = -(1 << 30)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside windows of ``WINDOW_WORDS`` that occur twice or more; ``hashes`` holds one hash per word.

    Equal windows meet by sorting (hash, position); only texts with a repeated window are sorted.
    """
    w = WINDOW_WORDS
    none = F.lit(0).cast("long")
    windows = F.transform(F.sequence(F.lit(0), n - w), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(w)]))

    def places(ranked):
        def repeated(x, at):
            return ((at > 0) & (F.get(ranked, at - 1)["h"] == x["h"])) | (F.get(ranked, at + 1)["h"] == x["h"])

        return F.array_sort(F.transform(F.filter(ranked, repeated), lambda x: x["i"]))

    def union(starts):
        gaps = F.transform(starts, lambda x, at: F.least(F.lit(w), F.coalesce(F.get(starts, at + 1) - x, F.lit(w))))
        return F.aggregate(gaps, none, lambda total, gap: total + gap)

    def covered(found):
        ranked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), _let(_let(ranked, places), union)).otherwise(none)

    return F.when(n > w, _let(windows, covered)).otherwise(none)


def metrics(docs: DataFrame) -> DataFrame:
    """Adds the counts and shares the rules use to ``docs``; NULL text has no words, and its shares are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK_CLASS[1:-1]}]"))
    counted = (
        docs.withColumn("_words", words(F.col("text"))).withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
        .withColumn("n_repeat_words", _repeat_words(F.col("_hashes"), F.size("_hashes")))
        .drop("_words", "_lines", "_hashes")
    )

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of)), F.lit(0.0))

    return counted.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "word_length": share("word_chars", "n_words"),
        "brevity": F.lit(1.0) / (F.col("n_words") + 1),
    })


def sketches(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(lang, source, metric, bucket, n): documents with words by bucket. A group has a few thousand buckets at most,
    whatever its size, and tasks add their own before the shuffle."""
    names = list(dict.fromkeys(r.metric for r in rules))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("bucket")) for m in names])
    return measured.where("n_words > 0").select("lang", "source", F.inline(cells)).groupBy("lang", "source", "metric", "bucket").agg(
        F.count("*").alias("n"))


def _bucket(value: Column) -> Column:
    place = F.ceil(F.log(value) / F.lit(math.log(GROWTH))).cast("int")
    return F.when(value > 0, place).otherwise(F.lit(_ZERO))


def _edge(bucket: Column) -> Column:
    """Upper edge of a bucket, which stands for its values."""
    return F.when(bucket > _ZERO, F.pow(F.lit(GROWTH), bucket)).otherwise(F.lit(0.0))


def _bounds(parts: DataFrame, keys: tuple[str, ...], rules: tuple[Rule, ...], prefix: str) -> DataFrame:
    """(keys, prefix_n, prefix_rule ...): documents and bound of every rule for merged sketches."""
    merged = parts.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bucket")), "total": F.sum("n").over(of)})

    def quantile(rule: Rule, q: float) -> Column:
        reached = (F.col("metric") == rule.metric) & (F.col("upto") >= F.ceil(F.col("total") * q))
        return F.min(F.when(reached, _edge(F.col("bucket"))))

    def bound(rule: Rule) -> Column:
        low, high = quantile(rule, 0.25), quantile(rule, 0.75)
        beyond = rule.ranges * (high - low) + rule.gap
        if rule.lower:
            return (low - beyond).alias(f"{prefix}_{rule.name}")
        return (high + beyond + rule.tail * quantile(rule, rule.tail_at)).alias(f"{prefix}_{rule.name}")

    return ranked.groupBy(*keys).agg(F.max("total").alias(f"{prefix}_n"), *[bound(r) for r in rules])


def thresholds(parts: DataFrame, rules: tuple[Rule, ...] = RULES, min_group: int = 200) -> DataFrame:
    """(lang, source) with the bound of every rule, from ``sketches`` (a written table), merged up where groups are small."""
    own = _bounds(parts, ("lang", "source"), rules, "own")
    lang = _bounds(parts, ("lang",), rules, "lang").withColumnRenamed("lang", "_lang")
    table = _bounds(parts, (), rules, "all").first()
    joined = own.join(lang, own.lang.eqNullSafe(lang._lang))
    return joined.select("lang", "source", *[
        F.when(F.col("own_n") >= min_group, F.col(f"own_{r.name}"))
        .when(F.col("lang_n") >= min_group, F.col(f"lang_{r.name}"))
        .otherwise(F.lit(table[f"all_{r.name}"])).alias(f"bound_{r.name}") for r in rules])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30,
          min_group: int = 200) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``failed_rules`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words or more than ``max_repeat_percent`` of them in repeated windows.
    ``failed_rules`` names the rules whose group's bound is passed. Columns of ``docs`` named like an added one are
    replaced. NULL lang or source is a group of its own; a document without words fails the base rule; texts are
    read whole; repeated rows are judged alike and count each; an empty table stays empty.
    """
    measured = metrics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    measured = write_and_reload(measured)
    limits = write_and_reload(thresholds(write_and_reload(sketches(measured, rules)), rules, min_group))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = measured.lang.eqNullSafe(limits._lang) & measured.source.eqNullSafe(limits._source)
    failed = F.array_compact(F.array(*[
        F.when((F.col(f"bound_{r.name}") > F.col(r.metric)) if r.lower else (F.col(r.metric) > F.col(f"bound_{r.name}")), F.lit(r.name))
        for r in rules]))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        measured.join(limits, same, "left")
        .withColumn("base_failed", base).withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_lang", "_source", *[f"bound_{r.name}" for r in rules])
    )
