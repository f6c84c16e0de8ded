"""URL filter: hand-written rules first, gradient-boosted trees over lexical features for the rest.

The trees learn from the URLs that the rules decide. Features are built-in expressions; the trees are Spark's own. A labelled
URL never sees its own label in the statistics of its suffix, and every URL is learned from twice, with the statistics
and as if its suffix had no label, since that is how pages of other suffixes look. A quarter of the labelled URLs is held
out and sets the score from which a page is blocked; where none separates them, the page is allowed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

FEATURES = ["url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "entropy",
            "n_params", "suffix_pages", "suffix_blocked", "suffix_known"]
FOLDS = 4  # of the labelled URLs; the first one is held out of the fit


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and URLs without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, pattern, 2)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else NULL. A rule fits its host, all subdomains, and paths that start
    with its own; equally long ones are tried in the order given."""
    fits = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        on_host = (host == rule.host) | host.endswith("." + rule.host)
        fits = F.when(on_host & path.startswith(rule.path), F.lit(rule.text)).otherwise(fits)
    return fits


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.char_length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c))) / n)
    bits = F.transform(F.filter(shares, lambda p: p > 0), lambda p: -p * F.log2(p))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, label (1 blocked, 0 allowed, NULL undecided), suffix and the features of the URL."""
    host, path = host_and_path(F.col("url"))
    url = F.coalesce(F.col("url"), F.lit(""))
    blocked = [r.text for r in rules if r.verdict == "block"]
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return (
        pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"), query.alias("query"))
        .withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
        .withColumn("label", F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocked).cast("double")))
        .withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
        .withColumn("url_length", F.char_length("url").cast("double"))
        .withColumn("host_length", F.char_length("host").cast("double"))
        .withColumn("path_length", F.char_length("path").cast("double"))
        .withColumn("host_labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("path_depth", F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"))
        .withColumn("digit_ratio", F.try_divide(F.length(F.regexp_replace("url", "[^0-9]+", "")), F.col("url_length")))
        .withColumn("digit_ratio", F.coalesce("digit_ratio", F.lit(0.0)))
        .withColumn("entropy", _entropy(F.col("url")))
        .withColumn("n_params", F.size(F.filter(F.split("query", "&"), lambda s: s != "")).cast("double"))
        .drop("url", "query")
    )


def _unknown(rows: DataFrame, overall: float) -> DataFrame:
    """The rows as pages of a suffix without labels."""
    return rows.withColumns({"suffix_pages": F.lit(0.0), "suffix_blocked": F.lit(overall), "suffix_known": F.lit(0.0)})


def with_suffix_statistics(found: DataFrame, smooth: float = 20.0) -> tuple[DataFrame, float]:
    """Adds ``fold`` and the statistics of the host's last label, and the share of blocked URLs among all that are decided.

    The share of a suffix counts different URLs of other folds than the row's own, drawn towards the overall share; a
    suffix without any is marked by ``suffix_known`` 0 and has that share.
    """
    found = found.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)).cast("int"))
    urls = found.where("label is not null").select("host", "path", "suffix", "fold", "label").distinct()
    decided = write_and_reload(urls.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b")))
    total = decided.agg(F.sum("b") / F.sum("n")).first()[0]
    overall = 0.0 if total is None else float(total)
    pages = found.groupBy("suffix").agg(F.log1p(F.count("*")).alias("pages"))
    sums = decided.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    suffixes = write_and_reload(pages.join(sums, "suffix", "left").na.fill(0))
    own = decided.select("suffix", "fold", F.col("n").alias("own_n"), F.col("b").alias("own_b"))
    joined = found.join(suffixes, "suffix").join(own, ["suffix", "fold"], "left").na.fill(0, ["own_n", "own_b"])
    labelled = F.col("label").isNotNull()
    n = F.col("all_n") - F.when(labelled, F.col("own_n")).otherwise(0)
    b = F.col("all_b") - F.when(labelled, F.col("own_b")).otherwise(0)
    known = n > 0
    return joined.withColumns({
        "suffix_pages": F.when(known, F.col("pages")).otherwise(0.0),
        "suffix_blocked": (b + smooth * overall) / (n + smooth),
        "suffix_known": known.cast("double"),
    }).drop("pages", "all_n", "all_b", "own_n", "own_b"), overall


@dataclass(frozen=True)
class Judge:
    """The trees, and the score from which they block pages whose suffix has labels, and pages whose suffix has none."""

    trees: object
    cut_known: float
    cut_unknown: float


def fit(rows: DataFrame, overall: float, max_rows: int | None = None, precision: float = 0.95, trees: int = 20, depth: int = 4,
        seed: int = 7) -> Judge | None:
    """Trees fitted on all different labelled URLs; None if there is only one label. The held-out fold sets the scores from
    which pages are blocked, so that ``precision`` of those blocked there are blocked by the rules. With ``max_rows``, at most
    half as many of each label are taken (those with the smallest hashes), weighted by how many there are of the label."""
    labelled = rows.where("label is not null").select("host", "path", "label", "fold", *FEATURES)
    once = labelled.withColumn("nth", F.row_number().over(Window.partitionBy("host", "path").orderBy(*FEATURES))).where("nth = 1")
    # In a fixed order: sums of the same rows in another order could choose another of two equal splits.
    ordered = once.orderBy("label", F.xxhash64("host", "path"), "host", "path")
    chosen = write_and_reload(ordered.select("host", "path", "label", "fold", *FEATURES))
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}  # two labels
    if len(counts) < 2:
        return None
    weight = F.lit(1.0)
    if max_rows is not None:
        most = max(1, max_rows // 2)
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("host", "path"), "host", "path"))
        chosen = chosen.withColumn("nth", place).where(F.col("nth") <= most)
        for label, n in counts.items():
            weight = F.when(F.col("label") == label, n / min(n, most)).otherwise(weight)
    chosen = chosen.select("label", "fold", weight.alias("weight"), *FEATURES)
    both = write_and_reload(chosen.withColumn("seen", F.lit(True)).unionByName(_unknown(chosen, overall).withColumn("seen", F.lit(False))))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)
    training = vectors.where("fold > 0")
    if training.select("label").distinct().count() < 2:
        return None
    # Some hundred passes over the rows: tasks of ten thousand URLs, both ways.
    tasks = max(4, sum(counts.values()) // 10_000)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, weightCol="weight").fit(
        training.select("features", "label", "weight").coalesce(tasks))
    held = model.transform(vectors.where("fold = 0")).select("seen", "label", "weight", vector_to_array("probability")[1].alias("score"))
    cuts = _cuts(held, precision)
    return Judge(model, cuts.get(True, 2.0), cuts.get(False, 2.0))


def _cuts(held: DataFrame, precision: float) -> dict[bool, float]:
    """For each ``seen`` the lowest score above which at least ``precision`` of the held-out URLs are blocked, of twenty or
    more, moved half the way to the next lower score; missing if there is none.

    The sums from the highest score down are those of the tasks before, whose scores are all higher, and those in the task.
    """
    parts = ("blocked", "total", "n")
    scores = held.groupBy("seen", "score").agg(
        F.sum(F.col("weight") * F.col("label")).alias("blocked"), F.sum("weight").alias("total"), F.count("*").alias("n"))
    falling = write_and_reload(scores.repartitionByRange("seen", F.desc("score")).withColumn("task", F.spark_partition_id()))
    earlier = Window.partitionBy("seen").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = falling.groupBy("seen", "task").agg(*[F.sum(c).alias(c) for c in parts])  # one row a task
    before = tasks.select("seen", "task", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in parts])
    inside = Window.partitionBy("seen", "task").orderBy(F.desc("score"))
    upto = write_and_reload(falling.join(before, ["seen", "task"]).select(
        "seen", "score", *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(c) for c in parts]))
    good = upto.where((F.col("blocked") >= precision * F.col("total")) & (F.col("n") >= 20))
    lowest = good.groupBy("seen").agg(F.min("score").alias("lowest"))
    next_lower = F.max(F.when(F.col("score") < F.col("lowest"), F.col("score")))
    cuts = upto.join(F.broadcast(lowest), "seen").groupBy("seen", "lowest").agg(F.coalesce(next_lower, "lowest").alias("below"))
    return {r["seen"]: (r["lowest"] + r["below"]) / 2 for r in cuts.collect()}  # two rows


def judge(pages: DataFrame, rules: list[Rule], max_train_rows: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of being blocked, for every page) of all pages.

    A rule's verdict stands; without one a page is blocked if its score is so high that at least 19 of 20 held-out URLs
    with such a score are blocked (told apart by whether the suffix has labels). Without labels of both kinds, or where no
    score separates them that well, the page is allowed.
    Repeated rows are kept, a NULL url has empty parts, other columns are ignored, no pages give no rows.
    """
    rows, overall = with_suffix_statistics(write_and_reload(lexical(pages, rules)))
    rows = write_and_reload(rows)
    judge = fit(rows, overall, max_train_rows)
    if judge is None:
        scored, cut = rows.withColumn("score", F.lit(0.0)), F.lit(2.0)
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = judge.trees.transform(vectors).withColumn("score", vector_to_array("probability")[1])
        cut = F.when(F.col("suffix_known") == 1, F.lit(judge.cut_known)).otherwise(F.lit(judge.cut_unknown))
    block = F.coalesce(F.col("label"), (F.col("score") >= cut).cast("double")) == 1
    return scored.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "score")
