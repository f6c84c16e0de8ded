"""Hosts, rules and the trees behind them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cupboard.llm import urls
from cupboard.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "https://www.example.com/en/x?q=1#f", "http://a.www.Example.COM/en/",
    "http://example.com/en", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "net://net/es/",
    "http://a.com?x=/en/", "http://a.com#/y", "a://b://c/d", "http://ÀB.com/Path/Ü", "http://com/", "http://h\nost.net/es/", "http://x.net:80/es/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host):])[0]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in urls.judge(pages, URL_RULES).collect():
        host, path = parts(URLS[r.page_id])
        fit = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit.text)
        assert r.verdict == fit.verdict if fit else r.verdict in ("allow", "block")


def test_features(spark):
    url = "http://a.b.org/x/yy/7.html?p=1&q=2#f"
    row = urls.lexical(spark.createDataFrame([(1, url)], "page_id long, url string"), URL_RULES).first()
    assert (row.url_length, row.host_labels, row.path_depth, row.n_params, row.suffix) == (len(url), 3, 3, 2, "org")
    shares = [url.count(c) / len(url) for c in set(url)]
    assert row.entropy == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert row.digit_ratio == pytest.approx(3 / len(url))


def test_trees_learn_the_rules(spark):
    """What the rules block has long digits in its paths; the trees carry that to hosts without a rule."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        path = "/" + ("".join(rng.choice("0123456789") for _ in range(25)) if bad else rng.choice(["news", "about", "team"]))
        rows.append((i, bad, f"http://h{rng.randrange(9)}.{rng.choice(['bad' if bad else 'good', 'other'])}{path}"))
    rules = [urls.Rule("block", "bad", "/"), urls.Rule("allow", "good", "/")]
    got = urls.judge(spark.createDataFrame([(i, u) for i, _, u in rows], "page_id long, url string"), rules).collect()
    truth = {i: bad for i, bad, _ in rows}
    free = [(truth[r.page_id], r.verdict == "block") for r in got if r.rule is None]
    assert len(free) > 200 and sum(a == b for a, b in free) / len(free) > 0.95


def test_a_suffix_without_labels_decides_nothing(spark):
    """Blocked and allowed URLs look alike but for their suffix: pages of other suffixes are allowed, of known ones judged."""
    rng = random.Random(2)
    urls_ = [f"http://h{rng.randrange(40)}.{rng.choice(['bad', 'gud', 'oth'])}/{rng.choice(['a', 'b'])}/{rng.randrange(10 ** 6)}" for _ in range(900)]
    rules = [urls.Rule("block", "bad", "/a/"), urls.Rule("allow", "gud", "/")]
    got = urls.judge(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), rules).collect()
    free = {}
    for r in got:
        if r.rule is None:
            free.setdefault(r.host.rsplit(".", 1)[1], []).append(r.verdict)
    assert set(free["oth"]) == {"allow"} and set(free["bad"]) == {"block"}


def test_a_labelled_row_does_not_see_its_own_label(spark):
    pages = spark.createDataFrame([(i, f"http://a.x{i}/p") for i in range(40)], "page_id long, url string")
    rules = [urls.Rule("block", f"x{i}", "/") for i in range(0, 40, 2)] + [urls.Rule("allow", f"x{i}", "/") for i in range(1, 40, 2)]
    rows, overall = urls.with_suffix_statistics(urls.lexical(pages, rules))
    assert overall == 0.5 and {(r.suffix_known, r.suffix_blocked) for r in rows.collect()} == {(0.0, 0.5)}


def test_a_rare_label_and_many_copies_keep_both_labels(spark):
    rows = [(i, "http://a.good/same") for i in range(3000)] + [(5000 + i, f"http://a.good/{i}") for i in range(400)]
    rows += [(9000 + i, f"http://a.bad/{'9' * 20}{i}") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found, overall = urls.with_suffix_statistics(urls.lexical(pages, [urls.Rule("block", "bad", "/"), urls.Rule("allow", "good", "/")]))
    assert abs(overall - 12 / 413) < 1e-9
    assert urls.fit(found, overall, max_rows=40) is not None


def test_one_kind_of_label_repeated_rows_clashing_names_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.com/"), (2, None)], "page_id long, url string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("label", F.lit("x")).withColumn("suffix", F.lit(2)).withColumn("html", F.lit(None))
    got = urls.judge(pages, URL_RULES).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0


def test_all_labelled_urls_are_learned_from(spark, monkeypatch):
    """More different URLs of a label than any sample: both ways of all that are not held out reach the trees."""
    url = F.concat(F.when(F.col("id") % 3 == 0, "http://a.bad/").otherwise("http://a.good/"), F.col("id").cast("string"))
    pages = spark.range(36_000).select(F.col("id").alias("page_id"), url.alias("url"))
    found, overall = urls.with_suffix_statistics(urls.lexical(pages, [urls.Rule("block", "bad", "/"), urls.Rule("allow", "good", "/")]))
    seen = []

    def count(self, rows):
        seen.append((rows.count(), rows.select("weight").distinct().collect()))
        raise InterruptedError

    monkeypatch.setattr(urls.GBTClassifier, "fit", count)
    with pytest.raises(InterruptedError):
        urls.fit(found, overall)
    assert seen == [(2 * found.where("fold > 0").count(), [(1.0,)])]


def test_scores_from_which_pages_are_blocked(spark):
    """Sums over many tasks give the cut that one walk down the scores gives."""
    rng = random.Random(5)
    rows = [(seen, float(rng.random() < score / 50), score / 100) for seen in (True, False) for score in [rng.randrange(100) for _ in range(2000)]]
    rows += [(True, 0.0, 0.995)] * 30
    held = spark.createDataFrame(rows, "seen boolean, label double, score double").withColumn("weight", F.lit(1.0))
    want = {}
    for seen in (True, False):
        mine = [(score, label) for s, label, score in rows if s is seen]
        scores = sorted({score for score, _ in mine}, reverse=True)
        above = {c: [label for score, label in mine if score >= c] for c in scores}
        good = [c for c in scores if len(above[c]) >= 20 and sum(above[c]) >= 0.9 * len(above[c])]
        if good:
            want[seen] = (good[-1] + next((c for c in scores if c < good[-1]), good[-1])) / 2
    assert len(want) == 2 and urls._cuts(held, 0.9) == want
    assert urls._cuts(held.withColumn("label", F.lit(0.0)), 0.9) == {}
