"""Containment search against brute force, and the edge cases of tables."""

import random
import re

from pyspark.sql import functions as F

from cupboard.llm import decontaminate


def shingles(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & have) / len(want) >= threshold - 1e-9:
                out.add((d, i, len(want), len(want & have)))
    return out


def test_brute_force(spark, docs):
    rng = random.Random(4)

    def prose(n):
        return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(n)]

    items = [(i, " ".join(prose(rng.choice([4, 5, 8, 15, 40, 120])))) for i in range(40)] + [(98, None), (99, "")]
    rows = [(0, None), (1, ""), (2, "one two")]
    for d in range(3, 90):
        words = prose(rng.choice([10, 50, 400, 3000]))
        for _ in range(rng.randrange(3)):
            inserted = rng.choice(items[:40])[1].split(" ")
            if rng.random() < 0.5:
                inserted[rng.randrange(len(inserted))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in inserted]
        rows.append((d, " ".join(words)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(docs(rows), table)
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == want and len(want) > 20
    assert {r.doc_id for r in decontaminate.without_items(docs(rows), table).collect()} == {d for d, _ in rows} - {w[0] for w in want}


def test_shuffled_benchmark_gives_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    table = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m")], "item_id long, text string")
    got = decontaminate.contained_items(docs([(1, "x a b c d e f g y"), (2, "h i j k l"), (3, "h i j k l m")]), table)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (3, 2)]


def test_repeated_null_ids_clashing_names_and_empty_tables(spark, docs):
    table = spark.createDataFrame([(1, "a b c d e f"), (None, "q r s t u")], "item_id long, text string")
    rows = docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f z"), (None, "q r s t u"), (3, "clean text of five words")])
    rows = rows.withColumn("hash", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("item_id", F.lit(3)).withColumn("__hit", F.lit(4))
    got = decontaminate.contained_items(rows, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 1), (2, 1)} and len(got) <= 3
    kept = decontaminate.without_items(rows, table)
    assert kept.columns == rows.columns and 3 in {r.doc_id for r in kept.collect()}
    assert decontaminate.contained_items(rows, table.where("false")).count() == 0
    assert decontaminate.without_items(rows, table.where("false")).count() == 5
    assert decontaminate.contained_items(rows.where("false"), table).count() == 0


def test_null_and_shared_ids_exactly(spark, docs):
    """Items without an id are found; of rows that share an id, or have none, only those with an item go."""
    table = spark.createDataFrame(
        [(1, "a b c d e f"), (None, "q r s t u"), (None, "v w x y z"), (4, "k l m n o"), (4, "one two three four five")],
        "item_id long, text string")
    leaks = [(1, "a b c d e f"), (None, "q r s t u"), (None, "so v w x y z"), (2, "V, W x y z"), (6, "one two three four five")]
    clean = [(1, "clean text of five words"), (None, "clean too and without id"), (None, None), (2, "short"), (7, "k l m n")]
    got = decontaminate.contained_items(docs(leaks + clean), table).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(1, 1), (None, None), (2, None), (6, 4)], key=repr)
    kept = decontaminate.without_items(docs(leaks + clean), table).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(clean, key=repr)
