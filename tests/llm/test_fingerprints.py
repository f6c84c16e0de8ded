"""Sketches, edits and successors against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cupboard.llm import fingerprints as fp

WORDS = "alpha beta gamma delta Epsilon ZETA eta theta iota kappa été 中文 \U0001f600".split()


def hashes(text, shingle=5):
    """All shingle hashes, by the definition."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    numbers = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
    size = min(shingle, len(words))
    return {sum(n * f for n, f in zip(numbers[i:i + size], fp.factors(shingle))) % 2 ** 64 for i in range(len(words) - size + 1)} if words else set()


def sketch(all_hashes, parts=4):
    return {h for h in all_hashes if h < 2 ** 64 // parts} or ({min(all_hashes)} if all_hashes else set())


def near(a, b):
    return float(len(a) == len(b)) if not a or not b else len(a & b) / min(len(a), len(b))


def as_text(hashed):
    return "".join(f"{h:016x}" for h in sorted(hashed))


def brute(rows, order):
    rows = sorted(rows, key=order)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = (sketch(hashes(t)) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), near(a, b), near(a, c)))
    return out


def order_of(spark):
    found = {}

    def key(row):
        if row[1] not in found:
            found[row[1]] = spark.createDataFrame([(row[1],)], "t string").select(F.xxhash64("t")).first()[0]
        return (row[0] is not None, row[0] or 0, found[row[1]], row[1])

    return key


def texts(rng, n):
    for i in range(n):
        yield "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 200])))


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_rows_against_brute_force(spark, docs, buckets):
    rng = random.Random(buckets)
    rows = [(rng.randrange(10 ** 6) * rng.choice([-1, 1]), t) for t in texts(rng, 60)]
    rows += [(None, t) for t in texts(rng, 9)] + [(5, t) for t in texts(rng, 12)]  # hot ids
    rows += [(77, "one two three four five six")] * 5 + [(78, "")] * 4  # equal rows
    got = fp.fingerprints_of_edits(docs(rows, 4), buckets=buckets).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, order_of(spark))))


def test_nulls_long_texts_clashing_names_and_empty_table(docs):
    frame = docs([(2, None), (1, "word " * 150_000), (None, "x")]).withColumn("bucket", F.lit("b")).withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: r for r in fp.fingerprints_of_edits(frame).collect()}
    assert got[1].n_chars == 750_000 and got[2].n_chars == 0 and got[2].fingerprint == "" == got[2].edited_fingerprint
    assert (got[2].near_edited, got[2].near_next, got[None].near_edited) == (1.0, 0.0, 0.0 if got[None].n_chars > 1 else 1.0)
    assert fp.fingerprints_of_edits(frame.where("false")).count() == 0
    alone = fp.fingerprints_of_edits(frame.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_likeness_follows_the_shared_part():
    """The estimate of containment is unbiased within sampling error, also for very unequal texts."""
    rng = random.Random(4)
    sketcher = fp.Sketcher()
    long = [f"w{rng.randrange(10 ** 9)}" for _ in range(40_000)]
    for share in (0.0, 0.25, 0.5, 1.0):
        own = [f"v{rng.randrange(10 ** 9)}" for _ in range(4000)]
        short = long[:int(4000 * share)] + own[int(4000 * share):]
        estimate = fp.likeness(sketcher.sketch(" ".join(short)), sketcher.sketch(" ".join(long)))
        assert abs(estimate - share) < 0.06


def test_merged_sketches_are_the_sketch_of_all_texts(spark, docs):
    rng = random.Random(5)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts(rng, 40))] + [(99, "tiny text", "en", None)]
    frame = docs(rows)
    done = fp.fingerprints_of_edits(frame).select("doc_id", "fingerprint")
    one = fp.sketch_rows(done, "doc_id")
    per_source = fp.merged(one.join(frame.select("doc_id", "source"), "doc_id"), "source")
    got = {}
    for r in per_source.collect():
        got.setdefault(r.source, set()).add(int(r["hash"], 16))
    want = {}
    for _, text, _, source in rows:
        want.setdefault(source, set()).update(hashes(text))
    assert got == {s: sketch(h) for s, h in want.items() if h}
    found = {(r.doc_id, r.source): r.containment for r in fp.contained(one, per_source).collect()}
    for doc_id, text, _, source in rows:
        own = sketch(hashes(text))
        if own and own <= sketch(want[source]):
            assert found[doc_id, source] == 1.0
