"""Suffix deduplication against a brute-force count of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cupboard.llm import repeats
from cupboard.llm.suffixes import BUFFER, runs_of, within_text


def brute(texts, depth):
    found = Counter(t[i:i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone, done = [False] * len(t), 0
        for i in range(len(t) - depth + 1):
            if found[t[i:i + depth]] > 1:
                for j in range(max(i, done), i + depth):
                    gone[j] = True
                done = i + depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng, 250) for _ in range(12)]
    texts = [None, "", "short"]
    for _ in range(40):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"EDIT{rng.randrange(3)}"
        text = " ".join(words)
        texts.append((prose(rng, 40) if rng.random() < 0.3 else "") + text[rng.randrange(200) if rng.random() < 0.3 else 0:])
    return texts + [prose(rng, 300) for _ in range(10)] + [base[0]] * 5 + [
        "ab " * 300, "ab " * 200, "x" * 199, "x" * 200, "y" * 201, "y" * 450, (prose(rng, 1500) + " ") * 3]


def result(df, **how):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, **how).collect())


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_brute_force(docs, bucket_rows):
    texts = corpus(bucket_rows)
    want = [(i, *row) for i, row in enumerate(brute([(t or "").encode() for t in texts], 200))]
    assert result(docs(enumerate(texts)), depth=200, bucket_rows=bucket_rows) == want


def test_repeated_rows_and_ids(docs):
    rng = random.Random(1)
    long, other = prose(rng, 100), prose(rng, 100)
    by = {(r[0], r[1]): r[2] for r in result(docs([(1, long), (1, long), (2, other), (3, None)]), depth=200)}
    assert by == {(1, len(long.encode())): len(long.encode()), (2, len(other.encode())): 0, (3, 0): 0}
    rows = repeats.without_repeats(docs([(None, other), (2, long), (2, other), (None, None)]), depth=200).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed) for r in rows) == sorted([
        ("2", len(long.encode()), 0), ("2", len(other.encode()), len(other.encode())),
        ("None", 0, 0), ("None", len(other.encode()), len(other.encode()))])


def test_rows_without_an_id_are_told_apart_by_their_texts(docs, monkeypatch):
    """Two texts without ids whose text hashes agree, as far as they are looked at, do not take each other's spans."""
    rng = random.Random(8)
    shared, own = prose(rng, 60), prose(rng, 60)
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c, _real=F.xxhash64: _real(*c) if len(c) > 1 else F.lit(5).cast("long"))
    rows = repeats.without_repeats(docs([(None, shared), (2, shared), (None, own)]), depth=200).collect()
    monkeypatch.undo()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == sorted([(len(shared.encode()),) * 2] * 2 + [(len(own.encode()), 0)])


def test_lists_of_equal_rows_are_as_long_as_one_text(docs):
    rng = random.Random(9)
    text, other = prose(rng, 300), prose(rng, 300)
    rows = repeats._identified(docs([(1, text)] * 60 + [(2, text[:len(text) // 2] + other)] * 60))
    spans = repeats.repeated_spans(rows, 200)
    per_row = spans.groupBy("id_hash", "text_hash").agg(F.size(F.collect_set(F.struct("begin", "end"))).alias("n"), F.count("*").alias("all")).collect()
    assert len(per_row) == 2 and all(r.n < 60 for r in per_row)
    assert {(r[0], r[1] == r[2]) for r in result(docs([(1, text)] * 60 + [(2, other)]), depth=200) if r[0] == 1} == {(1, True)}


def test_empty_table_and_extra_columns(docs):
    empty = docs([(1, "a")]).where("false")
    assert result(empty) == []
    clash = docs([(1, "z" * 300)]).withColumn("gram", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("text_hash", F.lit(0))
    row = repeats.without_repeats(clash).first()
    assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (300, 300, 1, b"")


def test_text_longer_than_a_buffer():
    rng = random.Random(5)
    head, tail = prose(rng, 200).encode(), bytes(rng.randrange(97, 123) for _ in range(BUFFER + 5000))
    runs = runs_of([head + tail + head], 200)
    assert int((runs.high - runs.low + 1).sum()) == len(head) * 2 + len(tail) - 199
    _, twice = within_text(runs)
    assert (runs.anchor[twice] < len(head)).any() and (runs.anchor[twice] > BUFFER).any()


def test_depth_is_checked(docs):
    with pytest.raises(ValueError):
        repeats.without_repeats(docs([(1, "a")]), depth=32)
