"""Similar and spoken names against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cupboard.operators.detections import consolidate_similar, spoken_names
from cupboard.operators.similar import connected_names, similar_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def digits(text):
    return "".join(c for c in text if c in "0123456789")


def typo(rng, text):
    letters = list(text)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(letters)) if letters else 0
        what = rng.randrange(3)
        if what == 0 and len(letters) > 1:
            del letters[at]
        elif what == 1:
            letters.insert(at, rng.choice("abx1"))
        elif letters:
            letters[at] = rng.choice("abx ")
    return "".join(letters) or "a"


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "mug", "cup", "cupboard", "sony wh 1000xm5", "aaaaaaaaaaaa", "résumé holder", "desk lamp", "banana bananas banana"]
    names = sorted({(rng.choice("xy"), typo(rng, rng.choice(words) + rng.choice(["", " small", " 2"]))) for _ in range(150)})
    rows = [(i, g, n) for i, (g, n) in enumerate(names)]
    frame = spark.createDataFrame(rows, "id long, g string, name string")
    want = {(i, j) for i, g, n in rows for j, h, m in rows if i < j and g == h and digits(n) == digits(m)
            and 5 * distance(n, m) <= max(len(n), len(m))}
    got = [(r.a, r.b) for r in similar_pairs(frame, ("g",)).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert {r.id: r.root for r in connected_names(frame, ("g",)).collect()} == root


def test_words_are_heard_whole_and_in_any_case(spark):
    names = spark.createDataFrame([(1, "cup"), (1, "cupboard"), (1, "sony wh 1000"), (1, "wh"), (2, "cup"), (3, "cup"), (1, "cup")], "session_id int, name_key string")
    sessions = spark.createDataFrame([(1, "A Cupboard, a SONY-WH 1000!"), (2, "cups"), (3, None)], "session_id int, audio_transcript string")
    got = [(r.session_id, r.name_key) for r in spoken_names(names, sessions).collect()]
    assert sorted(got) == [(1, "cupboard"), (1, "sony wh 1000"), (1, "wh")]
    assert spoken_names(names.limit(0), sessions).count() == 0


def test_misread_names_become_one_item(spark):
    items = spark.createDataFrame([
        (1, 1, "Desk lamp", "other", "good", "desk"), (1, 2, "desk lanp", "other", "fair", "Desk"), (1, 3, "Desk lamp", "other", "fair", "desk"),
        (1, 4, "desk lamps", "other", "good", "desk"), (1, 5, "WH 1000XM4", "other", "good", "desk"), (1, 6, "WH 1000XM5", "other", "good", "desk"),
        (1, 7, "Desk lamp", None, "good", "desk"), (1, 8, "--", "other", "good", "desk"), (2, 1, "desk lamp", "other", "good", None)],
        "session_id int, frame int, name string, category string, condition string, location string")
    sessions = spark.createDataFrame([(1, "two desk lamps")], "session_id int, audio_transcript string")
    rows = sorted((r.session_id, r.name, r.category or "", r.frames, r.from_audio, r.n_names, r.condition) for r in consolidate_similar(items, sessions).collect())
    assert rows == [(1, "Desk lamp", "", 1, False, 1, "good"), (1, "WH 1000XM4", "other", 1, False, 1, "good"), (1, "WH 1000XM5", "other", 1, False, 1, "good"),
                    (1, "desk lamps", "other", 4, True, 3, "good"), (2, "desk lamp", "other", 1, False, 1, "good")]


@pytest.mark.parametrize("few", [1, 3, 128])
def test_few_and_many_names_are_connected_alike(spark, few):
    """Names of small groups are compared directly, those of large ones by bigrams; letters beyond the BMP included."""
    rng = random.Random(8)
    words = ["ab", "mug", "wh 1000", "résumé holder", "a lamp 😀😀", "banana bananas"]
    names = sorted({(rng.choice("xyz"), rng.choice("uv"), typo(rng, rng.choice(words))) for _ in range(120)})
    rows = [(i, *name) for i, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "id long, g string, h string, name string")
    want = {(i, j) for i, *g, n in rows for j, *h, m in rows if i < j and g == h and digits(n) == digits(m)
            and 5 * distance(n, m) <= max(len(n), len(m))}
    assert sorted(map(tuple, similar_pairs(frame, ("g", "h"), few=few).collect())) == sorted(want)
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert {r.id: r.root for r in connected_names(frame, ("g", "h"), few=few).collect()} == root


def test_few_names_take_no_rounds_and_no_bigrams(spark, monkeypatch):
    from cupboard.operators import similar

    def refuse(*_):
        raise AssertionError("names that meet in one place need neither")

    monkeypatch.setattr(similar, "smallest_reachable", refuse)
    monkeypatch.setattr(similar, "_bigrams", refuse)
    frame = spark.createDataFrame([(1, "g", "desk lamp"), (2, "g", "desk lanp"), (3, "g", "desk lamps"), (4, "h", "desk lamp")], "id long, g string, name string")
    assert {r.id: r.root for r in connected_names(frame, ("g",)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
