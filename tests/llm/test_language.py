"""Language identification: held-out accuracy and tables out of the ordinary."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cupboard.llm import language

SYLLABLES = {"en": "th ing ed er wh ou st", "de": "sch ung ü ein ß ver ach", "fr": "eau è ou qu ç ment é", "es": "ción ñ os ll rr ado í", "xx": "zz kk ww yy"}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(docs, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(lang, rng.choice([6, 30, 200]), rng), lang, "s"))
    return docs(rows)


def test_held_out_accuracy(docs):
    rows = table(docs)
    held = language.held_out(F.col("doc_id"))
    model = language.fit(rows.where(~held), per_language=40)
    assert set(model.inside) == {"germanic", "romance", "xx"} and model.inside["romance"].classes == ("es", "fr")
    got = language.identify(rows, model).where(held).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_only_text_is_looked_at(docs):
    rows = table(docs, 100)
    model = language.fit(rows)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, model).collect()}
    changed = rows.withColumn("lang", F.lit("q")).withColumn("source", F.lit(None))
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(changed, model).collect()}


def test_unknown_texts_and_clashing_columns(docs):
    model = language.fit(table(docs, 100))
    odd = docs([(1, None), (2, ""), (3, "123 !!! ___ ²"), (4, "th " * 300_000), (4, "th " * 300_000), (None, "中文")])
    out = language.identify(odd.withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit("old")), model)
    got = out.collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert [r.lang_pred for r in got if r.doc_id == 4] == ["en", "en"] and len(got) == 6
    assert {r.lang_pred for r in got if r.doc_id is None} <= set(SYLLABLES)
    assert out.columns == [*odd.columns, "lang_pred", "score"]


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: 7, lambda i: i], ids=["none", "shared", "own"])
def test_every_language_is_learned_whatever_the_ids(docs, id_of):
    """A hot language beside small ones, with NULL ids, one id for all, or ids of their own; copies count once."""
    rng = random.Random(6)
    rows = [(id_of(i), prose("es", 12, rng), "es", "s") for i in range(2000)] + [(id_of(i), prose("en", 12, rng), "en", "s") for i in range(60)]
    rows += [(id_of(i), "zz kk " * 5, "xx", "s") for i in range(900)] + [(id_of(i), prose("xx", 12, rng), "xx", "s") for i in range(30)]
    frame = docs(rows, 5)
    counts = {r["lang"]: r["count"] for r in language.sample(frame, 40, 200).groupBy("lang").count().collect()}
    assert counts == {"es": 40, "en": 40, "xx": 31}
    model = language.fit(frame, per_language=40)
    assert {c for v in model.inside.values() for c in v.classes} == {"es", "en", "xx"}
    assert {r["lang"] for r in language.sample(frame, 40, 2).collect()} == {"es", "xx"}


def test_features_against_brute_force():
    def brute(text):
        raw = b" " + text.lower().encode() + b" "
        kept = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw)
        x = [b for i, b in enumerate(kept) if not (b == 32 and i and kept[i - 1] == 32)]
        counts = [0] * language.DIMENSIONS
        for i in range(len(x) - 1):
            pair = (x[i] * 0x9E3779B1 ^ x[i + 1] * 0x85EBCA6B) & 0xFFFFFFFF
            counts[pair >> 16 & language.DIMENSIONS - 1] += len(x) > 2
            if i < len(x) - 2:
                triple = (pair ^ x[i + 2] * 0xC2B2AE35 & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF
                counts[triple >> 16 & language.DIMENSIONS - 1] += 1
        root = np.sqrt(counts)
        return root / max(np.linalg.norm(root), 1e-9)

    for text in ("Hello, World 42!", "a", "Ünïcode 中文  text", "x" * 50, "123"):
        assert np.allclose(language.features(text), brute(text), atol=1e-6)


def test_votes_against_brute_force():
    rng = np.random.default_rng(1)
    x, labels = rng.standard_normal((90, 6)).astype(np.float32), np.array([f"l{i % 4}" for i in range(90)], object)
    x[np.arange(90), np.arange(90) % 4] += 2
    vote = language.Vote.fit(x, labels)
    best, least = vote.choose(x)
    for row, b, low in zip(x, best, least):
        won, total, margins = [0] * 4, [0.0] * 4, [[] for _ in range(4)]
        for (i, j), w in zip(vote.pairs, vote.weights):
            m = float(np.dot(row.astype(float), w[:-1].astype(float)) + w[-1])
            for k, own in ((i, m), (j, -m)):
                won[k] += own > 0
                total[k] += own
                margins[k].append(own)
        assert b == max(range(4), key=lambda k: (won[k], total[k])) and abs(low - min(margins[b])) < 1e-9
    assert np.mean([vote.classes[b] == want for b, want in zip(best, labels)]) > 0.8


def test_no_labels_one_label_and_empty_table(docs):
    rows = docs([(1, "some text", None, "s"), (2, "more text", None, "s")])
    none = language.fit(rows)
    assert {r.lang_pred for r in language.identify(rows, none).collect()} == {"und"}
    one = language.fit(docs([(1, "some text"), (2, "1234")]))
    assert [r.lang_pred for r in language.identify(docs([(5, "abc")]), one).collect()] == ["en"]
    assert language.identify(rows.where("false"), one).count() == 0
    assert language.fit(rows.where("false")).families.classes == ()


def test_sample_is_bounded(docs):
    rows = docs([(i, "word " + str(i)) for i in range(3000)])
    model = language.fit(rows, per_language=20)
    assert model.families.classes == ("germanic",)
