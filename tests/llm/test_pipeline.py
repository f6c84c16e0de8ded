"""The pipeline on a small corpus: what goes, what stays, and that every stage sees what the last one kept."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cupboard.llm import language

SYLLABLES = {"en": "th ing ed er wh ou st", "de": "sch ung ü ein ß ver ach", "fr": "eau è ou qu ç ment é", "es": "ción ñ os ll rr ado í"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = {i: prose(rng.choice(list(SYLLABLES)), rng.choice([40, 120, 300]), rng) for i in range(120)}
    item = prose("en", 30, rng)
    rows[200] = rows[5]  # an exact copy
    rows[201] = rows[6].upper() if rows[6].isascii() else rows[6]  # copies with other letters or none
    rows[202] = rows[7] + " " + item + " " + rows[8]  # a leak
    rows[203] = prose("en", 150, rng) + " mail me at bo.42@mail8.example.com or +1 (988) 555-2485"
    rows[204], rows[205], rows[206] = "12345 *** !!!", None, ""
    rows[207] = prose("fr", 2500, rng)
    return rows, item


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    rows, item = corpus
    path = str(tmp_path_factory.mktemp("sf"))
    langs = {i: next((k for k, s in SYLLABLES.items() if t and any(x in t.lower() for x in s.split()[:1])), "en") for i, t in rows.items()}
    spark.createDataFrame([(i, t, langs[i], "s", None if t is None else len(t)) for i, t in rows.items()], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_columns(spark, corpus, folder):
    rows, _ = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "decontamination", "pii_surrogates", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] - kept[1] == {204, 205, 206}
    assert kept[1] - kept[2] == {200, 201}
    assert kept[2] - kept[3] == {202}
    assert kept[4] == kept[3]
    texts = {r.doc_id: r for r in docs.collect()}
    assert "bo.42@mail8" not in texts[203].text and "555-2485" not in texts[203].text
    assert re.search(r"mail me at \S+@\S+\.com or \+1 \(\d{3}\) \d{3}-\d{4}$", texts[203].text) and texts[203].n_chars == len(texts[203].text)
    assert all(texts[i].text == rows[i] for i in kept[4] - {203})


def test_run(spark, corpus, folder):
    from tokenizers import Tokenizer

    from cupboard.llm.queries import vocabulary

    rows, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(rows) - {200, 201, 202, 204, 205, 206}
    plain = Tokenizer.from_file(vocabulary())
    for i in (0, 10, 207):
        assert sum(r.length for r in got if r.doc_id == i) == len(plain.encode(rows[i], add_special_tokens=False).ids) + 1
    assert sum(r.doc_id == 207 for r in got) > 1
    for s in {r.sequence_id for r in got}:
        places = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 2048


def test_odd_tables(spark, folder):
    """Empty tables, NULLs in every column, repeated rows and columns with names the operators use."""
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "th ing ed", None, None, None), (1, "th ing ed", None, None, None),
                                 (None, "ou wh", "en", "s", 5), (2, "th wh st " * 30_000, "en", "s", 9)], SCHEMA)
    clash = odd.withColumns({c: F.lit(1) for c in ("score", "lang_pred", "bits", "n", "__id", "hash", "item_id", "parts", "part", "length", "size")})
    for docs in (empty, odd, clash):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert not (docs is empty and rows)
            if name == "pii_surrogates":
                assert len(rows) == docs.count()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
    assert language.UNKNOWN == "und"
