"""Language identification in two levels: the language family first, then the languages inside it.

Both levels vote among one-versus-one linear support vector machines over hashed byte n-grams of letters. The
machines are fitted on a bounded sample; prediction reads every text whole, inside tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.session import write_and_reload

UNKNOWN = "und"
DIMENSIONS = 2048
BLOCK_BYTES = 1 << 20

# ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indo-aryan": "hi ur bn mr gu pa ne si",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_ASCII_LETTER = re.compile("[A-Za-z]")
# Letters outside ASCII stay as their UTF-8 bytes; digits, symbols and blanks become one blank.
_KEPT = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed 2- and 3-gram counts of the whole text."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw), BLOCK_BYTES):
        part = _KEPT[raw[at:at + BLOCK_BYTES + 2]]
        blank = part == 0x20
        x = part[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
        if len(x) < 3:
            continue
        pair = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA6B)
        triple = pair[:-1] ^ x[2:] * np.uint32(0xC2B2AE35)
        for gram in (pair, triple * np.uint32(0x27D4EB2F)):
            counts += np.bincount((gram >> np.uint32(16)) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    root = np.sqrt(counts.astype(np.float32))
    return root / max(np.linalg.norm(root), 1e-9)


def fit_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 8) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual coordinate descent in a fixed order."""
    y = np.where(positive, 1.0, -1.0)
    data = np.hstack([x, np.ones((len(x), 1), np.float32)])
    diagonal = (data ** 2).sum(axis=1) + 0.5 / cost
    alpha, weights = np.zeros(len(x)), np.zeros(data.shape[1], np.float64)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            slope = y[i] * (data[i] @ weights) - 1 + alpha[i] * 0.5 / cost
            step = max(alpha[i] - slope / diagonal[i], 0.0)
            if step != alpha[i]:
                weights += (step - alpha[i]) * y[i] * data[i]
                alpha[i] = step
    return weights


@dataclass(frozen=True)
class Vote:
    """One-versus-one machines among ``classes``; machine k tells ``pairs[k][0]`` from ``pairs[k][1]``."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Vote:
        classes = tuple(sorted(set(labels)))
        pairs, fitted = tuple(combinations(range(len(classes)), 2)), []
        for a, b in pairs:
            rows = (labels == classes[a]) | (labels == classes[b])
            fitted.append(fit_svm(x[rows], labels[rows] == classes[a]))
        return Vote(classes, pairs, np.array(fitted).reshape(len(pairs), x.shape[1] + 1).astype(np.float32))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class with most won votes (ties: larger margin) and its smallest margin; a single class has margin 1."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x.astype(np.float64) @ self.weights[:, :-1].T.astype(np.float64) + self.weights[:, -1]
        won, total = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for which, m in ((a, margin[:, k]), (b, -margin[:, k])):
                won[:, which] += m > 0
                total[:, which] += m
                least[:, which] = np.minimum(least[:, which], m)
        best = (won + np.tanh(total / len(self.pairs)) / 4).argmax(axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass(frozen=True)
class Model:
    families: Vote
    inside: dict[str, Vote]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score from 0 to 1 of each text; ``und`` and 0 for NULL and texts without a letter."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.families.classes:
            return langs, scores
        for at in range(0, len(known), 256):
            rows = known[at:at + 256]
            x = np.array([features(texts[i]) for i in rows], np.float32)
            family, margin = self.families.choose(x)
            for f in set(family):
                vote = self.inside[self.families.classes[f]]
                members = np.flatnonzero(family == f)
                best, least = vote.choose(x[members])
                for m, b, s in zip(members, best, np.minimum(margin[members], least)):
                    langs[rows[m]] = vote.classes[b]
                    # Rounded, so that the order of additions in a batch does not show.
                    scores[rows[m]] = round(1 / (1 + np.exp(-4 * np.clip(s, -10, 10))), 6)
        return langs, scores


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 3, is 1. A NULL id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def sample(usable: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """(lang, vector): feature vectors of at most ``per_language`` different texts of each of the ``max_languages`` most
    frequent languages, those with the smallest hashes.

    A text is told by its hash, not by its id, so shared and NULL ids lose no language and copies count once. Every task
    keeps that many hashes a language, so the shuffle is as small, and no share of a count is taken.
    """
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    hashed = usable.select("lang", F.xxhash64(F.lit("sample"), F.col("text").cast("string")).alias("h"))

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.to_pandas().groupby("lang")["h"]:
                kept[lang] = np.unique(np.concatenate([kept.get(lang, np.empty(0, np.int64)), rows.to_numpy()]))[:per_language]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, v in kept.items() for _ in v], pa.string()), pa.array([h for v in kept.values() for h in v.tolist()], pa.int64())],
            names=["lang", "h"])

    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    firsts = hashed.mapInArrow(smallest, "lang string, h long").distinct().withColumn("nth", nth).where(F.col("nth") <= per_language)
    chosen = write_and_reload(firsts.join(F.broadcast(counts), "lang").select("lang", "h"))
    rows = usable.select("lang", F.xxhash64(F.lit("sample"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()  # as many as were chosen
        for batch in batches:
            out = []
            for lang, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, h) not in done and has_letter(text):
                    out.append((lang, h, features(text).astype("<f4").tobytes()))
                done.add((lang, h))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))],
                                             names=["lang", "h", "vector"])

    # At most per_language * max_languages pairs of a label and a number.
    matched = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text")
    found = matched.mapInArrow(vectors, "lang string, h long, vector binary")
    return found.groupBy("lang", "h").agg(F.first("vector").alias("vector")).select("lang", "vector")


def fit(labelled: DataFrame, per_language: int = 800, max_languages: int = 200) -> Model:
    """Model of the languages in ``labelled`` (text, lang); other columns are ignored, rows without text or label left out.

    Learned from ``sample``: at most ``per_language * max_languages`` feature vectors of 8 KB reach the driver. Languages
    beyond the ``max_languages`` most frequent, and those without a letter in their sample, are not learned;
    ``Model.families`` and ``Model.inside`` name those that are. An empty table gives a model that answers ``und``.
    """
    usable = labelled.where("text is not null and lang is not null")
    rows = sorted((r["lang"], bytes(r["vector"])) for r in sample(usable, per_language, max_languages).collect())
    if not rows:
        return Model(Vote((), (), np.zeros((0, DIMENSIONS + 1), np.float32)), {})
    langs = np.array([lang for lang, _ in rows], object)
    x = np.frombuffer(b"".join(v for _, v in rows), "<f4").reshape(-1, DIMENSIONS)
    family = np.array([FAMILY_OF.get(lang, lang) for lang in langs], object)
    return Model(Vote.fit(x, family), {f: Vote.fit(x[family == f], langs[family == f]) for f in set(family)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced. Only ``text`` is looked at.

    A NULL text and one without a letter are ``und`` with score 0; texts are read whole, in blocks; repeated rows are
    judged alike; an empty table stays empty.
    """
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index("text")
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by languages and dimensions

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            fields = [*batch.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)],
                                             schema=pa.schema(fields))

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(predicted, T.StructType([*rows.schema.fields, *added]))
