"""Packing: ids, cuts, places, fill, and tables out of the ordinary."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cupboard.llm import packing
from cupboard.llm.tokens import Encoder


def packed(df, vocab, **how):
    return packing.best_fit(df, vocab, **how).collect()


def test_ids_equal_the_tokenizer(vocab):
    rng, own, plain = random.Random(1), Encoder(vocab), Tokenizer.from_file(vocab)
    texts = ["", "  a  b\n\n c ", "it's we'LL x²½ 中文 \x1c\u0085", "<|endoftext|> a<|endoftext|>", "a" * 5000, " word" * 300_000]
    texts += ["".join(rng.choice("ab c\n\t'sllé²中1 _.#  ") for _ in range(200)) for _ in range(200)]
    assert own._fast is not None
    for text in texts:
        assert own.encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(docs, vocab):
    rng = random.Random(2)
    texts = [None, "", "one"] + ["w" + " x" * rng.choice([3, 40, 63, 64, 65, 127, 128, 300]) for _ in range(60)]
    plain = Tokenizer.from_file(vocab)
    rows = packed(docs(enumerate(texts)), vocab, size=64)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
        assert all(r.length == 64 for r in mine[1:]) and mine[0].length <= 64 and (len(mine) > 1) == (len(ids) > 64)
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    least = max(-(-sum(r.length for r in rows) // 64), sum(r.length > 32 for r in rows))
    assert len(bins) <= 1.03 * least + 1


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        chosen = packing.fullest(counts, 30)
        best = {0}
        items = [n for n, c in counts.items() for _ in range(c)]
        items.remove(max(items))
        for n in items:
            best |= {b + n for b in best if b + n <= 30 - max(counts)}
        assert sum(n * k for n, k in chosen.items()) == max(counts) + max(best)
        assert all(0 < k <= counts[n] for n, k in chosen.items()) and max(counts) in chosen


def test_plan_is_bounded_by_lengths_not_by_pieces():
    rng = random.Random(4)
    small = {n: rng.randint(1, 50) for n in range(1, 257)}
    large = {n: c * 10**9 for n, c in small.items()}
    assert len(packing.plan_bins(large, 256)) <= 10 * 256 and len(packing.plan_bins(small, 256)) <= 10 * 256
    for histogram in (small, large):
        plan = packing.plan_bins(histogram, 256)
        assert {n: int((plan[plan[:, 0] == n][:, 2] * plan[plan[:, 0] == n][:, 5]).sum()) for n in histogram} == histogram


def test_hot_length_repeated_rows_clashing_names_and_empty_table(docs, vocab):
    rows = docs([(7, "same text")] * 500 + [(None, "x")] * 2, 5).withColumn("part", F.lit("p")).withColumn("length", F.lit(-1))
    got = packed(rows, vocab, size=64, with_ids=False)
    assert len(got) == 502 and len({(r.sequence_id, r.offset) for r in got}) == 502 and {r.ids for r in got} == {None}
    assert packed(rows.where("false"), vocab) == []
