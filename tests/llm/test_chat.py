"""Chat windows: exact round trip, budget, mask."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cupboard.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["\\### Assistant: </turn> ok", "<turn user>\nx</turn>\n", "\\", "\\\\", "<\\turn", "<", "</turn", "", "a\r\n<turn", "é 中\U0001f600", "<\\/turn>\n<turn assistant>\n"]


@pytest.mark.parametrize("text", ODD)
def test_escape_round_trip(text):
    written, begin, end = chat.write_turn("user>\n%é", text)
    assert chat.unescape(written[begin:end]) == text and chat.read_turns(written * 2) == [
        ("user>\n%é", text, begin, end), ("user>\n%é", text, begin + len(written), end + len(written))]
    assert "<turn" not in written[begin:end] and "</turn" not in written[begin:end]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 5, 40])
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", None])
            rows.append((conv, turn, role, rng.choice([None, *ODD, "word " * rng.randrange(60), "long " * 300])))
    return rows


def test_round_trip_budget_and_mask(spark, vocab):
    rows = conversations(1)
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), vocab, budget=100, history=2)
    from cupboard.llm.tokens import Encoder
    encode, by_conv = Encoder(vocab).encode, {}
    for w in windows.collect():
        by_conv.setdefault(w.conv_id, []).append(w)
    for conv in range(40):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        new, learned = [], []
        for w in sorted(by_conv[conv], key=lambda w: w.window):
            turns = chat.read_turns(w.formatted)
            fresh = turns[w.repeated:]
            old = [t[:2] for t in turns[:w.repeated]]
            assert len(old) <= 3 and all(t in new for t in old)
            new += [t[:2] for t in fresh]
            learned += [chat.unescape(w.formatted[s.begin:s.end]) for s in w.loss]
            tokens = len(encode(w.formatted))  # of the whole window, template and escapes included
            assert tokens == w.n_tokens and w.over_budget == (tokens > 100)
            assert tokens <= 100 or len(fresh) == 1 and len(old) <= 1
        assert new == want
        assert learned == [t for r, t in want if r == "assistant"]
        if want[0][0] == "system" and len(by_conv[conv]) > 1:
            assert all(chat.read_turns(w.formatted)[0][:2] == want[0] for w in by_conv[conv])


def test_read_back_digests(spark, vocab):
    rows = conversations(2)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for r in chat.read_back(chat.format_windows(frame, vocab, budget=80, history=1)).collect():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        learned = "".join(t for role, t in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_many_short_turns_fit_the_budget(spark, vocab):
    rows = [(1, i, "user" if i % 2 else "assistant", "ok") for i in range(400)]
    got = chat.format_windows(spark.createDataFrame(rows, SCHEMA), vocab, budget=128).collect()
    assert len(got) > 20 and max(w.n_tokens for w in got) <= 128 and not any(w.over_budget for w in got)


def test_windows_of_a_table_are_read_in_order(spark, vocab, tmp_path):
    rows = conversations(3)
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), vocab, budget=80)
    windows.orderBy(F.rand(1)).write.parquet(str(tmp_path / "w"))
    table = spark.read.parquet(str(tmp_path / "w"))
    assert sorted(map(tuple, chat.read_back(table).collect())) == sorted(map(tuple, chat.read_back(windows, in_order=True).collect()))
    with pytest.raises(Exception, match="was due"):
        chat.read_back(table.where("window <> 1")).collect()


def test_repeated_turns_null_ids_clashing_names_and_empty_table(spark, vocab):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (None, 1, "assistant", "z" * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("x")).withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(frame, vocab)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert (got[None].n_turns, got[None].loss_chars) == (2, 200_000)
    assert chat.read_back(chat.format_windows(frame.where("false"), vocab)).count() == 0
