"""Shards: contiguous, near-equal bytes, gapless slots."""

import random
import zlib

from pyspark.sql import functions as F

from cupboard.llm import sharding


def brute(rows, n):
    sized = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, d) for d, t in rows)
    total, start, out, slots = sum(s[3] for s in sized), 0, [], {}
    for _, _, crc, size, d in sized:
        shard = min((2 * start + size) * n // (2 * total), n - 1)
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    return sorted(out, key=repr)


def placed(df, n=8):
    return sorted((tuple(r) for r in sharding.byte_shards(sharding.sized(df), n).collect()), key=repr)


def test_brute_force(docs):
    rng = random.Random(1)
    rows = [(rng.randrange(-500, 10**12), rng.choice([None, "", "é" * rng.randrange(50), "x" * rng.randrange(4000)])) for _ in range(700)]
    rows += [(None, "n"), (None, None)] + [(5, "hot")] * 300
    got = placed(docs(rows, 6))
    assert got == brute(rows, 8)
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_one_long_text_few_rows_and_empty_table(docs):
    rows = [(1, "a"), (2, "b" * 100_000), (3, None)]
    assert placed(docs(rows)) == brute(rows, 8)
    assert placed(docs(rows).where("false")) == []


def test_clashing_names(docs):
    rows = docs([(1, "a"), (2, "b")]).withColumn("size", F.lit("s")).withColumn("shard", F.lit("t")).withColumn("_part", F.lit(1))
    assert placed(rows, 2) == brute([(1, "a"), (2, "b")], 2)


def test_written_shards(spark, docs, tmp_path):
    rows = docs([(i, "t" * (i % 40)) for i in range(200)])
    sharding.write_shards(rows, sharding.byte_shards(sharding.sized(rows), 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert sorted(c for c in back.columns) == sorted([*rows.columns, "shard", "slot"])
