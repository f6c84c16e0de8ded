"""Fingerprints and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cupboard.llm import simhash
from cupboard.operators.components import smallest_reachable


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_brute_force(docs):
    rng = random.Random(1)

    def prose(n):
        return [rng.choice("THE of é ñandú x y z".split()) + str(rng.randrange(40)) for _ in range(n)]

    base = [prose(rng.choice([1, 2, 3, 30, 150, 400])) for _ in range(25)]
    rows = [(0, None), (1, " \t\n\x0b\x0c\r "), (2, "nbsp\u00a0word"), (3, "")]
    for i in range(4, 160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    prints = {i: fingerprint(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = groups(prints, near)
    got = simhash.near_duplicates(docs(rows)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_first(docs(rows)).collect()
    assert {r.doc_id for r in kept} == set(want.values()) and {(r.doc_id, r.text) for r in kept} <= set(rows)


@pytest.mark.parametrize("max_bits,cell_rows", [(0, 4096), (1, 4096), (3, 4096), (3, 5), (5, 7)])
def test_links_connect_what_brute_force_connects(spark, max_bits, cell_rows):
    rng = random.Random(max_bits)
    values = {0, (1 << 64) - 1, 1 << 63}
    while len(values) < 150:
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(value)
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "bits long"), max_bits, cell_rows).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits for a, b in got)
    near = [(signed[a], signed[b]) for a in values for b in values if a < b and (a ^ b).bit_count() <= max_bits]
    assert groups(signed.values(), got) == groups(signed.values(), near)


def test_embedding_is_a_lower_bound_and_cells_cover():
    rng = random.Random(9)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        ua, ub = (int(x) for x in simhash.embedded(np.array([a, b], np.uint64)))
        assert (ua ^ ub).bit_count() <= (a ^ b).bit_count() <= 3
        assert all(any(ua & m == ub & m for m in simhash.grid(3, blocks)) for blocks in (6, 7, 8, 11))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    order = rng.sample(range(1000), 1000)
    chain = list(zip(order[:400], order[1:401]))
    star = [(5000, 6000 + i) for i in range(200)] + [(6000, 6000)]
    got = smallest_reachable(spark.createDataFrame(chain + star, "a long, b long")).collect()
    nodes = {n for link in chain + star for n in link}
    want = groups(nodes, chain + star)
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_null_ids_clashing_names_and_empty_table(docs):
    rows = docs([(3, "same words here"), (3, "same words here"), (2, "same words here"), (None, "same words here"),
                 (None, "alone in the world"), (9, "two texts one"), (9, "id of both rows")])
    rows = rows.withColumn("bits", F.lit(1)).withColumn("n", F.lit(2)).withColumn("__id", F.lit(None).cast("long")).withColumn("root", F.lit(3))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(3, 2), (3, 2), (2, 2), (None, 2), (None, None), (9, 9), (9, 9)], key=repr)
    kept = simhash.keep_first(rows)
    assert sorted((repr(r.doc_id) for r in kept.collect())) == ["2", "9", "None"] and kept.columns == rows.columns
    assert simhash.near_duplicates(rows.where("false")).count() == 0 and simhash.keep_first(rows.where("false")).count() == 0


def test_very_long_text():
    text = "A b C " * 200_000
    assert simhash.fingerprint(text, 3) == simhash.fingerprint("a b c " * 200_000, 3)


def test_one_row_of_each_group_whatever_the_ids(docs):
    """Groups that share an id or have none all stay; an id that is a copy elsewhere does not displace its own group."""
    rows = [(None, "alone in the world"), (None, "second text without any id"), (None, "second text without any id"),
            (9, "two texts one"), (9, "id of both rows"), (3, "same words here"), (5, "same words here"),
            (5, "own words of five"), (6, "own words of five"), (None, "own words of five"), (4, None), (4, "")]
    want = [(None, "alone in the world"), (None, "second text without any id"), (9, "two texts one"), (9, "id of both rows"),
            (3, "same words here"), (5, "own words of five")]
    table = docs(rows)
    kept = simhash.first_of_groups(table)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((r for r in got if r[0] != 4), key=repr) == sorted(want, key=repr) and len(got) == len(want) + 1
    assert kept.columns == table.columns and simhash.first_of_groups(table.where("false")).count() == 0
    assert sum(r.doc_id is None for r in simhash.keep_first(table).collect()) == 2


def test_pipeline_stage_keeps_groups_without_ids(spark, docs):
    import corpus_pipeline

    table = docs([(None, "first of the texts"), (None, "another one of them"), (7, "left over words"), (7, "not the same at all")])
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, table, "").count() == 4


def test_cells_stay_small_as_fingerprints_grow():
    """Strangers that a random fingerprint meets in all its cells, expected for large tables and counted for small ones."""
    for n, most in ((50_000, 1), (800_000, 1), (10 ** 8, 5), (10 ** 11, 300)):
        blocks = simhash.blocks_for(n, 3)
        cells = len(simhash.grid(3, blocks))
        assert cells <= 1600 and cells * n * 0.375 ** (32 * (blocks - 3) / blocks) <= most
    rng = np.random.default_rng(1)
    per_member = []
    for n in (50_000, 200_000, 800_000):
        where = simhash.embedded(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        pairs = 0
        for mask in simhash.grid(3, simhash.blocks_for(n, 3)):
            _, counts = np.unique(where & np.uint64(mask), return_counts=True)
            pairs += int((counts * (counts - 1)).sum() // 2)
        per_member.append(pairs / n)
    assert max(per_member) < 1
