"""Similar names inside groups: letters in common or prefix-filtered character bigrams, exact edit distance, connected names.

Two names are similar if their edit distance is at most ``share`` of the longer one's length and their digits agree (of two
model numbers that differ in a digit, neither is a misspelling of the other).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.operators.components import smallest_reachable
from cupboard.session import write_and_reload


def digits_of(name: Column) -> Column:
    return F.regexp_replace(name, "[^0-9]+", "")


def _bigrams(name: Column) -> Column:
    """Pairs of neighbouring characters; further occurrences of a pair are numbered, so that sets count as multisets.
    A single character stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    return F.transform(pairs, lambda pair, i: F.concat(
        pair, F.lit("/"), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda other: other == pair)).cast("string")))


#: Up to so many names of one group and digits are all compared with each other; beyond, by their rarest bigrams.
FEW_NAMES = 128


def _letters(name: Column) -> Column:
    """64 bits that tell which letters a name has. An edit takes one letter away and brings one in at most, so it changes two
    bits at most."""
    return F.aggregate(
        F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"),
        lambda bits, letter: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(letter), F.lit(64)))))


def _sized(names: DataFrame, group: tuple[str, ...], share: str) -> DataFrame:
    """``names`` with their digits, letters, length, the edits a name of that length allows (few: most pairs are told apart by
    these numbers), ``place`` (a hash of group and digits) and the number of names there."""
    digits = names.withColumns({"digits": digits_of(F.col("name")), "length": F.length("name"), "letters": _letters(F.col("name"))})
    placed = digits.withColumns({
        "place": F.xxhash64(*group, "digits"), "edits": F.floor(F.lit(share).cast("decimal(4,3)") * F.col("length")).cast("int")})
    sizes = placed.groupBy("place").agg(F.count("*").alias("n_here"))
    return write_and_reload(placed.join(sizes, "place"))


def _pairs_of_few(sized: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(a, b, place) of the similar names of places with few names: each is compared with fewer than ``FEW_NAMES`` others."""
    sized = sized.where("n_here > 1")
    other = sized.select("place", *(F.col(c).alias(f"_{c}") for c in ("id", *group, "digits", "name", "length", "letters", "edits")))
    most = F.greatest("edits", "_edits")
    near = sized.join(other, "place").where("id < _id").where(
        (F.abs(F.col("length") - F.col("_length")) <= most)
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("_letters"))) <= 2 * most))
    # Different places may have one hash. Equalities in a row would become join keys and be sorted by.
    one_place = F.least(*(F.col(column) == F.col(f"_{column}") for column in (*group, "digits")))
    return near.where(one_place & (F.levenshtein("name", "_name") <= most)).select(F.col("id").alias("a"), F.col("_id").alias("b"), "place")


def _roots_of_few(pairs: DataFrame) -> DataFrame:
    """(node, root) like ``smallest_reachable``: links of a place meet in one task, which holds one place at a time."""
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root = None, {}
        for batch in batches:
            done = []
            for place, a, b in zip(*(column.to_pylist() for column in batch.columns)):
                if place != now:
                    done += ((node, _find(root, node)) for node in root)
                    now, root = place, {}
                a, b = _find(root, a), _find(root, b)
                root[max(a, b)] = min(a, b)
            yield _rooted(done)
        yield _rooted([(node, _find(root, node)) for node in root])

    links = pairs.select("place", "a", "b").repartition("place").sortWithinPartitions("place")
    return links.mapInArrow(walk, "node long, root long")


def _find(root: dict[int, int], node: int) -> int:
    while (above := root.setdefault(node, node)) != node:
        root[node] = node = root[above]
    return node


def _rooted(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["node", "root"])


def _pairs_of_many(names: DataFrame, group: tuple[str, ...], share: str) -> DataFrame:
    """(a, b) of the similar names of places with many names.

    A name of length L within the distance of another shares with it all but two bigrams an edit; so any
    two similar names have a common bigram among their rarest ``2 * floor(share / (1 - share) * L) + 1``, and only names that do are
    compared. Rarity is counted over all names; the frequencies decide which pairs are looked at, not which are found.
    """
    limit = F.lit(share).cast("decimal(4,3)")
    grams = write_and_reload(names.select("id", *group, "name", F.explode(_bigrams(F.col("name"))).alias("gram")))
    frequency = write_and_reload(grams.groupBy("gram").agg(F.count("*").alias("n")))
    ranked = grams.join(frequency, "gram").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))  # as many as the name has letters
    length = F.length("name")
    # A partner may be longer, by L / (1 - share) at most; each edit it needs touches two bigrams.
    edits = F.floor(limit * F.ceil(length / (1 - limit))).cast("int")
    prefix = F.slice("grams", F.lit(1), 2 * edits + 1)
    heads = names.join(ranked, "id").select("id", *group, "name", "digits", F.explode(prefix).alias("_gram"))
    heads = write_and_reload(heads.select("id", *group, "name", "digits", F.col("_gram.gram").alias("gram")))
    other = heads.select(F.col("id").alias("b"), *group, F.col("name").alias("other"), "digits", "gram")
    longer = F.greatest(length, F.length("other"))
    most = F.floor(limit * longer).cast("int")
    near = heads.withColumnRenamed("id", "a").join(other, [*group, "digits", "gram"]).where("a < b").where(
        F.abs(length - F.length("other")) <= most)
    once = near.select("a", "b", "name", "other", most.alias("most")).distinct()
    return once.where(F.levenshtein("name", "other") <= F.col("most")).select("a", "b")


def similar_pairs(names: DataFrame, group: tuple[str, ...], share: str = "0.2", few: int = FEW_NAMES) -> DataFrame:
    """(a, b): ids of similar names of the same group, a < b.

    ``names`` (a written table) has a unique ``id``, the group columns (not NULL) and ``name`` (not empty), every name of a
    group once. Names of a group with equal digits are compared directly where they are few, and by bigrams elsewhere;
    both ways find the same pairs.
    """
    sized = _sized(names, group, share)
    pairs = _pairs_of_few(sized.where(F.col("n_here") <= few), group).select("a", "b")
    many = sized.where(F.col("n_here") > few)
    return pairs if many.isEmpty() else pairs.unionByName(_pairs_of_many(many, group, share))


def connected_names(names: DataFrame, group: tuple[str, ...], share: str = "0.2", few: int = FEW_NAMES) -> DataFrame:
    """``names`` with ``root``: the smallest id that similar names lead to, its own if there is none.

    Similar names are of one group and have equal digits, so a few of them are connected where they meet; only links
    among many names take rounds.
    """
    sized = _sized(names, group, share)
    roots = _roots_of_few(_pairs_of_few(sized.where(F.col("n_here") <= few), group))
    many = sized.where(F.col("n_here") > few)
    if not many.isEmpty():
        roots = roots.unionByName(smallest_reachable(_pairs_of_many(many, group, share)))
    roots = roots.withColumnRenamed("node", "id")
    return names.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
