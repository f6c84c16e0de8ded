"""Records cut by many tasks, against the csv module reading the file as one stream."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cupboard.operators.load import import_exports
from cupboard.operators.normalize import registry_importer
from cupboard import registry
from cupboard.sources.exports import profile_files
from cupboard.sources.records import cells_of, cut_records, raw_lines

PIECES = ["a", "bc", "é", "中文", " ", "1,5", '"', '""', "\n", "\r\n", "\n\n", ",", ",,", '","', '",\n"', "x" * 40, '\n"', 'y"z']


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cut(spark, folder):
    lines = raw_lines(spark, str(folder), lineSep="\n").withColumn("text", F.col("value")).drop("value")
    rows = cut_records(lines, F.lit("\n")).withColumn("cells", cells_of(F.col("record"))).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.file_block_start, r.row_id)):
        out.setdefault(r.file_path.rsplit("/", 1)[-1], []).append((r.is_first, r.cells))
    return out, {(r.file_path, r.file_block_start) for r in rows}


def by_stream(text):
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row and (len(row) > 1 or not row[0] or row[0].strip(" "))]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_one_stream(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    texts = {}
    for k in range(12):
        well_formed = k % 2 == 0
        if well_formed:
            out = io.StringIO(newline="")
            writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
            for _ in range(rng.randrange(1, 120)):
                writer.writerow(["".join(rng.choices(PIECES, k=rng.randrange(4))) for _ in range(rng.randrange(1, 5))])
            text = out.getvalue()
        else:  # stray and open quotes
            text = "".join(rng.choices(PIECES, k=rng.randrange(1, 900)))
            text = text.replace("\r\n", "\n").rstrip("\n")  # the last line break of an open record is not kept
        texts[f"{k}.csv"] = text
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    got, blocks = cut(spark, tmp_path)
    assert len(blocks) > 20  # files of several blocks
    for name, text in texts.items():
        want = by_stream(text)
        mine = got.get(name, [])
        assert [first for first, _ in mine] == [True] + [False] * (len(mine) - 1) if mine else not want
        # A cell of blanks alone is kept if it is quoted, which the csv module does not tell.
        assert [cells for _, cells in mine if len(cells) > 1 or not cells[0] or cells[0].strip(" ")] == want


def test_a_large_file_is_read_by_many_tasks_and_imports_the_same(spark, tmp_path):
    """Quoted line breaks in every tenth row, blocks that start inside quotes, order and duplicates as in the file."""
    path = tmp_path / "in" / "big.csv"
    path.parent.mkdir()
    rows = [["2026/01/01", str(i % 3000), f"item {i}" + ('\r\nsecond "line"\n' * 30 if i % 10 == 0 else ""), str(i)] for i in range(6000)]
    with open(path, "w", encoding="shift_jis", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(["注文日", "注文番号", "商品名", "価格"])
        writer.writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        profile = profile_files(spark, str(path.parent)).first()
        assert profile.multi_line and profile.charset == "Shift_JIS"
        n_blocks = raw_lines(spark, str(path.parent), lineSep="\n").select("file_block_start").distinct().count()
        done = import_exports(spark, str(path.parent), None, registry_importer(registry.FORMATS, registry.SYMBOLS))
        got = [(r.order_id, r.item_name, r.price) for r in done.accepted.orderBy("file_no", "file_block_start", "row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n_blocks > 10
    assert got == [(r[1], r[2].strip(), float(r[3])) for r in rows[:3000]]


def test_one_open_quote_takes_the_rest_and_hot_file_is_split(spark, tmp_path, small_splits):
    text = ('a,b\n1,"open\n' + "line,with,commas\n" * 300).rstrip()
    (tmp_path / "x.csv").write_bytes(text.encode())
    got, _ = cut(spark, tmp_path)
    assert [cells for _, cells in got["x.csv"]] == by_stream(text)


def test_lone_carriage_returns(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes('注文日,注文番号,商品名,価格\r2026/01/01,1,"a\rb",5\r2026/01/02,2,c,6\r'.encode())
    (tmp_path / "plain.csv").write_bytes('注文日,注文番号,商品名,価格\r2026/01/01,3,d,5\r2026/01/02,4,e,6\r'.encode())
    done = import_exports(spark, str(tmp_path), None, registry_importer(registry.FORMATS, registry.SYMBOLS))
    assert sorted((r.order_id, r.item_name) for r in done.accepted.collect()) == [("1", "a\rb"), ("2", "c"), ("3", "d"), ("4", "e")]
    assert {r.errors for r in done.statistics.collect()} == {0}


def test_no_path_list_reaches_a_reader(spark, tmp_path, monkeypatch):
    """Readers get the landing folder itself; the files are told apart by joins."""
    from pyspark.sql import DataFrameReader

    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'注文日,注文番号,商品名,価格\n2026/01/01,{k},"a\nb",5\n' if k else "x\n1\n", encoding="utf-8")
    asked = []
    for name in ("text", "csv"):
        real = getattr(DataFrameReader, name)
        monkeypatch.setattr(DataFrameReader, name, lambda self, path, *a, _real=real, **k: (asked.append(path), _real(self, path, *a, **k))[1])
    done = import_exports(spark, str(tmp_path), None, registry_importer(registry.FORMATS, registry.SYMBOLS))
    assert done.accepted.count() == 2 and set(asked) == {str(tmp_path)}


def test_one_row_a_file_moves_no_lines(spark, tmp_path):
    """Lines are counted by hash, not sorted, and the records stay where they are when they meet their file's first one."""
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("Order Date,Title\n" + "".join(f'2026-01-01,"line {i}\n{n} {n * 7919}"\n' for n in range(3000)))
    plan = profile_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        lines = raw_lines(spark, str(tmp_path), lineSep="\n").withColumn("text", F.col("value")).drop("value")
        records = cut_records(lines, F.lit("\n"))
        assert records.count() == 6002 and records.where("is_first").count() == 2
        assert "SortMergeJoin" not in records._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_lines_with_quotes_are_grouped(spark, tmp_path, monkeypatch):
    """Lines without quotes stay where they are, unless some in their block may lie inside quotes."""
    from cupboard.sources import records as module

    written, write = {}, module.write_and_reload
    monkeypatch.setattr(module, "write_and_reload", lambda df, path: written.setdefault(path.rsplit("/", 1)[-1], write(df, path)))
    body = [f"{n},plain" if n % 100 else f'{n},"2""\nlong"' for n in range(1, 1001)]
    (tmp_path / "pairs.csv").write_text("\n".join(["id,item", *body]))
    (tmp_path / "inner.csv").write_text('id,item\n1,"a\nb, no quote here\nc"\n2,d\n3,"e"\n4,"open\nto the end\nf')
    got, _ = cut(spark, tmp_path)
    assert [cells for _, cells in got["pairs.csv"]] == by_stream("\n".join(["id,item", *body]))
    assert [cells for _, cells in got["inner.csv"]] == [
        ["id", "item"], ["1", "a\nb, no quote here\nc"], ["2", "d"], ["3", "e"], ["4", "open\nto the end\nf"]]
    assert written["states"].where("file_path LIKE '%pairs.csv'").count() == 20
    assert written["records"].where("file_path LIKE '%pairs.csv'").count() == 10
