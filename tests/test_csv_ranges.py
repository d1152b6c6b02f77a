"""CSV read by byte ranges against the one-task reader."""

import os
import random
import tempfile

import pytest

from veritab.sources import csv_ranges as C
from veritab.sources import readers as R

CELLS = ["", "a", "bc", "12", "-3.5", "é😀", 'say ""hi""', "two\nlines", "\n", "a,b", '"" ""', "x\n\ny\n", '"",""', "\r\n", "tail\r", "NA",
         'ends "",\n""next']
PLAIN = ["", "a", "bc", "12", "5 in", 'mid"dle', 'x"y"z', "é", "  "]


@pytest.fixture()
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def write(rng, rows, end):
    folder = tempfile.mkdtemp(prefix="veritab-csv-")
    for part in range(2):
        lines = ["k,note,other"]
        for i in range(rows):
            own = [f'"{rng.choice(CELLS)}"' if rng.random() < 0.5 else rng.choice(PLAIN) for _ in range(2)]
            lines.append(",".join([str(i * 2 + part), *own][:rng.choice([3, 3, 3, 2])]))
        with open(os.path.join(folder, f"part-{part}.csv"), "w", newline="") as fh:
            fh.write(end.join(lines) + rng.choice(["", end]))
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v or "") for v in r])


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_one_task_reader(spark, small_ranges, seed):
    rng = random.Random(seed)
    folder = write(rng, 60, "\n")
    want = spark.read.options(header=True, escape='"', multiLine=True).csv(folder)
    got = C.read_csv_strings(spark, folder)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    lines = C.csv_lines(spark, folder)
    assert lines.rdd.getNumPartitions() > 8
    shuffled = C.csv_records(lines, broadcast_ranges=0)
    assert sorted(r[0] for r in shuffled.collect()) == sorted(r[0] for r in C.csv_records(lines).collect())


def test_windows_line_ends(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="veritab-csv-")
    with open(os.path.join(folder, "a.csv"), "w", newline="") as fh:
        fh.write("k,note\r\n" + "".join(f'{i},"line {i}\r\nand ""more"""\r\n' for i in range(50)) + '50,end\r\n')
    assert rows_of(C.read_csv_strings(spark, folder)) == sorted(
        [(str(i), f'line {i}\r\nand "more"') for i in range(50)] + [("50", "end")])


def test_record_over_many_ranges_and_open_end(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="veritab-csv-")
    long = "\n".join(f"line {i}" for i in range(400))
    with open(os.path.join(folder, "a.csv"), "w", newline="") as fh:
        fh.write(f'k,"no\nte"\n1,"{long}"\n2,b\n3,"{long}","\n4,never closed\n')
    want = spark.read.options(header=True, escape='"', multiLine=True).csv(folder)
    got = C.read_csv_strings(spark, folder)
    assert got.columns == want.columns
    assert rows_of(got)[:3] == rows_of(want)[:3] == [("1", long), ("2", "b"), ("3", long)]


def test_files_without_breaks_use_the_plain_reader(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="veritab-csv-")
    with open(os.path.join(folder, "a.csv"), "w", newline="") as fh:
        fh.write("k,note\n" + "".join(f'{i},"a ""b"", {i}"\n' for i in range(100)))
    df = C.read_csv_strings(spark, folder)
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and "FileScan csv" in df._jdf.queryExecution().toString()
    assert df.count() == 100 and df.where("k = '7'").first()["note"] == 'a "b", 7'


@pytest.mark.parametrize("line, inside, want", [
    ("a,b", False, False), ('a,"b', False, True), ('"a""', False, True), ('"a"""', False, False), ('a"b,c', False, False),
    ('x', True, True), ('x"', True, False), ('x"y,"z', True, True), ('x""', True, True), ('"",', True, True), ('",', True, False),
    ('","', True, True), ("", True, True), ("", False, False)])
def test_state_behind_a_line(line, inside, want):
    assert C.ends_open(line, inside) is want


def test_types_of_extreme_numbers_and_schema_by_name(spark):
    folder = tempfile.mkdtemp(prefix="veritab-csv-")
    path = os.path.join(folder, "n.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c\n-9223372036854775808,-2147483648,1\n5,2147483647,2\n")
    df = R.read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "int", "c": "int"} and df.first()["a"] == -2 ** 63
    typed = R.read_csv(spark, path, "b int, a long")
    assert typed.columns == ["b", "a"] and tuple(typed.first()) == (-2147483648, -2 ** 63)
    with pytest.raises(ValueError, match="missing|not in"):
        R.read_csv(spark, path, "a long, d int")


def test_mixed_records(spark):
    texts = ['{"a":1,"b":"x"}', "[1]", "7", "not json", None, '{"a":2.5,"c":{"d":[1,null],"e":true}}', '{"a":null,"b":3,"c":{"d":[2.5]}}',
             '{"b":{"q":1},"c":{"e":"no"},"f":null}', "{}", '{"a": 12345678901234567890}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = R.read_records(spark, df, "t", keep=["i"])
    assert dict(out.dtypes) == {"i": "int", "a": "double", "b": "string", "c": "struct<d:array<double>,e:string>", "f": "string"}
    got = {r["i"]: r for r in out.collect()}
    assert sorted(got) == [0, 5, 6, 7, 8, 9] and got[0]["a"] == 1.0 and got[6]["b"] == "3" and got[7]["b"] == '{"q":1}'
    assert got[5]["c"]["d"] == [1.0, None] and got[5]["c"]["e"] == "true" and got[9]["a"] == 12345678901234567890.0
    assert tuple(R.count_records(spark, df, "t").first()) == (10, 6, 4)
    assert R.read_records(spark, df.where("false"), "t", keep=["i"]).columns == ["i"]
