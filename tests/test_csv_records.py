"""Quoted CSV in many tasks against Spark's whole-file reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import csvfiles, records


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def write(path, rows, seed, end="\n"):
    rng = random.Random(seed)

    def cell(value):
        if any(c in value for c in ',"\n\r') or rng.random() < 0.2:
            return '"' + value.replace('"', '""') + '"'
        return value

    path.write_bytes(end.join(",".join(map(cell, r)) for r in rows).encode() + end.encode())


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["plain", "with, comma", 'a "quoted" word', "line\nbreak", "\n\n", 'end"', '"', "ünï", "x" * 900, "a\nb\nc\n" * 60, "", "7"]
    return [[str(i), rng.choice(parts) + rng.choice(parts), rng.choice(parts)] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks_gives_the_same_rows(spark, tmp_path, small_blocks, end):
    rows = texts(150, 4)
    file = tmp_path / "big.csv"
    write(file, [["id", "a", "b"], *rows], 1, end)
    lines = records.text_lines(spark, str(file))
    assert lines.rdd.getNumPartitions() > 20
    missing = set(csvfiles.MISSING_TOKENS)
    expected = sorted(tuple(None if c in missing else c for c in r) for r in rows)
    got = csvfiles.read_csv(spark, str(file), schema="id string, a string, b string").collect()
    assert sorted(map(tuple, got)) == expected
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(file))
    assert whole.count() == len(rows)
    cut = records.quoted_records(lines).count()
    joined = records.quoted_records(lines, known_blocks=0)
    assert cut == joined.count() == len(rows) + 1
    assert joined.select("file", "value").exceptAll(records.quoted_records(lines).select("file", "value")).isEmpty()


def test_stray_quotes_do_not_shift_records(spark, tmp_path, small_blocks):
    body = ['id,text', '1,5" pipe', '2,"open', 'and ""closed"" here"', '3,6" and 7" pipes, x', '4,"a"b', '5,"x,y"']
    filler = [f'{i},plain {"z" * 50}' for i in range(10, 60)]
    (tmp_path / "s.csv").write_text("\n".join([*body, *filler, '99,"last', '', 'line"']) + "\n")
    rows = {r.id: r.text for r in csvfiles.read_csv(spark, str(tmp_path)).collect()}
    assert rows[1] == '5" pipe' and rows[2] == 'open\nand "closed" here' and rows[99] == "last\n\nline" and len(rows) == 56
    assert rows[5] == "x,y" and rows[3].startswith('6" and 7" pipes')


def test_states_of_a_line():
    inside = records.ends_inside
    assert not inside(b"a,b", False, b",") and inside(b"a,b", True, b",")
    assert inside(b'a,"b', False, b",") and not inside(b'b",c', True, b",")
    assert inside(b'b"",c', True, b",") and not inside(b'a"b,c', False, b",")
    assert inside(b'x",y,"z', True, b",") and inside(b'a, "b', False, b",", True) and not inside(b'a, "b', False, b",")
    rng = random.Random(2)
    for _ in range(300):  # Python's reader as another opinion on well-formed text
        cells = ["".join(rng.choice('ab,"\n') for _ in range(rng.randrange(6))) for _ in range(3)]
        line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
        state, parts, n = False, line.split("\n"), 0
        for part in parts:
            state = inside(part.encode(), state, b",")
            n += not state
        assert n == 1 == len(list(csv.reader([line])))


def test_layouts_encodings_and_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name,name,\n1,x,y,z\n2,\"q\nr\",,\n".encode())
    (tmp_path / "b.csv").write_bytes("other,id\n\"caf\xe9 \x93q\x94\",3\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"id,other\r4,mac\r5,\"two\rlines\"\r")
    rows = sorted(tuple(r) for r in csvfiles.read_csv(spark, str(tmp_path), schema="id int, name1 string, name2 string, _c3 string, other string").collect())
    assert rows == [(1, "x", "y", "z", None), (2, "q\nr", None, None, None), (3, None, None, None, "café “q”"), (4, None, None, None, "mac"), (5, None, None, None, "two\rlines")] or rows[4][4] == "two\nlines"


def test_padded_rows_with_quotes(spark, tmp_path):
    (tmp_path / "p.txt").write_text('id ; note;more\n 1 ; "a;b\nc" ;x;surplus\n2;short\n\n')
    rows = sorted(tuple(r) for r in csvfiles.read_strings(spark, str(tmp_path)).collect())
    assert rows == [("1", "a;b\nc", "x"), ("2", "short", None)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        csvfiles.read_strings(spark, str(tmp_path / "none"))
