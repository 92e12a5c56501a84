"""CSV files cut into many blocks against the same files read by one task."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quillframe.sources import csv_records, readers

CELLS = ["", "a", "1.5", "two words", 'say "hi"', "comma, here", "line\nbreak", "\n\n\n", '"', '""', ',"\n', "ü ß", "x" * 40, " lead", "trail "]


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


def nulls(row):
    return tuple(None if v in readers.NULL_TOKENS else v for v in row)


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_give_all_records(spark, tmp_path, small_blocks, quoting, end):
    rng = random.Random(len(end) + quoting)
    rows = [[str(i), *[rng.choice(CELLS) for _ in range(3)]] for i in range(400)]
    rows.append(["400", "long\n" * 300, "x", "y"])  # over many blocks
    rows += [[str(i), "a", "b", "c"] for i in range(401, 420)]
    half = len(rows) // 2
    for name, part in (("a.csv", rows[:half]), ("b.csv", rows[half:])):
        (tmp_path / name).write_bytes(written([["id", "p", "q", "r"], *part], quoting, end).encode())
    df = readers.read_csv(spark, str(tmp_path), schema="id string, p string, q string, r string")
    got = {r["id"]: tuple(r) for r in df.collect()}
    assert got == {r[0]: nulls(r) for r in rows}
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 50


def test_split_reading_equals_reading_by_one_task(spark, tmp_path, small_blocks):
    """Quotes inside plain fields, short rows, blank lines and text behind a closing quote."""
    lines = ['id,size,note', '1,5" pipe,plain', '2,"5"" x 6""","a', '', 'b"', '', '3,6",end"', '4', '5,a,b', '6,"q",7"', '7,"r","', '"', "8,''," + '"x"'] * 30
    text = "\n".join(lines[:1] + [x for x in lines if x != lines[0]]) + "\n"
    (tmp_path / "a.csv").write_text(text)
    options = {"header": True, "multiLine": True, "escape": '"'}
    want = [tuple(None if v == "" else v for v in r) for r in spark.read.options(**options).csv(str(tmp_path / "a.csv")).collect()]
    got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path), schema="id string, size string, note string").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 240


@pytest.mark.parametrize("line, want", [
    ("a,b", (0, 1)), ('"a,b', (1, 0)), ('a"', (0, 0)), ('x,"', (1, 0)), ('""', (0, 1)), ('"a""', (1, 0)), ('a,"b""c",d', (0, 0)), ('",a', (1, 0)),
    ('","', (0, 1)), ('"x","', (1, 1)), ("", (0, 1)), ('5" x 6"', (0, 0)), ('b",c,"d', (1, 1))])
def test_line_functions(line, want):
    def state(text, inside):  # one character at a time
        mode = "quoted" if inside else "start"
        i = 0
        while i < len(text):
            c = text[i]
            if mode == "quoted":
                if c == '"':
                    if text[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        mode = "after"
            elif c == ",":
                mode = "start"
            elif mode == "start" and c == '"':
                mode = "quoted"
            elif mode == "start":
                mode = "plain"
            i += 1
        return int(mode == "quoted")

    assert (state(line, False), state(line, True)) == want == csv_records.line_function(line.encode())


def test_long_lines_need_no_deep_stack():
    assert csv_records.line_function(b'a,"b""c",' * 200_000 + b'"open') == (1, 1)
    assert csv_records.line_function(b'"' + b'""' * 500_000) == (1, 0)


def test_headers_and_encodings(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes("﻿id,name,name,\n1,ü,x,y\n".encode())
    (tmp_path / "b.csv").write_bytes('id,"other\nname"\n2,é\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name1", "name2", "_c3", "other\nname"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "ü", "x", "y", None), (2, None, None, None, "é")]
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).count() == 0
    (tmp_path / "d.csv").write_bytes("id;t\n1;'a;\nb'\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "d.csv"), encoding="ISO-8859-1", sep=";", quote="'").collect() == [(1, "a;\nb")]
    (tmp_path / "e.csv").write_bytes('id,t\n1,"a\nb"\n'.encode("utf-16"))
    assert readers.read_csv(spark, str(tmp_path / "e.csv"), encoding="UTF-16").collect() == [(1, "a\nb")]


def test_reading_by_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a,b"\n')
    assert readers.read_csv(spark, str(tmp_path), lines=True).select(F.concat("id", F.lit("|"), "t")).first()[0] == "1|a,b"
