"""Delimited files against a plain one-pass reader: quotes, breaks, headers of one's own, pieces of files."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidParameter
from millrace.sources import delimited as D


def plain_records(text, delimiter=";"):
    """Records of a text, character by character: a quote opens a cell at its start only."""
    out, record, cell, state = [], [], "", "start"

    def close():
        nonlocal cell
        whole = len(cell) > 1 and cell[0] == cell[-1] == '"'
        record.append(cell[1:-1] if whole else cell or None)
        cell = ""

    i = 0
    while i < len(text):
        c = text[i]
        if state != "quoted" and c == "\n":
            cell = cell.removesuffix("\r")
            close()
            out.append(record)
            record, state = [], "start"
        elif state != "quoted" and c == delimiter:
            close()
            state = "start"
        elif state == "start" and c == '"':
            cell, state = '"', "quoted"
        elif state == "quoted" and c == '"':
            cell += '"'
            if text[i + 1 : i + 2] == '"':
                i += 1
            else:
                state = "plain"
        else:
            cell += c
            state = "quoted" if state == "quoted" else "plain"
        i += 1
    if cell or record:
        close()
        out.append(record)
    return out


def read_cells(spark, path, width, **options):
    rows = D.read_delimited(spark, str(path), header="none", names=[f"c{i}" for i in range(width)], keep_blank=True, row_column="row", **options)
    return [[r[f"c{i}"] for i in range(width)] for r in rows.orderBy("row").collect()]


def padded(records, width):
    return [(r + [None] * width)[:width] for r in records]


def test_a_stray_quote_opens_nothing_either_way(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'id;name\r\n1;5" pipe\r\n2;b\r\n3;"q""q"\r\n')
    for options in ({}, {"row_column": "row"}, {"multi_line": True}, {"skip_lines": 0, "file_column": "f"}):
        rows = D.read_delimited(spark, str(path), **options)
        assert sorted((r.id, r.name) for r in rows.collect()) == [("1", '5" pipe'), ("2", "b"), ("3", 'q"q')]


def test_files_go_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;name\r\n1;A\r\n".encode())
    (tmp_path / "b.csv").write_bytes(b"NAME;extra;id;\r\nB;x;2;y\r\n")
    (tmp_path / "c.csv").write_bytes(b'"id";"two\r\nlines"\r\n3;C\r\n')
    for options in ({}, {"row_column": "row"}):
        rows = D.read_delimited(spark, str(tmp_path), **options)
        assert rows.drop("row").columns == ["id", "name", "extra", "two\r\nlines"]
        assert sorted(tuple(r)[:4] for r in rows.collect()) == [("1", "A", None, None), ("2", "B", "x", None), ("3", None, None, "C")]
    (tmp_path / "d.csv").write_bytes(b"id;Id\r\n1;2\r\n")
    with pytest.raises(InvalidParameter):
        D.read_delimited(spark, str(tmp_path))


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_records_over_pieces_equal_one_pass(spark, tmp_path, piece):
    r, old = random.Random(piece), spark.conf.get("spark.sql.files.maxPartitionBytes")
    cells = ["a", "", '""', '"x;y"', '"l\nm"', '"l\r\n""q"";\r\n"', 'st"ray', '5"', '"tail"x', "é", '"' + "long\n" * 30 + '"']
    text = "".join(";".join(r.choices(cells, k=r.randint(1, 4))) + r.choice(["\r\n", "\n"]) for _ in range(150)) + 'last;"unclosed\nline'
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        assert read_cells(spark, path, 4) == padded(plain_records(text), 4)
        if piece == 7:
            assert D._Lines(spark, str(path), None, "utf-8", False).rows.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_encodings_and_breaks(spark, tmp_path):
    text = 'a;"b\nc"\né;ü\n'
    for encoding in ("latin-1", "utf-16", "utf-8"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        assert read_cells(spark, path, 2, encoding=encoding) == [["a", "b\nc"], ["é", "ü"]]
    path = tmp_path / "bars.csv"
    path.write_bytes(b'1;"x|y"|2;z|')
    assert read_cells(spark, path, 2, line_break="|") == [["1", "x|y"], ["2", "z"]]


def test_a_long_open_cell_takes_linear_time(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'1;"' + b"line\r\n" * 200_000 + b'"\r\n2;x\r\n')
    rows = read_cells(spark, path, 2)
    assert [r[0] for r in rows] == ["1", "2"] and len(rows[0][1]) == 1_200_000


def test_empty_files_and_missing_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"id;v\r\n1\r\n\r\n2;b;beyond\r\n")
    for options in ({}, {"row_column": "row"}):
        rows = D.read_delimited(spark, str(tmp_path), **options)
        assert sorted((r.id, r.v) for r in rows.collect()) == [("1", None), ("2", "b")]
    kept = D.read_delimited(spark, str(tmp_path / "b.csv"), row_column="n", file_column="f", keep_blank=True)
    assert [(r.n, r.id) for r in kept.orderBy("n").collect()] == [(0, "1"), (1, None), (2, "2")] and kept.where(F.col("f").endswith("b.csv")).count() == 3
