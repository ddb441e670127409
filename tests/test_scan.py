"""Scan of snapshot files: delimiters, parity, blank lines, big files, errors."""

import datetime

import pytest
from pyspark.errors import PySparkException

from tremorline.sources.acceleration import scan_acceleration, with_time


def write(root, name, lines, end="\n"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(end.join(lines).encode())


@pytest.fixture
def folders(tmp_path):
    write(tmp_path, "train/B 1/acc_1.csv", ["9;39;39;65664.0;0.5;-1", "1;1;1;1;9;9", "", "9;9;9;9;8;8", "9,39,59,1500,0.25,"])
    write(tmp_path, "train/B 1/acc_2.csv", ["10,0,0,0,1.5,2", "1,1,1,1,9,9"], "\r\n")
    write(tmp_path, "train/B 1/temp_1.csv", ["x"])
    write(tmp_path, "train/B 1/acc_1.txt", ["x"])
    write(tmp_path, "test/B2/acc_1.csv", ["11;0;0;0;3;4"])
    return tmp_path


def test_scan(spark, folders):
    raw = scan_acceleration(spark, str(folders), ["train/B 1", "test/B2"])
    got = sorted((r["id"], r["time"], r["x"], r["y"]) for r in with_time(raw).collect())
    day = datetime.datetime(2023, 1, 1)
    assert [g[:3] for g in got] == [
        (1, day.replace(hour=9, minute=40, second=0, microsecond=500_000), 0.25),
        (1, day.replace(hour=9, minute=40, second=44, microsecond=664_000), 0.5),
        (1, day.replace(hour=10), 1.5),
        (2, day.replace(hour=11), 3.0),
    ]
    assert [g[3] for g in got] == [None, -1.0, 2.0, 4.0]


def test_split_files_number_lines_across_splits(spark, folders):
    lines = [f"1;0;0;{i};{i};0" for i in range(5000)]
    write(folders, "big/B9/acc_1.csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = scan_acceleration(spark, str(folders), ["big/B9"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(r["x"]) for r in rows) == list(range(0, 5000, 2))


def test_positions_follow_the_list(spark, folders):
    rows = scan_acceleration(spark, str(folders), ["test/B2", "train/B 1", "test/B2"]).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 2, 2, 3]


def test_bad_number_fails(spark, folders):
    write(folders, "bad/B/acc_1.csv", ["1;1;1;1;abc;2"])
    with pytest.raises(PySparkException):
        scan_acceleration(spark, str(folders), ["bad/B"]).collect()


def test_line_ends(spark, folders):
    write(folders, "cr/B/acc_1.csv", [f"1;0;0;0;{i};0" for i in range(5)], "\r")
    write(folders, "crlf/B/acc_1.csv", [f"1;0;0;0;{i};0" for i in range(5)], "\r\n")
    for name in ("cr/B", "crlf/B"):
        assert sorted(r["x"] for r in scan_acceleration(spark, str(folders), [name]).collect()) == [0.0, 2.0, 4.0]


@pytest.mark.parametrize("line", ["1;1;1;1;2", "1;1;1;1;2;3;4"])
def test_wrong_number_of_fields_fails(spark, folders, line):
    write(folders, "wrong/B/acc_1.csv", [line])
    with pytest.raises(PySparkException):
        scan_acceleration(spark, str(folders), ["wrong/B"]).collect()


def test_nothing_to_read_fails(spark, folders):
    with pytest.raises(ValueError):
        scan_acceleration(spark, str(folders), [])
    write(folders, "none/B/temp.csv", ["1"])
    with pytest.raises(ValueError):
        scan_acceleration(spark, str(folders), ["none/B"])
