"""Lines of event files: both line ends, open tails, equal lines and files read in many blocks."""

import pytest

from peerlens.sources.events import file_owner_gate, read_event_lines


def lines(spark, folder):
    return sorted((r["file"].rsplit("/", 1)[-1], r["value"]) for r in read_event_lines(spark, f"{folder}/*.jsonl").collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_an_open_last_line_is_dropped(spark, tmp_path, end):
    files = {"closed": ["a", "b", "ü€"], "open": ["a", "ü", "b"], "empty": [], "one": ["x"]}
    (tmp_path / "closed.jsonl").write_bytes((end.join(files["closed"]) + end).encode())
    (tmp_path / "open.jsonl").write_bytes((end.join(files["open"] + ["tail"])).encode())
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "one.jsonl").write_bytes(b"only a tail")
    assert lines(spark, tmp_path) == sorted([("closed.jsonl", x) for x in files["closed"]] + [("open.jsonl", x) for x in files["open"]])


def test_mixed_ends_and_blank_lines(spark, tmp_path):
    (tmp_path / "mixed.jsonl").write_bytes(b"a\r\n\nb\nc\r\n\r\nd\r")
    assert lines(spark, tmp_path) == [("mixed.jsonl", x) for x in ("", "", "a", "b", "c")]


def test_lines_equal_to_the_open_one_stay(spark, tmp_path):
    (tmp_path / "same.jsonl").write_bytes(b"x\ny\nx\nx")
    (tmp_path / "other.jsonl").write_bytes(b"x\nx\n")
    assert lines(spark, tmp_path) == [("other.jsonl", "x")] * 2 + [("same.jsonl", "x"), ("same.jsonl", "x"), ("same.jsonl", "y")]


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_many_blocks_of_one_file(spark, tmp_path, end):
    """The tail is found by its place in the file, whatever partition reads it; the owner is the first line's."""
    rows = [f"line {i:05d}".encode() for i in range(5000)]
    (tmp_path / "long.jsonl").write_bytes(end.join(rows) + end + b"open")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_event_lines(spark, f"{tmp_path}/*.jsonl")
        assert df.rdd.getNumPartitions() > 5
        assert sorted(r["value"] for r in df.collect()) == [r.decode() for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_owner_of_a_file_with_carriage_returns(spark, tmp_path):
    from peerlens.functions.scalar import user_token
    from pyspark.sql import functions as F

    name = spark.range(1).select(user_token(F.lit("ann"))).first()[0]
    (tmp_path / f"{name}.jsonl").write_bytes(b"ann\r\nbob\r\nann\r\nann")
    events = read_event_lines(spark, f"{tmp_path}/*.jsonl").withColumn("user", F.col("value"))
    assert [r["user"] for r in file_owner_gate(events).collect()] == ["ann", "ann"]
