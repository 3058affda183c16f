"""Published versions: all tables or none, whatever dies on the way."""

import pytest

from pollmill.sources import tables as T


def test_versions_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "out")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    with pytest.raises(FileNotFoundError):
        T.read_snapshot(spark, path)
    with pytest.raises(ValueError):
        T.publish_snapshot({"x": one}, ["x", "y"], path, "v1")
    T.publish_snapshot({"x": one, "y": two}, ["x", "y"], path, "v1")
    broken = spark.range(4).selectExpr("raise_error('killed') AS b")
    with pytest.raises(Exception):
        T.publish_snapshot({"x": two.toDF("a"), "y": broken}, ["x", "y"], path, "v2")
    got = T.read_snapshot(spark, path)  # x of v2 is on disk, but v2 was never committed
    assert {n: d.count() for n, d in got.items()} == {"x": 3, "y": 5}
    with pytest.raises(FileNotFoundError):
        T.read_snapshot(spark, path, "v2")


def test_modes_of_an_existing_version(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 5):
        T.publish_snapshot({"x": spark.range(n)}, ["x"], path, "v1", mode="skip")
    assert T.read_snapshot(spark, path, "v1")["x"].count() == 3
    with pytest.raises(FileExistsError):
        T.publish_snapshot({"x": spark.range(5)}, ["x"], path, "v1", mode="fail")
    T.publish_snapshot({"x": spark.range(5)}, ["x"], path, "v1", mode="replace")
    assert T.read_snapshot(spark, path, "v1")["x"].count() == 5
