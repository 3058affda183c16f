"""Row numbers, running sums and lookups over ranges, against plain Python."""

import pytest
from pyspark.sql import functions as F

from pollmill.operators.prefix import row_numbers, running_sums
from pollmill.operators.skew import heavy_keys, lookup


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, (i * 7919) % 101 if i % 3 else 5, "a" if i % 4 else None) for i in range(1000)]
    return spark.createDataFrame(data, "id long, v long, g string").repartition(7)


def test_row_numbers(rows):
    got = row_numbers(rows, [F.col("v").desc(), F.col("id").asc()], "n").collect()
    want = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.n for r in want] == list(range(1, 1001))
    assert row_numbers(rows.limit(0), [F.col("v")], "n").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, rows, descending):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, small as they are
    try:
        values = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
        got = running_sums(values, ["v"], ["n"], ["g"], descending).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [(r.g, r.v, r.n) for r in got]
    for r in got:
        assert r.n_before == sum(n for g, v, n in held if g == r.g and ((v > r.v) if descending else (v < r.v)))
    assert {r.g for r in got} == {None, "a"}


def test_lookup_of_heavy_light_and_null_keys(spark, rows):
    left = rows.withColumn("k", F.when(F.col("v") % 10 != 0, F.col("v")))
    right = spark.createDataFrame([(5, "five"), (7, "seven"), (None, "never")], "k long, name string")
    assert [r.k for r in heavy_keys(left.dropna(subset=["k"]), ["k"], 4).collect()] == [5]
    got = {(r.id, r.k, r.name) for r in lookup(left, right, ["k"], most=4).collect()}
    assert got == {(r.id, r.k, {5: "five", 7: "seven"}.get(r.k)) for r in left.collect()}
    assert lookup(left.limit(0), right, ["k"]).count() == 0
