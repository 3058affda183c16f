"""Shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="pollmill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_KEPT: dict[tuple, tuple[str, object]] = {}


def once(spark: SparkSession, name: str, source: DataFrame, make) -> DataFrame:
    """make()'s result, written to the shared folder the first time and read from there by all later uses in this application.

    Known by its name and the files of ``source``; ``forget`` drops what is known, for sources rewritten under the same names.
    """
    key = (spark.sparkContext.applicationId, name, tuple(sorted(source.inputFiles())))
    if key not in _KEPT:
        made, path = make(), new_path(spark, name)
        made.write.parquet(path)
        _KEPT[key] = (path, made.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def forget() -> None:
    _KEPT.clear()


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage in reliable storage; survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Cut, and use every core when a small input arrived in fewer partitions than there are cores."""
    out = cut(df)
    cores = out.sparkSession.sparkContext.defaultParallelism
    return out if out.rdd.getNumPartitions() >= cores else cut(out.repartition(cores, key))
