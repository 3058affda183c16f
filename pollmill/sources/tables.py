"""CSV and Parquet tables in and out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import parsed_columns, to_float


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV with a fixed all-string schema: no inference pass over the data."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


def numeric_columns(df: DataFrame, wanted: list[str], keep: list[str] = ()) -> DataFrame:
    """Typed projection of text columns; a column the table lacks becomes all missing."""
    have = set(df.columns)
    held = [c for c in wanted if c in have]
    rows = parsed_columns(df, held, to_float, keep) if held else df.select(*keep)
    kept = [F.col(f"`{c}`") for c in rows.columns[: len(rows.columns) - len(held)]]
    return rows.select(*kept, *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in wanted])


def scan_survey_csv(spark: SparkSession, path: str, file_columns: list[str], wanted: list[str],
                    id_col: str = "respondent_id") -> DataFrame:
    return numeric_columns(read_text_csv(spark, path, file_columns), wanted,
                           [F.col(id_col).try_cast("double").cast("bigint").alias(id_col)])


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def positional_rename(df: DataFrame, codes: list[str], extras: list[str] = ()) -> DataFrame:
    """Use the code names where the table has them, else name the first columns by position."""
    if any(c in df.columns for c in codes):
        return df
    if len(df.columns) < len(codes):
        raise ValueError(f"{len(df.columns)} columns cannot be mapped to {len(codes)} codes by position")
    carried = [e for e in extras if e in df.columns]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, codes)], *carried)


def with_respondent_id(df: DataFrame, order_col: str, id_col: str = "respondent_id") -> DataFrame:
    """Respondent ids are explicit data, never the position of a row in a DataFrame."""
    return df.withColumn(id_col, F.col(order_col).cast("bigint"))


# One name per way of treating outputs that already exist.
WRITE_MODES = {"skip": "ignore", "fail": "errorifexists", "replace": "overwrite"}


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "skip") -> None:
    writer = df.write.mode(WRITE_MODES[mode])
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    writer.format(fmt).save(path)


_MANIFEST = "version string, committed_at timestamp, n_tables int, table string, folder string, n_rows bigint, n_columns int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The committed tables of every version published under path; nothing yet: no rows."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def publish_snapshot(tables: dict[str, DataFrame], required: list[str], path: str, version: str, fmt: str = "parquet", mode: str = "skip") -> dict[str, str]:
    """Publish the required tables as one version: {table: folder}.

    Tables go to a folder of their own; a version exists once its manifest rows, one file written last, are committed. A write that dies
    before leaves readers with what was there. ``mode`` says what happens to a version that exists: kept, refused or superseded.
    """
    missing = [t for t in required if t not in tables]
    if missing:
        raise ValueError(f"missing result tables: {missing}")
    spark = tables[required[0]].sparkSession
    held = {r["table"]: r["folder"] for r in _complete(manifest(spark, path)).where(F.col("version") == version).collect()}
    if held and mode == "skip":
        return held
    if held and mode == "fail":
        raise FileExistsError(f"version {version} is published already")
    own = f"{path}/tables/{version}-{uuid.uuid4().hex}"
    rows = []
    for name in required:
        sink_table(tables[name], f"{own}/{name}", fmt, "fail")
        written = spark.read.format(fmt).schema(tables[name].schema).load(f"{own}/{name}", header=True)
        rows.append((version, len(required), name, f"{own}/{name}", written.count(), len(written.columns)))
    line = spark.createDataFrame(rows, "version string, n_tables int, table string, folder string, n_rows bigint, n_columns int").withColumn("committed_at", F.current_timestamp())
    line.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return {r[2]: r[3] for r in rows}


def _complete(rows: DataFrame) -> DataFrame:
    """The newest commit of each version, if all its tables are named."""
    newest = rows.groupBy("version").agg(F.max("committed_at").alias("committed_at"))
    mine = rows.join(newest, ["version", "committed_at"])
    whole = mine.groupBy("version").agg(F.count_distinct("table").alias("_n"), F.max("n_tables").alias("_all")).where("_n = _all").select("version")
    return mine.join(whole, "version", "left_semi")


def read_snapshot(spark: SparkSession, path: str, version: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """{table: DataFrame} of a version, of the last one committed by default: all of its tables, or an error."""
    rows = _complete(manifest(spark, path))
    rows = rows.where(F.col("version") == version) if version else rows.where(F.col("committed_at") == rows.agg(F.max("committed_at")).scalar())
    found = rows.collect()  # a row a table
    if not found:
        raise FileNotFoundError(f"no complete version {version or ''} under {path}")
    return {r["table"]: spark.read.format(fmt).load(r["folder"], header=True) for r in found}


def metrics_table(row: DataFrame, group: list[str] = ()) -> DataFrame:
    """One-row aggregate -> (metric, value) rows."""
    names = [c for c in row.columns if c not in group]
    return row.select(*group, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(group), names, "metric", "value")


def run_metrics(steps: dict[str, DataFrame]) -> DataFrame:
    """(step, metric, value) of a run: the metric rows of every step and step_done, which is 0 for a step that gave none."""
    out = None
    for name, rows in steps.items():
        kept = rows.select(F.lit(name).alias("step"), "metric", "value")
        done = rows.agg((F.count(F.lit(1)) > 0).cast("double").alias("value")).select(F.lit(name).alias("step"), F.lit("step_done").alias("metric"), "value")
        part = kept.unionByName(done)
        out = part if out is None else out.unionByName(part)
    return out
