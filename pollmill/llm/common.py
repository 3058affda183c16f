"""What the operators of this subpackage share: fresh names, Arrow passes over texts, stored intermediate tables."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pollmill.sources.scratch import cut, new_path

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 4 << 20
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Every byte that isn't part of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z becomes a space.
_ALNUM = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))

__all__ = ["STEP_BYTES", "cut", "new_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: bytes | None) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+`; null has none."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """The same words with A-Z lower-cased."""
    return text.translate(_LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return text.translate(_ALNUM).split() if text else []


def steps(texts: list[bytes | None], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of up to `most` bytes, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def over_texts(docs: DataFrame, text: str, out: str, kind: T.StructType, work: Callable[[list[bytes | None]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default all) and the struct `out`, whose fields `work` makes from a step of texts (UTF-8, null as None).

    One Arrow pass over the rows as they are partitioned: no shuffle, and the memory of a step is bounded by STEP_BYTES.
    """
    keep = docs.columns if keep is None else keep
    raw = fresh(docs, "raw")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, kind)])
    kinds = [to_arrow(f.dataType) for f in kind.fields]
    names = kind.names

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in sized(texts):
                part = texts.slice(lo, hi - lo).to_pylist()
                cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(work(part), kinds, strict=True)]
                made = pa.StructArray.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), made], [*keep, out])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").cast("binary").alias(raw)).mapInArrow(run, schema)


def sized(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """steps() over an Arrow column, without making its values first."""
    import pyarrow.compute as pc
    n = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    total, start = np.cumsum(n), 0
    while start < len(n):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        yield start, (start := max(end, start + 1))


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[kind.simpleString()]


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def struct(spec: str) -> T.StructType:
    """A schema from "name kind, ..."; kinds are the keys of _KINDS, with [] after them for arrays. Needs no session, as workers import this too."""
    def kind(k: str) -> T.DataType:
        return T.ArrayType(kind(k[:-2])) if k.endswith("[]") else _KINDS[k]

    return T.StructType([T.StructField(n, kind(k)) for n, k in (f.split() for f in spec.split(","))])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: used more than once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
