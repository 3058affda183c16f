"""Token ids as Parquet list columns in the order of the ids of the documents.

Texts are dealt in ranges of the id and sorted, encoded in the tasks, and written by Spark as Parquet with dictionary-encoded
id lists (delta encoding where a dictionary grows too large), page indexes, and row groups and pages of set size. Metadata
columns stand beside the lists, so a reader that wants lengths or some documents reads those columns and pages only.
A row has its part and its offset in that part; the table of parts (a row a part) gives each part's offset in all ids.

Nulls and empty texts are the end id alone. Rows that share an id lie one after the other in any order (equal rows are the
same either way, rows of one id and several texts are ordered by text); null ids come first. An empty table gives an empty store.
Columns of docs other than the id and the text aren't stored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import new_path, sized

#: Words and pieces that a worker remembers; beyond, it begins anew. Only speed depends on it.
REMEMBERED = 400_000
#: Letters, a digit, or other signs: how the pre-tokenizer of the word vocabulary parts lower-case text.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of other letters, with other spaces or with special tokens go through the whole tokenizer.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-\xAC\xAE-ſ]+")


class Encoder:
    """UTF-8 texts to ids as little-endian 32-bit bytes.

    For tokenizers that drop white space and never look across it (`by_word`), each word is encoded once and remembered.
    With `by_piece` (a normalizer of NFC and lower case and the pre-tokenizer of _PIECES), words are parted the same way first,
    as pieces repeat more often than words. Both give the ids of whole texts; tests hold them against those.
    """

    def __init__(self, path: str, by_word: bool = True, by_piece: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.by_word, self.by_piece = self.tokenizer.model, by_word, by_piece
        # bytes to the signs that byte-level vocabularies use: printable ones stand for themselves, others for 256 and up
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.signs = [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            mapped = p if p.isascii() else "".join([self.signs[b] for b in p.encode()])
            got = self.pieces[p] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        return got

    def learn(self, new: list[bytes]) -> None:
        odd, piece, words = [], self.piece, self.words
        for w in new:
            s = w.decode()
            low = s.lower()
            if not self.by_piece:
                odd.append(w)
            elif low.isalpha() and max(s) <= "ſ":  # most words are letters, and maybe a sign after them
                words[w] = piece(low)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha() and max(s) <= "ſ":
                words[w] = piece(low[:-1]) + piece(low[-1])
            elif _PLAIN.fullmatch(s) and "<|" not in s:
                words[w] = b"".join([piece(p) for p in _PIECES.findall(low)])
            else:
                odd.append(w)
        words.update(zip(odd, self.whole([w.decode() for w in odd])))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_word:
            return self.whole([(t or b"").decode() for t in texts])
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        split = [(t or b"").split() for t in texts]
        self.learn([w for w in set().union(*split) if w not in self.words])
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    """A worker's own, kept between tasks."""
    if args not in _ENCODERS:
        _ENCODERS[args] = Encoder(*args)
    return _ENCODERS[args]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", by_word: bool = True, by_piece: bool = True,
          row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, codec: str = "zstd") -> None:
    """Writes ids/ (part, place, key, offset in the part, n_tokens, ids) and parts/ (part, n_tokens) below path."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = narrow.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext
        part, place, total = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, by_word, by_piece)
        for b in batches:
            for lo, hi in sized(b.column(1), 2 << 20):
                rows = [x + end for x in enc.encode(b.column(1).slice(lo, hi - lo).to_pylist())]
                sizes = np.array([len(x) // 4 for x in rows], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(np.arange(place, place + len(rows))), b.column(0).slice(lo, hi - lo),
                                                  pa.array(total + ends - sizes), pa.array(sizes), ids], ["part", "place", "key", "part_offset", "n_tokens", "ids"])
                place += len(rows)
                total += int(ends[-1]) if len(rows) else 0

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("key", kind), T.StructField("part_offset", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    (dealt.mapInArrow(run, schema).write.option("compression", codec).option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20).parquet(f"{path}/ids"))
    rows = spark.read.parquet(f"{path}/ids")
    rows.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start: ids of all documents before, n_tokens, ids) of a store; a reader that drops ids doesn't read them."""
    rows, parts = spark.read.parquet(f"{path}/ids"), spark.read.parquet(f"{path}/parts")
    # parts has a row per written part, so this window is as small as the list of files
    before = parts.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("key", (F.col("before") + F.col("part_offset")).alias("start"), "n_tokens", "ids")


def with_crc(store: DataFrame, with_ids: bool = False) -> DataFrame:
    """The store's rows and ids_crc32: of the ids as little-endian 32-bit numbers."""
    def run(batches):
        for b in batches:
            ids = b.column(3)
            at, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    names = ["key", "start", "n_tokens", "ids"][: 3 + with_ids]
    kept = range(len(names))
    schema = T.StructType([*(store.schema[c] for c in names), T.StructField("ids_crc32", T.LongType())])
    return store.select("key", "start", "n_tokens", "ids").mapInArrow(run, schema)


def store(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """docs encoded, written to a new folder of the shared folder, and read back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, **options)
    return read(docs.sparkSession, path)
