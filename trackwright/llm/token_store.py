"""Token ids of a corpus in Parquet list columns.

Layout: one row for each document in ascending id order over numbered shards: id, shard, row (place in the shard), start_in_shard
(ids before it in the shard), n_tokens, ids (list of int). Row groups and pages have set sizes, ids are delta-encoded (or
dictionary-encoded), and Spark's writer adds page indexes; so a read of a few ids or of the metadata alone skips the pages
of tokens it does not need.

Defined cases: null text counts as empty, and its document holds the end id alone. Null ids come first. Rows with equal ids are
ordered by a hash of their text. An empty table gives an empty store. Columns other than the named ones are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import Cache, encode_texts, is_plain, slices, without_space

#: Bytes of a row group and of a page, rows of a page: small enough that a selective read skips most of a file.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2000
#: Entries of the cache in a Python worker; the library takes long for a new unit. And bytes of text encoded at once: a slice's different
#: units are looked up once, so of more text more come again.
CACHED, AT_ONCE = 400_000, 4_000_000


class WordEncoder:
    """The tokenizers library by way of a cache of units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold an added token go to the library whole: it takes such a token as one, wherever it stands.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = Cache(self._library, CACHED)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_plain(self, text: str) -> bool:
        return is_plain(text) and not ("<" in text and any(a in text.lower() for a in self.added))

    def encode(self, texts: list[str]) -> list[bytes]:
        # The tokenizer lower-cases; doing so first makes fewer units. In Latin-1 this is the same letter by letter.
        return encode_texts(texts, lambda plain: without_space(pc.utf8_lower(plain)), self.units, self._library, self._is_plain)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", encoding: str = "delta"
) -> None:
    """Encode all of docs and write the store to path. encoding: "delta" or "dictionary"."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding}")
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField("start_in_shard", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, start = encoder(tokenizer_file), 0, 0
        for part in slices(batches, "text", AT_ONCE):
            ids = [x + end for x in own.encode([t or "" for t in part.column("text").to_pylist()])]
            count = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(count)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("shard"), pa.array(row + np.arange(len(ids))), pa.array(start + ends - count), pa.array(count), lists],
                schema.names,
            )
            row, start = row + len(ids), start + int(ends[-1])

    # The texts are dealt before they are encoded, so that finding the ranges doesn't encode them twice.
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", F.xxhash64("text"))
        .withColumn("shard", F.spark_partition_id())
    )
    ordered.mapInArrow(run, schema).write.options(**{
        "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd",
    }).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store with start, the ids of all documents before each."""
    store = spark.read.parquet(path)
    # One row for each shard: their sums in order are the shards' starts.
    shards = store.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    # There are as many shards as shuffle partitions at most, which bounds the broadcast.
    return store.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("start_in_shard")).drop("shard_start")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    picked = tokens.select("id", "start", "n_tokens", "ids")
    schema = T.StructType([*picked.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values, at = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], schema.names)

    return picked.mapInArrow(run, schema)
