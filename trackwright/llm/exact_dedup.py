"""Exact deduplication over an extendible-hash index on shared files.

1. Entries (64-bit hash, SHA-256, length, id) of all documents are written to the shared folder.
2. The hash space is cut into buckets by extendible hashing: a bucket with more distinct keys than its capacity splits, which
   doubles the directory where needed.
3. The directory deals every text to the owner task of its bucket. An owner holds its buckets' keys in order. Texts of one hash
   chain behind it: they are compared byte by byte, each different text is one link of the chain, and a link knows the row that
   stays and how many rows it has. The owners' links are the index, which is written to the shared folder in turn.
4. Every entry takes its verdict from its link.

A text that many rows share is dealt once, not once for each row: the hashes with most rows are known from the entries, and rows
of those hashes are grouped by text, in part before they are dealt.

Texts are equal when they are the same without ASCII white space. Of equal texts, the row with the most code points, then
the smallest id stays. Defined cases: null text counts as empty, and all empty texts are equal. A null id comes after all
others. Rows that repeat id and text are one document in two rows: both have the same verdict. An empty table gives an empty
result. Columns other than the named ones are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import squeezed, whole_text

#: Distinct keys in a bucket before it splits, and the bits of a hash that the directory may use; a bucket that is too full
#: at that depth keeps its keys. The directory has at most 2 ** MAX_DEPTH rows, which bounds its broadcast.
CAPACITY, MAX_DEPTH = 128, 20
#: A hash is hot if it has more than one in so many of all rows, and HOT_ROWS at least. That bounds the number of hot hashes,
#: which are broadcast.
HOT_SHARE, HOT_ROWS = 100_000, 64


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h64", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The directory after all doublings: slot, bucket, local_depth, n_keys; global_depth is the same in all rows.

    A bucket of depth d is there if it fits, or can't be split further, and the bucket it was split from did not fit. One
    histogram by the finest prefix has all counts that the splits need.
    """
    finest = keys.select("h64").distinct().groupBy(_prefix(max_depth).alias("p")).agg(F.count("*").alias("n"))
    by_depth = (
        finest.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("local_depth"))
        .groupBy("local_depth", F.expr(f"shiftright(p, {max_depth} - local_depth)").alias("bucket"))
        .agg(F.sum("n").alias("n_keys"))
        .where((F.col("n_keys") <= capacity) | (F.col("local_depth") == max_depth))
    )
    parents = (
        finest.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("d"))
        .groupBy((F.col("d") + 1).alias("local_depth"), F.expr(f"shiftright(p, {max_depth} - d)").alias("parent"))
        .agg(F.sum("n").alias("parent_keys"))
        .where(F.col("parent_keys") > capacity)
    )
    split = by_depth.withColumn("parent", F.shiftright("bucket", 1)).join(parents, ["local_depth", "parent"], "left_semi").drop("parent")
    buckets = materialise(split.unionByName(by_depth.where("local_depth = 0")), "buckets")
    depth = buckets.agg(F.max("local_depth")).first()[0] or 0
    spread = F.expr(f"sequence(shiftleft(bucket, {depth} - local_depth), shiftleft(bucket + 1, {depth} - local_depth) - 1)")
    return buckets.select(F.explode(spread).alias("slot"), "bucket", "local_depth", "n_keys", F.lit(depth).alias("global_depth"))


def _best() -> Column:
    """Of rows with one text: the most code points, then the smallest id; null ids come last."""
    return F.min(F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("best")


def build_index(entries: DataFrame, texts: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The owners' links on shared files: slot range (bucket, local_depth), h64, link (place in the chain), sha, keep_id, group_size.

    texts: id, n_points, norm, h64 of every row; entries: the same without the text.
    """
    keys = materialise(entries.groupBy("h64").agg(F.count("*").alias("n_rows")), "keys")
    directory = materialise(build_directory(keys, capacity, max_depth), "directory")
    depth = (directory.select("global_depth").first() or [0])[0]
    rows = keys.agg(F.sum("n_rows")).first()[0] or 0
    hot = materialise(keys.where(F.col("n_rows") > max(HOT_ROWS, rows // HOT_SHARE)).select("h64"), "hot-keys")

    one = lambda df: df.withColumn("n", F.lit(1).cast("long"))
    dealt = one(texts.select("id", "n_points", "norm", "h64"))
    if not hot.isEmpty():
        grouped = (
            texts.join(F.broadcast(hot), "h64", "left_semi").groupBy("h64", "norm", "n_points").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        )
        dealt = dealt.join(F.broadcast(hot), "h64", "left_anti").unionByName(grouped)
    owned = (
        dealt.withColumn("slot", _prefix(depth))
        .join(F.broadcast(directory.select("slot", "bucket", "local_depth")), "slot")
        .repartition("bucket", "local_depth")
    )
    links = owned.groupBy("bucket", "local_depth", "h64", "norm").agg(_best(), F.sum("n").alias("group_size"))
    links = links.select("bucket", "local_depth", "h64", F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep_id"), "group_size")
    chain = Window.partitionBy("bucket", "local_depth", "h64").orderBy("sha")
    return materialise(links.withColumn("link", F.row_number().over(chain)), "index")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    original = whole_text(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.length(original).cast("long").alias("n_points"), squeezed(original).alias("norm"))
    texts = texts.withColumn("h64", F.xxhash64("norm"))
    entries = materialise(texts.select("id", "n_points", "h64", F.sha2("norm", 256).alias("sha")), "entries")
    index = build_index(entries, texts, capacity, max_depth)
    # Links of one row have nothing to tell: that row stays.
    shared = index.where("group_size > 1").select("h64", "sha", "keep_id", "group_size")
    joined = entries.join(shared, ["h64", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The rows of docs that stay, with docs' columns. A row goes by its id and text: others of its id, or without one, stay."""
    verdicts = exact_dedup(docs, id_col, text_col, **settings).where(~F.col("kept"))
    dropped = verdicts.select(F.col(id_col).alias("__dropped"), F.col("text_sha256").alias("__dropped_sha"))
    keyed = docs.withColumn("__sha", F.sha2(squeezed(whole_text(text_col)), 256))
    same = keyed[id_col].eqNullSafe(F.col("__dropped")) & (F.col("__sha") == F.col("__dropped_sha"))
    return keyed.join(dropped, same, "left_anti").drop("__sha")
