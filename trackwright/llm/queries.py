"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from ..session import scratch, table
from . import byte_cnn
from .align import alignment
from .bpe import bpe_encode
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .minhash import MinHash, near_duplicates
from .mixing import mix
from .packing import pack
from .quality_rules import quality_rules
from .repair import damage, repair_report
from .token_store import read_tokens, with_checksum, write_tokens
from .url_filter import url_filter
from .warc import read_archive, write_archive


def tokenizers():
    """The installed vocabulary files; operators take paths, only the queries name these."""
    import public_tokenizers

    return public_tokenizers


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizers().path("byte_bpe_50k.tiktoken"), tokenizers().PATTERN
    both = bpe_encode(table(spark, sf_dir, "documents"), ranks, pattern, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, payloads = write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return read_archive(records, payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of op4_url_filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path names the document it shows; a url is bad (1) if that document's quality label is 0."""
    named = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)")
    pages = table(spark, sf_dir, "pages").select("url", named.alias("doc_id"))
    return pages.join(table(spark, sf_dir, "labels"), "doc_id").select("url", (1 - F.col("quality")).alias("label"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules, labelled_urls(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: Domains of the labelled table, and their tokens as shares of all tokens in op6_mixing.
MIX_TARGETS = {"good": 0.9, "poor": 0.05, "toxic": 0.05}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), MIX_TARGETS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), p=MinHash(words=2, percent=80))


def held_out() -> Column:
    """Rows whose labels are for testing only."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = byte_cnn.fit(docs, labels.where(~held_out()))
    scored = byte_cnn.score(docs, net)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizers().path("word_bpe_49k.json"), end_id=1)
    return with_checksum(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


#: Tokens of a sequence in op11_packing.
SEQUENCE = 4096


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizers().path("word_bpe_49k.json"), SEQUENCE, end_id=1).drop("ids")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damage(conversations))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), tokenizers().path("byte_bpe_50k.json"), tokenizers().path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_warc, op4_url_filter, op5_exact_dedup, op6_mixing, op7_quality_rules, op8_minhash, op9_byte_cnn, op10_token_store, op11_packing, op12_repair, op13_alignment)
}
