"""From raw documents to token ids: each stage applies one operator to all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents.

Defined cases, as the operators have them: null and empty texts have no words and go in the first stage, texts of any length are
read whole, a null id comes after all others, of equal texts the longest original with the smallest id stays, rows that repeat
id and text go or stay together, an empty table gives an empty result, and further columns of documents come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwright.llm import exact_dedup, minhash, mixing, quality_rules
from trackwright.llm.bpe import bpe_encode
from trackwright.llm.queries import labelled_domains, tokenizers
from trackwright.session import passing_scratch, scratch, table, written

#: Weights of the domains' tokens in the mixture. All tokens of good documents stay, and the others thin out to their weights.
WEIGHTS = {"good": 0.98, "poor": 0.01, "toxic": 0.01}
MIXING = mixing.Settings(max_rate=1.0, anchor="good")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_each(docs, p=minhash.MinHash(words=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mixture(docs, labelled_domains(spark, sf_dir), WEIGHTS, settings=MIXING)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and whether decoding them gives the text again."""
    ranks, pattern = tokenizers().path("byte_bpe_50k.tiktoken"), tokenizers().PATTERN
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    both = bpe_encode(texts.select(F.struct("doc_id", "text_sha256").alias("key"), "text"), ranks, pattern, id_col="key", decode=True)
    exact = F.sha2("decoded", 256) == F.col("key.text_sha256")
    return both.select("key.doc_id", "n_tokens", "ids", exact.alias("exact"))


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("byte-level bpe", tokens),
]

#: The mixing stage fits a model and the last stage encodes; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with passing_scratch(spark):  # a stage's own tables go once its result is written
            docs = written(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
