"""Quality rules with host-level verdicts.

Document rules count words, symbols, repeated lines and repeated word windows inside each row. Their failures are then
summed by host; each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of
moments), and hosts that are far worse than the prior's mean host, or nearly all bad, lose all their documents.

There are two verdicts. The base rules (words, repeated windows) and the hosts' rates of failing them give base_failed and kept. All
rules (with shares of symbols and of repeated lines) and the hosts' rates of failing any give rules_failed and passed, which the
pipeline's stage follows.

Defined cases: null or empty text has no words and fails the word rule. A null host has no host verdict. Repeated rows count
as often as they occur. An empty table gives an empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import SPACE, let, whole_text, words


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected if its shrunk failure rate is above this, whatever the prior.
    max_host_rate: float = 0.8
    #: Symbols for 100 words and repeated lines for 100 lines that are not blank; above either a document fails all rules.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    #: A host is also rejected if its posterior failure rate, less host_sds of its standard deviations, has odds above host_odds
    #: times those of the mean host.
    host_odds: float = 4.0
    host_sds: float = 3.0


def repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal windows side by side, so a position counts if
    a neighbour has its hash; only texts with a repeated window are sorted.
    """
    windows = F.slice(
        F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2))),
        1,
        F.greatest(F.size(tokens) - 2, F.lit(0)),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda x, k: (
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            )),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
        )))))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    )))


def with_counts(docs: DataFrame, text_col: str, rules: Rules) -> DataFrame:
    """docs with a struct column of the counts, whether the base rules fail and whether any rule does."""
    counted = docs.withColumn("__rule", _counts(whole_text(text_col)))
    c = F.col("__rule")
    failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
    symbols = 100 * c["n_symbols"] > rules.max_symbol_percent * c["n_words"]
    lines = 100 * c["n_dup_lines"] > rules.max_dup_line_percent * c["n_lines"]
    return counted.withColumn("__failed", failed).withColumn("__any_failed", failed | symbols | lines)


def _shrunk(hosts: DataFrame, failures: str) -> tuple[Column, float, float]:
    """The shrunk rate of each host, and mean and strength of the prior."""
    rate = F.col(failures) / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = m["mean"] or 0.0, m["var"] or 0.0
    # Moments of a beta distribution; without spread between hosts one pseudo-document stands for the prior.
    strength = max(mean * (1 - mean) / var - 1, 1.0) if var > 0 else 1.0
    return (F.col(failures) + mean * strength) / (F.col("host_docs") + strength), mean, strength


def host_verdicts(judged: DataFrame, host_col: str, rules: Rules) -> DataFrame:
    """For each host: documents, failures of the base rules and of any, the shrunk rates, and whether either verdict rejects it."""
    hosts = materialise(
        judged.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("__host"))
        .agg(
            F.count("*").alias("host_docs"),
            F.sum(F.col("__failed").cast("long")).alias("host_failures"),
            F.sum(F.col("__any_failed").cast("long")).alias("host_any_failures"),
        ),
        "host-rates",
    )

    def judged_by(failures: str) -> tuple[Column, Column]:
        """The shrunk rate, and whether it is too high."""
        rate, mean, strength = _shrunk(hosts, failures)
        least = rate - rules.host_sds * F.sqrt(rate * (1 - rate) / (F.col("host_docs") + strength + 1))
        far = least > rules.host_odds * mean / (1 + (rules.host_odds - 1) * mean)
        return rate, far | (rate > rules.max_host_rate)

    base, any_rule = judged_by("host_failures"), judged_by("host_any_failures")
    return hosts.withColumns({"host_rate": base[0], "host_rejected": base[1], "host_any_rate": any_rule[0], "host_outlier": any_rule[1]})


def _passed() -> Column:
    return ~F.col("__any_failed") & ~F.coalesce("host_outlier", F.lit(False))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row for each document: the counts, both verdicts and the host's shrunk rates."""
    judged = materialise(
        with_counts(docs.select(F.col(id_col), F.col(text_col), F.col(host_col)), text_col, rules).select(
            F.col(id_col), F.col(host_col).alias("host"), "__rule.*", "__failed", "__any_failed"
        ),
        "rule-counts",
    )
    hosts = host_verdicts(judged, "host", rules)
    joined = judged.join(hosts, judged["host"] == hosts["__host"], "left")
    return joined.select(
        judged[id_col], "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        F.col("__failed").alias("base_failed"),
        (~F.col("__failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        F.col("__any_failed").alias("rules_failed"), _passed().alias("passed"),
        judged["host"], "host_docs", "host_failures", "host_rate", "host_any_failures", "host_any_rate", "host_outlier",
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass all rules, with docs' columns."""
    judged = materialise(with_counts(docs, text_col, rules).drop("__rule"), "rule-flags")
    hosts = host_verdicts(judged, host_col, rules).select("__host", "host_outlier")
    joined = judged.join(hosts, judged[host_col] == hosts["__host"], "left")
    return joined.where(_passed()).select(*(judged[c] for c in docs.columns))
