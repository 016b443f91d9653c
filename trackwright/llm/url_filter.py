"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

A rule fits its host and all subdomains if the url's path starts with the rule's path; of several the longest decides, of equally
long ones the one later in the alphabet, and of one rule with both verdicts "block". Urls without a rule are judged by trees (Spark
ML) that are trained on labelled urls. One feature is the rate of bad urls below the same suffix; a labelled url's own rate comes
from the other folds only, so that the trees do not see its label in it.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by its features like any
other. Urls may repeat. Without labelled urls of both classes no model is trained, and such urls are allowed. An empty table
gives an empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Trees:
    #: The model is fitted to about this many labelled urls at most, picked by hash.
    max_rows: int = 20_000
    trees: int = 12
    depth: int = 4
    #: A url is blocked if its probability is this or more.
    threshold: float = 0.5
    #: A suffix's rate of bad urls counts as if this many urls of the overall rate were added.
    prior: float = 20.0
    #: Parts of the labelled urls for the suffix rates of the training rows.
    folds: int = 5
    seed: int = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    full = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, F.substring(full, at + 3, F.length(full))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def _entropy(text: Column) -> Column:
    def of(t: Column) -> Column:
        chars = F.array_distinct(F.array_remove(F.split(t, ""), ""))
        shares = F.transform(chars, lambda c: (F.length(t) - F.length(F.replace(t, c))) / F.length(t))
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(text, of)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with suffix and the lexical features."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return urls.withColumns({
        "suffix": F.substring_index(host, ".", -2),
        "f_length": F.length(url).cast("double"), "f_host_length": F.length(host).cast("double"), "f_path_length": F.length(path).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"), "f_depth": _count(path, "/").cast("double"),
        "f_digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "f_hyphens": _count(host, "-").cast("double"),
        "f_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0), "f_query_length": F.length(query).cast("double"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("double"), "f_host_entropy": _entropy(host), "f_path_entropy": _entropy(path),
    })


def _vectors(rated: DataFrame) -> DataFrame:
    names = sorted(c for c in rated.columns if c.startswith("f_"))
    return VectorAssembler(inputCols=names, outputCol="features").transform(rated)


class UrlModel:
    """Suffix statistics and trees fitted to labelled urls (url string, label int: 1 is bad)."""

    def __init__(self, labelled: DataFrame, settings: Trees = Trees()):
        self.settings, self.model, self.rate = settings, None, 0.0
        host, path = split_url(F.col("url"))
        rows = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).where("label is not null")
        self.rows = materialise(lexical(rows), "labelled-urls")
        n, bad = self.rows.agg(F.count("*"), F.sum("label")).first()
        if not n or not 0 < bad < n:
            return
        self.rate = bad / n
        folded = self.rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(settings.seed + 1)), F.lit(settings.folds)))
        in_fold = materialise(folded.groupBy("suffix", "fold").agg(F.sum("label").alias("fold_bad"), F.count("*").alias("fold_n")), "suffix-folds")
        sums = in_fold.groupBy("suffix").agg(F.sum("fold_bad").alias("bad"), F.sum("fold_n").alias("n"))
        self.suffixes = materialise(sums.select("suffix", "bad", "n", self._shrunk(F.col("bad"), F.col("n")).alias("f_suffix_rate")), "suffix-rates")
        share = min(1.0, settings.max_rows / n)
        picked = folded.where(F.pmod(F.xxhash64("url", F.lit(settings.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        others = picked.join(in_fold, ["suffix", "fold"]).join(self.suffixes.select("suffix", "bad", "n"), "suffix")
        others = others.withColumn("f_suffix_rate", self._shrunk(F.col("bad") - F.col("fold_bad"), F.col("n") - F.col("fold_n")))
        self.model = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, seed=settings.seed, cacheNodeIds=False).fit(_vectors(others))

    def _shrunk(self, bad: Column, n: Column) -> Column:
        return (bad + self.settings.prior * self.rate) / (n + self.settings.prior)

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (url, host, path and others) with score, the probability that the url is bad."""
        if self.model is None:
            return urls.withColumn("score", F.lit(self.rate))
        rated = lexical(urls).join(self.suffixes.select("suffix", "f_suffix_rate"), "suffix", "left").fillna({"f_suffix_rate": self.rate})
        scored = self.model.transform(_vectors(rated))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and others) with rule and rule_verdict of the longest rule (host, path, verdict) that fits, or nulls.

    Each host's suffixes meet the rules once, so the join has one row for each host and rule, not for each url.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    named = rules.select(
        F.col("host").alias("suffix"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), F.col("path").alias("start"), F.col("verdict").alias("verdict")
        ).alias("r"),
    )
    # Written before it is joined: of a plain join Spark splits a host that many urls share.
    by_host = materialise(hosts.join(named, "suffix").groupBy("host").agg(F.collect_set("r").alias("rules")), "host-rules")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])))
    joined = urls.join(by_host, "host", "left").withColumn("best", best)
    return joined.select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", settings: Trees = Trees()) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, score."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    model = UrlModel(labelled, settings)
    judged = match_rules(model.score(urls), rules)
    own = F.when(F.col("score") >= settings.threshold, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
