"""Mixing to target weights with soft membership.

A classifier trained on a labelled table predicts for every document how likely it is of each domain: softmax regression on the
square roots of the shares of hashed byte 4-grams. Non-negative document rates are then fitted by projected gradient, so that the
expected tokens of each domain (rate times tokens times probability, summed over all documents) come as near to the targets as
least squares can. A rate is the projection of 1 less the document's probabilities times the steps' sum onto the allowed range; a
step is the gradient scaled by the inverse Gram matrix of the documents inside the range, so rare domains move as fast as common
ones. Every step is one pass of Spark tasks over the table of probabilities; only sums over domains reach the driver, and a
document's rate follows from one number for each domain, so lost tasks are simply run again. Of all rates that are equally near to
the targets, those nearest to 1 (weighted by tokens) are taken. Domains whose target can't be met are logged.

The classifier is fitted on the driver to at most max_rows labelled documents (smallest hashes of their ids first).

Defined cases: null text counts as empty: no tokens, and the labels' overall shares as probabilities. A document without tokens
keeps rate 1. Copies are drawn by id and text, and of rows that repeat both, null ids among them, for each row by itself. A labelled id
with two domains counts for the smallest. Repeated rows count as often as they occur. Without labels all domains are equally likely. An empty table gives an
empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .minhash import _IS_SPACE
from .units import slices


@dataclass(frozen=True)
class Settings:
    max_rows: int = 3000
    buckets: int = 4096
    epochs: int = 150
    #: Gradient steps end when no part of the gradient is above this share of its domain's target, or after max_steps (which is
    #: logged).
    tolerance: float = 1e-4
    max_steps: int = 60
    #: The largest rate, or None.
    max_rate: float | None = None
    #: With an anchor, targets are weights: the anchor's tokens all stay, and other domains get what their weights beside its say,
    #: or all that they have. Such targets are in reach without rates above 1.
    anchor: str | None = None
    seed: int = 9


def _grams(text: bytes, buckets: int) -> np.ndarray:
    """Square roots of the shares of the hashed 4-grams of the whole text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(buckets, np.float32)
    code = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    slot = (code * np.uint32(2654435761)) >> np.uint32(8)
    return np.sqrt(np.bincount(slot % buckets, minlength=buckets) / len(code)).astype(np.float32)


def _tokens(text: bytes) -> int:
    inside = ~_IS_SPACE[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (len(inside) and inside[0]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, s: Settings) -> np.ndarray:
    """(buckets + 1) x domains weights, the last row being the offsets. labelled has id and domain."""
    ids = (
        labelled.where(F.col("domain").isin(*domains) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("__id"), "__id").limit(s.max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = [_grams(t or b"", s.buckets).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("domain"), pa.array(x, pa.binary())], ["domain", "x"])

    # max_rows bounds the broadcast, and with buckets also what the driver gets.
    texts = docs.join(F.broadcast(ids), docs[id_col] == ids["__id"]).dropDuplicates(["__id"]).select("domain", F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(run, "domain string, x binary").toArrow()
    weights = np.zeros((s.buckets + 1, len(domains)), np.float32)
    if not rows.num_rows:
        return weights
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, s.buckets)
    y = np.zeros((len(x), len(domains)), np.float32)
    y[np.arange(len(x)), [domains.index(d) for d in rows.column("domain").to_pylist()]] = 1
    order = np.lexsort((y.argmax(axis=1), x @ np.arange(s.buckets, dtype=np.float32)))
    x, y = x[order], y[order]
    share = np.clip(y.mean(axis=0), 1e-3, 1)
    weights[-1] = np.log(share / share.sum())
    mean = x.mean(axis=0)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, s.epochs + 1):
        error = (_softmax((x - mean) @ weights[:-1] + weights[-1]) - y) / len(x)
        g = np.concatenate([x.T @ error - np.outer(mean, error.sum(axis=0)) + 1e-6 * weights[:-1], error.sum(axis=0, keepdims=True)])
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        weights -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights[-1] -= mean @ weights[:-1]
    return weights


def posteriors(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, extra: list[Column] | None = None) -> DataFrame:
    """id, text_hash, n_tokens and p (a probability for each domain) of every row."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("p", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            z = np.stack([_grams(t, len(weights) - 1) for t in texts]) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_hash"), pa.array([_tokens(t) for t in texts], pa.int64()), pa.array(_softmax(z.astype(np.float64)).tolist(), pa.list_(pa.float64()))],
                schema.names,
            )

    return docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


#: Weight of the rates' distance from 1 beside the targets; lengths of a step that one pass tries.
_NEAR, _LENGTHS = 1e-8, 4.0 ** -np.arange(15)
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Fit:
    """The projected-gradient steps: a document's rate follows from its probabilities and the sum of the steps.

    residual: what the domains' shares are above the targets in the end.
    """

    steps: np.ndarray
    max_rate: float | None
    residual: np.ndarray
    converged: bool = True

    def rates(self, p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens > 0, np.clip(1 - p @ self.steps, 0, self.max_rate), 1.0)


def _p_and_tokens(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("p").flatten()).reshape(-1, k), np.asarray(batch.column("n_tokens"))


def fit_rates(table: DataFrame, targets: np.ndarray, s: Settings) -> Fit:
    """Least squares over all rows of table (n_tokens, p), with a very small weight on rates other than 1. targets: shares of all tokens.

    With rates clip(1 - p . x), x minimises a convex function of one number for each domain, whose gradient is x times the weight
    less the domains' residuals. A pass tries all lengths of a step at once; the one with the least value is taken.
    """
    k = len(targets)

    def sums(tried: np.ndarray) -> np.ndarray:
        """For each of tried: tokens, the function's sum, tokens of each domain and the Gram matrix of rates inside the range."""
        width = 2 + k + k * k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tried), width))
            for batch in batches:
                p, t = _p_and_tokens(batch, k)
                for row, x in zip(total, tried, strict=True):
                    pull = p @ x
                    rate = np.clip(1 - pull, 0, s.max_rate)
                    inside = t * ((rate > 0) & (rate < (np.inf if s.max_rate is None else s.max_rate)))
                    row[0] += t.sum()
                    row[1] += t @ ((rate - 1) ** 2 / 2 + pull * rate)
                    row[2 : 2 + k] += (rate * t) @ p
                    row[2 + k :] += ((p * inside[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

        rows = table.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(tried) * width)
        for r in rows:
            out[r["i"]] = r["v"]
        return out.reshape(len(tried), width)

    x = np.zeros(k)
    found = sums(x[None])[0]
    tokens = found[0]
    if not tokens:
        return Fit(x, s.max_rate, np.zeros(k))
    if s.max_rate is not None and s.max_rate <= 1:
        found[2 + k :] = sums(np.full((1, k), 1e-9))[0, 2 + k :]  # all rates start at the limit: look just inside
    scale = np.maximum(np.abs(targets), 1e-6)
    value = lambda at, row: -row[1] / tokens + at @ targets + _NEAR / 2 * at @ at
    converged = False
    for _ in range(s.max_steps):
        residual = found[2 : 2 + k] / tokens - targets
        down = residual - _NEAR * x
        if (np.abs(down) <= s.tolerance * scale).all():
            converged = True
            break
        gram = found[2 + k :].reshape(k, k) / tokens + _NEAR * np.eye(k)
        tried = x + _LENGTHS[:, None] * np.linalg.solve(gram, down)
        passed = sums(tried)
        values = [value(at, row) for at, row in zip(tried, passed, strict=True)]
        best = int(np.argmin(values))
        x, found = tried[best], passed[best]
    residual = found[2 : 2 + k] / tokens - targets
    if not converged:
        _log.warning("rates are not at their optimum after %d steps: gradient %s", s.max_steps, (residual - _NEAR * x).tolist())
    if (np.abs(residual) > 0.01 * scale).any():
        _log.warning("targets %s are missed by %s: no allowed rates come nearer", targets.tolist(), residual.tolist())
    return Fit(x, s.max_rate, residual, converged)


def anchored(table: DataFrame, weights: dict[str, float], anchor: str) -> dict[str, float]:
    """Targets, as shares of all tokens, that keep the anchor's tokens and stand to them as the weights do, within what there is."""
    domains = sorted(weights)
    sums = table.agg(F.sum("n_tokens").alias("all"), *(F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"d{i}") for i in range(len(domains)))).first()
    present = {d: (sums[f"d{i}"] or 0.0) / (sums["all"] or 1) for i, d in enumerate(domains)}
    return {d: min(present[d], present[anchor] * weights[d] / weights[anchor]) for d in domains}


def with_rates(table: DataFrame, fit: Fit, k: int) -> DataFrame:
    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, t = _p_and_tokens(b, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fit.rates(p, t))], schema.names)

    return table.mapInArrow(run, schema)


def copies(rate: Column, seed: int, *key: Column) -> Column:
    """Whole copies of a row: the rate's whole part, and one more with the chance of the rest, drawn by hash of key."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str, text_col: str, settings: Settings
) -> tuple[DataFrame, list[str]]:
    """id, text_hash, n_tokens, p and rate of every row, and the domains in p's order."""
    domains = sorted(targets)
    weights = fit_domains(docs, labelled, domains, id_col, text_col, settings)
    table = materialise(posteriors(docs, weights, id_col, text_col), "posteriors")
    if settings.anchor is not None:
        targets = anchored(table, targets, settings.anchor)
    fit = fit_rates(table, np.array([targets[d] for d in domains]), settings)
    return with_rates(table, fit, len(domains)), domains


def _with_copies(rows: DataFrame, like: DataFrame, seed: int) -> DataFrame:
    """rows (id, text_hash, row: a number of its own, and rate if like has none) with copies. like: id, text_hash and rate of all rows.

    Rows that repeat id and text draw by their own numbers too, others by id and text alone, so wherever they lie.
    """
    groups = like.groupBy(F.col("id").alias("__i"), F.col("text_hash").alias("__h")).agg(F.first("rate").alias("__rate"), F.count("*").alias("__n"))
    joined = rows.join(groups, F.col("id").eqNullSafe(F.col("__i")) & (F.col("text_hash") == F.col("__h")))
    own = F.when(F.col("__n") > 1, F.col("row"))
    return joined.withColumn("copies", copies(F.col("__rate"), seed, F.col("id"), F.col("text_hash"), own)).drop("__i", "__h", "__n", "__rate")


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row for each document: id, n_tokens, a probability p_<domain> for each domain, rate, copies.

    labelled: id and domain of some documents. targets: each domain's tokens as a share of all tokens now in docs, or weights if
    settings name an anchor.
    """
    rated, domains = _rated(docs, labelled, targets, id_col, text_col, settings)
    named = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    drawn = _with_copies(rated.withColumn("row", F.monotonically_increasing_id()), rated, settings.seed)
    return drawn.select(F.col("id").alias(id_col), "n_tokens", *named, "rate", "copies")


def take_mixture(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """docs' rows, each as often as it draws by its rate."""
    rated, _ = _rated(docs, labelled, targets, id_col, text_col, settings)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    taken = _with_copies(rows, rated, settings.seed).where("copies > 0")
    if settings.max_rate is None or settings.max_rate > 1:
        taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("doc.*")
