"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk; their largest
answers (max-pooling, then ReLU) describe the chunk. The mean, largest and smallest description over all chunks enter one
logistic unit, which gives the probability of label 1.

The network is trained by Adam on the driver, from the whole texts of at most max_rows labelled documents (smallest hashes of
their ids first), which bounds what reaches the driver. Scoring reads whole texts in tasks.

Defined cases: null text counts as empty, and an empty text is one chunk of padding, so it has a score too. Texts of any length
are scored whole. Repeated rows are scored alike, and null ids like any other. Without labels every score is 0.5. An empty table
gives an empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import slices


@dataclass(frozen=True)
class Shape:
    filters: int = 32
    width: int = 5
    #: Chunks are two blocks long and start at every block.
    block: int = 128
    max_rows: int = 2000
    #: Steps of Adam, whatever the number of documents: few documents are seen more often.
    steps: int = 500
    batch: int = 32
    rate: float = 0.01
    seed: int = 3


#: Positions whose answers are held at once.
_TILE = 1 << 17


@dataclass
class Network:
    shape: Shape
    table: np.ndarray  # width x 256 x filters: what each byte adds to each filter's answer, by place in the window
    bias: np.ndarray
    weights: np.ndarray  # 3 * filters
    offset: float

    @classmethod
    def fresh(cls, shape: Shape) -> Network:
        rng = np.random.default_rng(shape.seed)
        table = rng.normal(0, 0.3, (shape.width, 256, shape.filters)).astype(np.float32)
        return cls(shape, table, np.zeros(shape.filters, np.float32), np.zeros(3 * shape.filters, np.float32), 0.0)

    def answers(self, windows_of: np.ndarray, n: int) -> np.ndarray:
        """The filters' answers at the first n positions of the last axis; it has width - 1 more bytes."""
        out = np.take(self.table[0], windows_of[..., :n], axis=0)
        for j in range(1, self.shape.width):
            out += np.take(self.table[j], windows_of[..., j : j + n], axis=0)
        return out + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts."""
        pad, size = b"\0" * (self.shape.width - 1), self.shape.block
        texts = [t or b"\0" for t in texts]
        data = np.frombuffer(pad.join(texts) + pad, np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(length + len(pad))[:-1]])
        blocks = -(-length // size)
        text_of = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[text_of] + place * size
        end = np.minimum(start + size, first[text_of] + length[text_of])
        top = np.empty((len(start), self.shape.filters), np.float32)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + _TILE)))
            a, b = start[i], end[j - 1]
            answers = self.answers(data[a : b + len(pad)], b - a)
            # Padding between texts is a segment of its own, which is left out.
            cuts = np.stack([start[i:j], end[i:j]], axis=1).ravel() - a
            keep = np.arange(0, len(cuts), 2)
            cuts, back = np.unique(np.minimum(cuts, b - a - 1), return_inverse=True)
            top[i:j] = np.maximum.reduceat(answers, cuts, axis=0)[back[keep]]
            i = j
        # A chunk is a block and the next one of the same text; a text of one block is one chunk.
        has_next = np.concatenate([text_of[1:] == text_of[:-1], [False]])
        chunk = np.flatnonzero(has_next | (blocks[text_of] == 1))
        seen = np.maximum(top[chunk], top[np.minimum(chunk + has_next[chunk], len(top) - 1)])
        return self._combine(np.maximum(seen, 0), np.flatnonzero(np.diff(text_of[chunk], prepend=-1)))[0]

    def _combine(self, seen: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability and description of texts whose chunks' descriptions begin at firsts."""
        count = np.diff(firsts, append=len(seen))[:, None]
        described = np.concatenate(
            [np.add.reduceat(seen, firsts, axis=0) / count, np.maximum.reduceat(seen, firsts, axis=0), np.minimum.reduceat(seen, firsts, axis=0)], axis=1
        )
        return 1 / (1 + np.exp(-np.clip(described @ self.weights + self.offset, -30, 30))), described

    def _tops(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters' largest answers in each block (n x bytes, with the bytes behind it) and where they are; size: positions that are text."""
        n = self.shape.block
        top = np.empty((len(data), self.shape.filters), np.float32)
        where = np.empty(top.shape, np.int64)
        for i in range(0, len(data), _TILE // n):
            part, left = data[i : i + _TILE // n], size[i : i + _TILE // n]
            answers = self.answers(part, n)
            short = np.flatnonzero(left < n)
            answers[short] = np.where(np.arange(n)[None, :, None] < left[short, None, None], answers[short], -np.inf)
            where[i : i + len(part)] = at = answers.argmax(axis=1)
            top[i : i + len(part)] = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0]
        return top, where

    def train(self, texts: list[bytes], labels: np.ndarray) -> None:
        s, rng = self.shape, np.random.default_rng(self.shape.seed + 1)
        rate = float(np.clip(labels.mean(), 0.01, 0.99))
        self.offset = float(np.log(rate / (1 - rate)))
        params = {"table": self.table, "bias": self.bias, "weights": self.weights, "offset": np.array([self.offset], np.float32)}
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
        step, f = 0, s.filters
        epochs = max(1, -(-s.steps * s.batch // len(texts)))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), s.batch):
                some = order[at : at + s.batch]
                cuts = [blocks(texts[i], s) for i in some]
                data, size = np.concatenate([c for c, _ in cuts]), np.concatenate([z for _, z in cuts])
                top, where = self._tops(data, size)
                # A chunk is a block and the next one of the same text; a text of one block is one chunk.
                count = np.array([len(z) for _, z in cuts])
                text_of = np.repeat(np.arange(len(some)), count)
                has_next = np.concatenate([text_of[1:] == text_of[:-1], [False]])
                chunk = np.flatnonzero(has_next | (count[text_of] == 1))
                following = chunk + has_next[chunk]
                block = np.where(top[following] > top[chunk], following[:, None], chunk[:, None])
                column = np.arange(f)[None, :]
                raw = top[block, column]
                seen, text_of = np.maximum(raw, 0), text_of[chunk]
                counts = np.maximum(count - 1, 1)
                p, described = self._combine(seen, np.cumsum(counts) - counts)
                error = ((p - labels[some]) / len(some)).astype(np.float32)
                w_mean, w_max, w_min = self.weights.reshape(3, f)
                is_max = seen == described[text_of, f : 2 * f]
                is_min = seen == described[text_of, 2 * f :]
                back = error[text_of][:, None] * (w_mean / counts[text_of][:, None] + w_max * is_max + w_min * is_min) * (raw > 0)
                grads = {"weights": described.T @ error, "offset": np.array([error.sum()]), "bias": back.sum(axis=0)}
                grads["weights"] = grads["weights"] + 1e-4 * self.weights
                table = np.empty_like(self.table)
                for j in range(s.width):
                    byte = data[block, where[block, column] + j].astype(np.int64)
                    table[j] = np.bincount((byte * f + column).ravel(), back.ravel(), 256 * f).reshape(256, f)
                grads["table"] = table
                step += 1
                pace = s.rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    params[k] -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                self.offset = float(params["offset"][0])


def blocks(text: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of text with the bytes behind them (zeros after its end), and how many positions of each are text."""
    text, size = text or b"\0", shape.block
    n = -(-len(text) // size)
    padded = np.frombuffer(text.ljust(n * size + shape.width - 1, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, size + shape.width - 1)[::size], np.minimum(size, len(text) - size * np.arange(n))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shape: Shape = Shape()) -> Network | None:
    """Train on the documents of labelled (id, label 0 or 1); None without any. An id with several labels has the smallest."""
    ids = (
        labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(shape.max_rows)
    )

    # max_rows bounds the broadcast, and the rows that the driver gets.
    texts = docs.join(F.broadcast(ids), docs[id_col] == ids["__id"]).dropDuplicates(["__id"])
    rows = texts.select("label", F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text")).toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["text"], r["label"]))
    net = Network.fresh(shape)
    net.train([r["text"] for r in rows], np.array([r["label"] for r in rows]))
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            scores = np.full(len(texts), 0.5) if net is None else net.probabilities(texts)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores.astype(np.float64))], schema.names)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
