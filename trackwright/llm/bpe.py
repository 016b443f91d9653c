"""Byte-level BPE encoding and decoding by a rank file.

A piece's byte positions are the leaves of a segment tree. Leaf i holds the rank of the pair that starts at live position i,
and every inner node the least (rank, position) below it, so the root is the leftmost pair of minimum rank. Merging that pair
ends one position, and changes the pairs of at most three live neighbours: three point updates, each logarithmic. Trees of
equal size are kept in one array and take their merges together; long pieces have a tree each.

Defined cases: null text counts as empty and has no ids. Texts of any length are encoded whole. Repeated rows and null ids
are encoded like any other. An empty table gives an empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .units import Cache, encode_texts, slices, with_space

NONE = np.int64(1) << 62
#: Bits for the position below the rank; longest piece whose tree shares an array; cells of such an array.
POS_BITS, SHARED, CELLS = 32, 256, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Ranks:
    """A rank file: bytes and rank on each line. The rank is the token's id."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {
            (left << 32) | right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        # An open-addressing table for whole arrays.
        self.bits = max(4, len(pairs).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        todo, ranks = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, self.probes = self._slot(todo), 0
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = todo[won], ranks[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, ranks, slot = todo[rest], ranks[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same pairs as a dict; only long pieces need it."""
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they do not merge or a side is below 0."""
        key = (left << 32) | right
        slot, out = self._slot(key), np.full(len(key), NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            at = slot[open_]
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _leaf(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        rank = self.of(left, right)
        return np.where(rank == NONE, NONE, (rank << POS_BITS) | pos)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most width bytes; width is a power of two."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        token = np.where(column < length[:, None], self.single[raw], -1)
        # One more column each, so that "no neighbour" can be read and written like any position.
        token = np.concatenate([token, np.full((n, 1), -1)], axis=1)
        after = np.minimum(np.broadcast_to(np.arange(1, width + 2), (n, width + 1)), width).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self._leaf(token[:, :-1].ravel(), token[:, 1:].ravel(), np.tile(column, n)).reshape(n, width)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            top = tree[row, 1]
            at, merged = top & ((1 << POS_BITS) - 1), top >> POS_BITS
            dead = after[row, at]
            behind, ahead = before[row, at], after[row, dead]
            token[row, at], token[row, dead] = merged, -1
            after[row, at], before[row, ahead] = ahead, at
            token[row, width] = -1
            tree[row, width + dead] = NONE
            tree[row, width + at] = self._leaf(merged, token[row, ahead], at)
            has = np.flatnonzero(behind < width)
            r, b = row[has], behind[has]
            tree[r, width + b] = self._leaf(token[r, b], merged[has], b)
            for rows, pos in ((row, dead), (row, at), (r, b)):
                node = (width + pos) >> 1
                while len(node) and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NONE]
        live = token[:, :width] >= 0
        ids, ends = token[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same for one long piece."""
        n, pairs = len(piece), self.pairs
        width = 1 << (n - 1).bit_length()
        none = int(NONE)
        token = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(left: int, right: int, pos: int) -> int:
            rank = pairs.get((left << 32) | right, -1)
            return none if rank < 0 else (rank << POS_BITS) | pos

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(token[i], token[i + 1], i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(pos: int, value: int) -> None:
            node = width + pos
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while (top := tree[1]) != none:
            at, merged = top & ((1 << POS_BITS) - 1), top >> POS_BITS
            dead = after[at]
            ahead, behind = after[dead], before[at]
            token[at], token[dead], after[at] = merged, -1, ahead
            put(dead, none)
            put(at, leaf(merged, token[ahead], at) if ahead < n else none)
            if ahead < n:
                before[ahead] = at
            if behind >= 0:
                put(behind, leaf(token[behind], merged, behind))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Piece -> ids, each piece by itself."""
        out, by_width = {}, {}
        for p in set(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > SHARED:
                out[p] = self.merge_one(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
        for width, some in by_width.items():
            step = max(1, CELLS // (2 * width))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                out.update(zip(part, self.merge_many(part, width), strict=True))
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = ranks(path), regex.compile(pattern)
        self.units = Cache(self._by_pieces)

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.pattern.findall(t)] for t in texts]
        known = self.ranks.encode_pieces([p for pieces in cut for p in pieces])
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_texts(texts, with_space, self.units, self._by_pieces)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


@cache
def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id; all that decoding needs."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker: its cache serves all tasks that the worker runs."""
    return Encoder(path, pattern)


def _decoded(ids: list[bytes | None], rank_file: str) -> list[bytes]:
    token = vocabulary(rank_file).__getitem__
    return [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit integers) and n_tokens of every row.

    decode adds decoded, the bytes that the ids stand for, from the same pass over the texts.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        *([T.StructField("decoded", T.BinaryType())] if decode else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for part in slices(batches, "text"):
            ids = own.encode([t or "" for t in part.column("text").to_pylist()])
            back = [pa.array(_decoded(ids, rank_file), pa.binary())] if decode else []
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *back], schema.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """encoded with one more column decoded (binary), the bytes that its ids stand for."""
    if "decoded" in encoded.columns:
        encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ids_col):
            out = pa.array(_decoded(part.column(ids_col).to_pylist(), rank_file), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
