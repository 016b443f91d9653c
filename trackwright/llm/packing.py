"""Packing of tokenised documents into as few sequences of a set capacity as possible.

Documents are encoded once and cut into pieces of at most capacity tokens, which are written with their ids. How they go together
depends on the histogram of the pieces' lengths alone, which has capacity rows at most, whatever the corpus: a linear program
over configurations (how many pieces of each length fill one sequence) is solved by multiplicative weights. Each length has a price; a
bounded knapsack by dynamic programming finds, for every length, the dearest way to fill the sequence beside it; these
configurations get as much as the lengths' quotas of the round still ask for, and lengths that fell behind become dearer. What is
asked for is never exceeded, so rounding down gives whole sequences; what rounding leaves is solved again, and the small rest is
filled sequence by sequence, beginning with the longest piece and adding the pieces that fill it best.

Pieces of one length are alike, so a piece finds its place from its length and its number among them: the numbers run on from shard to
shard, and the plan says which of them go to which configuration. No group of pieces meets in one task.

Defined cases: null text counts as empty, and its document holds the end id alone (no piece at all without an end id). Null and
repeated ids are documents of their own. A document longer than the capacity is cut, no other. An empty table gives an empty result.
Columns other than the named ones are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .token_store import PAGE, PAGE_ROWS, ROW_GROUP, encoder
from .units import slices

#: Rounds of multiplicative weights, rounds before them that set prices only, times that what rounding left is solved again, and how fast prices move.
ROUNDS, WARM_UP, LEVELS, RATE = 6, 4, 3, 0.1
#: Bytes of text handled at once: of more text, more words come again.
AT_ONCE = 4_000_000
#: A rest of fewer sequences than this is filled one by one.
SMALL = 256


def _fillings(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> list[dict[int, int] | None]:
    """For each size the dearest filling that holds it once more than the knapsack's choice beside it: {place of size: how many}."""
    items = []  # each size as lots of 1, 2, 4, ... pieces
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        n, lot = min(n, capacity // size), 1
        while n > 0:
            items.append((i, min(lot, n)))
            n, lot = n - lot, 2 * lot
    best, tried = np.zeros(capacity + 1), np.empty(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for k, (i, lot) in enumerate(items):
        size = int(sizes[i]) * lot
        here, above = tried[size:], best[size:]
        np.add(best[: capacity + 1 - size], prices[i] * lot, out=here)
        np.greater(here, above, out=taken[k, size:])
        np.maximum(here, above, out=above)
    room = capacity - sizes
    found: list[dict[int, int] | None] = [{i: 1} for i in range(len(sizes))]
    for k in range(len(items) - 1, -1, -1):
        i, lot = items[k]
        chosen = taken[k, room]
        for j in np.flatnonzero(chosen).tolist():
            found[j][i] = found[j].get(i, 0) + lot
        room = room - chosen * (int(sizes[i]) * lot)
    return [f if f[i] <= counts[i] else None for i, f in enumerate(found)]


def _solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, warm_up: int, rate: float) -> dict[tuple[tuple[int, int], ...], float]:
    """How often each configuration is taken, so that no length is taken more often than counts say."""
    prices = sizes / capacity
    covered, times = np.zeros(len(sizes)), {}
    for t in range(1 - warm_up, rounds + 1):
        share = max(t, 1) / rounds
        if t <= 0:  # prices only
            covered, times = np.zeros(len(sizes)), {}
        missing = (counts * share - covered).tolist()
        fillings = _fillings(sizes, counts, prices, capacity)
        for i in range(len(sizes) - 1, -1, -1):  # long pieces have the fewest partners
            f = fillings[i]
            if f is None:
                continue
            amount = min(missing[j] / c for j, c in f.items())
            if amount > 1e-9:
                key = tuple(sorted(f.items()))
                times[key] = times.get(key, 0.0) + amount
                for j, c in f.items():
                    missing[j] -= amount * c
        covered = counts * share - np.array(missing)
        prices = prices * np.exp(rate * np.array(missing) * rounds / counts)
        prices /= prices.sum()
    return times


def _best_fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Of the given pieces those that fill room best, long ones first; sizes ascend."""
    lots, reach = [], [1]
    mask = (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        n, lot = min(counts[i], room // sizes[i]), 1
        while n > 0 and not reach[-1] >> room:
            lots.append((i, min(lot, n)))
            reach.append((reach[-1] | reach[-1] << sizes[i] * lots[-1][1]) & mask)
            n, lot = n - lot, 2 * lot
        if reach[-1] >> room:
            break
    at, chosen = reach[-1].bit_length() - 1, {}
    for k in range(len(lots) - 1, -1, -1):
        if not reach[k] >> at & 1:
            i, lot = lots[k]
            chosen[i] = chosen.get(i, 0) + lot
            at -= sizes[i] * lot
    return chosen


def _fills(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequence by sequence: the longest piece, and what fills the room beside it best."""
    left, out = dict(left), []
    while left:
        longest = max(left)
        left[longest] -= 1
        sizes = sorted(s for s in left if left[s])
        chosen = _best_fill(sizes, [left[s] for s in sizes], capacity - longest)
        left[longest] += 1
        config = Counter({longest: 1})
        for i, c in chosen.items():
            config[sizes[i]] += c
        times = max(1, min(left[s] // c for s, c in config.items()))
        out.append((times, sorted(config.items(), reverse=True)))
        left = {s: n for s, n in ((s, n - times * config.get(s, 0)) for s, n in left.items()) if n}
    return out


def _best_fits(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Piece by piece, long ones first, each where it leaves the least room."""
    room: list[tuple[int, int]] = []  # ascending (room, sequence)
    packed: list[Counter[int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            at = bisect_left(room, (size, 0))
            free, k = room.pop(at) if at < len(room) else (capacity, len(packed))
            if k == len(packed):
                packed.append(Counter())
            packed[k][size] += 1
            insort(room, (free - size, k))
    same = Counter(tuple(sorted(c.items(), reverse=True)) for c in packed)
    return [(times, list(config)) for config, times in same.items()]


def pack_lengths(
    histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, warm_up: int = WARM_UP, levels: int = LEVELS, rate: float = RATE
) -> list[tuple[int, list[tuple[int, int]]]]:
    """Configurations that take up the whole histogram (length: pieces): (sequences, [(length, pieces in each)])."""
    left = {size: n for size, n in sorted(histogram.items()) if n > 0}
    if any(not 0 < size <= capacity for size in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(config: dict[int, int], times: int) -> None:
        out.append((times, sorted(config.items(), reverse=True)))
        for size, c in config.items():
            left[size] -= times * c
            if not left[size]:
                del left[size]

    def fits(config: dict[int, int]) -> int:
        return min(left.get(size, 0) // c for size, c in config.items())

    for level in range(levels):
        volume = sum(size * n for size, n in left.items())
        if not left or (level and volume < SMALL * capacity):
            break
        sizes, counts = np.array(list(left), np.int64), np.array(list(left.values()), np.int64)
        solved = _solve(sizes, counts, capacity, rounds, warm_up, rate)
        configs = [({int(sizes[i]): c for i, c in key}, x) for key, x in solved.items()]
        for config, x in configs:
            if x >= 1:
                take(config, int(x))
        if sum(size * n for size, n in left.items()) > 0.9 * volume:
            break
    return out + min(_best_fits(left, capacity), _fills(left, capacity), key=lambda rest: sum(times for times, _ in rest))


@dataclass(frozen=True)
class Layout:
    """Where the pieces of each length go. Row: the pieces of one length of one configuration."""

    key: np.ndarray  # length and first number, ascending
    first: np.ndarray
    each: np.ndarray  # pieces in one sequence
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, configs: list[tuple[int, list[tuple[int, int]]]]) -> Layout:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for times, config in configs:
            offset = 0
            for size, c in config:
                rows.append((size, used.get(size, 0), c, sequence, offset))
                used[size] = used.get(size, 0) + times * c
                offset += size * c
            sequence += times
        size, first, each, seq, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        return cls(cls.code(size, first), first, each, seq, offset, sequence)

    @staticmethod
    def code(size: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (size << 44) | number  # 2^44 pieces of one length, lengths below 2^19

    def places(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and numbers."""
        row = np.searchsorted(self.key, self.code(size, number), side="right") - 1
        copy, place = np.divmod(number - self.first[row], self.each[row])
        return self.sequence[row] + copy, self.offset[row] + place * size


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """A written table of pieces: id, shard, piece, start, length, number (among the shard's pieces of its length), ids_crc32, ids."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("shard", T.IntegerType()), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("number", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(tokenizer_file), [0] * (capacity + 1)
        for part in slices(batches, "text", AT_ONCE):
            row, piece, size, number, crc, parts = [], [], [], [], [], []
            for r, ids in enumerate(own.encode([t or "" for t in part.column("text").to_pylist()])):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own_ids = ids[at : at + 4 * capacity]
                    n = len(own_ids) // 4
                    row.append(r), piece.append(p), size.append(n), number.append(seen[n]), crc.append(zlib.crc32(own_ids)), parts.append(own_ids)
                    seen[n] += 1
            of = pa.array(row, pa.int64())
            values = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(of), part.column("shard").take(of), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()),
                 pa.array(size, pa.int64()), pa.array(number, pa.int64()), pa.array(crc, pa.int64()), lists], schema.names,
            )

    texts = docs.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("shard"), F.col(text_col).cast("string").alias("text"))
    return materialise(texts.mapInArrow(run, schema), "pieces", **{
        "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
    })


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset and ids."""
    pieces = cut_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col)
    # A row for each shard and length: how many, and from them where the shard's numbers begin.
    by_shard = pieces.groupBy("shard", "length").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(by_shard.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity bounds the rows
    layout = Layout.of(pack_lengths(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = layout.places(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = pieces.join(starts.drop("n"), ["shard", "length"]).withColumn("at", place("length", F.col("number") + F.col("before")))
    return numbered.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of whole sequences; a group has as many tokens as the capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
