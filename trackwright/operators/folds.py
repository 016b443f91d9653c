"""Sequential folds of a video's rows without a task that sees the whole video.

A fold's rows are dealt by video and block of frames. Each block is summed up as a function from the state before it to the state
behind it, as a small table: only states that can differ there have a row. The functions are put together in order over one row for each
block, which gives every block the state before it, and then each block runs its own rows once. So a video of any length is as many
tasks as it has blocks, and what meets in one place is a row for each block of 4,096 frames.

Most videos are short, so a task holds many blocks: it reads them sorted, one after the other, from Arrow batches. A block costs what its rows
cost, and no call of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import CHUNK, KEY, chunk_of


def entered(blocks: DataFrame, start: int, behind: Callable[[Column, Column], Column]) -> DataFrame:
    """KEY, part and state: the state before each block. blocks: KEY, part and what behind needs; behind gives the state behind a block
    from the state before it and the block's row."""
    in_order = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("part", *(c for c in blocks.columns if c not in (KEY, "part"))))).alias("blocks"))
    first = F.struct(F.lit(start).cast("long").alias("state"), F.array().cast("array<bigint>").alias("before"))
    step = lambda acc, b: F.struct(behind(acc["state"], b).cast("long").alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before"))
    states = F.aggregate("blocks", first, step, lambda acc: acc["before"])
    return in_order.select(KEY, F.explode(F.arrays_zip(F.col("blocks.part").alias("part"), states.alias("state"))).alias("x")).select(KEY, "x.*")


def each_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """KEY, part and the other columns as lists, in order, of each block of sorted batches. A block may go on in the next batch."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        keys, parts = batch[KEY].to_numpy(), batch["part"].to_numpy()
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1)
        columns = [batch[c].tolist() for c in batch.columns if c not in (KEY, "part")]
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield keys[i], int(parts[i]), *(c[i:j] for c in columns)
        held = batch.iloc[int(starts[-1]) :]
    if held is not None:
        yield held[KEY].iloc[0], int(held["part"].iloc[0]), *(held[c].tolist() for c in held.columns if c not in (KEY, "part"))


def by_block(rows: DataFrame, order: str, run: Callable[..., list[tuple]], schema: str, many: int = 10_000) -> DataFrame:
    """What run gives for each block of rows (KEY, part and more columns, which run takes as lists in order of order)."""
    names = [field.split()[0] for field in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for block in each_block(batches):
            out += run(*block)
            if len(out) >= many:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=names, dtype=object)

    columns = [KEY, "part", *(c for c in rows.columns if c not in (KEY, "part"))]
    return rows.where(F.col(KEY).isNotNull()).select(*columns).repartition(KEY, "part").sortWithinPartitions(KEY, "part", order).mapInPandas(task, schema)


def kept_chain(rows: DataFrame, at: str, until: str, gap: int, chunk: int = CHUNK) -> DataFrame:
    """Rows kept one after the other: the next one whose at is more than gap past the last kept one's until, 0 before the first.

    Rows of a video must not overlap: at <= until < the next row's at. Then a row that can be the first kept one of a block lies within gap of
    the block's first row, or is the first beyond, and the block's table has no more rows than that.
    """
    kind = rows.schema[KEY].dataType.simpleString()

    def summary(key: object, part: int, a: list[int], u: list[int]) -> list[tuple]:
        following = [bisect_right(a, x + gap) for x in u]
        exits = list(u)
        for i in range(len(a) - 1, -1, -1):
            if following[i] < len(a):
                exits[i] = exits[following[i]]
        n = bisect_right(a, a[0] + gap) + 1
        return [(key, part, [{"at": x, "behind": y} for x, y in zip(a[:n], exits[:n], strict=True)])]

    def run(key: object, part: int, a: list[int], u: list[int], state: list[int]) -> list[tuple]:
        kept, i = [], bisect_right(a, state[0] + gap)
        while i < len(a):
            kept.append((key, a[i]))
            i = bisect_right(a, u[i] + gap)
        return kept

    slim = rows.select(KEY, chunk_of(F.col(at), chunk).alias("part"), F.col(at).cast("long").alias("__at"), F.col(until).cast("long").alias("__until"))
    blocks = by_block(slim, "__at", summary, f"{KEY} {kind}, part bigint, firsts array<struct<at:bigint,behind:bigint>>")
    states = entered(blocks, 0, lambda s, b: F.coalesce(F.get(F.filter(b["firsts"], lambda f: f["at"] > s + gap), F.lit(0))["behind"], s))
    kept = by_block(slim.join(states, [KEY, "part"]), "__at", run, f"{KEY} {kind}, {at} bigint")
    return rows.join(kept, [KEY, at], "left_semi")


def gap_sections(lengths: DataFrame, allowed: int, chunk: int = CHUNK) -> DataFrame:
    """KEY, start, end (null if still open at the video's end) of sections over runs (KEY, value: empty, first, n).

    A section begins with a run that isn't empty, and ends where the empty frames since its beginning, all together, are more than allowed.
    The state is the number of empty frames of an open section, or -1.
    """
    kind = lengths.schema[KEY].dataType.simpleString()
    parts = lengths.select(KEY, chunk_of(F.col("first"), chunk).alias("part"), "value", F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n"))

    def after(state: int, empty: bool, n: int) -> int:
        if not empty:
            return max(state, 0)
        return -1 if state < 0 or state + n > allowed else state + n

    def summary(key: object, part: int, value: list[bool], first: list[int], n: list[int]) -> list[tuple]:
        # States that have become one stay one.
        now = {s: s for s in range(-1, allowed + 1)}
        alive = set(now.values())
        for i, (empty, k) in enumerate(zip(value, n, strict=True)):
            if len(alive) == 1:
                state = alive.pop()
                for empty, k in zip(value[i:], n[i:], strict=True):
                    state = after(state, empty, k)
                now = dict.fromkeys(now, state)
                break
            then = {s: after(s, empty, k) for s in alive}
            if any(s != t for s, t in then.items()):
                now = {s: then[t] for s, t in now.items()}
            alive = set(then.values())
        return [(key, part, [now[s] for s in range(-1, allowed + 1)])]

    def run(key: object, part: int, value: list[bool], first: list[int], n: list[int], before: list[int]) -> list[tuple]:
        """Sections from start to end; one that is open where the block begins has no start, one that is open where it ends no end."""
        state, start, out = before[0], None, []
        for empty, at, k in zip(value, first, n, strict=True):
            then = after(state, empty, k)
            if state < 0 <= then:
                start = at
            elif then < 0 <= state:
                out.append((key, part, start, at + allowed - state))
                start = None
            state = then
        return out if start is None else [*out, (key, part, start, None)]

    blocks = by_block(parts, "first", summary, f"{KEY} {kind}, part bigint, behind array<bigint>")
    states = entered(blocks, -1, lambda s, b: F.get(b["behind"], (s + 1).cast("int")))
    turns = by_block(parts.join(states, [KEY, "part"]), "first", run, f"{KEY} {kind}, part bigint, start bigint, end bigint")
    # Sections over the ends of blocks are in two rows, one after the other among the video's loose ones, of which a block has two at most.
    loose = F.col("start").isNull() | F.col("end").isNull()
    following = Window.partitionBy(KEY, F.when(~loose, F.col("part"))).orderBy(F.coalesce("start", "end"))
    whole = turns.withColumn("end", F.coalesce("end", F.when(loose, F.lead("end").over(following))))
    return whole.where("start is not null").select(KEY, "start", "end")
