"""Repair of conversations by error-correcting parsing of their roles.

A weighted grammar describes roles in order (one system row at most, then pairs of user and assistant) and what may be done about
errors: a row may be deleted, a row may take another role, and a row without text may be put in. An Earley parser fills a chart whose
items keep the least (cost, audit) of their span, the audit being the edits' initials in order; of equal cost the audit that is least in
ASCII wins. Audits of one span and one cost are never each other's prefix (a further insertion costs), so the least whole is
made of least parts, and a part's best audit needs no look at its neighbours.

The grammar is left-linear: all that a parser must know between two rows is the nonterminal reached. So long conversations are cut into
blocks of rows; each block is parsed once from every nonterminal that may stand before it, and the blocks' tables are put together in
order, as charts are, by least (cost, audit). Blocks have a bounded number of rows and bytes, whatever a conversation holds; only
its audit, which is one value of the result, and a running hash pass through one task.

Defined cases: a null role or text counts as one space, and so does a null id or turn where rows are hashed; rows with a null turn come
first, rows of one turn by role, then the text's first 64 characters, then its hash, and a row that comes again is a duplicate. Conversations with a null id are one
conversation. No rows give zeros and empty strings. Columns other than the named ones are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise
from .text import SPACE

#: Rows and bytes of text in a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20

Best = tuple[int, str]  # cost and audit


@dataclass(frozen=True)
class Production:
    """left -> right at a cost. A terminal in right is a kind of use of one row; the audit gets the letter."""

    left: str
    right: tuple[str, ...]
    cost: int = 0
    letter: str = ""


#: Nonterminals: what stands before a place. Nothing; a system row; a user row that waits; a whole pair.
STATES = ("Nothing", "System", "Asked", "Answered")
#: Terminals: rows kept as system, user or assistant, a row with a new role, a deleted row.
TERMINALS = frozenset("suarx")
GRAMMAR = (
    Production("System", ("Nothing", "Opening")),
    *(Production("Asked", (before, "User")) for before in ("Nothing", "System", "Answered")),
    Production("Answered", ("Asked", "Assistant")),
    *(Production(state, (state, "Gone")) for state in STATES),
    Production("Opening", ("s",), 0, "K"),
    *(Production(role, (kept,), 0, "K") for role, kept in (("User", "u"), ("Assistant", "a"))),
    *(Production(role, ("r",), 2, "R") for role in ("User", "Assistant")),
    *(Production(role, (), 2, "I") for role in ("User", "Assistant")),
    Production("Gone", ("x",), 3, "D"),
)
#: States in which a conversation may end.
FINAL = ("Nothing", "Answered")


def uses(row: str) -> dict[str, int]:
    """Terminals that a row can be, with what they cost beside the grammar. A row is one letter: x must be deleted, else the role's
    initial (o: another), as a capital if the text breaks off."""
    if row == "x":
        return {"x": 0}
    cut = int(row.isupper())
    kept = {row.lower(): cut} if row.lower() in "sua" else {}
    return {"x": 0, "r": cut} | kept


def parse(rows: str, entry: str) -> dict[str, Best]:
    """The best (cost, audit) of every state that can be reached behind the rows from the state entry. Short ones often come again."""
    return _parse_short(rows, entry) if len(rows) <= 32 else _parse(rows, entry)


def _parse(rows: str, entry: str) -> dict[str, Best]:
    """Earley's chart of the rows."""
    by_left: dict[str, list[int]] = {}
    for k, p in enumerate(GRAMMAR):
        by_left.setdefault(p.left, []).append(k)
    # The entry is a completed item of no rows; what is predicted at 0 are the states it can grow into.
    charts: dict[int, dict[tuple[int, int, int], Best]] = {0: {}}
    done: dict[tuple[str, int], Best] = {}
    for at in range(len(rows) + 1):
        chart, terminals = charts[at], uses(rows[at]) if at < len(rows) else {}
        done, following = {}, {}
        work: list[tuple[int, int, int]] = list(chart)
        waiting: dict[tuple[str, int], list[tuple[int, int, int]]] = {}

        def put(item: tuple[int, int, int], value: Best) -> None:
            if item not in chart or value < chart[item]:
                chart[item] = value
                work.append(item)

        def complete(left: str, origin: int, value: Best) -> None:
            if (left, origin) in done and done[left, origin] <= value:
                return
            done[left, origin] = value
            behind = charts[origin].items() if origin != at else [(i, chart[i]) for i in waiting.get((left, at), ())]
            for (k, dot, start), before in list(behind):
                if dot < len(GRAMMAR[k].right) and GRAMMAR[k].right[dot] == left:
                    put((k, dot + 1, start), (before[0] + value[0], before[1] + value[1]))

        if at == 0:
            for k, p in enumerate(GRAMMAR):
                if p.left in STATES:
                    put((k, 0, 0), (0, ""))
            for k, dot, start in list(chart):
                waiting.setdefault((GRAMMAR[k].right[dot], start), []).append((k, dot, start))
            complete(entry, 0, (0, ""))
        while work:
            item = work.pop()
            k, dot, start = item
            p, value = GRAMMAR[k], chart[item]
            if dot == len(p.right):
                complete(p.left, start, (value[0] + p.cost, value[1] + p.letter))
                continue
            wanted = p.right[dot]
            if wanted in TERMINALS:
                if wanted in terminals:
                    key, new = (k, dot + 1, start), (value[0] + terminals[wanted], value[1])
                    if key not in following or new < following[key]:
                        following[key] = new
                continue
            if wanted in STATES:  # stands first in its production, and only at 0
                continue
            here = waiting.setdefault((wanted, at), [])
            if item not in here:
                here.append(item)
                for j in by_left[wanted]:
                    put((j, 0, at), (0, ""))
            if (wanted, at) in done:
                empty = done[wanted, at]
                put((k, dot + 1, start), (value[0] + empty[0], value[1] + empty[1]))
        charts = {o: charts[o] for o in {i[2] for i in following} | {0} if o in charts}
        charts[at] = chart
        if at < len(rows):
            charts[at + 1] = following
    return {state: value for (state, origin), value in done.items() if origin == 0 and state in STATES}


_parse_short = lru_cache(maxsize=1 << 15)(_parse)


def best_repair(rows: str) -> Best:
    """The cheapest edits of a whole conversation."""
    ends = parse(rows, "Nothing")
    return min(ends[s] for s in FINAL if s in ends)


def apply_edits(rows: list[tuple[str, str]], audit: str, state: str) -> list[tuple[str, str]]:
    """The (role, text) rows after the audit's edits, from the state before them."""
    out, at = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        due = "assistant" if state == "Asked" else "user"
        opening = letter == "K" and state == "Nothing" and role[:1] == "s"
        state = "System" if opening else {"user": "Asked", "assistant": "Answered"}[due]
        out.append((role if letter == "K" else due, text))
    return out


def next_state(rows: str, audit: str, state: str) -> str:
    """The state behind the rows."""
    at = iter(rows)
    for letter in audit:
        row = "" if letter == "I" else next(at)
        if letter != "D":
            opening = letter == "K" and state == "Nothing" and row.lower() == "s"
            state = "System" if opening else "Answered" if state == "Asked" else "Asked"
    return state


def damage(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left after damage drawn by crc32 of id and turn: 0 drops a row, 1 empties its
    text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(name) % kinds).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _last_word_ends(text: Column) -> Column:
    return F.rlike(F.regexp_replace(text, SPACE + "+$", ""), F.lit(r"[.!?]$"))


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (from 0 among equal rows) and fault: blank, duplicate, truncated or null, the first that holds."""
    # Rows that are wholly alike are counted before they are dealt out, so a row that comes again and again is no hot group.
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    earliest = alike.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("turns"))
    earliest = earliest.where("turns > 1").select(*(F.col(c).alias(f"e_{c}") for c in ("conv_id", "role", "text")), "first")
    same = F.col("conv_id").eqNullSafe(F.col("e_conv_id")) & (F.col("role") == F.col("e_role")) & (F.col("text") == F.col("e_text"))
    found = alike.join(earliest, same, "left")
    later = F.coalesce(F.col("first") != F.struct(F.col("turn").isNotNull(), "turn"), F.lit(False))
    each = found.select("conv_id", "turn", "role", "text", later.alias("later"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"))
    fault = (
        F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), "blank").when(F.col("later") | (F.col("copy") > 0), "duplicate")
        .when(~_last_word_ends(F.col("text")), "truncated")
    )
    return each.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


_TABLES = T.ArrayType(T.StructType([T.StructField("state", T.StringType()), T.StructField("end", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_ROWS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _blocks(rows: DataFrame) -> DataFrame:
    """A written table of blocks: conv_id, shard, block, letters (a row each), turns, least and greatest turn, fault counts, rows."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("letters", T.StringType()),
        T.StructField("initials", T.ArrayType(T.StringType())), T.StructField("low", rows.schema["turn"].dataType), T.StructField("high", rows.schema["turn"].dataType),
        T.StructField("turns", T.LongType()), T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()),
        T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("tables", _TABLES), T.StructField("rows", _ROWS),
    ])
    # Ranges of the whole order, so that a long conversation is dealt over tasks.
    order = ["conv_id", F.col("turn").isNotNull(), "turn", "role", F.substring("text", 1, 64), F.md5("text"), "copy"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("shard", F.spark_partition_id())

    table_type = to_arrow_schema(schema).field("tables").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            letters = "".join("x" if f in ("blank", "duplicate") else (lambda c: c.upper() if f == "truncated" else c)(r[0] if r[:1] in ("s", "u", "a") else "o") for _, r, _, f in held)
            initials = [r[:1] for _, r, _, _ in held]
            turns = sorted({t for t, _, _, _ in held if t is not None})
            faults = [f for _, _, _, f in held]
            # A block that other blocks of its conversation may precede is parsed from every state, here and not where blocks meet.
            entries = STATES if block or not flushed else ()
            tables = [{"state": s, "end": e, "cost": c, "audit": x} for s in entries for e, (c, x) in parse(letters, s).items()]
            return pa.RecordBatch.from_arrays([
                pa.array([conv], ids), pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([letters]),
                pa.array([[initials[0], initials[-1]]]), *(pa.array([t], turn_type) for t in ((turns[0], turns[-1]) if turns else (None, None))),
                *(pa.array([n], pa.int64()) for n in (len(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal(initials))),
                pa.array([tables], table_type), pa.array([[{"role": r, "text": t} for _, r, t, _ in held]], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
            ], schema.names)

        conv, held, size, block, flushed = None, [], 0, 0, 0
        for batch in batches:
            ids, turn_type = batch.column("conv_id").type, batch.column("turn").type
            shard = batch.column("shard")[0].as_py() if batch.num_rows else 0
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                turn_ends = not held or held[-1][0] != row[0]  # a turn stays in one block, unless it alone is too large
                if held and (own != conv or (len(held) >= BLOCK_ROWS or size > BLOCK_BYTES) and (turn_ends or len(held) >= 2 * BLOCK_ROWS or size > 2 * BLOCK_BYTES)):
                    yield flush()
                    flushed += own != conv
                    block = block + 1 if own == conv else 0
                    held, size = [], 0
                conv = own
                held.append(tuple(row))
                size += len(row[2])
        if held:
            yield flush()

    return materialise(ordered.mapInArrow(run, schema), "conversation-blocks")


#: Initials that may follow each other.
LEGAL = ("su", "ua", "au")


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames. A row for each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. And the
    repaired rows by block: conv_id, shard, block (these two in order), rows (array of role and text) and body (their lines)."""
    blocks = _blocks(faulted(conversations.select("conv_id", "turn", "role", "text")))
    kind, turn = blocks.schema["conv_id"].dataType, blocks.schema["low"].dataType
    summary = T.StructType([
        T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        T.StructField("audit", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("state", T.StringType()), T.StructField("edits", T.StringType())]))),
    ])

    def whole(own: list[dict]) -> dict:
        """One conversation, given its blocks in order, without their rows."""
        # For each state: least (cost, audit), and the edits of each block on the way.
        reached: dict[str, tuple[Best, tuple]] = {"Nothing": ((0, ""), ())}
        for b in own:
            new: dict[str, tuple[Best, tuple]] = {}
            known: dict[str, dict[str, Best]] = {}
            for t in b["tables"]:
                known.setdefault(t["state"], {})[t["end"]] = (t["cost"], t["audit"])
            for state, (so_far, way) in reached.items():
                for end, (cost, audit) in (known.get(state) or parse(b["letters"], state)).items():
                    value = (so_far[0] + cost, so_far[1] + audit)
                    if end not in new or value < new[end][0]:
                        new[end] = (value, (way, (state, audit)))
            reached = new
        (cost, audit), way = min((reached[s] for s in FINAL if s in reached), key=lambda x: x[0])
        edits = []
        while way:
            way, step = way
            edits.append(step)
        lows, highs = [b["low"] for b in own if b["low"] is not None], [b["high"] for b in own if b["high"] is not None]
        turns = sum(b["turns"] for b in own) - sum(a == b for a, b in zip(highs, lows[1:], strict=False))
        return {
            "conv_id": own[0]["conv_id"], "gaps": max(highs) - min(lows) + 1 - turns if lows else 0, "cost": cost, "audit": audit,
            "illegal": sum(b["illegal"] for b in own) + _illegal_between(own), **{c: sum(b[c] for b in own) for c in ("blank", "duplicate", "truncated")},
            "parts": [{"shard": b["shard"], "block": b["block"], "state": s, "edits": e} for b, (s, e) in zip(own, reversed(edits), strict=True)],
        }

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        out: list[dict] = []
        for _, own in groupby(rows_of(), key=lambda b: b["conv_id"]):
            out.append(whole(list(own)))
            if len(out) >= 1000 or len(out[-1]["audit"]) > 100_000:
                yield pa.RecordBatch.from_pylist(out, schema=pa_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa_schema)

    pa_schema = to_arrow_schema(summary)
    in_order = blocks.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "shard", "block")
    found = materialise(in_order.mapInArrow(compose, summary), "conversation-repairs")

    repaired = T.StructType([T.StructField("conv_id", kind), T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("rows", _ROWS), T.StructField("body", T.StringType())])
    out_schema = to_arrow_schema(repaired)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                rows = apply_edits([(r["role"], r["text"]) for r in b["rows"]], b["edits"], b["state"])
                out.append({"conv_id": b["conv_id"], "shard": b["shard"], "block": b["block"], "rows": [{"role": r, "text": t} for r, t in rows], "body": "\n".join(f"{r}:{t}" for r, t in rows)})
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    # A shard and a block's number in it name a block only with the conversation.
    ways = found.select("conv_id", F.explode("parts").alias("p")).select(F.col("conv_id").alias("p_conv_id"), F.col("p.shard").alias("p_shard"), F.col("p.block").alias("p_block"), "p.state", "p.edits")
    met = (F.col("shard") == F.col("p_shard")) & (F.col("block") == F.col("p_block")) & F.col("conv_id").eqNullSafe(F.col("p_conv_id"))
    bodies = blocks.join(ways, met).select("conv_id", "shard", "block", "rows", "state", "edits").mapInArrow(edit, repaired)
    return found.drop("parts"), bodies


def _illegal_between(own: list[dict]) -> int:
    return sum(a["initials"][1] + b["initials"][0] not in LEGAL for a, b in zip(own, own[1:], strict=False))


def body_hashes(bodies: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of a conversation's repaired rows, read in order with a running hash: a task holds one block at a time."""
    schema = T.StructType([bodies.schema["conv_id"], T.StructField("sha256", T.StringType())])
    parts = bodies.where(F.size("rows") > 0).select("conv_id", "shard", "block", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, first = None, None, True
        for batch in batches:
            ids, sums = [], []
            for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if state is not None and conv != own:
                    ids.append(own), sums.append(state.hexdigest())
                    state = None
                if state is None:
                    own, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(body.encode())
            kind = batch.column("conv_id").type
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([state.hexdigest()], pa.string())], schema.names)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "shard", "block").mapInArrow(run, schema)


def repair_report(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conv_id of original: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged."""
    found, bodies = repair(damaged)
    hashes = body_hashes(bodies)
    ids = original.select("conv_id").distinct()
    by = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    found, hashes = found.withColumnRenamed("conv_id", "f_id"), hashes.withColumnRenamed("conv_id", "h_id")
    joined = ids.join(found, by("f_id"), "left").join(hashes, by("h_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))
