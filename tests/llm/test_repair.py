"""Conversation repair: the parser against plain search, the query against a plain restatement, blocks against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from oracle import SF

from trackwright.llm import repair as R
from trackwright.llm.queries import QUERIES
from trackwright.session import table


def search(rows, insertions):
    """The least (cost, audit) by trying everything; rows: letters as R.uses has them."""

    @cache
    def go(i, state, left):
        found = [(0, "")] if i == len(rows) and state in "NA" else []
        steps = [(2, "I", i, "A" if state == "U" else "U", left - 1)] if left else []
        if i < len(rows):
            steps.append((3, "D", i + 1, state, left))
            cut, role = int(rows[i].isupper()), rows[i].lower()
            if role != "x":
                due, then = ("a", "A") if state == "U" else ("u", "U")
                steps.append((2 + cut, "R", i + 1, then, left))
                if role == due:
                    steps.append((cut, "K", i + 1, then, left))
                if role == "s" and state == "N":
                    steps.append((cut, "K", i + 1, "S", left))
        for cost, letter, *rest in steps:
            tail = go(*rest)
            if tail:
                found.append((cost + tail[0], letter + tail[1]))
        return min(found, default=None)

    return go(0, "N", insertions)


def test_parser_against_search():
    for n in range(4):
        for rows in map("".join, itertools.product("suaoUAx", repeat=n)):
            assert R.best_repair(rows) == search(rows, n + 2), rows
    rnd = random.Random(1)
    for _ in range(150):
        rows = "".join(rnd.choices("suaoSUAx", k=rnd.randint(4, 12)))
        assert R.best_repair(rows) == search(rows, 14), rows


def test_edits_give_the_grammar():
    rnd = random.Random(2)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(100):
        rows = "".join(rnd.choices("suaoUx", k=rnd.randint(0, 20)))
        cost, audit = R.best_repair(rows)
        out = R.apply_edits([(roles.get(c.lower(), "x"), str(i)) for i, c in enumerate(rows)], audit, "Nothing")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
        prices = {"K": 0, "R": 2, "D": 3, "I": 2}
        at = iter(rows)
        assert cost == sum(prices[x] + (x in "KR" and c.isupper()) for x in audit for c in ["" if x == "I" else next(at)])


def restated(rows):
    """rows: (conv_id, turn, role, text). The query's rows, conversation by conversation."""
    after, out = {}, {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = after.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            kept = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
            seen.add((role, text))
        letters = "".join("x" if f in ("blank", "duplicate") else (c.upper() if f else c) for (_, role, _), f in zip(own, faults, strict=True) for c in [role[:1] if role[:1] in ("s", "u", "a") else "o"])
        cost, audit = search(letters, len(letters) + 2)
        body = "\n".join(f"{r}:{t}" for r, t in R.apply_edits([(r, t) for _, r, t in own], audit, "Nothing"))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(body.encode()).hexdigest(),
        )
    return out


def got(frame):
    rows = frame.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_restatement(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    assert got(QUERIES["op12_repair"](spark, SF)) == restated(rows)


def made(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why?  ", "é。", "x" * 300]
    return [(rnd.choice([1, 1, 2, 3, None]), rnd.choice([None, *range(8)]), rnd.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), rnd.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("rows", [[], [(9, 1, "user", None)], made(1, 40), made(2, 90)])
def test_nulls_ties_and_repeated_rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cost", "'a' as audit", "2 as block", "'x' as fault", "0 as copy", "1 as shard")
    assert got(R.repair_report(frame, R.damage(frame))) == restated(rows)


def test_blocks_give_what_whole_conversations_give(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(1, i, rnd.choice(["user", "assistant", "assistant", "user", "system"]), rnd.choice(["Fine.", f"Number {i}.", "cut", ""])) for i in range(120)] + made(3, 60)
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(R.repair_report(frame, R.damage(frame))) == restated(rows)


def test_conversations_without_rows(spark):
    ids = [i for i in range(300) if zlib.crc32(f"{i}:1".encode()) % 20 == 0][:3]
    frame = spark.createDataFrame([(i, 1, "user", "Hello.") for i in ids], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(R.repair_report(frame, R.damage(frame))) == {i: (0, 0, 0, 0, 0, 0, "", nothing) for i in ids}


def test_long_text(spark):
    frame = spark.createDataFrame([(1, 1, "user", "word " * 600_000 + "end."), (1, 2, "assistant", "Yes.")], SCHEMA)
    assert got(R.repair_report(frame, frame)) == {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(("user:" + "word " * 600_000 + "end.\nassistant:Yes.").encode()).hexdigest())}
